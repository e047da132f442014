"""Trees are flattened once, pages without a partner meet nothing, and wide views are dealt to tasks by rows."""

import json

from pyspark.sql import functions as F

from surfacegraph.operators import patterns, viewport
from surfacegraph.sources import trees


def test_trees_are_flattened_once(spark):
    read = spark.sparkContext.accumulator(0)
    child = {"role": "AXWindow", "title": "x", "frame": {"x": 500, "y": 300, "w": 400, "h": 200}}
    dumps = spark.createDataFrame([(f"w{i}", "app", json.dumps({"role": "AXGroup", "children": [child]})) for i in range(20)], "page_id string, url string, tree string")

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    nodes = trees.visual_nodes(trees.trees(dumps.mapInArrow(counted, dumps.schema), "macos"))
    found = patterns.patterns(nodes).collect()
    assert {(r["page_id"], r["primary_pattern"]) for r in found} == {(f"w{i}", "dialog-overlay") for i in range(20)}
    assert read.value == 20


def test_views_are_dealt_to_tasks_by_rows(spark):
    style = F.create_map(*[F.lit(x) for k in range(20) for x in (f"property-{k}", "the same value")])
    v = spark.range(3000).select(F.lit("p").alias("page_id"), F.concat(F.lit("a"), "id").alias("ax_id"), F.struct(*[F.lit(1.0).alias(k) for k in "xywh"]).alias("rect"), style.alias("style"), F.lit("visible").alias("visibility"))
    pairs = viewport.pair_up(v, v.where("ax_id <> 'a5'"), most=300)
    per = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) == 10 and max(per) < 450 and sum(per) == 2999
