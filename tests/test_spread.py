"""Stored rows spread over tasks, and what is found without sorting wide rows."""

from pyspark.sql import functions as F

from surfacegraph.plans import derive
from surfacegraph.plans.catalog import Catalog


def part_table(spark, path, n):
    rows = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("small nut").alias("p_name"), F.concat(F.lit("b"), F.col("id") % 3).alias("p_brand"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_a_file_of_one_split_is_read_by_several_tasks(spark, tmp_path):
    sf = part_table(spark, tmp_path, 3 * derive.SPREAD)
    v = derive.visual(spark, sf)
    per = [r["count"] for r in v.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) == 3 and max(per) < 1.2 * derive.SPREAD and sum(per) == 3 * derive.SPREAD
    assert v.agg(F.count_distinct("id")).first()[0] == 3 * derive.SPREAD


def test_primary_nodes_are_found_without_sorting_whole_rows(spark):
    rows = [("a", "v1", "m", 1), ("a", "v2", None, 5), ("a", "v3", None, 4), ("b", "v4", "m", 3), ("b", "v5", "m", 2), ("c", "v6", None, None), ("c", "v7", None, 1), (None, "v8", "m", 9), (None, "v9", "m", 8)]
    v = spark.createDataFrame(rows, "ax_id string, id string, name string, seq bigint")
    v = v.withColumns({"viewport": F.when(F.col("name").isNotNull(), F.struct("name")), "style": F.create_map(F.lit("z"), F.col("id"))}).drop("name")
    found = Catalog(spark, {"visual": v}).primary_visual()
    assert found.columns == v.columns
    assert {(r["ax_id"], r["id"], r["style"]["z"]) for r in found.collect()} == {("a", "v3", "v3"), ("b", "v5", "v5"), ("c", "v6", "v6"), (None, "v9", "v9")}
    assert "min_by" not in found._jdf.queryExecution().optimizedPlan().toString()
