"""Pages are parsed once, in small batches."""

from pyspark.sql import functions as F

from surfacegraph.sources import html


def pages(spark):
    body = '<ul id="l" aria-owns="a b"><li id="a" aria-controls="l x">one</li></ul><nav><a href="/x" aria-current="page">x</a></nav><button commandfor="l" id="b" popovertarget="a">y</button>'
    return spark.range(30).select(F.concat(F.lit("p"), "id").alias("page_id"), F.lit("https://h/").alias("url"), F.lit(body).alias("html"))


def test_structure_and_navigation_parse_pages_once(spark):
    found = html.nodes(pages(spark))
    for df in (html.structure_edges(found), html.nav_elements(found)):
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    edges = html.structure_edges(found)
    named = {(r["src"], r["dst"], r["kind"]) for r in edges.where("src like 'ax:p7:%' and kind <> 'a11y:child-of'").collect()}
    at = lambda x: f"ax:p7:{x}"
    assert named == {(at("l"), at("a"), "aria-owns"), (at("l"), at("b"), "aria-owns"), (at("a"), at("l"), "aria-controls"), (at("a"), at("x"), "aria-controls"), (at("b"), at("l"), "commandfor"), (at("b"), at("a"), "popovertarget")}


def test_batches_of_pages_are_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        found = html.nodes(pages(spark))
        assert spark.conf.get(key) == "1000" and found.select("page_id").distinct().count() == 30
        spark.conf.set(key, "77")
        html.nodes(pages(spark))
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)
