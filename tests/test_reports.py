"""Failed pages, and a pattern at the edge of its rule."""

import duckdb
from pyspark.sql import functions as F

from surfacegraph import catalogue
from surfacegraph.operators import patterns, report
from surfacegraph.plans.catalog import Catalog

SF = "/root/testdata/sf0.001"


def test_failed_pages_of_one_url_have_their_own_errors(spark):
    pages = spark.createDataFrame([("p1", "u", "timeout"), ("p2", "u", "timeout"), ("p3", "u", "complete"), ("p4", "w", "spa-error")], "id string, url string, load_status string")
    errors = [("p1", "u", "late", 2), ("p1", "u", "early", 1), (None, "w", "b", 1), (None, "w", "a", 1), ("p9", "w", "other", 0)]
    errors = spark.createDataFrame([("pageErrors", *e) for e in errors], "kind string, page_id string, url string, message string, seq long")
    got = sorted(map(tuple, report.failed_pages(Catalog(spark, {"pages": pages, "diagnostics": errors})).collect()))
    assert got == [("u", "timeout", "Unknown page failure"), ("u", "timeout", "early"), ("w", "spa-error", "a")]


def test_failed_pages_with_repeated_urls_equal_their_sql(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1010)).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in "nation customer part events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.queries()["r_failed_pages"](spark, str(tmp_path)).select("url", "status", "error").collect()))
    assert got == sorted(con.sql(f"SELECT url, status, error FROM ({catalogue.oracle_sql()['r_failed_pages']})").fetchall())


def test_a_button_at_just_35_hundredths_of_the_width_floats(spark):
    row = [("p", x, (float(x), 600.0, 200.0, 20.0), {"position": "fixed"}, "button", "b", False, "none") for x in ("504", "505")]
    schema = "page_id string, id string, rect struct<x:double,y:double,w:double,h:double>, style map<string,string>, role string, name string, focusable boolean, container_type string"
    assert [r["id"] for r in patterns.patterns(spark.createDataFrame(row, schema)).collect()] == ["504"]
