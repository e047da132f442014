"""Places among siblings against the lists of siblings."""

from surfacegraph import catalogue
from surfacegraph.operators import layout

SCHEMA = "page_id string, id string, parent string, rect struct<x:double,y:double,w:double,h:double>, seq long"


def test_places_agree_with_lists(spark):
    # one parent has most children; many share a place
    rows = [("p", f"n{i}", None if i % 11 == 0 else "big" if i % 3 else f"q{i % 7}", (float(i % 4), float(i * 37 % 50), 1.0, 1.0), i) for i in range(400)]
    rows += [(None, "lost", None, None, None), ("o", "n1000", "big", (0.0, 0.0, 1.0, 1.0), 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    lists = {r["id"]: r for r in layout.siblings(df).collect()}
    places = layout.sibling_places(df)
    assert {r["id"]: r["place"] for r in places.collect()} == {k: len(r["siblings_before"]) for k, r in lists.items()}
    asked = spark.createDataFrame([("n5",), ("n11",), ("lost",), ("n5",), ("unknown",)], "id string")
    got: dict = {}
    for r in layout.siblings_of(places, asked).collect():
        got.setdefault((r["id"], r["side"]), []).append((r["distance"], r["sibling"]))
    for i in ("n5", "n11"):
        assert [s for _, s in sorted(got[i, "before"], reverse=True)] == lists[i]["siblings_before"]
        assert [s for _, s in sorted(got[i, "after"])] == lists[i]["siblings_after"]
    assert {k[0] for k in got} == {"n5", "n11"}


def test_ranks_agree_with_lists_and_make_none(spark):
    rows = [("p" if i % 5 else None, f"n{i}", None if i % 11 == 0 else "big", (float(i % 4), float(i * 37 % 50), 1.0, 1.0), i) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r["id"], len(r["siblings_before"]), len(r["siblings_after"]), (r["siblings_before"] or [r["id"]])[0]) for r in layout.siblings(df).collect()}
    got = layout.sibling_ranks(df)
    assert {tuple(r) for r in got.collect()} == want
    # the lists of a parent add up to the square of its children
    for ranks in (got, catalogue.queries()["l_siblings"](spark, "/root/testdata/sf0.001")):
        assert "collect_list" not in ranks._jdf.queryExecution().optimizedPlan().toString()


def test_no_nodes(spark):
    none = spark.createDataFrame([], SCHEMA)
    places = layout.sibling_places(none)
    assert places.count() == 0 and layout.siblings_of(places, none).count() == 0
