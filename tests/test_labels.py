"""Interval labels and values along parents, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from surfacegraph.operators import labels, occlusion
from surfacegraph.plans.prefix import running_sum

NODES = "page_id string, id string, parent string, order int"


def forest(seed, n):
    """Nodes of two pages: a chain, a node with many children, ties in the order, parents that are no nodes."""
    rnd = random.Random(seed)
    out = []
    for page in ("p", "q"):
        for i in range(n):
            kind = rnd.randrange(4)
            up = None if i == 0 else f"{page}{i - 1}" if kind == 0 else f"{page}0" if kind == 1 else f"{page}{rnd.randrange(i)}" if kind == 2 else rnd.choice([f"{page}{i // 2}", "gone", None])
            out.append((page, f"{page}{i}", up if up != f"{page}{i}" else None, rnd.choice([None, 0, 1, 5])))
    rnd.shuffle(out)
    return out


def plain_labels(rows):
    known = {r[1] for r in rows}
    kids = {}
    for page, i, up, order in rows:
        kids.setdefault((page, up if up in known else None), []).append((order is not None, order or 0, i))
    out = {}

    def walk(page, i, depth, at):
        end = at
        for _, _, kid in sorted(kids.get((page, i), [])):
            end = walk(page, kid, depth + 1, end + 1)
        out[i] = (at, end, depth)
        return end

    for page in {r[0] for r in rows}:
        at = 0
        for _, _, root in sorted(kids[page, None]):
            at = walk(page, root, 0, at) + 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals(spark, seed):
    rows = forest(seed, 60)
    got = {r["id"]: (r["pre"], r["last"], r["depth"]) for r in labels.intervals(spark.createDataFrame(rows, NODES)).collect()}
    want = plain_labels(rows)
    assert got == want
    below = {b for b, (pre, _, _) in want.items() if b[0] == "p" and want["p0"][0] < pre <= want["p0"][1]}
    one = labels.intervals(spark.createDataFrame([r for r in rows if r[0] == "p"], NODES))
    assert {r["id"] for r in labels.descendants(one, "p0").collect()} == below
    assert {r["id"]: r["hops"] for r in labels.descendants(one, "p0", 1).collect()} == {b: 1 for b in below if want[b][2] == want["p0"][2] + 1}


def test_long_chains_cycles_and_no_rows(spark):
    chain = [("p", f"n{i:03}", f"n{i - 1:03}" if i else None, 0) for i in range(200)]
    got = {r["id"]: (r["pre"], r["last"], r["depth"]) for r in labels.intervals(spark.createDataFrame(chain, NODES)).collect()}
    assert got == {f"n{i:03}": (i, 199, i) for i in range(200)}
    assert labels.intervals(spark.createDataFrame([], NODES)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        labels.intervals(spark.createDataFrame([("p", "a", "c", 0), ("p", "b", "a", 0), ("p", "c", "b", 0), ("p", "d", "a", 0)], NODES))


def test_running_sums_over_partitions(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.randrange(9)) for i in range(200)]
    got = {r["n"]: r["s"] for r in running_sum(spark.createDataFrame(rows, "k string, n int, v long").repartition(5), ["k"], ["n"], F.col("v"), "s").collect()}
    assert got == {n: sum(v for k2, m, v in rows if k2 == k and m < n) for k, n, _ in rows}


def plain_area(rects):
    xs = sorted({x for r in rects for x in (r[0], r[0] + r[2])})
    ys = sorted({y for r in rects for y in (r[1], r[1] + r[3])})
    inside = lambda x, y: any(r[0] <= x < r[0] + r[2] and r[1] <= y < r[1] + r[3] for r in rects)
    return sum((x1 - x0) * (y1 - y0) for x0, x1 in zip(xs, xs[1:], strict=False) for y0, y1 in zip(ys, ys[1:], strict=False) if inside(x0, y0))


def test_areas_of_crowded_regions(spark):
    """Few covers at once, so that regions are quartered, and covers that all cross in one point."""
    rnd = random.Random(3)
    clip = (0.0, 0.0, 64.0, 64.0)
    covers = {
        "many": [(float(rnd.randrange(60)), float(rnd.randrange(60)), float(rnd.randrange(1, 9)), float(rnd.randrange(1, 9))) for _ in range(60)],
        "cross": [(20.0 - i / 8, 20.0 - i / 4, 1 + i / 4, 1 + i / 2) for i in range(30)],
        "hidden": [(0.0, 0.0, 64.0, 64.0)] + [(1.0, 1.0, 5.0, float(i + 1)) for i in range(30)],
        "outside": [(500.0, 0.0, 5.0, 5.0)],
    }
    box = "struct<x:double,y:double,w:double,h:double>"
    df = spark.createDataFrame([(k, clip, c) for k, cs in covers.items() for c in cs], f"id string, clip {box}, cover {box}")
    got = {r["id"]: r["covered"] for r in occlusion.covered_areas(df, most=10).collect()}
    assert got == pytest.approx({k: plain_area([(x, y, min(w, 64 - x), min(h, 64 - y)) for x, y, w, h in cs if x < 64]) for k, cs in covers.items() if k != "outside"})


def test_nodes_without_children_take_no_part_in_the_doublings(spark, monkeypatch):
    rows = [("t", "r", None, 0), ("t", "s", "lost", 1)] + [("t", f"c{i}", "r", i) for i in range(5)] + [("t", f"o{i}", f"c{i % 5}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id string, id string, parent string, order int")
    climbed, climb = [], labels.climb
    monkeypatch.setattr(labels, "climb", lambda nodes, *a, **k: climbed.append(nodes.count()) or climb(nodes, *a, **k))
    got = {r["id"]: (r["pre"], r["last"], r["depth"]) for r in labels.intervals(df).collect()}
    assert climbed == [6, 6]
    assert got["r"] == (0, 205, 0) and got["s"] == (206, 206, 0) and got["c1"] == (42, 82, 1)
    assert sorted(pre for pre, _, _ in got.values()) == list(range(207))
    assert all(got[f"o{i}"][2] == 2 and got[f"c{i % 5}"][0] < got[f"o{i}"][0] <= got[f"c{i % 5}"][1] for i in range(200))
