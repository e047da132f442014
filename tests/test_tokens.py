"""Bindings and drift against a pass over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacegraph.operators import tokens
from surfacegraph.plans import derive


def expected(values, toks):
    """Per value text: ("bound", path, type) or ("drift", path, delta) by trying every token; ``values`` carry their own colour or length."""
    out = {}
    for text, color, px in values:
        same = [t for t in toks if t[0] == text]
        hue = [t for t in toks if color and t[1] == color]
        size = [t for t in toks if px is not None and t[2] is not None and abs(t[2] - px) < 0.01]
        if same or hue or size:
            out[text] = ("bound", (same or hue or size)[0][3], "exact" if same else "normalized")
            continue
        if color:
            near = [(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(color, t[1])))), i) for i, t in enumerate(toks) if t[1]]
            near = [n for n in near if 0 < n[0] <= 35]
        else:
            near = [(abs(px - t[2]), i) for i, t in enumerate(toks) if t[2] and t[2] > 0 and px and px > 0]
            near = [n for n in near if 0 < n[0] <= 3]
        if near:
            d, i = min(near)
            out[text] = ("drift", toks[i][3], round(d, 2))
    return out


def hexed(c):
    return "#%02x%02x%02x" % c


def nodes_of(spark, texts):
    rows = [("p", f"n{i}", {"color": t}) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id string, ax_id string, style map<string,string>")


def test_matches_equal_a_pass_over_all_pairs(spark):
    r = random.Random(7)
    color = lambda: tuple(r.choice((0, 3, 30, 33, 60, 200, 228, 255)) if r.random() < 0.5 else r.randrange(256) for _ in range(3))
    toks = []
    for i in range(150):
        if i % 2:
            c = color()
            toks.append((r.choice((hexed(c), "rgb(%d, %d, %d)" % c)), c, None, f"t{i}"))
        else:
            px = r.choice((0, 1, 4, 8, 8.004, 12.5, 16, 40, r.randrange(200)))
            toks.append((f"{px}px", None, float(px), f"t{i}"))
    values = {}
    for _ in range(300):
        c = color()
        values[hexed(c)] = (hexed(c), c, None)
        px = r.choice((0, 2, 4.005, 6, 8.003, 14, 10.25, r.randrange(220)))
        values[f"{px}px"] = (f"{px}px", None, float(px))
    want = expected(list(values.values()), toks)
    table = spark.createDataFrame([(t[3], t[0], i) for i, t in enumerate(toks)], "path string, value string, seq long")
    got = {}
    for x in tokens.judged(nodes_of(spark, list(values)), table).collect():
        assert (x["bound"] is None) or (x["drift"] is None)
        if x["bound"]:
            got[x["value"]] = ("bound", x["bound"]["path"], x["bound"]["match_type"])
        elif x["drift"]:
            got[x["value"]] = ("drift", x["drift"]["path"], pytest.approx(x["drift"]["delta"], abs=0.0051))
    assert got == want
    assert {k for k, v in want.items() if v[0] == "drift"} and {v[2] for v in want.values() if v[0] == "bound"} == {"exact", "normalized"}


def test_equally_near_tokens_the_first_counts(spark):
    table = spark.createDataFrame([("b", "#0a0000", 2), ("a", "#000a00", 1), ("y", "10px", 3), ("x", "14px", 4)], "path string, value string, seq long")
    got = {x["value"]: x["path"] for x in tokens.drifts(nodes_of(spark, ["#000000", "12px"]), table).collect()}
    assert got == {"#000000": "a", "12px": "y"}


def test_null_empty_and_odd_values(spark):
    table = spark.createDataFrame([("n", None, 0), ("e", "", 1), ("h", "rgb(999999999999, 0, 0)", 2)], "path string, value string, seq long")
    nodes = nodes_of(spark, [None, "", "  ", "none", "x" * 100000, "rgba(255, 0, 0, 1.2.3)", "#fe0000"])
    assert {(x["ax_id"], x["path"]) for x in tokens.bindings(nodes, table).collect()} == {("n5", "h")}
    assert [(x["ax_id"], x["delta"], x["severity"]) for x in tokens.drifts(nodes, table).collect()] == [("n6", 1.0, "low")]
    empty = table.limit(0)
    assert tokens.judged(nodes, empty).where("bound is not null or drift is not null").count() == 0
    assert tokens.judged(nodes.limit(0), table).count() == 0
    assert nodes.sparkSession.createDataFrame([], nodes.schema).transform(lambda d: tokens.drifts(d, empty)).count() == 0


def test_every_node_of_a_shared_value_is_judged(spark):
    table = spark.createDataFrame([("m", "16px", 0)], "path string, value string, seq long")
    assert tokens.bindings(nodes_of(spark, ["16px"] * 500 + ["16"] * 7), table).groupBy("match_type").count().rdd.collectAsMap() == {"exact": 500, "normalized": 7}


@pytest.mark.parametrize("spread", [256, 40])
def test_many_tokens_without_a_pass_over_all_pairs(spark, spread):
    """50,000 tokens, and colours of which many are far from the tokens where these are dense."""
    rng = np.random.default_rng(3)
    toks = np.unique(rng.integers(0, spread, (50000, 3)), axis=0)
    rng.shuffle(toks)
    own = np.unique(np.concatenate([rng.integers(0, 256, (700, 3)), rng.integers(0, spread, (300, 3))]), axis=0)
    code = lambda a: (a[:, 0] * 65536 + a[:, 1] * 256 + a[:, 2]).tolist()
    table = spark.createDataFrame(list(zip(code(toks), range(len(toks)))), "token_rgb int, token int")
    got = {x["rgb"]: x["near"] for x in tokens.nearest_color(spark.createDataFrame([(c,) for c in code(own)], "rgb int"), table).collect()}
    for c, row in zip(code(own), own):
        square = ((toks - row) ** 2).sum(axis=1)
        ok = np.flatnonzero((square > 0) & (square <= 35**2))
        if len(ok) == 0:
            assert got[c] is None
        else:
            at = ok[np.lexsort((ok, square[ok]))[0]]
            assert (got[c]["token"], got[c]["dist"]) == (int(at), float(np.sqrt(square[at])))


def test_lengths_are_compared_with_neighbours_only(spark):
    """20,000 lengths and 20,000 tokens within three pixels: all pairs would be 400 million."""
    rng = np.random.default_rng(5)
    toks, own = np.unique(rng.uniform(5, 8, 20000)), np.unique(rng.uniform(5, 9, 20000))
    table = spark.createDataFrame([(float(t), i) for i, t in enumerate(toks)], "token_px double, token int")
    got = {x["px"]: x["near"]["dist"] for x in tokens.nearest_length(spark.createDataFrame([(float(x),) for x in own], "px double"), table).where(F.col("near").isNotNull()).collect()}
    at = np.clip(np.searchsorted(toks, own), 1, len(toks) - 1)
    want = np.minimum(abs(own - toks[at - 1]), abs(own - toks[at]))
    assert len(got) == len(own) and np.allclose([got[float(x)] for x in own], want)


@pytest.mark.parametrize("join", ["bindings", "lint", "references"])
def test_styles_are_not_sent_to_every_task(spark, join):
    """Tokens made in the driver have no estimated size: the styles were taken for the smaller side, and collected in the driver."""
    sf = "/root/testdata/sf0.001"
    df = getattr(tokens, join)(derive.visual(spark, sf), derive.tokens(spark))
    assert "BuildLeft" not in df._jdf.queryExecution().sparkPlan().toString()


def test_many_texts_are_joined_by_a_shuffle(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    one = lambda: sorted(map(tuple, tokens.bindings(derive.visual(spark, sf), derive.tokens(spark)).collect()))
    sent = one()
    monkeypatch.setattr(tokens, "MOST_SENT", 3)
    assert sent and one() == sent
