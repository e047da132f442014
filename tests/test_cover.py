"""Nodes above and hidden areas are measured without pairs: as the pairs have them, and no plan joins a page with itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacegraph.operators import cover, occlusion

BOX = "struct<x:double,y:double,w:double,h:double>"


def some_nodes(spark, n=260):
    """Nodes of two pages, some outside the viewport, large or of halves; trees whose lower nodes paint above, and scroll."""
    rnd, rows = random.Random(11), []
    for i in range(n):
        w, h = rnd.choice([(30, 20), (140, 150), (0.5, 300), (25, 1.5), (0, 9), (3000, 2000 if i % 40 == 0 else 2)])
        x, y = rnd.choice([(rnd.randrange(300), rnd.randrange(300)), (rnd.randrange(-600, 2000) / 2, rnd.randrange(-600, 2000) / 2)])
        parent = f"n{i - i % 10}" if i % 10 and i % 3 else None
        style = {"zIndex": str(rnd.randrange(-1, 4)), "display": rnd.choice(["block", "block", "none"]), "position": rnd.choice(["static", "fixed"]), "overflow": rnd.choice(["visible"] * 4 + ["hidden"])}
        rows.append((f"p{(i // 10) % 2}", f"n{i}", parent, (float(x), float(y), float(w), float(h)), style, i % 4 == 0))
    df = spark.createDataFrame(rows, f"page_id string, id string, parent string, rect {BOX}, style map<string,string>, is_stacking boolean")
    return df.withColumns({"padding_box": F.lit(None).cast(BOX), "is_scroll": F.lit(False), "z": F.lit(None).cast("int"), "has_children": F.lit(True)})


def test_counts_and_areas_are_those_of_the_pairs(spark, monkeypatch):
    df = some_nodes(spark)
    want = {r["id"]: (r["visible_ratio"], len(r["occluded_by"]), r["visible_area"], r["is_offscreen"]) for r in occlusion.occlusion(df).collect()}
    assert len({w[1] for w in want.values()}) > 5 and want["n16"] == (0.0, 0, 0.0, True)  # outside the viewport, below a clipping node
    counted, made = occlusion.counted, []
    monkeypatch.setattr(occlusion, "occluders", lambda *a: pytest.fail("pairs were made"))
    for most in (256, 5):
        monkeypatch.setattr(occlusion, "counted", lambda *a, most=most: (made.append(1), counted(*a, most=most))[1])
        got = {r["id"]: (r["visible_ratio"], r["occluders"], r["visible_area"], r["is_offscreen"]) for r in occlusion.occlusion(df, listed=False).collect()}
        assert got == want
    assert len(made) == 2


def test_fine_grids_are_taken_apart():
    rnd = np.random.default_rng(2)
    at = np.sort(rnd.integers(0, 40, (80, 2, 2)), 1).transpose(0, 1, 2).reshape(80, 4)
    at = at[(at[:, 0] < at[:, 2]) & (at[:, 1] < at[:, 3])]
    code, line = rnd.integers(0, 5, len(at)), np.cumsum(rnd.random(41))
    plain = []
    for a, c in zip(at, code, strict=True):
        grid = np.zeros((40, 40), bool)
        for b in at[code > c]:
            grid[b[1] : b[3], b[0] : b[2]] = True
        own = np.zeros_like(grid)
        own[a[1] : a[3], a[0] : a[2]] = True
        plain.append(np.outer(np.diff(line), np.diff(line))[grid & own].sum())
    meets = [sum(d > c and b[0] < a[2] and b[2] > a[0] and b[1] < a[3] and b[3] > a[1] for b, d in zip(at, code, strict=True)) for a, c in zip(at, code, strict=True)]
    for most in (1 << 20, 60):
        assert cover.hidden(line, line, at, code, at, code, most) == pytest.approx(plain)
        assert cover.met(at, code, at, code, 41, 41, most).tolist() == meets


def test_places_of_ranks():
    z, tier = np.array([1.0, np.nan, 0.0, 1.0, np.nan, -0.0]), np.array([0, 1, 2, 3, 1, 2])
    assert cover.codes(z, tier).tolist() == [1, 3, 0, 2, 3, 0]
