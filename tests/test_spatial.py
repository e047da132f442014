"""Relations and paint order of pairs of boxes: right for thin and equal boxes, and compiled a pair."""

import random

from pyspark.sql import functions as F

from surfacegraph.operators import occlusion, spatial

SCHEMA = "page_id string, id string, rect struct<x:double,y:double,w:double,h:double>"


def some_boxes(n):
    """Boxes of all shapes near one another, a third of them as thin as the tolerance, some equal."""
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        w, h = rnd.choice([(30, 20), (1.5, 25), (25, 1.5), (1, 1), (40, 40)])
        rows.append((f"p{i % 2}", f"n{i}", (float(rnd.randrange(200)), float(rnd.randrange(200)), float(w), float(h))))
    return [*rows, *[("p0", f"c{i}", (50.0, 50.0, 30.0, 20.0)) for i in range(5)]]


def plain_relations(rows):
    """As in the rules: every ordered pair, every relation."""
    out = []
    for p, i, (ax, ay, aw, ah) in rows:
        for q, j, (bx, by, bw, bh) in rows:
            if p != q or i == j:
                continue
            if ax >= bx - 2 and ay >= by - 2 and ax + aw <= bx + bw + 2 and ay + ah <= by + bh + 2 and aw * ah < bw * bh:
                out.append((p, i, j, "visual:nested-in", 0.0, float(int(aw * ah + 0.5))))
                continue
            ox, oy = max(0, min(ax + aw, bx + bw) - max(ax, bx)), max(0, min(ay + ah, by + bh) - max(ay, by))
            for kind, gap, common in (("above", by - ay - ah, ox), ("below", ay - by - bh, ox), ("left-of", bx - ax - aw, oy), ("right-of", ax - bx - bw, oy)):
                if common >= 4 and -2 <= gap <= 64:
                    out.append((p, i, j, f"visual:{kind}", float(max(0, int(gap + 100.5) - 100)), float(int(common + 0.5))))
    return sorted(out)


def test_relations_equal_all_pairs(spark):
    rows = some_boxes(150)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_relations(rows)
    kinds = {}
    for r in want:
        kinds.setdefault((r[1], r[2]), []).append(r[3])
    assert any(len(k) > 1 for k in kinds.values())  # thin boxes are both above and below
    for most in (256, 3):
        assert sorted(map(tuple, spatial.relations(df, most=most).collect())) == want


def test_what_is_judged_for_every_pair_is_compiled(spark):
    """Functions of lists are interpreted, for which pairs are too many: none comes after the boxes have met."""
    df = spark.createDataFrame(some_boxes(20), SCHEMA)
    n = df.select("*", F.col("rect").alias("clip"), F.struct(F.lit(1.0).alias("z"), F.lit(0).alias("context"), F.lit(0).alias("floating")).alias("rank"), F.lit(True).alias("occludes"))
    for found in (spatial.relations(df), occlusion.occluders(n)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        pairs = plan.split("Join Inner")[0] + plan.split("Join Inner")[1].split("\n")[0]
        assert "lambda" not in pairs and "a_rect.x" not in pairs and "rect#" not in plan.split("Join Inner")[1].split("\n")[0]


def test_nodes_of_one_id_are_met_as_often_as_they_are(spark):
    """Two rows with one id are two boxes: each is covered once, not once for each row of the id."""
    none = "struct<x:double,y:double,w:double,h:double>"
    rows = [("p", "a", (0.0, 0.0, 10.0, 10.0), "1"), ("p", "a", (0.0, 0.0, 10.0, 10.0), "1"), ("p", "b", (5.0, 5.0, 10.0, 10.0), "2")]
    df = spark.createDataFrame(rows, SCHEMA + ", zi string").select("page_id", "id", "rect", F.create_map(F.lit("zIndex"), "zi").alias("style"))
    df = df.withColumns({"parent": F.lit(None).cast("string"), "padding_box": F.lit(None).cast(none), "is_scroll": F.lit(False), "is_stacking": F.lit(False), "has_children": F.lit(False), "z": F.lit(None).cast("int")})
    assert occlusion.occluders(occlusion.clipped(occlusion.ranked(df))).count() == 2
    assert occlusion.occluders(occlusion.clipped(df.withColumns({"rank": occlusion.paint_rank(F.col("style"), F.lit(False), F.lit(None)), "occludes": F.lit(True)}))).count() == 2


def test_occluders_are_counted_without_lists(spark):
    none = "struct<x:double,y:double,w:double,h:double>"
    df = spark.createDataFrame(some_boxes(60), SCHEMA)
    style = F.create_map(F.lit("zIndex"), F.pmod(F.hash("id"), F.lit(5)).cast("string"))
    df = df.withColumns({"style": style, "parent": F.lit(None).cast("string"), "padding_box": F.lit(None).cast(none), "is_scroll": F.lit(False), "is_stacking": F.lit(False), "has_children": F.lit(False), "z": F.lit(None).cast("int")})
    lists, counts = occlusion.occlusion(df), occlusion.occlusion(df, listed=False)
    assert "collect_list(other" not in counts._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda found, n: {(r["id"], r["visible_ratio"], r["visible_area"], n(r)) for r in found.collect()}
    want = rows(lists, lambda r: len(r["occluded_by"]))
    assert rows(counts, lambda r: r["occluders"]) == want and len({w[3] for w in want}) > 2
