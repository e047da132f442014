"""Groups of overlapping boxes on crowded pages."""

import random

from surfacegraph.operators import layout


def plain(boxes):
    """The groups, by search."""
    out, free = set(), set(boxes)
    while free:
        todo, group = [free.pop()], set()
        while todo:
            a = todo.pop()
            group.add(a)
            x, y, w, h = boxes[a]
            near = {b for b in free if min(x + w, boxes[b][0] + boxes[b][2]) - max(x, boxes[b][0]) >= 24 and min(y + h, boxes[b][1] + boxes[b][3]) - max(y, boxes[b][1]) >= 24}
            free -= near
            todo += near
        out.add(frozenset(group))
    return out


def test_crowded_pages_are_folded_before_boxes_meet(spark, monkeypatch):
    r = random.Random(4)
    small = [(r.randrange(3000), r.randrange(3000), r.randrange(10, 90), r.randrange(10, 90)) for _ in range(500)]
    large = [(r.randrange(700), r.randrange(880), 20 + r.randrange(1450), 20 + r.randrange(800)) for _ in range(600)] + [(5.0, 5.0, 40.0, 40.0)] * 200
    few = [(0, 0, 50, 50), (30, 30, 50, 50), (10, 10, 50, 50), (500, 0, 23, 90), (500, 0, 23, 90)]
    pages = {"small": small, "large": large, "few": few}
    rows = [(p, i, tuple(map(float, b))) for p, boxes in pages.items() for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "page_id string, seq bigint, rect struct<x:double,y:double,w:double,h:double>")
    met, grouped = [], layout.grouped
    monkeypatch.setattr(layout, "grouped", lambda df, *a: met.append(df.groupBy("page_id").count().collect()) or grouped(df, *a))
    got = {}
    for x in layout.overlap_groups(df, most=200).collect():
        got.setdefault((x["page_id"], x["label"]), set()).add(x["seq"])
    for p, boxes in pages.items():
        want = {g for g in plain(dict(enumerate(boxes))) if len(g) > 1}
        assert {frozenset(g) for (q, _), g in got.items() if q == p and len(g) > 1} == want
    # of the large ones, and of the equal ones, few are left to meet
    assert {x["page_id"]: x["count"] for x in met[0]}["large"] < 400
