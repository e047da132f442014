"""Shortest paths found from both ends, against a queue."""

import random
from collections import deque

import pytest

from surfacegraph.operators import traverse

EDGES = "src string, dst string, kind string, provenance string, seq long"


def plain_path(rows, start, end, max_hops):
    out = {}
    for src, dst, kind, prov, seq in sorted(rows, key=lambda r: (r[4], r[1])):
        out.setdefault(src, []).append((dst, kind, prov))
    parent, queue = {start: None}, deque([(start, 0)])
    while queue:
        at, hops = queue.popleft()
        if at == end:
            path = []
            while parent[at]:
                up, kind, prov = parent[at]
                path.append({"from": up, "to": at, "via": kind, "provenance": prov})
                at = up
            return {"found": True, "cost": len(path), "hops": path[::-1]}
        if hops < max_hops:
            for dst, kind, prov in out.get(at, []):
                if dst not in parent:
                    parent[dst] = (at, kind, prov)
                    queue.append((dst, hops + 1))
    return {"found": False, "cost": -1, "hops": []}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_path_of_a_queue(spark, seed):
    """Many paths of equal length, parallel edges and loops."""
    rnd = random.Random(seed)
    nodes = [f"n{i}" for i in range(40)]
    rows = [(rnd.choice(nodes), rnd.choice(nodes), rnd.choice("xy"), "p", i) for i in range(90)]
    rows += [("n1", "n2", "x", "p", 200), ("n2", "n2", "x", "p", 201), ("n3", "lone", "x", "p", 202)]
    df = spark.createDataFrame(rows, EDGES)
    for start, end, hops in [("n0", "n7", 5), ("n3", "lone", 5), ("lone", "n3", 5), ("n5", "n9", 2), ("n4", "n4", 5), ("n8", "n30", 9)]:
        assert traverse.find_path(df, start, end, None, hops) == plain_path(rows, start, end, hops), (start, end)
    some = [r for r in rows if r[2] == "x"]
    assert traverse.find_path(df, "n0", "n11", "x", 8) == plain_path(some, "n0", "n11", 8)


def test_fewer_nodes_than_from_one_end(spark):
    """A graph of degree 20: both sides together see a small part of what one search does."""
    rnd = random.Random(5)
    rows = [(f"n{i}", f"n{rnd.randrange(5000)}", "x", "p", i * 20 + k) for i in range(5000) for k in range(20)]
    df = spark.createDataFrame(rows, EDGES).cache()
    one = traverse.search(df, "n0", None, 9, until="n77")
    forward, backward = traverse.meet_in_the_middle(df, "n0", "n77", None, 9)
    both = sum(level.count() for level in [*forward, *backward])
    assert len(forward) + len(backward) - 2 == one.where("id = 'n77'").first()["hops"]
    assert both * 4 < one.count()
