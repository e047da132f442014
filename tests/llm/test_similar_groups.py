import math

import numpy as np

from surfacegraph.llm import jaccard

from .helpers import documents, prose, smallest_reachable
from .test_jaccard import edited, kept, plain_shingles, similar


def kept_and_dealt(monkeypatch, spark, texts, block):
    """(ids that stay, rows that go to cells with their sets)."""
    links, dealt = jaccard._links, []

    def counted(cells, *rest):
        dealt.append(cells.count())
        return links(cells, *rest)

    monkeypatch.setattr(jaccard, "_links", counted)
    return kept(jaccard.keep_one(documents(spark, texts), block=block)), sum(dealt)


def wanted(texts):
    sets = [plain_shingles(t) for t in texts]
    low = smallest_reachable(list(range(len(texts))), lambda i, j: similar(sets[i], sets[j]))
    return [i for i, c in enumerate(low) if i == c]


def test_cells_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    base = prose(1, 150)
    texts = [edited(base, s, 1) for s in range(400)]  # 50 blocks
    ids, dealt = kept_and_dealt(monkeypatch, spark, texts, 8)
    assert ids == wanted(texts) == [0]
    assert dealt <= 3 * len(texts)


def test_a_set_goes_to_one_cell_not_to_each_bucket(spark, monkeypatch):
    texts = [edited(prose(s, 150), 10 * s + k, 7) for s in range(40) for k in range(3)]
    ids, dealt = kept_and_dealt(monkeypatch, spark, texts, 256)
    assert ids == wanted(texts) and len(ids) > 80  # most share buckets and are no copies
    assert 0 < dealt <= len(texts)


def test_outsiders_of_a_large_group_are_still_compared(spark, monkeypatch):
    base = prose(2, 120)
    texts = [edited(base, s, 1) for s in range(40)]
    for s in range(12):  # far from the group, each pair alike
        far = edited(base, 900 + s, 4)
        texts += [far, edited(far, 950 + s, 1)]
    ids, _ = kept_and_dealt(monkeypatch, spark, texts, 4)
    assert ids == wanted(texts)


def test_groups_are_sparse_where_few_rows_meet_in_their_clusters(spark):
    chain = [(i, i + k, 1) for i in range(39) for k in (0, 1)]
    dense = [(1000, 1000 + i, 5) for i in range(10)]
    joined = spark.createDataFrame(chain + dense, "first long, node long, rows long")
    for block, large in ((4, True), (256, False)):
        got = {(r["component"], r["n"], r["node"], r["large"], r["sparse"]) for r in jaccard._grouped(joined, block).collect()}
        assert got == {(0, 40, i, large, large) for i in range(40)} | {(1000, 10, 1000 + i, large, False) for i in range(10)}


def test_sparse_groups_are_compared_by_cluster(spark, monkeypatch):
    texts, chain = [], prose(3, 150)
    for s in range(90):  # each like the one before
        chain = edited(chain, 700 + s, 2)
        texts.append(chain)
    grouped, found = jaccard._grouped, []

    def seen(*args):
        out = grouped(*args)
        found.append(out.where("sparse").count())
        return out

    monkeypatch.setattr(jaccard, "_grouped", seen)
    ids, _ = kept_and_dealt(monkeypatch, spark, texts, 1)
    assert found[0] > 40 and ids == wanted(texts)


def test_lowest_follows_links_in_any_order():
    rng = np.random.default_rng(2)
    order = rng.permutation(200)
    a, b = order[:-1], order[1:]
    keep = np.arange(199) % 50 != 49
    low = jaccard.lowest(a[keep], b[keep], 200)
    for part in np.split(order, [50, 100, 150]):
        assert set(low[part].tolist()) == {part.min()}


def test_sizes_part_only_sets_that_cannot_be_similar():
    n = np.arange(1, 3000)
    a, b = (x.ravel() for x in np.meshgrid(n, n))
    some = np.minimum(a, b) >= 0.8 * np.maximum(a, b)
    far = np.abs(jaccard.sized(a[some]).astype(int) - jaccard.sized(b[some])).max()
    assert far <= math.ceil(-jaccard.STEPS * math.log2(0.8)) + 1
    bits, size = np.zeros((4, 3), np.uint64), jaccard.sized(np.array([100, 125, 156, 220]))
    assert [sorted(g.tolist()) for g in jaccard.clusters(bits, 10, size, 0.8)] == [[0, 1, 2]]
    assert [sorted(g.tolist()) for g in jaccard.clusters(bits, 10)] == [[0, 1, 2, 3]]


def test_a_row_serves_every_bucket_of_its_masks():
    plan = jaccard.plan(230_000, 0.8)
    each = jaccard.masks(jaccard.RADIUS, bits=plan.bits)
    assert sorted(m for ms in plan.together for m in ms) == list(range(len(each)))
    rng = np.random.default_rng(1)
    part = rng.integers(0, 1 << plan.bits, 2000, np.uint64)
    for ms in plan.together:
        common = np.uint64(each[ms[0]] & each[ms[-1]])
        for m in ms:
            by = {}
            for k, p in zip(jaccard.bucket(part, np.zeros(2000, int), m, plan).tolist(), part, strict=True):
                by.setdefault(k, set()).add(int(p & common))
            assert max(map(len, by.values())) == 1  # texts of a bucket are dealt alike
            assert len(by) == len(set((part & np.uint64(each[m])).tolist()))
