import random

import numpy as np
import pytest

import corpus_pipeline
from surfacegraph.llm import jaccard

from .helpers import documents, prose
from .test_simple_operators import SF


def plain_bit(s, word, bit):
    """A bit of the fingerprint, vote by vote."""
    total = 0
    for weight, seed in ((1, 6), (2, 7)):
        flip, by = int(jaccard.constants(64, seed + 2)[word]), int(jaccard.constants(64, seed)[word])
        for h in s.tolist():
            x = int(jaccard.mixed(np.array([(h ^ flip) * by % 2**64], np.uint64))[0])
            # bits are numbered as in the bytes of the words, the highest of a byte first
            total += weight if x >> (bit // 8 * 8 + 7 - bit % 8) & 1 else -weight
    return int(total > 0)


def test_fingerprint_is_the_majority_of_the_shingles_votes():
    for s in (jaccard.shingles(None, 5), jaccard.shingles("a b", 5), jaccard.shingles(prose(1, 300), 5)):
        bits = np.unpackbits(jaccard.fingerprint(s, 4).view(np.uint8))
        for at in (0, 1, 7, 8, 100, 191, 255):
            assert bits[at] == plain_bit(s, at // 64, at % 64)


@pytest.mark.parametrize("texts", [10, 230_000, 14_000_000])
def test_masks_cover_every_part_that_differs_in_few_bits(texts):
    plan, rng = jaccard.plan(texts, 0.8), np.random.default_rng(texts)
    base = rng.integers(0, 1 << 64, (400, plan.words), np.uint64, endpoint=False)
    bits = np.unpackbits(base.view(np.uint8), axis=1)
    for row, b in enumerate(bits):
        for part in range(plan.parts):  # all parts differ by far, but one
            n = jaccard.RADIUS if part == row % plan.parts else plan.bits
            b[part * plan.bits + rng.permutation(plan.bits)[:n]] ^= 1
    other = np.packbits(bits, axis=1).view(np.uint64)
    assert (jaccard.buckets(base, plan) == jaccard.buckets(other, plan)).any(1).all()


@pytest.mark.parametrize("texts", [10, 230_000])
@pytest.mark.parametrize("both, a, b", [(4, 0, 1), (12, 1, 2), (80, 10, 10), (80, 0, 20)])
def test_sets_of_the_least_similarity_meet_and_pass_the_check(texts, both, a, b):
    plan, rng = jaccard.plan(texts, 0.8), np.random.default_rng(both + a)
    sets = rng.integers(0, 1 << 64, (1500, both + a + b), np.uint64, endpoint=False)
    x = np.array([jaccard.fingerprint(s[: both + a], plan.words) for s in sets])
    y = np.array([jaccard.fingerprint(np.r_[s[:both], s[both + a :]], plan.words) for s in sets])
    apart = np.bitwise_count(x ^ y).sum(1) / (64 * plan.words)
    assert apart.mean() <= jaccard.differ(0.8) + 0.002
    assert (jaccard.buckets(x, plan) == jaccard.buckets(y, plan)).any(1).all()
    assert (np.bitwise_count(x ^ y)[:, : jaccard.CHECK // 64].sum(1) <= plan.near).all()


def test_clusters_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 1 << 64, (150, 3), np.uint64, endpoint=False)
    bits[50:90] = bits[0] ^ (np.uint64(1) << rng.integers(0, 64, (40, 3), np.uint64))
    for i in range(90, 110):  # a chain whose ends are far apart
        bits[i] = bits[i - 1]
        bits[i, i % 3] ^= np.uint64((1 << 20) - 1) << np.uint64(2 * (i - 90))
    near = 25
    close = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2) <= near
    for _ in range(8):
        close = close @ close
    want = {tuple(np.flatnonzero(r).tolist()) for r in close if r.sum() > 1}
    for mates in (512, 1):  # all at once, and as a very large bucket
        monkeypatch.setattr(jaccard, "MATES", mates)
        assert {tuple(sorted(g.tolist())) for g in jaccard.clusters(bits, near)} == want


def test_stage_drops_near_copies_of_few_words(spark):
    texts = []
    for s in range(150):
        words = prose(s, 9, 10**6).split()
        texts += [" ".join(words[:8]), " ".join(words)]  # 4 of 5 shingles
    order = random.Random(1).sample(range(300), 300)
    rows = documents(spark, [texts[i] for i in order], order)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, rows, SF).collect()) == list(range(0, 300, 2))
