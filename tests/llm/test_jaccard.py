import random

import corpus_pipeline
from surfacegraph.llm import jaccard, simhash

from .helpers import documents, odd_texts, prose, smallest_reachable
from .test_simple_operators import SF


def plain_shingles(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited(text, seed, edits):
    rnd, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def kept(rows):
    return sorted(r["doc_id"] for r in rows.collect())


def test_near_copies_beyond_four_bits_are_dropped(spark):
    texts = [prose(s, 200) for s in range(12)]
    texts += [edited(t, 100 * e + s, e) for s, t in enumerate(texts) for e in (1, 2, 3, 4, 5, 8)]
    sets = [plain_shingles(t) for t in texts]
    low = smallest_reachable(list(range(len(texts))), lambda i, j: similar(sets[i], sets[j]))
    want = [i for i, c in enumerate(low) if i == c]
    assert 12 < len(want) < len(texts) - 40
    assert kept(dict(corpus_pipeline.STAGES)["simhash"](spark, documents(spark, texts), SF)) == want


def test_large_groups_chains_and_odd_texts(spark):
    base = prose(50, 100)
    texts = odd_texts() + [edited(base, s, 1) for s in range(40)] + [base.upper()]
    chain = prose(51, 120)
    for s in range(15):  # each like the one before, the ends unlike
        chain = edited(chain, 500 + s, 2)
        texts.append(chain)
    ids = random.Random(3).sample(range(1000), len(texts))
    sets = [plain_shingles(t) for t in texts]
    low = smallest_reachable(ids, lambda i, j: similar(sets[i], sets[j]))
    want = sorted(i for i, c in zip(ids, low, strict=True) if i == c)
    for block in (4, 256):
        rows = jaccard.keep_one(documents(spark, texts, ids), block=block)
        assert kept(rows) == want and rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]


def test_a_repeated_id_drops_only_the_copy(spark):
    base, other = prose(60, 80), prose(61, 80)
    df = documents(spark, [base, base.upper(), other, other], [1, 7, 7, 7])
    for keep_one in (jaccard.keep_one, simhash.keep_one):
        assert sorted((r["doc_id"], r["text"]) for r in keep_one(df).collect()) == [(1, base), (7, other)]
