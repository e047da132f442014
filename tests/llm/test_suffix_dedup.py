import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from surfacegraph.llm import queries, suffix_dedup

from .helpers import documents, odd_texts, prose

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def tangled(seed, n=60):
    """Texts that share passages, cut and edited, some of them periodic."""
    rnd = random.Random(seed)
    pool = [prose(seed * 100 + i, 40) for i in range(6)] + ["ab" * 50, "x" * 90]
    texts = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p) // 2)
            parts.append(p[a : a + rnd.randint(5, len(p))])
            parts.append(prose(rnd.randrange(10**6), rnd.randint(0, 6)))
        texts.append(rnd.choice(["", " "]).join(parts))
    return texts


@pytest.mark.parametrize("seed,length,hot", [(1, 20, 1000), (2, 50, 1000), (3, 20, 2), (4, 33, 3), (5, 50, 1)])
def test_equals_brute_force(spark, seed, length, hot):
    texts = tangled(seed)
    rows = got(suffix_dedup.remove_repeats(documents(spark, texts), length, text_bytes=3000, hot=hot))
    assert [rows[i] for i in range(len(texts))] == brute(texts, length)


@pytest.mark.parametrize("piece", [1, 37, 200])
def test_a_long_text_goes_in_pieces(spark, piece):
    texts = tangled(6, 25)
    texts += [" ".join(texts[:8]), "y" * 333]
    rows = got(suffix_dedup.remove_repeats(documents(spark, texts), 30, piece=piece))
    assert [rows[i] for i in range(len(texts))] == brute(texts, 30)


def test_query_equals_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = got(queries.op7_suffix_dedup(spark, SF))
    assert [rows[i] for i, _ in docs] == brute([t for _, t in docs], 200)


def test_cases(spark):
    texts = [*odd_texts(), "é" * 150, "b" + "é" * 150]
    ids = [*range(len(texts) - 1), None]
    rows = got(suffix_dedup.remove_repeats(documents(spark, texts, ids)))
    assert [rows[i] for i in ids] == brute(texts, 200)
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0
    twice = suffix_dedup.remove_repeats(documents(spark, [prose(1, 90)] * 2, [5, 5])).collect()
    assert [r["n_spans"] for r in twice] == [1, 1] and all(r["n_removed"] == r["n_bytes"] for r in twice)


@pytest.mark.parametrize("seed", range(5))
def test_long_prefixes_equal_sorted_suffixes(seed):
    rng = np.random.default_rng(seed)
    text = np.r_[rng.integers(0, 2 + seed, 300), 1000]
    order, same = suffix_dedup.long_prefixes(text, 5)
    tails = [tuple(text[i:].tolist()) for i in range(len(text))]
    want = sorted(range(len(text)), key=lambda i: tails[i])
    assert order.tolist() == want
    assert same.tolist() == [False] + [tails[a][:5] == tails[b][:5] and len(tails[a]) >= 5 for a, b in zip(want, want[1:])]
