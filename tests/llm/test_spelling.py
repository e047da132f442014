"""Spelling variants against brute force over all pairs."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from surfacegraph.llm import spelling

from .helpers import documents, odd_texts


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def plain_variants(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], [ord(c) for c in v]), default=None)
        enough = best is not None and counts[best] >= ratio * n
        out[w] = (best if enough else None, n, len(near), counts[best] if enough else None)
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("most", [1, 4, 4096])
def test_pairs_of_dense_words(spark, most):
    """Few letters, so that every bucket is full; small bounds split them down to single characters."""
    rnd = random.Random(most)
    words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 9))) for _ in range(250)} | {"", "a", "b", "ab", "ba"})
    got = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), most=most).collect()]
    assert len(got) == len(set(got))
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if one_edit(a, b)}
    assert set(got) == want


def test_a_frequent_segment(spark):
    """All words share their first half."""
    rnd = random.Random(5)
    words = sorted({"common" + "".join(rnd.choice("abcdef") for _ in range(rnd.choice((5, 6)))) for _ in range(400)})
    got = {tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), most=100).collect()}
    assert got == {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if one_edit(a, b)}


def test_forms_roots_and_ties(spark):
    counts = {"lettter": 1, "letter": 6, "letters": 30, "lettera": 30, "lette": 30, "other": 3, "abcd": 5, "abce": 24, "é" * 40: 2, "é" * 41: 10}
    counts |= {"z" * 3000: 1, "z" * 3001: 5}
    assert found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain_variants(counts)


def test_words_of_texts(spark):
    texts = [*odd_texts(), "Straße STRASSE café Ünder-under x1y", "café cafe", None, "a×b"]
    docs = documents(spark, texts, ids=[None, 1, 1, *range(3, len(texts))]).withColumn("run", F.lit("clash")).withColumn("word", F.lit("clash"))
    want = Counter(w for t in texts if t for w in re.findall(r"[A-Za-zÀ-ÿ]+", "".join(c.lower() if c.isascii() else c for c in t)))
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, least=1, n=1).collect()}
    assert got == dict(want)
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, least=3, n=2).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2 and len(w) >= 3}


def test_empty(spark):
    assert found(spelling.variants(spelling.count_words(documents(spark, [])))) == []
    assert found(spelling.variants(spelling.count_words(documents(spark, [None, "", "short"])))) == []
    assert found(spelling.variants(spark.createDataFrame([("single", 7)], "word string, n long"))) == [("single", None, "single", 7, 0, None)]
