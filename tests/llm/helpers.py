"""Small tables and brute-force versions for the operators' tests."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from fractions import Fraction

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, langs=None, sources=None):
    """A documents table of the texts, with an extra column whose name clashes."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    langs = ["en"] * n if langs is None else langs
    sources = ["s"] * n if sources is None else sources
    rows = [(i, t, la, s, None if t is None else len(t), "x") for i, t, la, s in zip(ids, texts, langs, sources, strict=True)]
    return spark.createDataFrame(rows, DOC_SCHEMA + ", kept string")


def prose(seed, words, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


def odd_texts():
    """Null, empty, blank, very long, tied and repeated texts."""
    return [None, "", " \t\n", "a", "A", "a a", "é́  x", prose(1, 30), prose(1, 30), prose(1, 30) + " ", prose(2, 60_000), "z" * 5000]


def smallest_reachable(ids, linked):
    """{position: smallest id reachable} by brute force over all pairs."""
    n = len(ids)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(n)]


def plain_targets(per, weights=(5, 2, 1), share=1, cap=3):
    """{source: target words} of {source: words}, in exact fractions."""
    order = sorted(per, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weigh = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    goal, full = share * sum(per.values()), set()
    while True:
        rest = goal - cap * sum(per[s] for s in full)
        total = sum(weigh[s] for s in order if s not in full)
        want = {s: Fraction(cap * per[s]) if s in full else rest * weigh[s] / total for s in order}
        above = {s for s in order if want[s] > cap * per[s]}
        if not above:
            return {s: float(t) for s, t in want.items()}
        full |= above


def plain_rates(sizes, target, cap=3.0):
    """{size: rate} of documents of these sizes: the exponential tilt with which they give ``target`` words, by bisection."""
    mean, many = sum(sizes) / len(sizes), Counter(s for s in sizes if s)
    lo, hi = -200.0, 200.0
    for _ in range(200):
        lam = (lo + hi) / 2
        words = sum(n * s * min(cap, math.exp(min(50.0, lam * s / mean))) for s, n in many.items())
        lo, hi = (lam, hi) if words < target else (lo, lam)
    return {s: min(cap, math.exp(min(50.0, lam * s / mean))) for s in many}


def check_mix(rows, cap=3.0):
    """The mix against brute force: sizes, targets, and the copies of each bin. ``rows``: (source, text, target, taken)."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    per, sizes, taken = Counter(), {}, {}
    for source, text, _, words in rows:
        n = len(word.findall(text or ""))
        per[source] += n
        sizes.setdefault(source, []).append(n)
        taken.setdefault(source, Counter())[n] += words
        assert 0 <= words <= cap * n and (n == 0 or words % n == 0)
    want = plain_targets(per) if per else {}
    for source, ns in sizes.items():
        many = Counter(n for n in ns if n)
        if not many:
            continue
        assert all(abs(t - want[source]) <= 1e-9 * want[source] for s, _, t, _ in rows if s == source)
        rates = plain_rates(ns, want[source])
        for n in many:
            # rounding is off by half a document, and by errors of at most half a document that larger sizes leave
            assert abs(taken[source][n] / n - many[n] * rates[n]) <= 1 + max(many) / n + 1e-3 * many[n], (source, n)
        off = sum(taken[source].values()) - want[source]
        # what is off is less than any document that could be taken once more, or once less
        for n, total in many.items():
            room = taken[source][n] / n < cap * total if off < 0 else taken[source][n] > 0
            assert not room or n > abs(off) - 1e-5 * want[source] - 1e-9, (source, n, off)
