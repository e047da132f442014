"""Merkle manifests against plain trees, tampered rows included."""

import hashlib

import pytest
from pyspark.sql import functions as F

from surfacegraph.llm import merkle

from .helpers import documents, odd_texts

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return plain_hash(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def plain_tree(nodes, arity):
    """(root, a list of (digests before, digests after) for each leaf)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            first = at[i] // arity * arity
            run = nodes[first : first + arity]
            path.append((run[: at[i] - first], run[at[i] - first + 1 :]))
            at[i] //= arity
        nodes = [plain_hash(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain_manifest(rows, arity, tamper=lambda row: row):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = []
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        inner.append(plain_tree([plain_leaf(r) for r in groups[s]], arity))
    if not order:
        return []
    root, outer = plain_tree([sub for sub, _ in inner], arity)
    out = []
    for s, (sub, paths), top in zip(order, inner, outer, strict=True):
        for row, path in zip(groups[s], paths, strict=True):
            d = plain_leaf(tamper(row))
            for before, after in path + top:
                d = plain_hash(*before, d, *after)
            siblings = plain_hash(*(x for before, after in path + top for x in before + after))
            out.append((row["doc_id"], plain_leaf(row), sub, root, siblings, d))
    return sorted(out, key=str)


def found(docs, arity, check=None):
    m = merkle.manifest(docs, COLUMNS, group="source", order="doc_id", arity=arity, check=check)
    m = m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.folded(F.col("claimed"), F.col("proof")))
    return sorted((tuple(r) for r in m.collect()), key=str)


@pytest.mark.parametrize(("arity", "n"), [(3, 0), (3, 1), (3, 3), (3, 4), (3, 28), (2, 21), (5, 60)])
def test_trees_of_sources(spark, arity, n):
    sources = [("big" if i % 3 else "só" if i % 2 else None if i % 4 else "") for i in range(n)]
    docs = documents(spark, [f"text\n{i}" for i in range(n)], sources=sources).repartition(3)
    assert found(docs, arity) == plain_manifest(docs.collect(), arity)


def test_odd_rows_and_tampering(spark):
    texts = [*odd_texts(), "a\nb", "a\nb", "c\n"]
    ids = [None, None, 1, 1, *range(4, len(texts))]
    langs = [None if i % 2 else "en" for i in range(len(texts))]
    docs = documents(spark, texts, ids=ids, langs=langs, sources=[None if i % 4 == 0 else "s" for i in range(len(texts))])
    rows = docs.collect()
    check = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}

    def tamper(row):
        return {**row.asDict(), "text": None if row["text"] is None else row["text"].replace("\n", "")}

    got = found(docs, 3, check)
    assert got == plain_manifest(rows, 3, tamper)
    assert [r[5] == r[3] for r in got] != [True] * len(got)
    # the same rows, dealt otherwise, give the same root
    assert found(docs.repartition(7), 3) == plain_manifest(rows, 3)


def test_one_group_and_many_groups(spark):
    docs = documents(spark, ["x"] * 10)
    assert found(docs, 3) == plain_manifest(docs.collect(), 3)
    docs = documents(spark, ["x"] * 30, sources=[f"s{i}" for i in range(30)])
    assert found(docs, 3) == plain_manifest(docs.collect(), 3)
