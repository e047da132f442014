"""What the pipeline's first stage says decides what follows: F11."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from surfacegraph.llm import language_id, packing, queries

from .helpers import documents
from .test_simple_operators import check_packing

STAGES = dict(corpus_pipeline.STAGES)


def of_one_group(places):
    """(sequences, those of one group) of (sequence, group) pairs."""
    groups = {}
    for sequence, group in places:
        groups.setdefault(sequence, set()).add(group)
    return len(groups), sum(len(g) == 1 for g in groups.values())


def test_the_network_names_the_language_by_which_documents_are_packed(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r["doc_id"]: r["lang"] for r in base.select("doc_id", "lang").collect()}
    unlabelled = F.col("doc_id") % 3 == 0
    docs = base.withColumn("lang", F.when(~unlabelled, F.col("lang"))).localCheckpoint()
    rows = STAGES["language_id"](spark, docs, "").localCheckpoint()
    assert rows.schema == docs.schema and rows.count() == docs.count()
    got = {r["doc_id"]: r["lang"] for r in rows.select("doc_id", "lang").collect()}
    right = [got[i] == true[i] for i in got if i % 3 == 0]
    assert len(right) > 300 and sum(right) >= 0.98 * len(right)
    assert rows.drop("lang").exceptAll(docs.drop("lang")).isEmpty()

    packed = STAGES["packing"](spark, rows, "").collect()
    texts = [(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]
    used = check_packing(packed, texts, Tokenizer.from_file(queries.vocabulary()))
    assert all(r["lang"] == got[r["doc_id"]] for r in packed)
    plain = packing.pack(rows, queries.vocabulary()).collect()
    assert used <= len({r["sequence_id"] for r in plain})
    alone, before = (of_one_group([(r["sequence_id"], got[r["doc_id"]]) for r in p])[1] for p in (packed, plain))
    assert alone >= 0.6 * used and alone > 1.3 * before
    # without the first stage the same documents are packed in another way
    without = STAGES["packing"](spark, docs, "").collect()
    assert {(r["doc_id"], r["piece"], r["sequence_id"]) for r in without} != {(r["doc_id"], r["piece"], r["sequence_id"]) for r in packed}


def test_labels_stay_but_where_the_network_contradicts_them_for_sure(spark):
    net, long = language_id.ByteNet(["de", "en"]), "x" * language_id.WINDOW
    named = lambda text, label, lang, score: language_id.named(net, text, label, (lang, score))
    assert named("a", None, "en", 0.3) == "en" and named("1", None, "und", 0.0) is None and named("1", "de", "und", 0.0) == "de"
    assert named(long, "de", "en", language_id.SURE) == "en" and named(long, "de", "en", 0.89) == "de"
    assert named(long[1:], "de", "en", 0.99) == "de" and named("é" * 64, "de", "en", 0.99) == "en"
    assert named(long, "nl", "en", 0.99) == "nl"  # a language that the network never saw
    assert named(long, "en", "en", 0.99) == "en"

    texts = ["le la les une des est avec pour " * 9, "der die das und ist mit von zu " * 9] * 200
    df = documents(spark, [*texts, "le la les une des est avec pour " * 9, None, "12"], langs=[*["fr", "de"] * 200, "de", None, None])
    net = language_id.train(df)
    rows = language_id.keep_identified(df, net, 0.0, lang_col="lang").collect()
    assert Counter(r["lang"] for r in rows) == {"fr": 201, "de": 200}
    assert {tuple(r) for r in language_id.keep_identified(df, net, 0.0).collect()} == {tuple(r) for r in df.collect() if r["text"] not in (None, "12")}


@pytest.mark.parametrize("seed", range(3))
def test_groups_have_sequences_of_their_own_at_no_cost(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate((300, 100, 40)):
        for length in np.unique(np.minimum(4096, np.exp(rng.normal(6, 1.3, n)).astype(int) + 1)).tolist():
            rows.append((g, length, int(rng.integers(1, 5))))
    groups, lengths, counts = np.array(rows).T
    plan = packing.plan_groups(groups, lengths, counts, 4096, rest=2)
    per = np.bincount(lengths, counts, 4097).astype(np.int64)
    assert plan.sequences <= packing.plan_sequences(np.flatnonzero(per), per[per > 0], 4096).sequences
    places = {}
    for g, length, n in rows:
        at, offset = plan.place(np.full(n, g), np.full(n, length), np.arange(n))
        for s, o in zip(at.tolist(), offset.tolist(), strict=True):
            places.setdefault(s, []).append((o, length, g))
    for seq in places.values():
        end = 0
        for o, length, _ in sorted(seq):
            assert o == end
            end += length
        assert end <= 4096
    assert len(places) == plan.sequences
    alone = of_one_group([(s, g) for s, seq in places.items() for _, _, g in seq])[1]
    assert alone > 0.5 * plan.sequences


def test_no_group_is_kept_apart_where_that_costs_sequences():
    plan = packing.plan_groups(np.array([0, 1]), np.array([2000, 96]), np.array([300, 150]), 4096)
    assert plan.sequences == 150


def test_groups_that_are_null_small_or_alone(spark):
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    texts = [f"word{i} " * (1 + i % 40) for i in range(200)]
    langs = [None if i % 3 == 0 else "en" if i % 3 == 1 else f"rare{i}" for i in range(200)]
    for few in (langs, [None] * 200, ["en"] * 200):
        rows = packing.pack(documents(spark, texts, langs=few), queries.vocabulary(), capacity=200, group_col="lang").collect()
        check_packing(rows, list(enumerate(texts)), tokenizer, 200)
        assert all(r["lang"] == few[r["doc_id"]] for r in rows)
    assert packing.pack(documents(spark, []), queries.vocabulary(), group_col="lang").count() == 0
