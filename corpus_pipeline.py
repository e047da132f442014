"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage works on all rows its predecessor kept. ``run`` writes every
stage's result to the shared folder and reads it again as the next one's
input, so a lost executor costs one stage's tasks at most.

Null, empty and blank texts have no letter and go in the first stage, so later
ones see none from ``run``; given such rows, exact and near dedup keep one of
them, mixing drops them, packing gives each its end id. Rows with a null or a
repeated id are documents of their own. Ties go to the smallest id. Extra
columns pass all stages but the last; an empty table stays empty.

The first stage's language is the column ``lang``: of rows without a label what
the network says, of others the label, unless the network contradicts it for
sure. Packing puts documents of one language together and returns it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surfacegraph.llm import exact_dedup, jaccard, language_id, mixing, packing
from surfacegraph.llm.queries import vocabulary
from surfacegraph.llm.workspace import keep, transient


#: Known words that a worker keeps in packing: the stages before have grown the executors' heaps, so workers hold less than in a job of their own.
KNOWN_WORDS = 50_000

#: Mean probability from which a document stays; single words and texts in several languages score low, so every score does.
LEAST_SCORE = 0.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, for which the network names no language; gives the others theirs where the label is null or wrong."""
    return language_id.keep_identified(docs, language_id.train(docs), least=LEAST_SCORE, lang_col="lang")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the longest stays, then the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of at least 0.8 (5 words a shingle) the smallest id stays: SimHash, covering LSH, exact check."""
    return jaccard.keep_one(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the entropy-balanced mix says; a copy is a row."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens, of one language as far as that costs no sequence."""
    return packing.pack(docs, vocabulary(), capacity=4096, end_id=1, words=KNOWN_WORDS, group_col="lang")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network decides in the first stage, which SQL cannot express;
#: tests/llm/test_pipeline.py compares ``run`` with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, on the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with transient(spark):  # a stage's working tables go when its result is written
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
