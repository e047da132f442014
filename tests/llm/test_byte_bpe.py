"""Byte-level BPE against the library of the vocabulary's format, and its round trip."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from surfacegraph.llm import byte_bpe

from .helpers import documents, odd_texts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture
def encoder():
    return byte_bpe.Encoder(PATH, public_tokenizers.PATTERN)


def same(encoder, plain, texts):
    decoder = byte_bpe.Decoder(PATH)
    for text, ids in zip(texts, encoder.encode(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text or ""), text
        assert decoder.decode(ids).decode() == (text or "")


def test_white_space_and_apostrophes(encoder, plain):
    same(encoder, plain, [None, "", " ", "  ", "a  b", " a", "a ", "a\nb", "a\n b", "a \nb", "a  b", "a 　b", "it's 'll !'s", "×÷ª²é's"])


def test_random_texts(encoder, plain):
    rnd = random.Random(7)
    marks = "ab'sltré×1 2 \n\t\r\x1c .,!?-  漢字ñ́😀"
    same(encoder, plain, ["".join(rnd.choice(marks) for _ in range(rnd.randrange(60))) for _ in range(3000)])
    same(encoder, plain, ["".join(rnd.choice("etaoinshrd") for _ in range(rnd.randrange(1, 90))) for _ in range(1000)])


def test_every_kind_of_character(encoder, plain):
    same(encoder, plain, [f"a{c}1{c}{c} {c}b.{c}" for c in map(chr, (*range(0x3000), *range(0x1F300, 0x1F400)))])


def test_long_pieces_and_long_texts(encoder, plain, monkeypatch):
    rnd = random.Random(3)
    same(encoder, plain, ["z" * 5000, "ab" * 3000, "".join(rnd.choice("abcdefgh") for _ in range(9000))])
    monkeypatch.setattr(byte_bpe, "BLOCK", 50)  # texts of many blocks
    long = " ".join("".join(rnd.choice("abc1'é.!") for _ in range(rnd.randrange(1, 80))) for _ in range(300))
    same(encoder, plain, [long, long.replace("a ", "a  \n"), long + " " + long, "short", ""])


def test_table_of_known_chunks_is_bounded(plain):
    encoder = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN, limit=50)
    for start in range(0, 600, 100):
        same(encoder, plain, [f"word{i} it's {i}" for i in range(start, start + 100)])
    assert len(encoder.known) <= 50


def test_rows_and_columns(spark, plain):
    texts = [*odd_texts(), "same", "same"]
    docs = documents(spark, texts, ids=[None, 1, 1, *range(3, len(texts))])
    found = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert found.columns == [*docs.columns, "ids", "n_tokens", "decoded"]
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_null_and_unknown_ids(spark):
    one = spark.range(1).select(F.lit(None).cast("binary").alias("ids"))
    assert byte_bpe.decode(one, PATH).first()["decoded"] is None
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.Decoder(PATH).decode(b"\xff\xff\xff\x7f")
