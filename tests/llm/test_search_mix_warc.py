import gzip
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacegraph.llm import mixing, queries, topk, warc, workspace

from .helpers import check_mix, documents, odd_texts, plain_targets, prose

SF = "/root/testdata/sf0.001"


def brute_top_k(rows, k, is_query):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max([len(v) for _, v in good], default=0)
    ints = [(i, [int(np.floor(256 * float(x))) for x in v] + [0] * (width - len(v))) for i, v in good]
    out = {}
    for q, a in sorted(ints):
        if is_query(q) and q not in out:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def got_top_k(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_top_k_equals_brute_force_over_many_buckets(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12))
    rows = []
    for i in range(600):
        v = centres[i % 8] + rng.normal(scale=0.05, size=12)
        rows.append((i, [float(x) for x in v * np.exp(rng.normal() * spread)]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_top_k(rows, 4, lambda i: i % 7 == 0)
    for tile_bytes in (topk.TILE, 3 * 8 * 12 * (32 + 16), 1):
        assert got_top_k(topk.top_k(df, F.col("vec_id") % 7 == 0, k=4, bucket=32, block=16, tile_bytes=tile_bytes)) == want


def test_top_k_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, [1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [9.0, 9.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, []), (100, [-1.0, -0.001])]
    df = spark.createDataFrame([(i, v, "r") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = got_top_k(topk.top_k(df, F.col("vec_id") % 50 == 0))
    assert got == brute_top_k(rows, 5, lambda i: i % 50 == 0)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    for x in (1e30, 2.0**23.6):
        far = spark.createDataFrame([(0, [x, x]), (1, [x, -x])], "vec_id long, embedding array<double>")
        with pytest.raises(OverflowError):
            topk.top_k(far, F.col("vec_id") % 50 == 0)
    rows = [(0, [2.0**22, 3.5]), (1, [2.0**22, -1.0]), (2, [-(2.0**22), 1.0])]
    assert got_top_k(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)) == brute_top_k(rows, 5, lambda i: i % 50 == 0)
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(alone, F.col("vec_id") % 50 == 0).count() == 0


# mixing


def test_targets_stop_at_three_times(spark):
    per = {"b": 1000, None: 10, "a": 20, "é": 500}
    df = spark.createDataFrame([(s, n, 1) for s, n in per.items()], "source string, words long, docs long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    # a weighs 5, b 2, é 1, null 5
    assert got["a"] == 60 and got[None] == 30
    assert abs(got["b"] / got["é"] - 2) < 1e-9 and abs(sum(got.values()) - 1530) < 1e-6
    many = {f"{i:x}": 1 + (7 * i) % 101 for i in range(700)}
    df = spark.createDataFrame([(s, n, 1) for s, n in many.items()], "source string, words long, docs long")
    want = plain_targets(many)
    rows = mixing.targets(df).collect()
    assert len(rows) == 700 and all(abs(r["target"] - want[r["source"]]) < 1e-9 * want[r["source"]] for r in rows)
    assert sorted(r["src"] for r in rows) == list(range(700))


def test_mixing_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_mixing(spark, sf).collect()
    again = queries.op2_mixing(spark, sf).collect()
    assert sorted(rows) == sorted(again)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    per = {}
    for d in docs.values():
        per[d["source"]] = per.get(d["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    assert len(rows) == len(docs)
    assert all(r["source_size"] == per[docs[r["doc_id"]]["source"]] and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or "")) for r in rows)
    check_mix([(docs[r["doc_id"]]["source"], docs[r["doc_id"]]["text"], r["target"], r["taken"]) for r in rows])


def test_mixing_cases(spark):
    texts = [*odd_texts()[:10], *[prose(i % 5, 7) for i in range(300)]]
    sources = [None if i % 11 == 0 else "aé"[i % 2] for i in range(len(texts))]
    ids = [None, 3, 3, *range(10, len(texts) + 7)]
    df = documents(spark, texts, ids, sources=sources)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts)
    by = {(r["doc_id"], r["size"], r["source"]): r["copies"] for r in rows if r["size"] and r["doc_id"] is not None}
    out = mixing.mixed(df)
    got = Counter((r["doc_id"], len(r["text"].split()), r["source"]) for r in out.collect())
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in rows if r["size"])
    assert {k: n for k, n in by.items() if n} == {k: n for k, n in got.items() if k in by}
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mixed(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.mixed(documents(spark, [None, ""])).count() == 0


def test_rows_without_ids_and_repeated_rows_meet_their_target(spark):
    texts = ["a b c d e"] * 1000 + ["f g"] * 500 + ["h i j"] * 10 + [prose(s, 6) for s in range(200)]
    sources = ["s"] * 1000 + ["t"] * 500 + [None] * 10 + ["s"] * 200
    ids = [None] * 1000 + [7] * 500 + [None] * 10 + [None] * 200
    df = documents(spark, texts, ids, sources=sources)
    rows = mixing.mix(df).collect()
    assert len({r["row"] for r in rows}) == len(texts)
    text = {("s", 5): "a b c d e", ("t", 2): "f g", (None, 3): "h i j", ("s", 6): "a b c d e f"}
    check_mix([(r["source"], text[r["source"], r["size"]], r["target"], r["taken"]) for r in rows])
    got = Counter((r["source"], len(r["text"].split())) for r in mixing.mixed(df).collect())
    want = Counter()
    for r in rows:
        want[r["source"], r["size"]] += r["copies"]
    assert got == +want


def test_a_large_bin_is_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)
    texts, sources = ["a b c"] * 700 + ["d e"] * 300, ["s"] * 700 + ["t"] * 300
    rows = mixing.mix(documents(spark, texts, sources=sources), weights=(1, 3)).collect()
    want = plain_targets({"s": 2100, "t": 600}, (1, 3))
    for s in "st":
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - want[s]) <= 3


# WARC


def test_records_round_trip():
    parts = [warc.record(1, "http://a/\r\nx", b"<p>\r\n\r\nhi", None, "d"), warc.record(2, None, b"", 1, "d"), warc.record(None, "é", "ü".encode() * 9000, None, "d")]
    archive = b"".join(gzip.compress(p) for p in parts)
    for chunk in (1, 7, 1 << 20):
        got = [warc._row(r, True) for r in warc.read_records(io.BytesIO(archive), chunk)]
        assert [g["page_id"] for g in got] == [1, 2, None] and all(g["verified"] for g in got)
        assert got[0]["payload"] == b"<p>\r\n\r\nhi" and got[1]["refers_to"] == 1 and got[2]["payload_bytes"] == 18000


def test_broken_archives_are_noticed():
    good = warc.record(1, "u", b"payload", None, "d")
    assert not next(warc.read_records(io.BytesIO(gzip.compress(good.replace(b"payload", b"Payload"))))).verify()
    with pytest.raises(warc.Framing):
        list(warc.read_records(io.BytesIO(gzip.compress(good)[:-9])))
    with pytest.raises(warc.Framing):
        list(warc.read_records(io.BytesIO(gzip.compress(good + b"x"))))


def test_every_cut_of_an_archive_is_noticed():
    members = [gzip.compress(warc.record(i, "http://a/b", bytes(range(65, 91)) * 20 * i, None, "d")) for i in (1, 2, 40)]
    whole, ends = b"".join(members), {0, len(members[0]), len(members[0]) + len(members[1])}
    for chunk in (5, warc.CHUNK):
        for cut in range(len(whole)):
            if cut in ends:
                assert len(list(warc.read_records(io.BytesIO(whole[:cut]), chunk))) < 3
                continue
            with pytest.raises((warc.Framing, zlib.error)):
                list(warc.read_records(io.BytesIO(whole[:cut]), chunk))


def test_a_record_is_framed_before_its_member_is_inflated():
    bomb = gzip.compress(warc.record(1, "u", b"p", None, "d") + b"\0" * 50_000_000)
    stream = io.BytesIO(bomb)
    with pytest.raises(warc.Framing):
        next(warc.read_records(stream))
    assert stream.tell() < len(bomb) / 2
    short = warc.record(1, "u", b"payload", None, "d").replace(b"Content-Length: ", b"Content-Length: 9", 2)
    with pytest.raises(warc.Framing):
        list(warc.read_records(io.BytesIO(gzip.compress(short))))


def test_rows_that_share_an_id_are_different_records():
    names = {warc.record(1, "u", p, None, "d").split(b"Record-ID: ")[1].split(b"\r\n")[0] for p in (b"a", b"b")}
    assert len(names) == 2


def test_warc_cases(spark):
    html = [None, "", "same", "same", "same", "x" * 200_000, "same"]
    ids = [4, 3, 9, 7, None, 8, 9]
    df = spark.createDataFrame([(i, None, h, "z") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, sha string")
    rows = warc.read_warc(warc.write_warc(df, workspace.new_path(spark, "w"), file_bytes=200), payloads=True).collect()
    assert len(rows) == 7 and all(r["verified"] for r in rows)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows)
    assert got == [("3", "response", None), ("4", "revisit", 3), ("7", "response", None), ("8", "response", None), ("9", "revisit", 7), ("9", "revisit", 7), ("None", "response", None)]
    some = warc.read_warc(warc.write_warc(df, workspace.new_path(spark, "w"), min_bytes=5)).where("record_type = 'revisit'")
    assert some.count() == 0
    assert warc.read_warc(warc.write_warc(df.limit(0), workspace.new_path(spark, "w"))).count() == 0
