import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from surfacegraph.llm import components, exact_dedup, language_id, packing, queries, simhash, text_tokens, token_files, url_filter, workspace

from .helpers import DOC_SCHEMA, documents, odd_texts, prose, smallest_reachable

SF = "/root/testdata/sf0.001"


def by_sql(sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return sorted(map(str, con.sql(sql).fetchall()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    rows = [tuple(r[c] for c in rel.columns) for r in df.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, rel.fetchall()))


# exact dedup


def test_exact_dedup_cases(spark):
    texts = [*odd_texts(), "a", "x y", "xy", "xy "]
    ids = [*range(len(texts) - 3), 90, 80, 80]
    rows = exact_dedup.mark_copies(documents(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    groups = {}
    for r in rows:
        groups.setdefault(r["text_sha256"], []).append(r)
    for g in groups.values():
        assert sum(r["kept"] for r in g) == 1
        assert {r["group_size"] for r in g} == {len(g)}
    xy = [r for r in rows if r["doc_id"] in (80, 90)]
    assert {r["keep_id"] for r in xy} == {80}  # three points each but for "xy", then the smaller id


def test_exact_dedup_null_ids_and_empty(spark):
    rows = exact_dedup.mark_copies(documents(spark, ["q", "q", "q"], [None, 5, None])).collect()
    assert [r["keep_id"] for r in rows] == [5, 5, 5] and sum(r["kept"] for r in rows) == 1
    assert exact_dedup.mark_copies(documents(spark, [])).count() == 0
    assert exact_dedup.drop_copies(documents(spark, [])).count() == 0


def test_exact_dedup_tiny_filter_is_still_exact(spark):
    texts = [prose(i % 700, 12) for i in range(1500)]
    df = documents(spark, texts)
    rows = exact_dedup.mark_copies(df, max_words=2).collect()
    assert sum(r["kept"] for r in rows) == len(set(texts)) and len(rows) == 1500
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}


# components and simhash


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(500, 600)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100}
    assert {got[i] for i in range(500, 600)} == {7} and got[3] == 3


@pytest.mark.parametrize("radius", [1, 4])
def test_masks_cover(radius):
    rng = np.random.default_rng(5)
    ms = [m & (2**64 - 1) for m in simhash.masks(radius)]
    assert len(ms) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        diff = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any(diff & m == 0 for m in ms)


@pytest.mark.parametrize("block", [4, 1024])
def test_link_components_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6)
    fps = set()
    for c in centres.tolist():
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.add(int(np.uint64(c) ^ np.uint64(sum(1 << int(i) for i in flips))))
    signed = sorted(f - 2**64 if f >> 63 else f for f in fps)
    got = {r["fp"]: r["component"] for r in simhash.link_components(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, block).collect()}
    want = smallest_reachable(signed, lambda i, j: bin((signed[i] ^ signed[j]) & (2**64 - 1)).count("1") <= 4)
    have = {}
    for f in signed:
        have.setdefault(got.get(f, f), set()).add(f)
    groups = {}
    for f, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(f)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, groups.values()))


def plain_fingerprint(text, k):
    import re

    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_query_equals_brute_force(spark):
    rows = queries.op4_simhash(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    fp = [plain_fingerprint(docs[i], 4) for i in ids]
    low = smallest_reachable(ids, lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fp, low, strict=True)}


def test_simhash_cases(spark):
    texts = odd_texts()
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert all(rows[i]["fingerprint"] == f"{plain_fingerprint(t, 4):016x}" for i, t in enumerate(texts))
    assert {rows[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert {rows[i]["component_id"] for i in (7, 8, 9)} == {7}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    df = documents(spark, ["k l m n o p", "k l m n o p", "k l m n o p", "other words are here now"], [None, 4, 4, 9])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "9", "None"]


# token ids


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.vocabulary())


def test_chunk_encoder_equals_the_library(tokenizer):
    import random

    rnd = random.Random(4)
    alphabet = [*"aBsTÉéσΣς가한🙂中̈́\u0085 \x1c\x0b\n\t  12,.!'\"-_", "'s", "'LL", "<|endoftext|>", "word", "Word,", "…"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(4000)] + [None, "z" * 3000, prose(3, 5000)]
    codec = text_tokens.ChunkEncoder(queries.vocabulary(), limit=500)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for t, ids in zip(part, codec.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies_go_text_by_text(name):
    codec = text_tokens.ChunkEncoder(queries.vocabulary(name))
    assert not codec.by_chunk
    assert np.frombuffer(codec.encode(["Hi  there"])[0], "<u4").tolist() == Tokenizer.from_file(queries.vocabulary(name)).encode("Hi  there").ids


def check_token_rows(rows, docs, tokenizer):
    start = 0
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert rows[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_query(spark, tokenizer):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op8_token_files(spark, SF).collect()}
    assert len(rows) == len(docs)
    check_token_rows(rows, docs, tokenizer)


def test_token_files_cases(spark, tokenizer):
    texts = odd_texts()
    folder = workspace.new_path(spark, "t")
    rows = token_files.read_token_files(token_files.write_token_files(documents(spark, texts, [None, *range(9, 20)]), folder, queries.vocabulary())).collect()
    assert sorted((r["start"], r["doc_id"]) for r in rows)[0] == (0, None)
    check_token_rows({r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows}, list(zip([None, *range(9, 20)], texts, strict=True)), tokenizer)
    empty = token_files.write_token_files(documents(spark, []), folder, queries.vocabulary())
    assert token_files.read_token_files(empty).count() == 0


# packing


def check_packing(rows, docs, tokenizer, capacity=4096):
    want = Counter()
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[(i, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in places.values():
        end = 0
        for offset, length in sorted(seq):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing_query(spark, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op6_packing(spark, SF).collect()
    used = check_packing(rows, docs, tokenizer)
    assert used <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_cases(spark, tokenizer):
    texts = odd_texts()
    ids = [None, 3, 3, *range(10, 19)]
    rows = packing.pack(documents(spark, texts, ids), queries.vocabulary(), capacity=50).collect()
    check_packing(rows, list(zip(ids, texts, strict=True)), tokenizer, 50)
    assert packing.pack(documents(spark, []), queries.vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(np.minimum(4096, np.exp(rng.normal(6, 1.3, 3000)).astype(int) + 1))
    counts = rng.integers(1, 30, len(lengths))
    plan = packing.plan_sequences(lengths, counts, 4096)
    per = Counter()
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        seq, off = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            per[s] += length
            assert o + length <= 4096
    assert set(per) == set(range(plan.sequences)) and max(per.values()) <= 4096
    assert plan.sequences <= 1.01 * (lengths * counts).sum() / 4096 + 2


def test_knapsack_is_optimal():
    sizes, worth = np.array([3, 5, 7]), np.array([3.0, 5.5, 7.2])
    combo = packing.knapsack(sizes, worth, 16)
    got = sum(worth[k] * n for k, n in combo.items())
    best = max(3 * a + 5.5 * b + 7.2 * c for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)
    assert abs(got - best) < 1e-9


# language


def test_language_id_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op9_language_id(spark, sf).collect()}
    ok = []
    for d in docs.collect():
        r = rows[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if r["held_out"] and r["lang_pred"] != "und":
            ok.append(r["lang_pred"] == d["lang"])
    assert len(rows) == docs.count() and np.mean(ok) > 0.9


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.ByteNet(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0, 1])

    def loss():
        return -np.log(net.probabilities(x)[np.arange(5), y]).mean()

    g = net.step(x, y)
    for name, at in (("d", (3, 1)), ("b", (0,)), ("w4", (7, 2)), ("emb", (int(x[0, 5]), 3))):
        keep, h = net.p[name][at], 1e-5
        net.p[name][at] = keep + h
        up = loss()
        net.p[name][at] = keep - h
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * h) - g[name][at]) < 1e-4


def test_language_cases(spark):
    texts = odd_texts() + ["1234 !!", "le la les une des est avec pour"]
    df = documents(spark, texts, [None, *range(1, len(texts))], ["en", None] * 7)
    net = language_id.train(df)
    rows = language_id.identify(df, net).collect()
    got = [r["lang_pred"] for r in rows]
    assert len(got) == len(texts) and got[:3] == ["und"] * 3 and got[12] == "und"
    assert language_id.keep_identified(df, net).columns == df.columns
    none = language_id.train(documents(spark, []))
    assert none.langs == [] and language_id.identify(df, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(documents(spark, []), net).count() == 0


def test_every_language_is_learned_and_letters_are_unicode_letters(spark):
    n = 260  # more labels than any earlier bound
    texts = [f"{chr(0x4E00 + i)}{chr(0x4E00 + 3 * i)} " * 40 for i in range(n) for _ in range(3)]
    df = documents(spark, texts, range(len(texts)), [f"l{i}" for i in range(n) for _ in range(3)])
    net = language_id.ByteNet
    fitted = []
    language_id.ByteNet = lambda langs: fitted.append(langs) or type("N", (), {"fit": lambda self, x, y: (len(x), sorted(set(y.tolist())))})()
    try:
        n_windows, classes = language_id.train(df, most_documents=100)
    finally:
        language_id.ByteNet = net
    learned = {f"l{i // 3}" for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5}
    assert set(fitted[0]) == learned and len(classes) == len(learned) > 200 and n_windows <= 5 * len(learned)
    small = language_id.train(documents(spark, ["le la les une des est avec pour", "der die das und ist mit von zu"] * 20, langs=["fr", "de"] * 20))
    odd = ["½ ²", "①", "Ⅷ", "1234 !!", "\u0301", "ª", "字", "ǅ", ""]
    assert [lang == "und" for lang, _ in small.predict(odd)] == [True, True, True, True, True, False, False, False, True]


# URLs


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1", "https://example.org/en/15?x", "http://org", "http://x.com/fr/a#b",
            "http://x.com/de/", "http://porn.example.net/", "http://a.net/adult/casino", "http://a.net/adult/adult", "http://a.net/essex/adults", "http://a.net://b/c"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = [url for url in url_filter.judge_urls(df, queries.URL_RULES).orderBy("page_id").collect()]
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/15", "example.org/en/1", "block"), ("org", "", None, "allow"),
        ("x.com", "/fr/a", "com/fr/", "allow"), ("x.com", "/de/", "com/de/", "block"), ("porn.example.net", "/", None, "block"),
        ("a.net", "/adult/casino", None, "block"), ("a.net", "/adult/adult", None, "allow"), ("a.net", "/essex/adults", None, "allow"), ("a.net:", "//b/c", None, "allow"),
    ]
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0
