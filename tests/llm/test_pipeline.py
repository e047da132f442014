import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from surfacegraph.llm import language_id, queries

from .helpers import check_mix, documents, plain_targets, prose, smallest_reachable
from .test_jaccard import edited, plain_shingles, similar
from .test_simple_operators import SF, check_packing


def small_corpus(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").collect()[:80]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in base]
    rows += [(1000, base[0]["text"] + " ", "en", "src1", 1), (1001, base[2]["text"], "en", "src2", 1), (1002, "123 456", "en", "src2", 7), (1003, None, "en", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_decide_as_brute_force_does(spark):
    docs = small_corpus(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash", "mixing", "packing"]

    net = language_id.train(docs)
    rows = docs.collect()
    verdict = net.predict([r["text"] for r in rows])
    want = {r["doc_id"]: r for r, (lang, score) in zip(rows, verdict, strict=True) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
    now = stages["language_id"](spark, docs, SF)
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == set(want)
    assert {1002, 1003}.isdisjoint(want)

    groups = {}
    for r in want.values():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append(r)
    want = {r["doc_id"]: r for g in groups.values() for r in [min(g, key=lambda r: (-len(r["text"]), r["doc_id"]))]}
    now = stages["exact_dedup"](spark, now, SF)
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == set(want)

    ids = sorted(want)
    sets = [plain_shingles(want[i]["text"]) for i in ids]
    low = smallest_reachable(ids, lambda i, j: similar(sets[i], sets[j]))
    want = {i: want[i] for i, c in zip(ids, low, strict=True) if i == c}
    now = stages["simhash"](spark, now, SF)
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == set(want)

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in want.items()}
    per = Counter()
    for i, r in want.items():
        per[r["source"]] += size[i]
    goal = plain_targets(per)
    mixed = stages["mixing"](spark, now, SF)
    got = mixed.collect()
    assert mixed.columns == docs.columns
    taken, copies = Counter(), Counter(r["doc_id"] for r in got)
    assert max(copies.values()) <= 3 and set(copies) <= set(want)
    for r in got:
        assert r == want[r["doc_id"]]
        taken[r["source"]] += size[r["doc_id"]]
    smallest = {s: max(size[i] for i, r in want.items() if r["source"] == s) for s in goal}
    assert all(abs(taken[s] - t) <= smallest[s] for s, t in goal.items())

    packed = stages["packing"](spark, mixed, SF).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in got], Tokenizer.from_file(queries.vocabulary()))


def plain_run(rows):
    """(rows that reach the mix) by brute force: a letter, then exact copies, then near copies."""
    rows = [r for r in rows if any(unicodedata.category(c).startswith("L") for c in r["text"] or "")]
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append(r)
    first = lambda r: (-len(r["text"]), r["doc_id"] is None, r["doc_id"] or 0)
    rows = [min(g, key=first) for g in groups.values()]
    sets = [plain_shingles(r["text"]) for r in rows]
    group = smallest_reachable(list(range(len(rows))), lambda i, j: similar(sets[i], sets[j]))
    low = {}
    for r, c in zip(rows, group, strict=True):
        if r["doc_id"] is not None:
            low[c] = min(low.get(c, r["doc_id"]), r["doc_id"])
    return [r for r, c in zip(rows, group, strict=True) if r["doc_id"] is None or r["doc_id"] == low[c]]


def test_run_equals_brute_force(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").collect()[:60]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in base]
    near = [edited(prose(s, 150), s, e) for s in range(4) for e in (0, 1, 2, 3)]
    rows += [(2000 + i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(near)]
    a, b = prose(70, 90), prose(71, 90)
    rows += [(5, a, "en", "src0", 1), (9, a, "en", "src0", 1), (3002, b, "en", "src1", 1), (5, b, "en", "src1", 1)]  # one id, two texts, each a copy of another row's
    rows += [(None, prose(72 + i, 40), None, None, 1) for i in range(5)] + [(3003, prose(90, 40), "en", "src1", 1)] * 3
    rows += [(3004, None, "en", "src1", 0), (3005, "", "en", "src1", 0), (3006, "½ ① 12", "en", "src1", 0), (3007, "a", "fr", "src2", 1), (3008, b + " ", "en", "src2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    want = plain_run(df.collect())
    assert len(want) < len(rows) - 12
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    heads = Counter((r["doc_id"], r["ids_crc32"]) for r in packed if r["piece"] == 0)
    copies, docs = [], []
    for r in want:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [1]
        n = heads.pop((r["doc_id"], zlib.crc32(np.array(ids[:4096], "<u4").tobytes())), 0)
        copies.append((r, n))
        docs += [(r["doc_id"], r["text"])] * n
    assert not heads  # nothing else was packed
    per = Counter()
    for r, _ in copies:
        per[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    goal = plain_targets(per)
    check_mix([(r["source"], r["text"], goal[r["source"]], n * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r, n in copies])
    check_packing(packed, docs, tokenizer)


def test_stages_take_an_empty_table(spark):
    empty = documents(spark, []).drop("kept")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_every_text_with_a_letter_passes_language_id(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").collect()[:80]
    first = {r["lang"]: r["text"][:120] for r in base if r["lang"] and r["text"]}
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in base]
    words = {w for r in base for w in (r["text"] or "").split()[:3] if re.search(r"[^\W\d_]", w)}
    short = ["This.", "Thtion.", "Edrere.", "a", *sorted(words), " ".join(first.values())]
    rows += [(5000 + i, t, None, "s", len(t)) for i, t in enumerate(short)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    assert kept == {r[0] for r in rows if re.search(r"[^\W\d_]", r[1] or "")}
