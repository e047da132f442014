"""The contract queries: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, language_id, merkle, mixing, packing, simhash, spelling, sql, suffix_dedup, token_files, topk, url_filter, warc, workspace

#: Rules of the URL query: (verdict, host/path).
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace.new_path(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents")).drop("row")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=1)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace.new_path(spark, "token-files")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=2)
    return token_files.read_token_files(manifest)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    def misspelled(run: Column) -> Column:
        """One run in 199, told by a checksum, lacks a character."""
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
        at = (h % F.char_length(run)).cast("int")
        return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)

    words = spelling.count_words(table(spark, sf_dir, "documents"), least=6, n=5, spelled=misspelled, shrinks=1)
    return spelling.variants(words, ratio=5)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.manifest(table(spark, sf_dir, "documents"), columns, group="source", order="doc_id", arity=3, check={"text": text})
    found = found.withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("proof")))
    proof = merkle.proof_digest(F.col("proof")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    back = byte_bpe.decode(coded.drop("text"), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": op1_top_k,
        "op2_mixing": op2_mixing,
        "op3_warc": op3_warc,
        "op4_simhash": op4_simhash,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_packing": op6_packing,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_token_files": op8_token_files,
        "op9_language_id": op9_language_id,
        "op10_url_filter": op10_url_filter,
        "op11_spelling": op11_spelling,
        "op12_merkle": op12_merkle,
        "op13_byte_bpe": op13_byte_bpe,
    }


def _url_oracle() -> str:
    url = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def hit(term: str) -> str:
        return f"CAST(regexp_matches({url}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INT)"

    strict = " + ".join(map(hit, url_filter.STRICT))
    soft = " + ".join(map(hit, url_filter.SOFT))
    # the contract's rules, longest first, written out
    best = """CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'block:example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'block:example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'allow:com/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'block:com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'allow:org/' END"""
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url,
             CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
     c AS (SELECT page_id, host, path, {best} AS fit, CAST({strict} AS INT) AS strict_hits, CAST({soft} AS INT) AS soft_hits FROM b)
SELECT page_id, host, path, split_part(fit, ':', 2) AS rule,
       CASE WHEN fit IS NOT NULL THEN split_part(fit, ':', 1) WHEN strict_hits > 0 OR soft_hits >= {url_filter.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits FROM c"""


_EXACT_ORACLE = r"""
WITH a AS (SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     b AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM a)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM b"""


_TOP_K_ORACLE = """
WITH e AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""


def _warc_oracle() -> str:
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # five hex digits are twenty bits, four digits of base32
    letters = " || ".join(
        f"substr('{digits}', CAST((CAST('0x' || substr(sha, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * k}) & 31 AS INT) + 1, 1)"
        for g in range(8)
        for k in range(4)
    )
    return f"""
WITH a AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     b AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS sha, min(page_id) OVER (PARTITION BY payload) AS first FROM a)
SELECT page_id, payload_bytes, {letters} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, TRUE AS verified FROM b"""


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": _TOP_K_ORACLE, "op3_warc": _warc_oracle(), "op5_exact_dedup": _EXACT_ORACLE, "op10_url_filter": _url_oracle(), "op11_spelling": sql.SPELLING, "op12_merkle": sql.MERKLE}
