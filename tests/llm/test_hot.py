from pyspark.sql import functions as F

from surfacegraph.llm import exact_dedup, hot

from .helpers import documents


def test_rows_of_hot_and_small_groups_meet_their_facts(spark):
    rows = spark.createDataFrame([(7, i) for i in range(500)] + [(i, i) for i in range(100, 140)] + [(None, 1), (-1, 1)], "k long, v long")
    groups = rows.where("k > 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"))
    joined = hot.join_groups(rows, groups, ["k"], "n")
    got = sorted((r["k"], r["v"], r["n"], r["low"]) for r in joined.collect())
    assert got == sorted([(7, i, 500, 0) for i in range(500)] + [(i, i, 1, i) for i in range(100, 140)])
    assert hot.join_groups(rows.limit(0), groups.limit(0), ["k"], "n").count() == 0


def test_a_large_group_of_copies_and_a_partitioned_filter(spark):
    texts = ["same text"] * 400 + ["same  text "] * 3 + [f"t{i % 50} u" for i in range(100)] + [f"only {i}" for i in range(60)]
    df = documents(spark, texts)
    for max_words in (1 << 21, 1):  # broadcast, and joined by shuffle
        rows = exact_dedup.mark_copies(df, max_words=max_words).collect()
        assert len(rows) == len(texts) and sum(r["kept"] for r in rows) == 1 + 50 + 60
        same = [r for r in rows if r["group_size"] == 403]
        assert len(same) == 403 and {r["keep_id"] for r in same} == {400}
        kept = exact_dedup.drop_copies(df, max_words=max_words)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])
