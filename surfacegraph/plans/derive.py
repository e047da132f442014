"""Projections of the driver's tables onto the catalog's schemas.

Scalar expressions are kept as text that Spark SQL and ANSI engines both read,
so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import rect

K = "p_partkey"


def cases(of: str, n: int, values: dict[int, str], other: str) -> str:
    return f"CASE {of} % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


#: Styles of visual nodes, by name.
STYLES = {
    "position": cases(K, 7, {0: "'fixed'", 1: "'sticky'", 2: "'absolute'"}, "'static'"),
    "display": cases(K, 11, {0: "'grid'", 1: "'flex'", 2: "'none'"}, "'block'"),
    "backgroundColor": f"concat('rgb(', {K} % 256, ', ', ({K} * 7) % 256, ', ', ({K} * 13) % 256, ')')",
    "opacity": f"CASE WHEN {K} % 3 = 0 THEN '0.5' ELSE '1' END",
    "cursor": f"CASE WHEN {K} % 4 = 0 THEN 'pointer' ELSE 'auto' END",
    "fontSize": f"concat(8 + {K} % 20, 'px')",
    "zIndex": f"cast({K} % 5 AS varchar(10))",
    "padding-left": f"concat({K} % 9, 'px')",
    "border-top-width": f"concat({K} % 4, 'px')",
    "margin-left": f"concat({K} % 13, 'px')",
    "border-radius": f"concat({K} % 20, 'px')",
    "boxShadow": f"CASE WHEN {K} % 6 = 0 THEN '0 1px 2px' ELSE 'none' END",
    "width": cases(K, 5, {0: "'50%'", 1: "'100px'", 2: "'calc(100% - 2px)'"}, "''"),
    "flex-wrap": f"CASE WHEN {K} % 8 = 0 THEN 'wrap' ELSE 'nowrap' END",
}
COLUMNS = {
    "page_id": "p_brand",
    "id": f"concat('v', {K})",
    "ax_id": f"concat('a', {K})",
    "x": f"cast(({K} * 37) % 1440 AS double)",
    "y": f"cast(({K} * 91) % 900 AS double)",
    "w": "cast(20 + p_size AS double)",
    "h": "cast(10 + p_size AS double)",
    "z": f"cast({K} % 5 AS int)",
    "parent": f"CASE WHEN {K} % 10 <> 0 THEN concat('v', {K} - {K} % 10) END",
    "role": cases(K, 9, {0: "'dialog'", 1: "'button'", 2: "'alert'", 3: "'group'", 4: "'link'"}, "'generic'"),
    "name": f"CASE WHEN {K} % 5 = 0 THEN 'Close' ELSE p_name END",
    "container_type": cases(K, 6, {0: "'container'", 1: "'wrapper'"}, "'none'"),
    "seq": K,
}
#: Larger boxes, for rules that look at the whole viewport.
LARGE = {"w": f"cast(20 + ({K} * 53) % 1450 AS double)", "h": f"cast(20 + ({K} * 29) % 800 AS double)", "x": f"cast(({K} * 37) % 700 AS double)", "y": f"cast(({K} * 91) % 880 AS double)"}
TOKENS = (
    ("color.a", "#000000", "color"), ("color.b", "rgb(10, 70, 130)", "color"), ("color.c", "#64bc14", "color"), ("color.d", "#c8783c", "color"), ("color.e", "rgb(120, 72, 24)", "color"),
    ("size.s", "8px", "dimension"), ("size.m", "1rem", "dimension"), ("size.l", "18pt", "dimension"), ("size.x", "3px", "dimension"), ("text.auto", "auto", ""), ("flag", "true", "boolean"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task turns into nodes or trees.
SPREAD = 20_000


def spread(rows: DataFrame, key: str, most: int = SPREAD) -> DataFrame:
    """``rows`` of a stored table over so many tasks that each has about ``most``.

    Stored rows are narrow, so a file of few splits has millions of them; what
    is made of each is a hundred times as wide, or runs in Python.
    """
    parts = -(-rows.count() // most)  # from the files' footers
    return rows if parts <= 1 else rows.repartition(parts, key)


def visual_sql(large: bool = False, where: str = "TRUE") -> str:
    """The visual nodes as a query over ``part``; styles are columns named s_*."""
    cols = COLUMNS | (LARGE if large else {})
    parts = [f"{e} AS {n}" for n, e in cols.items()] + [f'{e} AS s_{style_column(n)}' for n, e in STYLES.items()]
    return f"SELECT {', '.join(parts)} FROM part WHERE {where}"


def style_column(name: str) -> str:
    return name.replace("-", "_").lower()


def visual(spark: SparkSession, sf_dir: str, large: bool = False, where: str = "TRUE") -> DataFrame:
    """Visual nodes with rect and style, from ``part``."""
    cols = COLUMNS | (LARGE if large else {})
    part = spread(table(spark, sf_dir, "part"), K).where(where)
    styles = F.create_map(*[x for n, e in STYLES.items() for x in (F.lit(n), F.expr(e.replace("varchar(10)", "string")))])
    df = part.select(*[F.expr(e).alias(n) for n, e in cols.items()], styles.alias("style"))
    return df.withColumn("rect", rect("x", "y", "w", "h")).drop("x", "y", "w", "h")


def tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, v, "str", t, None, i) for i, (p, v, t) in enumerate(TOKENS)], "path string, value string, value_kind string, type string, description string, seq bigint").coalesce(1)


def tokens_sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{v}', '{t}', {i})" for i, (p, v, t) in enumerate(TOKENS)) + ") t(path, value, type, seq)"


TREE_PARTS = (
    ("nation", "concat('r', n_regionkey)", "concat('n', n_nationkey)", "n_nationkey"),
    ("customer", "concat('n', c_nationkey)", "concat('c', c_custkey)", "1000 + c_custkey"),
    ("orders", "concat('c', o_custkey)", "concat('o', o_orderkey)", "100000000 + o_orderkey"),
)


def tree_edges(spark: SparkSession, sf_dir: str, kind: str = "a11y:child-of") -> DataFrame:
    """region, nation, customer, orders as edges from parent to child."""
    out = None
    for name, src, dst, seq in TREE_PARTS:
        one = table(spark, sf_dir, name).select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit("derived").alias("provenance"), F.expr(f"cast({seq} AS bigint)").alias("seq"))
        out = one if out is None else out.unionByName(one)
    return out


def tree_sql() -> str:
    return " UNION ALL ".join(f"SELECT {src} AS src, {dst} AS dst, CAST({seq} AS BIGINT) AS seq FROM {name}" for name, src, dst, seq in TREE_PARTS)


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name) of every node of the tree."""
    parts = (("region", "concat('r', r_regionkey)", "r_name"), ("nation", "concat('n', n_nationkey)", "n_name"), ("customer", "concat('c', c_custkey)", "c_name"), ("orders", "concat('o', o_orderkey)", "o_orderstatus"))
    out = None
    for name, i, n in parts:
        one = table(spark, sf_dir, name).select(F.expr(i).alias("id"), F.expr(n).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def tree_nodes_sql() -> str:
    return (
        "SELECT concat('r', r_regionkey) AS id, r_name AS name FROM region UNION ALL SELECT concat('n', n_nationkey), n_name FROM nation "
        "UNION ALL SELECT concat('c', c_custkey), c_name FROM customer UNION ALL SELECT concat('o', o_orderkey), o_orderstatus FROM orders"
    )


ROLES = cases("c_custkey", 8, {0: "'button'", 1: "'link'", 2: "'tab'", 3: "'tabpanel'", 4: "'textbox'", 5: "'heading'"}, "'generic'")
AX = {"id": "concat('ax', c_custkey)", "page_id": "concat('page', c_custkey % 40)", "role": ROLES, "name": "CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END", "seq": "c_custkey"}
PAGES = {"id": "concat('page', page_id)", "canonical_url": "url", "url": "url", "title": "concat('Page ', page_id)", "load_status": cases("page_id", 10, {3: "'timeout'", 7: "'spa-error'", 8: "'interactive'"}, "'complete'"), "seq": "page_id"}
CAPS = {"id": f"concat('cap', {K})", "name": "p_name", "page_id": f"concat('page', {K} % 60)", "ax_id": f"concat('ax', {K})", "seq": K}


def projected(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).select(*[F.expr(e).alias(n) for n, e in columns.items()])


def sql(name: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {name}"


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970, to the nearest (halves away from zero) and not cut off, as SQL's ``epoch_ms`` has them."""
    return F.round(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_type, next_type, ts, event_id): each event and the user's next."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("next_type", F.lead("event_type").over(w))


STEPS_SQL = "SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events"
