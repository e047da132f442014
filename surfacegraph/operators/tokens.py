"""Design tokens: binding styles to tokens, drift, references, export.

What a style matches depends on its text alone, so texts are matched once each,
however many nodes have them. Equal texts, colours and lengths are equi-joins.
The nearest colour is searched in cells of all three channels, small ones
first, and the nearest length between its neighbours in sorted order, so work
grows with styles and tokens, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.css import guess_type, parse_color, parse_length, rgb_to_hex
from ..functions.js import round_to
from ..plans.lineage import stored

# The largest drifts, and where severities change.
COLOR_DRIFT = 35.0
LENGTH_DRIFT = 3.0
DTCG_TYPES = ("color", "dimension", "fontFamily", "fontWeight", "duration", "cubicBezier", "number", "string", "boolean")
#: Rows of a table that is sent to every task; a larger one is joined by a shuffle.
MOST_SENT = 50_000
# Widths of the colour cells that are searched before those as wide as the largest drift.
_RINGS = (4, 12)
# From a cell's number to those around it.
_STEPS = [x * 1000000 + y * 1000 + z for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]


def properties(nodes: DataFrame) -> DataFrame:
    """(page_id, ax_id, property, value): the styles of nodes that have a value."""
    e = nodes.select("page_id", "ax_id", F.explode("style").alias("property", "raw"))
    return e.select("page_id", "ax_id", "property", F.trim("raw").alias("value")).where("value <> ''")


def _meet(styles: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The inner join of ``styles`` with a row a text, or a key.

    Rows of ``few`` are counted, as sizes that the planner estimates mislead
    here: exploded styles look smaller than tokens made in the driver, and
    would be collected there to be broadcast.
    """
    few = stored(few)
    return styles.join(F.broadcast(few) if few.count() <= MOST_SENT else few.hint("merge"), key)


def _rgb(c: Column) -> Column:
    """The channels as one number; a transform, so that the colour is parsed once."""
    return F.transform(F.array(c), lambda x: x["r"] * 65536 + x["g"] * 256 + x["b"])[0]


def _channels(rgb: str | Column) -> list[Column]:
    c = F.col(rgb) if isinstance(rgb, str) else rgb
    return [F.shiftright(c, 16), F.shiftright(c, 8).bitwiseAND(255), c.bitwiseAND(255)]


def _first(tokens: DataFrame, key: str) -> DataFrame:
    """(key, token): the first token of each key."""
    return tokens.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("token").alias("token"))


def _equal_length(lengths: DataFrame, tokens: DataFrame) -> DataFrame:
    """(px, by_px): the first token within 0.01 pixels. ``tokens``: token_px, token, a row a length."""
    at = F.floor(F.col("token_px") * 50)
    cells = tokens.select(F.explode(F.array(at - 1, at, at + 1)).alias("cell"), "token_px", "token")
    near = lengths.withColumn("cell", F.floor(F.col("px") * 50)).join(cells, "cell").where(F.abs(F.col("px") - F.col("token_px")) < 0.01)
    return near.groupBy("px").agg(F.min("token").alias("by_px"))


def nearest_color(colors: DataFrame, tokens: DataFrame, limit: float = COLOR_DRIFT) -> DataFrame:
    """(rgb, near): for each different ``rgb`` the nearest token colour within ``limit``, as struct(dist, token); null if there is none.

    ``tokens``: token_rgb, token, a row a colour; of equally near ones the least
    token counts. Colours meet the tokens of the 27 cells around them, which
    hold all within a cell's width; only those without a token so near go on to
    wider cells. A cell of width w holds w^3 different colours at most, so no
    cell grows with the tables.
    """
    found = colors.withColumn("near", F.lit(None).cast(f"struct<dist:double,token:{tokens.schema['token'].dataType.simpleString()}>"))
    widest = max(int(limit) + 1, 1)
    for w in [*[w for w in _RINGS if w < widest], widest]:

        def cell(rgb: str) -> Column:
            r, g, b = (F.floor(c / w) for c in _channels(rgb))
            return (r * 1000000 + g * 1000 + b).cast("int")

        # settled colours keep a row of their own: negative cells have no token and spread over the tasks
        apart = (F.lit(-2000000) - F.pmod(F.xxhash64("rgb"), F.lit(1 << 30))).cast("int")
        stepped = found.withColumn("step", F.explode(F.when(F.col("near").isNull(), F.array(*map(F.lit, _STEPS))).otherwise(F.array(F.lit(0)))))
        cells = tokens.select(cell("token_rgb").alias("cell"), "token_rgb", "token")
        met = stepped.withColumn("cell", F.when(F.col("near").isNull(), cell("rgb") + F.col("step")).otherwise(apart)).join(cells, "cell", "left")
        square = sum(((a - b) * (a - b) for a, b in zip(_channels("rgb"), _channels("token_rgb"))), F.lit(0))
        hit = F.when((square > 0) & (square <= min(float(w), limit) ** 2), F.struct(F.sqrt(square.cast("double")).alias("dist"), "token"))
        found = met.groupBy("rgb").agg(F.coalesce(F.max("near"), F.min(hit)).alias("near"))
    return found


def nearest_length(lengths: DataFrame, tokens: DataFrame, limit: float = LENGTH_DRIFT) -> DataFrame:
    """(px, near): for each different ``px`` the nearest token length within ``limit``, as struct(dist, token); null if there is none.

    ``tokens``: token_px, token, a row a length. Lengths and tokens of a cell
    are sorted; a length's nearest tokens are the last before and the first after it.
    """
    width = int(limit) + 1
    at = F.floor(F.col("token_px") / width)
    t = tokens.select(F.explode(F.array(at - 1, at, at + 1)).alias("cell"), F.col("token_px").alias("at"), F.struct("token_px", "token").alias("t"))
    v = lengths.select(F.floor(F.col("px") / width).alias("cell"), F.col("px").alias("at"), F.lit(None).cast(t.schema["t"].dataType).alias("t"))
    order = Window.partitionBy("cell")
    below = F.last("t", ignorenulls=True).over(order.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    above = F.last("t", ignorenulls=True).over(order.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0))
    both = v.unionByName(t).withColumns({"below": below, "above": above}).where("t is null")

    def hit(c: str) -> Column:
        d = F.abs(F.col("at") - F.col(c)["token_px"])
        return F.when((d > 0) & (d <= limit), F.struct(d.alias("dist"), F.col(c)["token"].alias("token")))

    return both.select(F.col("at").alias("px"), F.least(hit("below"), hit("above")).alias("near"))


def matches(values: DataFrame, tokens: DataFrame, color_drift: float = COLOR_DRIFT, length_drift: float = LENGTH_DRIFT, drifting: bool = True) -> DataFrame:
    """(value, bound, drift): what each different style text binds to, else what it is near to, in one pass.

    ``bound``: struct(path, token_value, match_type, confidence); ``drift``:
    struct(path, token_value, delta, severity); one of them at most, neither
    for a text far from all tokens. ``values``: value, a row a text;
    ``tokens``: path, value, seq. Null or empty tokens match nothing. Without
    ``drifting`` the nearest tokens are not searched.
    """
    token = F.struct(F.col("seq").alias("token_seq"), "path", F.col("value").alias("token_value"))
    t = tokens.where("value is not null").select(
        F.trim("value").alias("text"), _rgb(parse_color("value")).alias("token_rgb"), parse_length("value").alias("token_px"), token.alias("token")
    )
    v = stored(values.select("value", _rgb(parse_color("value")).alias("rgb"), parse_length("value").alias("px")))
    texts, hues, sizes = _first(t, "text"), _first(t, "token_rgb"), _first(t, "token_px")
    colors, lengths = (v.where(F.col(c).isNotNull()).select(c).distinct() for c in ("rgb", "px"))
    by_px = _equal_length(lengths, sizes)
    met = (
        v.join(texts.select(F.col("text").alias("value"), F.col("token").alias("by_text")), "value", "left")
        .join(hues.select(F.col("token_rgb").alias("rgb"), F.col("token").alias("by_rgb")), "rgb", "left")
        .join(by_px, "px", "left")
    )
    b = F.coalesce("by_text", "by_rgb", "by_px")
    kind = F.when(F.col("by_text").isNotNull(), "exact").otherwise("normalized")
    sure = F.when(F.col("by_text").isNotNull(), 1.0).when(F.col("by_rgb").isNotNull(), 0.98).otherwise(0.95)
    bound = F.struct(b["path"].alias("path"), b["token_value"].alias("token_value"), kind.alias("match_type"), sure.alias("confidence"))
    if not drifting:
        return met.select("value", F.when(b.isNotNull(), bound).alias("bound"))
    near_rgb = nearest_color(colors.join(hues, F.col("rgb") == F.col("token_rgb"), "left_anti"), hues, color_drift)
    near_px = nearest_length(lengths.where("px > 0").join(by_px, "px", "left_anti"), sizes.where("token_px > 0"), length_drift)
    met = met.join(near_rgb.withColumnRenamed("near", "near_rgb"), "rgb", "left").join(near_px.withColumnRenamed("near", "near_px"), "px", "left")
    # a value that is a colour is never compared as a length
    n, colored = F.when(F.col("rgb").isNotNull(), F.col("near_rgb")).otherwise(F.col("near_px")), F.col("rgb").isNotNull()
    low, mid = F.when(colored, 15.0).otherwise(1.0), F.when(colored, 25.0).otherwise(2.0)
    severity = F.when(n["dist"] <= low, "low").when(n["dist"] <= mid, "medium").otherwise("high")
    drift = F.struct(n["token"]["path"].alias("path"), n["token"]["token_value"].alias("token_value"), round_to(n["dist"], 2).alias("delta"), severity.alias("severity"))
    return met.select("value", F.when(b.isNotNull(), bound).alias("bound"), F.when(b.isNull() & n.isNotNull(), drift).alias("drift"))


def judged(nodes: DataFrame, tokens: DataFrame, color_drift: float = COLOR_DRIFT, length_drift: float = LENGTH_DRIFT) -> DataFrame:
    """(page_id, ax_id, property, value, bound, drift): every style with what it binds to and what it is near to, as in :func:`matches`."""
    p = properties(nodes)
    return _meet(p, matches(p.select("value").distinct(), tokens, color_drift, length_drift), "value").select("page_id", "ax_id", "property", "value", "bound", "drift")


def bindings(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(page_id, ax_id, property, value, path, token_value, match_type, confidence).

    A property binds to the first token of equal text (1.0), else of equal
    colour (0.98), else of equal length to 0.01 pixels (0.95).
    ``tokens``: path, value, seq.
    """
    p = properties(nodes)
    bound = matches(p.select("value").distinct(), tokens, drifting=False).where("bound is not null")
    return _meet(p, bound, "value").select("page_id", "ax_id", "property", "value", "bound.*")


def drifts(nodes: DataFrame, tokens: DataFrame, color_drift: float = COLOR_DRIFT, length_drift: float = LENGTH_DRIFT) -> DataFrame:
    """(page_id, ax_id, property, value, path, token_value, delta, severity) of styles near, but off, a token.

    The nearest token counts, the first of equally near ones. A value that is a
    colour is never compared as a length.
    """
    return judged(nodes, tokens, color_drift, length_drift).where("drift is not null").select("page_id", "ax_id", "property", "value", "drift.*")


def lint(nodes: DataFrame, tokens: DataFrame, page_id: str | None = None) -> DataFrame:
    """Drift of all nodes, or of one page's."""
    return drifts(nodes if page_id is None else nodes.where(F.col("page_id") == page_id), tokens)


def references(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(page_id, ax_id, refs): tokens whose text, or hex colour, some style of the node has, each once."""
    p = properties(nodes)
    t = tokens.select("path", F.col("seq").alias("token_seq"), F.trim("value").alias("text"), rgb_to_hex("value").alias("hex"))
    keyed = p.select("page_id", "ax_id", F.explode(F.array_distinct(F.array(F.concat(F.lit("="), "value"), F.concat(F.lit("#"), rgb_to_hex("value"))))).alias("key"))
    keys = t.select("path", "token_seq", F.explode(F.array(F.concat(F.lit("="), "text"), F.concat(F.lit("#"), "hex"))).alias("key")).where("key is not null")
    hits = _meet(keyed.where("key is not null"), keys, "key").select("page_id", "ax_id", "path", "token_seq").distinct()
    return hits.groupBy("page_id", "ax_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("token_seq", "path"))), lambda x: x["path"]).alias("refs"))


def token_type(value: str | Column, declared: str | Column) -> Column:
    """The declared type, else the guessed one."""
    d = F.col(declared) if isinstance(declared, str) else declared
    return F.coalesce(F.nullif(d, F.lit("")), guess_type(value))


def export_counts(tokens: DataFrame) -> DataFrame:
    """(type, n): tokens by DTCG type; unknown types count as string; types without tokens are zero."""
    kind = token_type("value", "type")
    kind = F.when(kind.isin(*DTCG_TYPES), kind).otherwise("string")
    counted = tokens.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    types = tokens.sparkSession.createDataFrame([(t,) for t in DTCG_TYPES], "type string")
    return types.join(counted, "type", "left").select("type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def detached(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(ax_id, path): tokens that nodes referred to before and no longer do. Both: ax_id, refs."""
    before = baseline.select("ax_id", F.explode("refs").alias("path"))
    return before.join(candidate.select("ax_id", F.explode("refs").alias("path")), ["ax_id", "path"], "left_anti").distinct()


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
