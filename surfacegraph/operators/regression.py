"""Visual regression between a baseline and a candidate: a full outer join by element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.js import is_, round_to, truthy, yes

# Fixed values of the rules.
STYLE_PROPERTIES = ("color", "background-color", "backgroundColor", "font-size", "fontSize", "font-weight", "fontWeight", "opacity", "display", "visibility", "z-index", "zIndex")
SEVERITIES = ("none", "low", "medium", "high", "critical")


def _rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def _worst(defects: Column) -> Column:
    top = F.aggregate(defects, F.lit(1).cast("long"), lambda m, d: F.greatest(m, _rank(d["severity"])))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), top.cast("int"))


def _defect(on: Column, kind: str, severity: Column | str, delta: Column | None = None, prop: Column | str | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(
        on,
        F.struct(
            F.lit(kind).alias("kind"), lit(severity).alias("severity"), (delta if delta is not None else F.lit(None)).cast("double").alias("delta"),
            lit(prop).cast("string").alias("property"),
        ),
    )


def node_differences(baseline: DataFrame, candidate: DataFrame, viewport_w: float = 1920, viewport_h: float = 1080, min_shift: float = 1.0, min_size: float = 1.0) -> DataFrame:
    """Rows of elements in both, added or removed: page_id, ax_id, status, defects, max_severity, shift_score.

    Both: page_id, ax_id, rect, style, refs, primary_pattern, visible_ratio,
    is_occluded; one row an element.
    """
    cols = ("rect", "style", "refs", "primary_pattern", "visible_ratio", "is_occluded")
    pack = lambda df, n: df.select("page_id", "ax_id", F.struct(*cols).alias(n))
    both = pack(baseline, "a").join(pack(candidate, "b"), ["page_id", "ax_id"], "full_outer")
    a, b = F.col("a"), F.col("b")
    ar, br = a["rect"], b["rect"]
    dx, dy = br["x"] - ar["x"], br["y"] - ar["y"]
    dist = F.sqrt(dx * dx + dy * dy)
    shifted = dist >= min_shift
    area = ar["w"] * ar["h"]
    score = round_to(F.least(F.lit(1.0), area / F.lit(max(1.0, viewport_w * viewport_h))) * F.least(F.lit(1.0), dist / F.lit(float(max(viewport_w, viewport_h)))), 4)
    dw, dh = F.abs(br["w"] - ar["w"]), F.abs(br["h"] - ar["h"])
    most = F.greatest(dw, dh)

    defects = [
        _defect(shifted, "layout-shift", F.when(dist >= 50, "critical").when(dist >= 15, "high").when(dist >= 5, "medium").otherwise("low"), round_to(dist, 1)),
        _defect(most >= min_size, "dimension-change", F.when(most >= 50, "high").when(most >= 10, "medium").otherwise("low"), round_to(most, 1)),
    ]
    for p in STYLE_PROPERTIES:
        x, y = a["style"][p], b["style"][p]
        severity = "critical" if p in ("display", "visibility") else "medium" if any(w in p for w in ("color", "background", "font")) else "low"
        defects.append(_defect(truthy(x) & truthy(y) & (F.trim(x) != F.trim(y)), "style-drift", severity, None, p))

    none = F.array().cast("array<string>")
    lost = F.array_except(F.coalesce(a["refs"], none), F.coalesce(b["refs"], none))
    token_defects = F.transform(
        lost, lambda t: F.struct(F.lit("token-detachment").alias("kind"), F.lit("medium").alias("severity"), F.lit(None).cast("double").alias("delta"), t.alias("property"))
    )

    def ratio(n: Column) -> Column:
        hidden = is_(n["style"]["visibility"], "hidden") | is_(n["style"]["display"], "none")
        return F.coalesce(n["visible_ratio"], F.when(hidden, 0.0).otherwise(1.0))

    dimmed = (~yes(a["is_occluded"]) & yes(b["is_occluded"])) | (ratio(a) - ratio(b) >= 0.5)
    last = [
        _defect(dimmed, "visibility-regression", F.when(ratio(b) <= 0.2, "critical").otherwise("high")),
        _defect(truthy(a["primary_pattern"]) & ~a["primary_pattern"].eqNullSafe(b["primary_pattern"]), "pattern-degradation", "high"),
    ]
    compact = lambda xs: F.filter(F.array(*xs), lambda d: d.isNotNull())
    matched = F.concat(compact(defects), token_defects, compact(last))
    important = truthy(a["primary_pattern"]) | (F.size(F.coalesce(a["refs"], none)) > 0)
    gone = F.array(F.struct(F.lit("visibility-regression").alias("kind"), F.when(important, "high").otherwise("medium").alias("severity"), F.lit(None).cast("double").alias("delta"), F.lit(None).cast("string").alias("property")))
    status = F.when(a.isNull(), "added").when(b.isNull(), "removed").otherwise("matched")
    found = F.when(status == "matched", matched).when(status == "removed", gone).otherwise(F.slice(gone, 1, 0))
    return both.select(
        "page_id", "ax_id", status.alias("status"), found.alias("defects"), F.when((status == "matched") & shifted, score).otherwise(0.0).alias("shift_score")
    ).withColumn("max_severity", _worst(F.col("defects")))


def report(differences: DataFrame) -> DataFrame:
    """A row a page: counts by severity, regressed nodes, added, removed, layout shift."""
    counted = F.col("status") != "added"
    return differences.groupBy("page_id").agg(
        F.count_if(F.col("status") != "added").alias("total_nodes_compared"),
        F.count_if(counted & (F.size("defects") > 0)).alias("regressed_nodes"),
        *[F.count_if(counted & (F.col("max_severity") == s)).alias(f"n_{s}") for s in reversed(SEVERITIES)],
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.max(_rank(F.col("max_severity"))).cast("int")).alias("max_severity"),
        round_to(F.sum("shift_score"), 4).alias("cumulative_layout_shift"),
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "removed").alias("removed"),
    )
