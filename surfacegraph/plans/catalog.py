"""The catalog: one DataFrame a node kind, with last-wins upserts and look-ups."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .prefix import running_sum


def last_wins(df: DataFrame, keys: list[str] | str = "id", order: str = "seq") -> DataFrame:
    """Of rows with equal keys the last one, at the place of the first.

    An upsert keeps the place where the key was first inserted, so the first
    ``seq`` stays. Of rows with the same place a hash of their columns (maps
    apart) decides, so reruns agree. One aggregation with partial results, no
    sort.
    """
    keys = [keys] if isinstance(keys, str) else keys
    rest = [c for c in df.columns if c not in keys]
    tie = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*tie))).alias("_last"), F.min(order).alias("_first"))
    cols = [F.col(c) if c in keys else (F.col("_first").alias(order) if c == order else F.col(f"_last.{c}")) for c in df.columns]
    return last.select(*cols)


@dataclass
class Catalog:
    """Tables by name, as in ``schema.TABLES``; a missing table is empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in schema.TABLES:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], schema.TABLES[name])
        return self.tables[name]

    def with_tables(self, **tables: DataFrame) -> Catalog:
        return replace(self, tables=self.tables | tables)

    def upsert(self, name: str, rows: DataFrame, key: str | list[str] = "id") -> Catalog:
        """Adds rows; a row with a known key replaces the one before."""
        return self.with_tables(**{name: last_wins(getattr(self, name).unionByName(rows, allowMissingColumns=True), key)})

    def remove_edges(self, ids: DataFrame) -> Catalog:
        """Without the edges whose id is in ``ids(id)``."""
        return self.with_tables(edges=self.edges.join(ids, "id", "left_anti"))

    def provenance(self, root_url: str | None = None) -> DataFrame:
        """Where the catalog's graphs come from, one row a root; none for a graph that does not say."""
        return self.meta if root_url is None else self.meta.where(F.col("root_url") == root_url)

    def with_provenance(self, rows: DataFrame) -> Catalog:
        """Sets the provenance of the roots in ``rows``, which replace what was there. Of several rows of one root the last to start counts."""
        last = F.max_by(F.struct(*rows.columns), F.struct(F.col("started_at"), F.xxhash64(*rows.columns))).alias("m")
        new = rows.groupBy("root_url").agg(last).select("m.*")
        kept = self.meta.join(new.select("root_url"), self.meta["root_url"].eqNullSafe(new["root_url"]), "left_anti")
        return self.with_tables(meta=kept.unionByName(new, allowMissingColumns=True))

    def without_provenance(self, roots: DataFrame) -> Catalog:
        """Takes away the provenance of the roots in ``roots(root_url)``."""
        return self.with_tables(meta=self.meta.join(roots, "root_url", "left_anti").select(self.meta.columns))

    def views(self, prefix: str = "") -> None:
        """Registers every table as a temporary view."""
        for name in schema.TABLES:
            getattr(self, name).createOrReplaceTempView(prefix + name)

    # look-ups

    def get(self, name: str, id_: str) -> DataFrame:
        return getattr(self, name).where(F.col("path" if name == "tokens" else "id") == id_)

    def page_by_url(self, canonical_url: str) -> DataFrame:
        return self.pages.where(F.col("canonical_url") == canonical_url).orderBy("seq").limit(1)

    def by_page(self, name: str, page_id: str) -> DataFrame:
        return getattr(self, name).where(F.col("page_id") == page_id)

    def ax_by_role(self, role: str) -> DataFrame:
        return self.ax.where(F.col("role") == role)

    def primary_visual(self) -> DataFrame:
        """One visual node an element: the first without a viewport, else the first."""
        # found by numbers alone: rows with their styles are not sorted to be aggregated
        seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63)))
        free = F.col("viewport").isNull()
        first = self.visual.groupBy(F.col("ax_id").alias("p_id")).agg(F.coalesce(F.min(F.when(free, seq)), F.min(seq)).alias("p_seq"), F.max(free).alias("p_free"))
        on = F.col("ax_id").eqNullSafe(F.col("p_id")) & (seq == F.col("p_seq")) & (free == F.col("p_free"))
        one = self.visual.join(first, on, "left_semi")
        # of rows with one place any counts
        return one.dropDuplicates(["ax_id"])

    def visual_by_ax(self, ax_id: str) -> DataFrame:
        return self.visual.where(F.col("ax_id") == ax_id).orderBy(F.col("viewport").isNotNull(), "seq").limit(1)

    def visual_containers(self, page_id: str | None = None) -> DataFrame:
        df = self.visual.where(F.coalesce("is_visual_container", F.lit(False)))
        return df if page_id is None else df.where(F.col("page_id") == page_id)

    def edges_from(self, id_: str, kind: str | None = None) -> DataFrame:
        return self._edges("src", id_, kind)

    def edges_to(self, id_: str, kind: str | None = None) -> DataFrame:
        return self._edges("dst", id_, kind)

    def _edges(self, end: str, id_: str, kind: str | None) -> DataFrame:
        df = self.edges.where(F.col(end) == id_)
        return df if kind is None else df.where(F.col("kind") == kind)

    def transitions_from(self, ax_id: str) -> DataFrame:
        return self.transitions.where(F.col("from_ax_id") == ax_id)

    def states_where(self, page_id: str | None = None, route: str | None = None, auth_kind: str | None = None) -> DataFrame:
        df = self.states
        for column, value in (("page_id", page_id), ("route", route), ("auth_kind", auth_kind)):
            df = df if value is None else df.where(F.col(column) == value)
        return df

    def counts(self) -> DataFrame:
        """(kind, n) of every table."""
        out = None
        for name in (*schema.ANY_ORDER, "auth", "tokens"):
            one = getattr(self, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def all_nodes(self) -> DataFrame:
        """(kind, id, page_id) of pages, elements, visual and nav nodes, capabilities, transitions and states."""
        out = None
        for name in ("pages", "ax", "visual", "nav", "capabilities", "transitions", "states"):
            df = getattr(self, name)
            page = F.col("page_id") if "page_id" in df.columns else F.col("id") if name == "pages" else F.lit(None).cast("string")
            one = df.select(F.lit(name).alias("kind"), "id", page.alias("page_id"))
            out = one if out is None else out.unionByName(one)
        return out


def merge_visual(existing: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visual nodes, observations) after adding ``rows``: last wins by id, and every row with a viewport is an observation."""
    both = existing.unionByName(rows, allowMissingColumns=True)
    seen = both.where("viewport is not null").select(
        "ax_id", F.lower("viewport.name").alias("vp_key"), "viewport", "rect", "style",
        F.when(F.coalesce(F.col("style")["display"] == "none", F.lit(False)), "display-none").when(F.coalesce(F.col("style")["visibility"] == "hidden", F.lit(False)), "hidden").otherwise("visible").alias("visibility"),
        F.lit(None).cast("string").alias("crawled_at"), "seq",
    )
    return last_wins(both), last_wins(seen, ["ax_id", "vp_key"])


def add_observation(observations: DataFrame, rows: DataFrame) -> DataFrame:
    """Observations with ``rows`` added; an element has one for each viewport name."""
    keyed = rows.withColumn("vp_key", F.lower("viewport.name"))
    return last_wins(observations.unionByName(keyed, allowMissingColumns=True), ["ax_id", "vp_key"])


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``seq`` by the order, within each page if it has one.

    Rows of different pages have the order of the page ids. Without pages all
    rows are sorted over the partitions and numbered from sums of these.
    """
    if "page_id" in df.columns:
        return df.withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)).cast("long"))
    before = running_sum(df, [], list(order), F.lit(1).cast("long"), "seq")
    return before.withColumn("seq", F.col("seq") + 1)
