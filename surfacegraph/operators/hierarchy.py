"""Pages among each other: parents by URL, and the order of a crawl, replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, in_scope, prefixes
from .traverse import search


def parents(pages: DataFrame) -> DataFrame:
    """(id, parent_page_id): the page with the longest URL that is a strict prefix, else the referring page.

    ``pages``: id, canonical_url, referrer, seq. Each page is exploded to the
    prefixes of its path and joined by equality.
    """
    known = pages.groupBy("canonical_url").agg(F.min_by("id", "seq").alias("parent"))
    steps = pages.select("id", F.explode(prefixes("canonical_url")).alias("p"))
    by_path = steps.join(known, F.col("p") == F.col("canonical_url")).groupBy("id").agg(F.max_by("parent", F.length("p")).alias("by_path"))
    by_link = pages.where("referrer is not null").select("id", "canonical_url", canonical_url("referrer").alias("r"))
    by_link = by_link.join(known.withColumnRenamed("canonical_url", "k"), F.col("r") == F.col("k")).where("id <> parent").select("id", F.col("parent").alias("by_link"))
    return pages.select("id").join(by_path, "id", "left").join(by_link, "id", "left").select("id", F.coalesce("by_path", "by_link").alias("parent_page_id"))


def hierarchy_edges(parented: DataFrame) -> DataFrame:
    """Edges from parents to children of ``parents``."""
    rows = parented.where("parent_page_id is not null").select(F.col("parent_page_id").alias("src"), F.col("id").alias("dst"))
    return rows.select(F.concat(F.lit("edge:"), "src", F.lit("->"), "dst", F.lit(":nav:child-of")).alias("id"), "src", "dst", F.lit("nav:child-of").alias("kind"), F.lit("html:hierarchy").alias("provenance"))


def frontier(links: DataFrame, root: str, max_pages: int = 50, scope: str = "same-origin") -> DataFrame:
    """(url, hops, rank): the pages that a crawl from ``root`` would visit, first come first served, however long the chains. ``links``: src, dst, seq."""
    ok = links.where(in_scope(F.lit(root), "dst", scope)).select("src", "dst", "seq", F.lit("link").alias("kind"), F.lit("replay").alias("provenance"))
    tree = search(ok, root, None, None, most=max_pages)
    return tree.orderBy("hops", "rank").limit(max_pages).select(F.col("id").alias("url"), "hops", "rank")
