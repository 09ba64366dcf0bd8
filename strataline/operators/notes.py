"""Note graphs: links, hubs, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A hub has at least so many linking notes; so many are reported.
HUB_LEAST, HUB_MOST = 2, 10
_SUFFIX = r"\.(md|mdx|markdown|txt|rst)$"


def _key(column):
    return F.lower(F.regexp_replace(column, "(?i)" + _SUFFIX, ""))


def resolved_links(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(vault_id, src, dst) of links that hit a note: by full path first, else by file name (shortest path, then first).

    notes: vault_id, seg_ord, path; links: vault_id, src (a path), target (text of the link).
    """
    full = notes.groupBy("vault_id", _key(F.col("path")).alias("k")).agg(F.max_by("path", "seg_ord").alias("by_path"))
    stem = notes.groupBy("vault_id", F.element_at(F.split(_key(F.col("path")), "/"), -1).alias("k")).agg(F.min_by("path", F.struct(F.length("path"), "seg_ord")).alias("by_stem"))
    own = links.withColumns({"k": _key(F.col("target")), "last": F.element_at(F.split(_key(F.col("target")), "/"), -1)})
    hit = own.join(full, ["vault_id", "k"], "left").join(stem.withColumnRenamed("k", "last"), ["vault_id", "last"], "left")
    return hit.select("vault_id", "src", F.coalesce("by_path", "by_stem").alias("dst")).filter("dst IS NOT NULL")


def hubs(edges: DataFrame) -> DataFrame:
    """(vault_id, path, inbound, rank): notes that at least two other notes link to, the ten most linked."""
    counted = edges.filter("src <> dst").groupBy("vault_id", F.col("dst").alias("path")).agg(F.countDistinct("src").alias("inbound")).filter(F.col("inbound") >= HUB_LEAST)
    order = Window.partitionBy("vault_id").orderBy(F.desc("inbound"), F.lower("path"), "path")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HUB_MOST)


def tag_counts(notes: DataFrame, by: str, tags: str) -> DataFrame:
    """(by, tag, n, rank): notes per tag; a note counts once for a tag."""
    counted = notes.select(by, F.explode(F.array_distinct(F.col(tags))).alias("tag")).groupBy(by, "tag").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "tag")))
