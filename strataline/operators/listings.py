"""Playlists, channels and feeds: listed videos and their transcripts, with tolerated failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rate-limited answers in a row that end an extraction, entries from which a warning is due.
ABORT_AFTER, WARN_FROM = 3, 31


def rate_limited(reason: Column) -> Column:
    return F.coalesce(reason.contains("429") | reason.contains("Too Many Requests"), F.lit(False))


def numbered_entries(entries: DataFrame, by: str, order: str, limit: str | None = None, feed: str | None = None) -> DataFrame:
    """Entries with number, title, url and reason (why an entry is skipped), the first ``limit`` of each listing.

    entries: by, order, id, url, title; limit and feed name columns.  Numbers count listed entries, skipped ones too.
    """
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    is_feed = F.col(feed) if feed else F.lit(False)
    url = F.coalesce(F.nullif("url", F.lit("")), F.when(~is_feed & F.col("id").isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), "id")))
    own = entries.withColumn("number", n)
    if limit:
        own = own.filter(F.col(limit).isNull() | (F.col("number") <= F.col(limit)))
    titled = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Video "), F.col("number").cast("string")))
    return own.withColumns({"title": titled, "url": url}).withColumn("reason", F.when(F.col("url").isNull(), F.lit("playlist entry has no url or id")))


def outcome(tries: DataFrame, by: str) -> DataFrame:
    """(by, aborted, all_failed): three rate-limited answers in a row end a listing; an entry without address breaks no run.

    tries: by, number, url, reason (null: extracted).
    """
    asked = tries.filter(F.col("url").isNotNull()).withColumn("limited", rate_limited(F.col("reason")))
    w = Window.partitionBy(by).orderBy("number")
    run = F.col("limited") & F.lag("limited", 1, False).over(w) & F.lag("limited", 2, False).over(w)
    return asked.withColumn("run", run).groupBy(by).agg(F.bool_or("run").alias("aborted"), F.bool_and(F.col("reason").isNotNull()).alias("all_failed"))


def chosen_transcript(videos: DataFrame, captions: DataFrame, speech: DataFrame, by: str = "video_id") -> DataFrame:
    """(by, label, text, reason): captions (manual or auto) unless transcription is forced or they are empty, else speech.

    captions: by, kind, text; speech: by, text; videos: by, forced.
    """
    own = videos.join(captions.withColumnsRenamed({"text": "__caption"}), by, "left").join(speech.withColumnsRenamed({"text": "__speech"}), by, "left")
    told = F.nullif(F.trim(F.coalesce("__caption", F.lit(""))), F.lit(""))
    by_speech = F.col("forced") | told.isNull()
    text = F.when(by_speech, F.col("__speech")).otherwise(told)
    label = F.when(by_speech, F.lit("whisper")).otherwise(F.col("kind"))
    return own.select(by, F.when(text.isNotNull(), label).alias("label"), text.alias("text"), F.when(text.isNull(), F.lit("no captions and no transcription")).alias("reason"))


def chunk() -> Column:
    """Rendering of a listing's entry: its two-digit number, title, address and transcript."""
    n = F.col("number").cast("string")
    return F.concat(F.lit("=== ["), F.lpad(n, F.greatest(F.lit(2), F.length(n)), F.lit("0")), F.lit("] "), "title", F.lit(" ===\n"), "url", F.lit("\n"), "text", F.lit("\n\n"))
