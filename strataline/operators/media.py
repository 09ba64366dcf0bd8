"""Media time: cues, windows, assignment to segments, markers, durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.folds import mark_times

#: Seconds of a window without chapters, and between markers inside a segment.
WINDOW_S, MARK_EVERY_S = 600, 30


def without_repeats(cues: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Cues whose text differs from the one before: a dropped cue equals its predecessor, so one look back suffices."""
    last = F.lag(text).over(Window.partitionBy(by).orderBy(order))
    return cues.withColumn("__last", last).filter(~F.col(text).eqNullSafe(F.col("__last")) | F.col("__last").isNull()).drop("__last")


def durations(cues: DataFrame, by: str, start: str) -> DataFrame:
    """Seconds of a source without a stated duration: its last start and one more."""
    return cues.groupBy(by).agg((F.max(start).cast("long") + 1).alias("duration_s"))


def fixed_windows(sources: DataFrame, by: str, duration: str, window: int = WINDOW_S) -> DataFrame:
    """Segments ``Part i`` of equal length; one ``Full transcript`` where no duration is known."""
    d = F.floor(F.coalesce(F.col(duration), F.lit(0))).cast("long")
    starts = F.when(d > 0, F.sequence(F.lit(0).cast("long"), d - 1, F.lit(window).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = sources.select(by, (d > 0).alias("__known"), F.posexplode(starts).alias("i", "start_s"))
    return rows.select(by, (F.col("i") + 1).cast("long").alias("seg_ord"), F.when(F.col("__known"), F.concat(F.lit("Part "), (F.col("i") + 1).cast("string"))).otherwise(F.lit("Full transcript")).alias("title"), "start_s")


def chapter_segments(chapters: DataFrame, by: str, order: str) -> DataFrame:
    """Segments from chapters (title, start_time); starts are whole seconds."""
    return chapters.select(by, F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long").alias("seg_ord"), "title", F.col("start_time").cast("long").alias("start_s"))


def assign(cues: DataFrame, segments: DataFrame, by: str, start: str) -> DataFrame:
    """Adds seg_ord to each cue: the last segment beginning at or before it; the first takes all before it.

    An as-of join without a range join: starts and cues are laid on one time line, and the
    last start seen is carried forward, one shuffle by source for any number of segments.
    """
    marks = segments.select(by, F.when(F.col("seg_ord") == 1, F.lit(float("-inf"))).otherwise(F.col("start_s").cast("double")).alias("__t"), F.lit(0).alias("__cue"), F.col("seg_ord").alias("__seg"))
    own = cues.withColumns({"__t": F.col(start).cast("double"), "__cue": F.lit(1), "__seg": F.lit(None).cast("long")})
    line = own.unionByName(marks, allowMissingColumns=True)
    # of several segments with one start the last is meant: its interval alone is not empty
    last = F.last("__seg", ignorenulls=True).over(Window.partitionBy(by).orderBy("__t", "__cue", "__seg"))
    return line.withColumn("seg_ord", last).filter("__cue = 1").drop("__t", "__cue", "__seg")


def rendered(cues: DataFrame, segments: DataFrame, by: str, order: str, start: str, text: str, every: float = MARK_EVERY_S) -> DataFrame:
    """Segments with chunk and offset: cue texts of each, marked [t=Ns] at intervals; empty segments stay."""
    own = assign(cues, segments, by, start)
    since = segments.select(by, "seg_ord", F.when(F.col("seg_ord") == 1, F.lit(0)).otherwise(F.col("start_s")).alias("__since"))
    marked = mark_times(own.join(since, [by, "seg_ord"]), [by, "seg_ord"], order, start, "__since", every)
    line = F.when(F.col("marked"), F.concat(F.lit("[t="), F.col(start).cast("long").cast("string"), F.lit("s] "), text)).otherwise(F.col(text))
    bodies = marked.withColumn("__line", line).groupBy(by, "seg_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__line"))), lambda x: x["__line"]), "\n").alias("__body"))
    chunk = F.concat(F.lit("=== "), "title", F.lit(" [t="), F.col("start_s").cast("string"), F.lit("s] ===\n"), F.coalesce("__body", F.lit("")), F.lit("\n\n"))
    out = segments.join(bodies, [by, "seg_ord"], "left").withColumn("chunk", chunk).drop("__body")
    before = Window.partitionBy(by).orderBy("seg_ord").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum(F.length("chunk")).over(before), F.lit(0)).cast("long"))


def aborted_runs(tries: DataFrame, by: str, order: str, limited: str, after: int = 3) -> DataFrame:
    """(by, aborted_at): where the ``after``-th consecutive rate-limited try of a source is; null if never."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(by, limited).orderBy(order))
    runs = tries.withColumn("__island", island)
    length = F.row_number().over(Window.partitionBy(by, limited, "__island").orderBy(order))
    return runs.withColumn("__run", length).groupBy(by).agg(F.min(F.when(F.col(limited) & (F.col("__run") == after), F.col(order))).alias("aborted_at"))


def track_choice(tracks: DataFrame, by: str) -> DataFrame:
    """One caption track a source: manual before automatic, English before the first language, first vtt format."""
    english = (F.col("lang") == "en") | F.startswith("lang", F.lit("en-"))
    order = [F.col("kind") != "manual", ~english, F.col("lang"), F.col("fmt_ord")]
    return tracks.filter("ext = 'vtt'").withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("__n = 1").drop("__n")
