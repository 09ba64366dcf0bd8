"""From ordered entries to addressable segments: headers, chunks, offsets, keys, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import text as T

#: Characters of a part of a source's whole text.
PART_CHARS = 1 << 14


def chunk(title: Column, body: Column) -> Column:
    """The rendering of one segment."""
    return F.concat(F.lit("=== "), title, F.lit(" ===\n"), body, F.lit("\n\n"))


def with_offsets(segments: DataFrame, by: list[str], order: list[str], size: Column) -> DataFrame:
    """Adds offset: characters of all earlier chunks of the source."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def segments(entries: DataFrame, by: list[str], order: list[str], title: str, body: str) -> DataFrame:
    """Entries with seg_ord, header, n_chars (of the chunk), offset, words and est_tokens; the text itself stays behind."""
    own = entries.withColumn("__chunk", chunk(F.col(title), F.col(body)))
    own = own.withColumns({"n_chars_chunk": F.length("__chunk").cast("long"), "words": T.word_count(F.col("__chunk"))}).drop("__chunk")
    own = own.withColumn("seg_ord", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return with_offsets(own, by, order, F.col("n_chars_chunk")).withColumn("est_tokens", T.est_tokens(F.col("words")))


def unique_keys(rows: DataFrame, by: list[str], title: str, order: list[str]) -> DataFrame:
    """Adds key: the title, from its second occurrence in a source on with an ordinal."""
    nth = F.row_number().over(Window.partitionBy(*by, title).orderBy(*order))
    return rows.withColumn("key", F.when(nth == 1, F.col(title)).otherwise(F.concat(F.col(title), F.lit(" ("), nth.cast("string"), F.lit(")"))))


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; ties cannot arise if ``order`` is a total order."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__nth = 1").drop("__nth")


def full_text(segments_: DataFrame, by: list[str], order: str, chunk_col: str) -> DataFrame:
    """The whole text of each source, for export of single sources."""
    return segments_.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, chunk_col))), lambda s: s[chunk_col]), "").alias("full_text"))


def _parts_of(begin: Column, end: Column) -> Column:
    """Numbers of the parts that characters [begin, end) lie in; none for none."""
    return F.when(end > begin, F.sequence(F.floor(begin / PART_CHARS).cast("long"), F.floor((end - 1) / PART_CHARS).cast("long")))


def text_parts(segments_: DataFrame, by: list[str], chunk_col: str) -> DataFrame:
    """(by, part, part_text): the whole text of each source, cut at every PART_CHARS characters; no row holds more, whatever the source's size.

    segments_: by, offset and the chunk; rows that repeat both count once.
    """
    begin = F.col("part") * PART_CHARS
    own = segments_.withColumn("part", F.explode(_parts_of(F.col("offset"), F.col("offset") + F.length(chunk_col))))
    first = F.greatest(begin - F.col("offset"), F.lit(0))
    piece = F.substring(chunk_col, (first + 1).cast("int"), (begin + PART_CHARS - F.greatest(begin, F.col("offset"))).cast("int"))
    pieces = F.array_sort(F.collect_set(F.struct("offset", piece.alias("piece"))))
    return own.groupBy(*by, "part").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("part_text"))


def slices(ranges: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, offset, slice): characters [offset, next) of each source's text; a null ``next`` means to its end."""
    ends = parts.groupBy(*by).agg(F.max(F.col("part") * PART_CHARS + F.length("part_text")).alias("__end"))
    own = ranges.select(*by, "offset", "next").join(ends, by).withColumn("__to", F.coalesce("next", "__end"))
    begin = F.col("part") * PART_CHARS
    own = own.withColumn("part", F.explode(_parts_of(F.col("offset"), F.col("__to")))).join(parts, [*by, "part"])
    first = F.greatest(F.col("offset"), begin)
    piece = F.substring("part_text", (first - begin + 1).cast("int"), (F.least("__to", begin + PART_CHARS) - first).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("part", piece.alias("piece"))))
    return own.groupBy(*by, "offset").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("slice"))
