"""Order-dependent folds: greedy size caps, time markers, budgets.

A fold runs over (order, size) pairs only, never over texts, so the array that a
source collects is small; sources are dealt out by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_cap(rows: DataFrame, by: str, order: str, size: str, cap: int) -> DataFrame:
    """(by, order, kept): a row that would exceed the cap is dropped, later smaller ones may still fit; the first always stays."""
    start = "named_struct('total', 0L, 'any', false, 'kept', cast(array() as array<bigint>), 'gone', cast(array() as array<bigint>))"
    step = f"""(s, x) -> if(s.any and s.total + x.size > {cap},
        named_struct('total', s.total, 'any', s.any, 'kept', s.kept, 'gone', array_append(s.gone, x.ord)),
        named_struct('total', s.total + x.size, 'any', true, 'kept', array_append(s.kept, x.ord), 'gone', s.gone))"""
    folded = rows.select(by, F.col(order).cast("long").alias("ord"), F.col(size).cast("long").alias("size")).groupBy(by).agg(F.expr(f"aggregate(array_sort(collect_list(struct(ord, size))), {start}, {step})").alias("f"))
    both = F.concat(F.transform("f.kept", lambda i: F.struct(i.alias(order), F.lit(True).alias("kept"))), F.transform("f.gone", lambda i: F.struct(i.alias(order), F.lit(False).alias("kept"))))
    return folded.select(by, F.explode(both).alias("r")).select(by, f"r.{order}", "r.kept")


def mark_times(cues: DataFrame, by: list[str], order: str, second: str, since: str, every: float) -> DataFrame:
    """Adds marked: the cue is at least ``every`` seconds after the last marked one (or the segment's start ``since``)."""
    start = "named_struct('last', cast(min({s}) as double), 'out', cast(array() as array<bigint>))".replace("{s}", since)
    step = f"(s, x) -> if(x.t - s.last >= {every}, named_struct('last', x.t, 'out', array_append(s.out, x.ord)), s)"
    folded = cues.groupBy(*by).agg(F.expr(f"aggregate(array_sort(collect_list(struct(cast({order} as bigint) as ord, cast({second} as double) as t))), {start}, {step}).out").alias("__marks"))
    return cues.join(folded, by).withColumn("marked", F.array_contains("__marks", F.col(order).cast("long"))).drop("__marks")


def take_budget(rows: DataFrame, by: str, order: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """(by, order, taken): rows in order until so many rows or bytes were taken; the row that crosses a limit still counts whole.

    Both limits are tested before a row, so what is taken is a prefix: prefix sums decide, no fold is needed.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.select(by, order, size).withColumns({"__n": F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1, "__b": F.coalesce(F.sum(size).over(before), F.lit(0))})
    return counted.withColumn("taken", (F.col("__n") < most_rows) & (F.col("__b") < most_bytes)).select(by, order, "taken")


def take_optional(rows: DataFrame, by: str, order: str, required_max: int, text_cap: int, optional_budget: int) -> DataFrame:
    """(by, order, outcome) of linked pages in listing order: columns optional, size (null: fetch failed).

    Required pages: at most ``required_max``; a page that would exceed the text cap is left out, unless none was
    fetched yet.  Optional pages follow while the total is below the budget; the first violation ends them.
    """
    folded = rows.groupBy(by).agg(F.expr("array_sort(collect_list(struct(cast(optional as int) as opt, cast(%s as bigint) as ord, cast(size as bigint) as size)))" % order).alias("a"))
    start = "named_struct('total', 0L, 'fetched', 0L, 'required', 0L, 'ended', false, 'out', cast(array() as array<struct<ord: bigint, outcome: string>>))"
    outcome = f"""case
        when x.opt = 0 and s.required >= {required_max} then 'over page cap'
        when x.opt = 1 and (s.ended or s.total >= {optional_budget} or s.fetched >= {required_max}) then 'optional skipped'
        when x.size is null then 'failed'
        when x.size = 0 then 'empty page'
        when s.fetched > 0 and s.total + x.size > {text_cap} then 'over text cap'
        else 'kept' end"""
    step = f"""(s, x) -> named_struct(
        'total', s.total + if({outcome} = 'kept', x.size, 0L),
        'fetched', s.fetched + if({outcome} = 'kept', 1L, 0L),
        'required', s.required + if(x.opt = 0, 1L, 0L),
        'ended', s.ended or {outcome} = 'optional skipped',
        'out', array_append(s.out, named_struct('ord', x.ord, 'outcome', {outcome})))"""
    return folded.select(by, F.explode(F.expr(f"aggregate(a, {start}, {step}).out")).alias("r")).select(by, F.col("r.ord").alias(order), "r.outcome")
