"""Refreshing, inventory, evaluation and study schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types that grow, days until a refresh is due, days between reviews by box.
GROWING = ("playlist", "docs", "repo", "notes", "thread")
REFRESH_DAYS = 30
BOX_DAYS = (1, 3, 7, 14, 30)


def added(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Segments (by, key, title, position) of the new manifest whose key the old one lacks."""
    return new.join(old.select(by, "key"), [by, "key"], "left_anti")


def removed(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    return old.join(new.select(by, "key"), [by, "key"], "left_anti")


def unchanged(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """(by, unchanged): distinct keys in both manifests."""
    return old.select(by, "key").distinct().join(new.select(by, "key"), [by, "key"], "left_semi").groupBy(by).agg(F.count("*").alias("unchanged"))


def age_days(extracted_at: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(extracted_at)) / F.lit(86_400_000_000)).cast("long")


def refresh_due(source_type: Column, age: Column, days: int = REFRESH_DAYS) -> Column:
    return F.coalesce(source_type.isin(*GROWING) & (age >= days), F.lit(False))


def next_box(box: Column, correct: Column) -> Column:
    return F.when(correct, F.least(box + 1, F.lit(len(BOX_DAYS)))).otherwise(F.lit(1))


def next_due(day: Column, box: Column) -> Column:
    return F.date_add(day, F.element_at(F.array(*[F.lit(d) for d in BOX_DAYS]), box))


def eval_scores(passed: DataFrame, by: str, flag: str) -> DataFrame:
    """(by, passed, total, score) of expectations."""
    return passed.groupBy(by).agg(F.sum(F.col(flag).cast("long")).alias("passed"), F.count("*").alias("total")).withColumn("score", F.col("passed") / F.col("total"))


def quiz(cards: DataFrame, by: str, today: Column, most: int = 8) -> DataFrame:
    """(by, id, rank): cards that are due, the longest waiting first, then unseen ones, spread over their source files.

    cards: by, id, source, due, seen.
    """
    due = F.coalesce(F.col("due") <= today, F.lit(False)) & (F.col("seen") > 0)
    own = cards.withColumn("__due", due).filter(F.col("__due") | (F.col("seen") == 0))
    turn = F.when(F.col("__due"), 0).otherwise(F.row_number().over(Window.partitionBy(by, "__due", "source").orderBy("id")))
    order = Window.partitionBy(by).orderBy(F.desc("__due"), F.when(F.col("__due"), F.col("due")), "__turn", "source", "id")
    return own.withColumn("__turn", turn).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(by, "id", "rank")
