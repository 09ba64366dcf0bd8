"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source gets a share of all words by weight, at most ``most`` times its own
words; what a stopped source leaves is shared again by weight among the rest.
Within a source the document rates w are the ones nearest to 1 in (bounded)
relative entropy whose expected words meet the target: w(s) = most / (1 +
(most - 1) exp(-l s)), an exponential tilt in the document's size s that a rate
of ``most`` bounds.  The dual has one variable l per source; Newton steps,
kept inside a shrinking bracket, solve all sources at once.  Rates depend only
on (source, size), so the steps run over that histogram and never over rows.

Rates become copies class by class, long documents first: copies are rounded
along the running sum of expected copies, and the words a class misses or
overshoots move into the next class, which holds documents at most 1/8 as long.  Of the
documents of one (source, size), those with the lowest hashes get the extra copy;
large groups are ranked in salted parts, so no group meets in one task.

Defined results: null text has size 0; null sources are a source of their own,
last in the order; documents of size 0 are taken 0 times in words; repeated rows
count each; rates and copies depend on the rows alone, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.runtime import durable, words_column

#: Newton steps at most; the bracket halves at least where a step leaves it.
STEPS = 60
#: Relative error in a source's expected words at which the steps stop.
CLOSE = 1e-7
#: Size classes are powers of this base.
BASE = 8
#: Rows of one (source, size) that a ranking part holds on average.
PART_ROWS = 500


def _measures(docs: DataFrame, text: str, source: str) -> dict[str, Column]:
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))
    hashed = [f.name for f in docs.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return {"__key": key, "__size": words_column(text), "__hash": F.xxhash64(*[F.col(f"`{c}`") for c in hashed])}


def measured(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Adds __key (the source, null included), __size (words) and __hash (of the whole row)."""
    return docs.withColumns(_measures(docs, text, source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(key, source_size, target) from (key, size, n): shares by repeating weights, stopped at most x size.

    Sources go by code point, null last.  With b = most x size / weight, a source is stopped
    exactly if b is below the level at which the stopped sources' bounds and the others'
    level x weight make up the whole; prefix sums in the order of b give that level.
    """
    own = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("key") == "", F.col("key").cast("binary"))) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1)
    room = own.withColumn("w", w).withColumn("bound", F.lit(most) * F.col("source_size")).withColumn("b", F.col("bound") / F.col("w"))
    rest = Window.orderBy("b", F.col("key").cast("binary")).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    stopped = F.sum("bound").over(whole) - F.sum("bound").over(rest)
    levels = room.withColumn("level", (F.sum("source_size").over(whole) - stopped) / F.sum("w").over(rest))
    final = F.min(F.when(F.col("level") <= F.col("b") * (1 + 1e-12), F.struct("b", "level"))).over(whole)["level"]
    return levels.select("key", "source_size", F.least(F.coalesce(F.col("w") * final, F.col("bound")), F.col("bound")).alias("target"))


def _rate(tilt: Column, x: Column, most: float) -> Column:
    return F.lit(most) / (1 + F.lit(most - 1) * F.exp(F.least(F.lit(700.0), -tilt * x)))


def document_rates(sizes: DataFrame, goals: DataFrame, most: float = 3.0) -> DataFrame:
    """(key, size, n, rate) of all sizes above 0: the tilted rates that meet each source's target."""
    held = sizes.filter("size > 0")
    mean = held.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    base = durable(held.join(goals, "key").join(mean, "key").select("key", "size", "n", "source_size", "target", (F.col("size") / F.col("mean")).alias("x")), "mix-sizes")
    # at l = 0 every rate is 1; a target at the bound itself needs no tilt
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-9)
    state = base.filter(~full).groupBy("key").agg(F.lit(0.0).alias("tilt"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    words = F.col("n") * F.col("size")
    for _ in range(STEPS):
        w = _rate(F.col("tilt"), F.col("x"), most)
        sums = base.join(state, "key").groupBy("key", "tilt", "low", "high", "target").agg(F.sum(words * w).alias("got"), F.sum(words * F.col("x") * w * (1 - w / most)).alias("slope"))
        over, gap = F.col("got") > F.col("target"), F.col("got") - F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.greatest("slope", F.lit(1e-300))
        reach = 2 + F.abs("tilt")
        step = F.greatest(F.col("tilt") - reach, F.least(F.col("tilt") + reach, newton))
        inside = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        done = F.abs(gap) <= CLOSE * F.col("target")
        moved = durable(sums.select("key", F.when(done, F.col("tilt")).otherwise(inside).alias("tilt"), low.alias("low"), high.alias("high"), done.alias("done")), "mix-tilt")
        state = moved.select("key", "tilt", "low", "high")
        if moved.filter(~F.col("done")).isEmpty():
            break
    # sums of floats depend on their order in the last digits; rounded, reruns agree
    tilted = base.join(state.select("key", F.round("tilt", 8).alias("tilt")), "key", "left")
    return tilted.select("key", "size", "n", F.when(full, F.lit(most)).otherwise(_rate(F.col("tilt"), F.col("x"), most)).alias("rate"))


def copies_by_size(rates: DataFrame, most: float = 3.0) -> DataFrame:
    """(key, size, n, copies): whole copies that all n documents of a size get together."""
    rates = durable(rates.withColumn("class", F.floor(F.log(F.col("size") + 0.5) / math.log(BASE)).cast("int")), "mix-rates")
    top = rates.agg(F.max("class")).first()[0]
    carry = rates.select("key").distinct().withColumn("carry", F.lit(0.0))
    parts = []
    for k in range(-1 if top is None else top, -1, -1):
        own = rates.filter(F.col("class") == k).join(carry, "key")
        planned = F.sum(F.col("n") * F.col("size") * F.col("rate")).over(Window.partitionBy("key"))
        moved = F.round(F.greatest(F.lit(0.0), F.least(F.lit(most), F.col("rate") * (1 + F.col("carry") / planned))), 8)
        running = F.sum(F.col("n") * F.col("moved")).over(Window.partitionBy("key").orderBy(F.desc("size")))
        upto = own.withColumn("moved", moved).withColumn("upto", F.round(running))
        before = F.coalesce(F.lag("upto").over(Window.partitionBy("key").orderBy(F.desc("size"))), F.lit(0.0))
        got = F.greatest(F.lit(0), F.least((F.col("upto") - before).cast("long"), (F.col("n") * most).cast("long")))
        part = durable(upto.select("key", "size", "n", "rate", got.alias("copies")), "mix-copies")
        parts.append(part.select("key", "size", "n", "copies"))
        missed = part.groupBy("key").agg(F.sum(F.col("size") * (F.col("n") * F.col("rate") - F.col("copies"))).alias("missed"))
        carry = durable(carry.join(missed, "key", "left").select("key", (F.col("carry") + F.coalesce("missed", F.lit(0.0))).alias("carry")), "mix-carry")
    out = rates.select("key", "size", "n", F.lit(0).cast("long").alias("copies")).limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Rows of ``measured`` with source_size, target and copies (0 to ``most``) of each."""
    sizes = durable(rows.groupBy(F.col("__key").alias("key"), F.col("__size").alias("size")).agg(F.count("*").alias("n")), "mix-hist")
    goals = durable(targets(sizes, weights, float(most)), "mix-targets")
    plan = copies_by_size(document_rates(sizes, goals, float(most)), float(most))
    plan = durable(sizes.select("key", "size", "n").join(plan.select("key", "size", "copies"), ["key", "size"], "left").join(goals, "key"), "mix-plan")
    keyed = rows.withColumnsRenamed({"__key": "key", "__size": "size"})
    share = F.coalesce("copies", F.lit(0))
    got = keyed.join(plan.withColumn("parts", F.ceil(F.col("n") / PART_ROWS)), ["key", "size"]).withColumn("part", F.pmod("__hash", "parts"))
    # ranks inside a part, and how many rows of the size the parts before it hold
    part_rows = keyed.join(plan.filter(F.col("n") > PART_ROWS).select("key", "size", F.ceil(F.col("n") / PART_ROWS).alias("parts")), ["key", "size"])
    part_rows = part_rows.groupBy("key", "size", F.pmod("__hash", "parts").alias("part")).agg(F.count("*").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = got.withColumn("__rank", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("__hash")))
    ranked = ranked.join(part_rows.select("key", "size", "part", ahead.alias("ahead")), ["key", "size", "part"], "left")
    extra = (F.col("__rank") + F.coalesce("ahead", F.lit(0)) <= F.pmod(share, F.col("n"))).cast("long")
    return ranked.withColumn("copies", F.floor(share / F.col("n")).cast("long") + extra).withColumnsRenamed({"key": "__key", "size": "__size"}).drop("n", "parts", "part", "ahead", "__rank")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, same columns, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(whole, *[c.alias(name) for name, c in _measures(docs, "text", "source").items()])
    taken = mix(rows, weights, most).filter("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
