"""Exact top-k search by distributed histogram selection.

Every vector is quantised to integers and packed into blocks.  A pass scores
each query block against each candidate block (one matrix product, never kept)
and emits, per query, counts of scores in equal-width bins, only down to the
bin where the block itself already holds k scores: the k-th best of all rows is
never below the k-th best of one block, so the bins above stay exact.  Summed
over the blocks, the counts locate the bin of the k-th value; the next pass
divides that bin, until it is one integer wide.  A last pass keeps the scores
above that value and, of the scores equal to it, each block's smallest ids, as
many as are still needed; ranks are then given out among these few rows.

What has a row per query or block is joined by sorting, never broadcast: the
driver builds broadcasts, small as the files may look, and these grow with the queries.

Defined results: vectors that are null, empty or hold a null, NaN or infinite
component take no part; rows with a null id take no part; a query meets only
candidates of its own dimension; rows that repeat an id are candidates each;
a query with fewer than k candidates returns all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.runtime import durable, partitions_of

#: Rows of a candidate block and of a query block; they bound a task's score matrix.
CANDIDATES, QUERIES = 2048, 512
#: Bins a query's score interval is divided into in each pass.
BINS = 256

#: Scores beyond it (either way) count as it, so that intervals of scores stay in 64 bits.
LIMIT = 1 << 61

_BLOCK = "dim int, n int, ids binary, mat binary, top double"


def _pack(size: int, scale: float):
    def run(batches):
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vecs = zip(*held.pop(dim), strict=True)
            mat = np.vstack(vecs)
            top = float(np.sqrt((mat.astype(np.float64) ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [np.array(ids, "<i8").tobytes()], "mat": [mat.astype("<i8").tobytes()], "top": [top]},
                schema=pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("mat", pa.binary()), ("top", pa.float64())]),
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                own = held.setdefault(len(x), [])
                own.append((i, np.clip(np.floor(x * scale), -(2.0**62), 2.0**62).astype(np.int64)))
                if len(own) >= size:
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)

    return run


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and their score matrix; floats only where they are exact."""
    dim = row["dim"]
    q, c = (np.frombuffer(row[k], "<i8").reshape(-1, dim) for k in ("q_mat", "mat"))
    if row["q_top"] * row["top"] < 2**52:
        s = np.rint(q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        s = q @ c.T  # exact modulo 2^64
        if row["q_top"] * row["top"] >= LIMIT:
            near = q.astype(np.float64) @ c.T.astype(np.float64)
            s = np.where(np.abs(near) >= LIMIT, np.where(near > 0, LIMIT, -LIMIT), s)
    return np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8"), s


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}


def _count(batches):
    out, held = [], 0
    for row in _rows(batches):
        q_ids, c_ids, s = _scores(row)
        width, end = row["width"], row["span"]
        for p, lo, need in zip(row["pos"], row["lo"], row["need"], strict=True):
            own = s[p][(c_ids != q_ids[p]) & (s[p] >= lo) & (s[p] < lo + end)] - lo
            if len(own) > need:
                # only down to the bin in which this block itself has as many as are needed
                own = own[own >= np.partition(own, len(own) - need)[len(own) - need] // width * width]
            bins, n = np.unique(own // width, return_counts=True)
            if len(bins):
                out.append((row["qb"], p, bins, n))
                held += len(bins)
        if held >= 65536:
            yield _counted(out)
            out, held = [], 0
    if out:
        yield _counted(out)


def _counted(out) -> pa.RecordBatch:
    lens = [len(b) for _, _, b, _ in out]
    return pa.RecordBatch.from_pydict(
        {
            "qb": pa.array(np.repeat([o[0] for o in out], lens), pa.int64()),
            "pos": pa.array(np.repeat([o[1] for o in out], lens).astype(np.int32), pa.int32()),
            "bin": pa.array(np.concatenate([o[2] for o in out]).astype(np.int64), pa.int64()),
            "n": pa.array(np.concatenate([o[3] for o in out]).astype(np.int64), pa.int64()),
        }
    )


def _keep(batches):
    for row in _rows(batches):
        q_ids, c_ids, s = _scores(row)
        cols: list[list] = [[], [], []]
        for p, at, need in zip(row["pos"], row["lo"], row["need"], strict=True):
            other = c_ids != q_ids[p]
            above = np.flatnonzero((s[p] > at) & other)
            tied = np.flatnonzero((s[p] == at) & other)
            if len(tied) > need:
                tied = tied[np.argsort(c_ids[tied], kind="stable")[:need]]
            got = np.concatenate([above, tied])
            cols[0].append(np.full(len(got), q_ids[p]))
            cols[1].append(c_ids[got])
            cols[2].append(s[p][got])
        if cols[0]:
            yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(c).astype(np.int64)) for k, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row of ``queries`` its k highest inner products with the other rows of ``vectors``.

    Returns query_id, rank (from 1), vec_id, score; equal scores go by the smaller id.  Scaled
    components and scores have 64 bits: scores of 2^61 or more, either way, count as that.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))
    cands = durable(pick(vectors).mapInArrow(_pack(CANDIDATES, scale), _BLOCK), "topk-cand")
    asked = pick(queries).mapInArrow(_pack(QUERIES, scale), _BLOCK).withColumn("qb", F.monotonically_increasing_id())
    asked = durable(asked.withColumnsRenamed({"n": "q_n", "ids": "q_ids", "mat": "q_mat", "top": "q_top"}), "topk-query")
    bound = asked.join(cands.groupBy("dim").agg(F.max("top").alias("c_top")), "dim").select("qb", "q_n", F.ceil(F.least(F.col("q_top") * F.col("c_top") + 1, F.lit(float(LIMIT)))).cast("long").alias("bound"))
    whole = bound.agg(F.max("bound")).first()[0] or 0
    # every query block goes to every slot of candidate blocks of its dimension
    slots = max(partitions_of(cands), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cands = cands.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))

    def pairs(state: DataFrame, span: int, width: int) -> DataFrame:
        packed = state.groupBy("qb").agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "need"))).alias("s"))
        packed = packed.select("qb", F.col("s.pos").alias("pos"), F.col("s.lo").alias("lo"), F.col("s.need").alias("need"), F.lit(span).alias("span"), F.lit(width).alias("width"))
        spread = asked.join(packed.hint("merge"), "qb").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        return cands.hint("merge").join(spread, ["dim", "slot"])

    # state of a query: its k-th score lies in [lo, lo + span), and so many of that interval belong to the answer
    state = bound.select(
        "qb", F.explode(F.sequence(F.lit(0), F.col("q_n") - 1)).alias("pos"), F.lit(-whole).cast("long").alias("lo"), F.lit(k).cast("long").alias("need")
    )
    span = 2 * whole + 1
    while span > 1:
        width = -(-span // BINS)
        counts = pairs(state, span, width).mapInArrow(_count, "qb long, pos int, bin long, n long").groupBy("qb", "pos", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("qb", "pos").orderBy(F.desc("bin"))
        cum = counts.withColumn("cum", F.sum("n").over(down)).join(state.select("qb", "pos", "need").hint("merge"), ["qb", "pos"])
        reached = F.col("cum") >= F.col("need")
        found = cum.groupBy("qb", "pos").agg(F.max(F.when(reached, F.col("bin"))).alias("hit"), F.max_by(F.col("need") - F.col("cum") + F.col("n"), F.when(reached, F.col("bin"))).alias("left"))
        # too few scores for k: the lowest bin, so that every score is kept
        state = durable(
            state.join(found.hint("merge"), ["qb", "pos"], "left").select("qb", "pos", (F.col("lo") + F.coalesce("hit", F.lit(0)) * width).cast("long").alias("lo"), F.coalesce("left", "need").cast("long").alias("need")),
            "topk-state",
        )
        span = width
    kept = pairs(state, 1, 1).mapInArrow(_keep, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
