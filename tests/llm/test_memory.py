"""What one task holds: bounds that do not grow with its input."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from strataline.llm import tokens, topk
from strataline.llm.queries import byte_bpe


def test_encoding_holds_a_small_block_at_a_time():
    words = [f"{chr(97 + i % 26)}{i * 7919 % 99991}" for i in range(40_000)]
    text = " ".join(words * 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(9), pa.int64()), "text": [text] * 9})
    run = tokens._encode(byte_bpe(), 0)
    want = [len(x) for part in run([batch]) for x in part.column(1)]  # learns the pieces
    tracemalloc.start()
    got = [len(x) for part in run([batch]) for x in part.column(1)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and len(set(got)) == 1
    assert batch.nbytes > 4 << 20 and peak < 40 << 20


def test_topk_broadcasts_nothing_that_grows_with_the_queries(spark, monkeypatch):
    states, write = [], topk.durable

    def noted(df, label, **options):
        if label == "topk-state":
            states.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label, **options)

    monkeypatch.setattr(topk, "durable", noted)
    rows = [(i, [float((i * k) % 11 - 5) for k in range(1, 9)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.exact_topk(vectors, vectors.filter("vec_id % 20 = 0"), k=3)
    whole = [[int(64 * x) for x in v] for _, v in rows]
    want = {}
    for q in range(0, 200, 20):
        ranked = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q)
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(ranked[:3])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()} == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    # the first state begins from a bound for each dimension, which is small; later ones only read what was written
    joins = [line for plan in states[1:] for line in plan.split("\n") if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)
