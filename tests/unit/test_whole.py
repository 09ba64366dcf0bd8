"""Queries of the catalogue do the whole job: every row, every line, against Python on the same tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from strataline.operators import contract
from strataline.plans import catalog

#: A table on which every query meets rows that a cap or a filter would leave out.
SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_every_document_is_sliced(spark):
    got = {(r.source, r.doc_id, r.n_chars, r.same) for r in catalog.QUERIES["q13_segment_slice_roundtrip"](spark, SF).collect()}
    assert got == {(r.source, r.doc_id, len(f"=== Document {r.doc_id} ===\n{r.text}\n\n"), True) for r in table(spark, "documents")}


def test_parts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(contract, "PART_CHARS", 7)
    chunks = {("a", 0): "äb", ("a", 2): "c" * 5 + "d" * 20, ("a", 27): "e", ("b", 0): "f" * 14}
    frame = spark.createDataFrame([(s, o, c) for (s, o), c in chunks.items()] * 2, "source string, offset long, chunk string")
    parts = contract.text_parts(frame, ["source"], "chunk")
    whole = {"a": "äbcccccdddddddddddddddddddde", "b": "f" * 14}
    assert {(r.source, r.part): r.part_text for r in parts.collect()} == {(s, k // 7): t[k : k + 7] for s, t in whole.items() for k in range(0, len(t), 7)}
    ranges = spark.createDataFrame([("a", 0, 2), ("a", 2, 27), ("a", 27, None), ("b", 0, None)], "source string, offset long, next long")
    assert {(r.source, r.offset): r["slice"] for r in contract.slices(ranges, parts, ["source"]).collect()} == chunks
    wrong = ranges.withColumn("next", F.col("next") - 1)
    assert {(r.source, r.offset): r["slice"] for r in contract.slices(wrong, parts, ["source"]).collect()}["a", 2] == chunks["a", 2][:-1]


def rendered(spark):
    """{(thread, id): (pos, root, text)}: every line of every comment that stays, as the reference renders it."""
    turns = {(r.conv_id, r.turn): r for r in table(spark, "conversations")}
    out = {}
    for thread in sorted({t for t, _ in turns}):
        todo, pos = [(0, 0, None)], 0
        while todo:
            at, depth, root = todo.pop()
            if (own := turns.get((thread, at))) is None:
                continue
            stays = at % 3 != 1
            if stays:
                pos, root, pad = pos + 1, at if root is None else root, "  " * depth
                first, *more = [" ".join(x.split()) for x in own.text.splitlines() if x.strip()] or [""]
                out[thread, at] = pos, root, "\n".join([f"{pad}{own.role}: {first}", *[pad + x for x in more]])
            todo += [(k, depth + stays, root) for k in (2 * at + 2, 2 * at + 1)]
    return out


def test_every_line_of_a_comment(spark):
    want = rendered(spark)
    assert sum("\n" in text for *_, text in want.values()) > 100
    assert {(r.thread_id, r.id): (r.pos, r.line) for r in catalog.QUERIES["q34_dfs_render_order"](spark, SF).collect()} == {k: (pos, text) for k, (pos, _, text) in want.items()}


def test_budget_counts_every_line(spark):
    taken, spent = {}, {}
    for (thread, _), (pos, _, text) in sorted(rendered(spark).items(), key=lambda x: (x[0][0], x[1][0])):
        taken[thread, pos] = pos <= 4 and spent.get(thread, 0) < 900
        spent[thread] = spent.get(thread, 0) + sum(len(x.encode()) + 1 for x in text.split("\n"))
    assert {(r.thread_id, r.pos): r.taken for r in catalog.QUERIES["q35_comment_budget"](spark, SF).collect()} == taken


def test_segments_hold_every_line(spark):
    bodies = {}
    for (thread, _), (pos, root, text) in rendered(spark).items():
        bodies.setdefault((thread, root), []).append((pos, text))
    want = {k: (len(v), hashlib.md5("\n".join(t for _, t in sorted(v)).encode()).hexdigest()) for k, v in bodies.items()}
    assert {(r.thread_id, r.root_id): (r.n_comments, r.body_md5) for r in catalog.QUERIES["q37_thread_segments"](spark, SF).collect()} == want


def test_every_document_is_a_section(spark):
    got = {(r.source, r.ord): (r.title, r.body) for r in catalog.QUERIES["q45_llms_full_split"](spark, SF).collect()}
    want, n = {}, {}
    for r in sorted(table(spark, "documents"), key=lambda r: (r.source, r.doc_id)):
        if body := "\n".join(r.text.splitlines()).strip():
            n[r.source] = n.get(r.source, 0) + 1
            want[r.source, n[r.source]] = f"Page {r.doc_id}", body
    assert len(want) == 1000 and got == want


def test_whole_descriptions_are_checked(spark, monkeypatch):
    seen = []
    from strataline.operators import validate

    monkeypatch.setattr(validate, "frontmatter_errors", lambda folder, name, about: seen.append(F.length(about)) or F.array(seen[-1].cast("string")))
    got = {r.doc_id: int(r.error) for r in catalog.QUERIES["q50_validate_rules"](spark, SF).collect()}
    assert got == {r.doc_id: 0 if r.doc_id % 6 == 0 else len(r.text) for r in table(spark, "documents")}
