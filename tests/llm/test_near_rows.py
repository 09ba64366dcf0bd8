"""The near-duplicate stage decides per row, also where doc_ids are null or repeated."""

from __future__ import annotations

import corpus_pipeline

BASE = " ".join(f"word{k}" for k in range(60))
OTHER = " ".join(f"other{k}" for k in range(60))
THIRD = " ".join(f"third{k}" for k in range(60))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted([(r.doc_id, r.text) for r in out.collect()], key=repr)


def test_null_doc_ids(spark):
    rows = [(None, BASE), (None, BASE), (None, BASE + " tail"), (None, OTHER), (4, OTHER), (None, ""), (None, "")]
    got = kept(spark, [(*r, "s") for r in rows])
    assert [r for r in got if r[1] == OTHER] == [(4, OTHER)]
    assert [r for r in got if r[1] == ""] == [(None, ""), (None, "")]
    assert len([r for r in got if r[1].startswith(BASE)]) == 1 and len(got) == 4


def test_repeated_doc_ids(spark):
    rows = [(1, BASE), (2, BASE + " tail"), (2, OTHER), (3, THIRD), (3, THIRD)]
    assert kept(spark, [(*r, "s") for r in rows]) == [(1, BASE), (2, OTHER), (3, THIRD)]


def test_mixing_keeps_columns_named_like_its_own(spark):
    from strataline.llm.mixing import mix_documents

    rows = [(i, "w " * (i + 1), "ab"[i % 2], f"k{i}", i, -i, f"r{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __key string, __size int, __hash long, __row string")
    got = mix_documents(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    taken = {tuple(r) for r in got.collect()}
    assert taken and taken <= set(rows)
