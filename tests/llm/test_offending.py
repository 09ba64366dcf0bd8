"""Sentences named as offending carry the document's score."""

from __future__ import annotations

from strataline.llm import toxicity

MODEL = {"bias": -9.0, "features": {b"weak": 8.6, b"strong": 12.0}}


def named(text):
    return [text[a:z].strip() for a, z, _ in toxicity.spans(text, toxicity.WordScores(MODEL))]


def test_weak_sentences_together(spark):
    text = "A weak one. Nothing here. Another weak one."
    row = toxicity.score(spark.createDataFrame([(1, text), (2, "A weak one. Nothing here.")], "doc_id long, text string"), MODEL).orderBy("doc_id").collect()
    assert row[0].score >= 0.5 and all(r.p < 0.5 for r in row[0].offending) and row[0].offending
    assert row[1].score < 0.5 and not row[1].offending


def test_until_the_rest_stays_below():
    assert named("A strong one. One weak one. Nothing.") == ["A strong one"]
    assert named("A weak one. A strong one. A strong two. Another weak one. Plain.") == ["A weak one", "A strong one", "A strong two"]
    assert named("Plain. Words.") == [] and named("") == []
