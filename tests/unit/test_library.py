"""Inventory, manifests, listings and the continuous operators."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strataline.operators import library, listings
from strataline.streaming import segments


def test_inventory(spark):
    assert library.skill_fields("---\r\nname: a\r\ndescription: >-\r\n  one\r\n\r\n  two\r\nx: y\r\n---\r\n") == {"name": "a", "description": "one two", "x": "y"}
    assert library.skill_fields("no") == {}
    one = json.dumps({"source": "s", "origin": "https://o", "source_type": "docs", "title": "T", "est_tokens": 5, "extracted_at": "2024-01-01T00:00:00Z", "segments": [{"key": "k", "title": "t"}]})
    files = spark.createDataFrame([("a", "source.json", one), ("a", "sources/1.source.json", json.dumps({"source": "u", "source_type": "book", "extracted_at": "bad"})), ("b", "source.json", "{broken"), ("c", "source.json", one)], "skill string, path string, content string")
    skills = spark.createDataFrame([("a", "/r/a", 0, "A", None), ("a", "/r/a", 1, "A", None), ("b", "/r/b", 0, None, None), ("c", "/r/c", 0, None, "d")], "skill string, real_path string, root_ord int, name string, description string")
    got = {r.skill: r for r in library.inventory(skills, library.manifests(files), F.lit("2024-01-31").cast("timestamp")).collect()}
    assert set(got) == {"a", "c"} and got["a"].topic and got["a"].refresh_due and not got["c"].topic
    assert [(s.origin, s.age_days, s.due) for s in got["a"].sources] == [("https://o", 30, True), ("u", None, False)]


def test_manifest(spark):
    docs = spark.createDataFrame([(1, "~/x.pdf", "/home/x.pdf", "paper", "T", 7, None)], "source_id int, source string, origin string, source_type string, title string, est_tokens long, x string")
    docs = docs.withColumns({"extracted_at": F.lit("2024-01-02 03:04:05").cast("timestamp"), "options": F.struct(F.lit(3).alias("limit"))})
    segs = spark.createDataFrame([(1, 2, None, "k2", "B"), (1, 1, "https://u", "k", "A")], "source_id int, seg_ord int, url string, key string, title string")
    got = json.loads(library.manifest_json(docs, segs, "1").first().json)
    assert got["origin"] == "~/x.pdf" and got["extracted_at"] == "2024-01-02T03:04:05Z" and got["segments"] == [{"key": "https://u", "title": "A"}, {"key": "k2", "title": "B"}]
    row = spark.range(1).select(library.file_name(F.lit(7), F.lit("a")).alias("x"), library.file_name(F.lit(123), F.lit("b")).alias("y"), library.read_plan(F.lit(50_000)).alias("z")).first()
    assert tuple(row) == ("07-a.md", "123-b.md", "slices")


def test_listing(spark):
    rows = [("p", 1, "a", None, "A"), ("p", 2, None, None, None), ("p", 3, "c", "https://c", ""), ("p", 4, "d", None, "D")]
    got = listings.numbered_entries(spark.createDataFrame(rows, "p string, o int, id string, url string, title string").withColumn("most", F.lit(3)), "p", "o", "most").orderBy("o").collect()
    assert [(g.number, g.title, g.url, g.reason is None) for g in got] == [(1, "A", "https://www.youtube.com/watch?v=a", True), (2, "Video 2", None, False), (3, "Video 3", "https://c", True)]
    tries = [("p", 1, "u", "HTTP 429"), ("p", 2, None, "no url"), ("p", 3, "u", "Too Many Requests"), ("p", 4, "u", "429"), ("q", 1, "u", "429"), ("q", 2, "u", None), ("q", 3, "u", "429")]
    done = {r.p: (r.aborted, r.all_failed) for r in listings.outcome(spark.createDataFrame(tries, "p string, number int, url string, reason string"), "p").collect()}
    assert done == {"p": (True, True), "q": (False, False)}
    videos = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "video_id int, forced boolean")
    captions = spark.createDataFrame([(1, "auto", "hi"), (2, "manual", "x"), (3, "manual", " ")], "video_id int, kind string, text string")
    speech = spark.createDataFrame([(2, "said"), (3, "spoken")], "video_id int, text string")
    got = {r.video_id: (r.label, r.text, r.reason is None) for r in listings.chosen_transcript(videos, captions, speech).collect()}
    assert got == {1: ("auto", "hi", True), 2: ("whisper", "said", True), 3: ("whisper", "spoken", True), 4: (None, None, False)}


def test_streaming_marks(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 5.0, "a"), (1, 31.0, "b"), (1, 40.0, "c"), (2, 90.0, "d")], "source_id long, start_s double, text string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("source_id long, start_s double, text string").parquet(src)
    query = segments.marked_cues(stream).writeStream.format("memory").queryName("marks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    assert {(r.source_id, r.text) for r in spark.table("marks").filter("marked").collect()} == {(1, "b"), (2, "d")}
