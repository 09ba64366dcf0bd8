"""Inventory of generated skills, their manifests, and how documents are delivered."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators.contract import first_of
from strataline.operators.refresh import REFRESH_DAYS, age_days, refresh_due

#: Frontmatter of a skill, and the mark of a block that goes on below.
FRONT = re.compile(r"\A---\n(.*?)\n---\n", re.S)
BLOCK = re.compile(r"[>|][+-]?")
MANIFEST = "struct<source:string,origin:string,source_type:string,title:string,est_tokens:bigint,extracted_at:string,segments:array<struct<key:string,title:string>>>"


def skill_fields(text: str) -> dict[str, str]:
    """Top-level fields of a skill's frontmatter; block values are folded into one line."""
    head = FRONT.match((text or "").replace("\r\n", "\n"))
    fields: dict[str, str] = {}
    block = None
    for line in head[1].split("\n") if head else ():
        if block and (not line.strip() or line[0] in " \t"):
            fields[block] = f"{fields[block]} {line.strip()}".strip()
            continue
        block = None
        key, _, value = (x.strip() for x in line.partition(":"))
        if not key or line.startswith(" "):
            continue
        if BLOCK.fullmatch(value):
            block, fields[key] = key, ""
        elif value:
            fields[key] = value
    return fields


def skill_frontmatter(files: DataFrame) -> DataFrame:
    """(skill, name, description) of SKILL.md files (skill, content)."""

    def run(batches):
        for b in batches:
            got = [skill_fields(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g.get(k) for g in got], pa.string()) for k in ("name", "description")]], ["skill", "name", "description"])

    return files.select("skill", "content").mapInArrow(run, "skill string, name string, description string")


def manifests(files: DataFrame) -> DataFrame:
    """(skill, path, m) of manifest files (skill, path, content as JSON); broken ones and those without a source are left out."""
    own = files.filter(F.col("path").rlike(r"(^|/)source\.json$|(^|/)sources/[^/]*\.source\.json$"))
    return own.select("skill", "path", F.from_json("content", MANIFEST).alias("m")).filter(F.coalesce("m.source", F.lit("")) != "")


def inventory(skills: DataFrame, found: DataFrame, now: Column, days: int = REFRESH_DAYS) -> DataFrame:
    """One row a skill: name, description, topic (several sources), sources in order, refresh_due.

    skills: skill, real_path, root_ord, name, description; a folder reached twice counts for the first root.
    """
    at = F.try_to_timestamp("m.extracted_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    age = age_days(at, now)
    main = ~F.col("path").contains("sources/")
    source = F.struct(
        (~main).alias("later"), "path", "m.source_type", "m.title", F.coalesce(F.nullif("m.origin", F.lit("")), "m.source").alias("origin"), "m.extracted_at", age.alias("age_days"), "m.est_tokens",
        F.coalesce(F.size("m.segments"), F.lit(0)).alias("n_segments"), refresh_due(F.col("m.source_type"), age, days).alias("due"),
    )
    by_skill = found.select("skill", source.alias("s")).groupBy("skill").agg(F.array_sort(F.collect_list("s")).alias("sources"), F.bool_or("s.due").alias("refresh_due"))
    unique = first_of(skills, ["real_path"], ["root_ord", "skill"])
    return unique.join(by_skill, "skill").select("skill", F.coalesce("name", "skill").alias("name"), F.coalesce("description", F.lit("")).alias("description"), (F.size("sources") > 1).alias("topic"), "sources", "refresh_due")


def manifest_json(documents: DataFrame, segments: DataFrame, version: str) -> DataFrame:
    """(source_id, json) of what was extracted, for later refreshing.

    documents: source_id, source, origin, source_type, title, est_tokens, extracted_at, options (struct); segments: source_id, seg_ord, url, key, title.
    """
    key = F.coalesce(F.nullif("url", F.lit("")), F.nullif("key", F.lit("")), "title")
    listed = segments.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", key.alias("key"), "title"))), lambda s: F.struct(s["key"].alias("key"), s["title"].alias("title"))).alias("segments"))
    origin = F.when(F.col("origin").rlike("^https?://"), F.col("origin")).otherwise(F.col("source"))
    out = F.struct("source", origin.alias("origin"), "source_type", "title", "est_tokens", F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted_at"), F.lit(version).alias("extractor_version"), "options", "segments")
    return documents.join(listed, "source_id").select("source_id", F.to_json(out).alias("json"))


def file_name(seg_ord: Column, slug: Column) -> Column:
    """NN-slug.md; numbers of three digits stay whole."""
    n = seg_ord.cast("string")
    return F.concat(F.lpad(n, F.greatest(F.lit(2), F.length(n)), F.lit("0")), F.lit("-"), slug, F.lit(".md"))


def read_plan(est_tokens: Column) -> Column:
    """How a source of so many tokens is read: whole, by slices, or by parallel ranges."""
    return F.when(est_tokens <= 40_000, F.lit("whole")).when(est_tokens <= 100_000, F.lit("slices")).otherwise(F.lit("ranges"))


def skipped(front_matter: Column, hidden: Column, orphan: Column, stub: Column) -> Column:
    """Segments that get no file of their own."""
    return F.coalesce(front_matter, F.lit(False)) | F.coalesce(hidden, F.lit(False)) | F.coalesce(orphan, F.lit(False)) | F.coalesce(stub, F.lit(False))


def anki_rows(cards: DataFrame, deck: str) -> DataFrame:
    """front, back and tags of study cards, for a tab-separated sink."""
    flat = lambda c: F.regexp_replace(c, r"[\t\r\n]+", " ")
    back = F.when(F.coalesce("link", F.lit("")) == "", flat(F.col("a"))).otherwise(F.concat(flat(F.col("a")), F.lit(" "), "link"))
    return cards.select(flat(F.col("q")).alias("front"), back.alias("back"), F.lit(deck).alias("tags"))


def capabilities(spark) -> DataFrame:
    """Which optional packages are there: name, what for, available."""
    import importlib.util

    wanted = [("yt_dlp", "media downloads"), ("pymupdf", "PDF text"), ("mlx_whisper", "transcription"), ("faster_whisper", "transcription"), ("whisper", "transcription"), ("tokenizers", "token ids")]
    return spark.createDataFrame([(n, use, importlib.util.find_spec(n) is not None) for n, use in wanted], "name string, used_for string, available boolean")
