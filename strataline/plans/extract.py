"""One plan per kind of source: from its input rows to segments, and the rows that were left out.

Every plan takes input tables keyed by source_id and returns (segments, rejects).  segments: source_id, seg_ord,
title, body, key, offset, words, and the kind's own columns; rejects: source_id, stage, path or url, reason.
``summary`` gives one record per source from segments.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.operators import contract, docs, epub, folds, html, media, notes, office, paper, repo, subtitles
from strataline.operators.markdown import render_note, split_frontmatter, tags_of
from strataline.operators.repo import file_title
from strataline.sources import http

#: Bounds of notes, folders and files that hold none, files that come first, words of a text layer.
NOTE_BYTES, TEXT_BYTES, SNIFF_BYTES = 1_000_000, 2_000_000, 8192
NOTE_ENDINGS = r"(?i)\.(md|markdown|mdx|txt|rst)$"
TOOL_FOLDERS = r"(^|/)(\.[^/]*|node_modules|__pycache__|venv|site-packages)(/|$)|^logseq/(bak|version-files)/"
FIRST_FILES = ("readme", "index", "_index", "home")
PDF_WORDS = 50

def located(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with title and body as segments: seg_ord, key, offset and words."""
    own = rows.withColumn("seg_ord", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))
    if "key" not in own.columns:
        own = contract.unique_keys(own, ["source_id"], "title", ["seg_ord"])
    chunk = contract.chunk(F.col("title"), F.col("body"))
    own = own.withColumns({"__n": F.length(chunk), "words": T.word_count(chunk)})
    return contract.with_offsets(own, ["source_id"], ["seg_ord"], F.col("__n")).drop("__n")


def summary(segments: DataFrame, source_type: str) -> DataFrame:
    """source_id, source_type, words, est_tokens, n_segments."""
    own = segments.groupBy("source_id").agg(F.sum("words").alias("words"), F.count("*").alias("n_segments"))
    return own.withColumns({"source_type": F.lit(source_type), "est_tokens": T.est_tokens(F.col("words"))})


def refused(rows: DataFrame, stage: str, place: Column, reason: Column) -> DataFrame:
    return rows.select("source_id", F.lit(stage).alias("stage"), place.alias("place"), reason.alias("reason"))


def articles(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Web pages (source_id, url, status, media_type, charset, body); a page of under 100 words is refused."""
    fetched = http.texts(responses).withColumnRenamed("text", "html")
    own = responses.select("source_id", "url").join(fetched, "url")
    bad = http.failure(F.col("status"), F.col("n_bytes"))
    good = own.filter(bad.isNull())
    segs = html.article_segments(html.page_sections(good, "source_id", "html"), "source_id")
    gate = segs.groupBy("source_id").agg(F.sum("content_words").alias("n"))
    readable = gate.filter(F.col("n") >= html.LEAST_WORDS)
    short = gate.filter(F.col("n") < html.LEAST_WORDS)
    rejects = refused(own.filter(bad.isNotNull()), "fetch", F.col("url"), bad).unionByName(refused(short, "gate", F.lit(None).cast("string"), F.concat(F.lit("not readable: "), F.col("n").cast("string"), F.lit(" words"))))
    kept = segs.join(readable.select("source_id"), "source_id", "left_semi")
    return contract.unique_keys(kept, ["source_id"], "title", ["seg_ord"]).drop("content_words"), rejects


def note_order(path: Column) -> Column:
    """Sort key of a note: a folder's files before its subfolders, entry pages first."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(F.lit(1).alias("folder"), F.lit(0).alias("late"), F.lower(p).alias("name")))
    late = (~F.regexp_replace(name, r"\.[^.]*$", "").isin(*FIRST_FILES)).cast("int")
    return F.concat(folders, F.array(F.struct(F.lit(0).alias("folder"), late.alias("late"), name.alias("name"))))


def vaults(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Note folders (source_id, path, content as bytes); segments carry path, tags and links."""
    own = files.filter(F.col("path").rlike(NOTE_ENDINGS) & ~F.col("path").rlike(TOOL_FOLDERS))
    zero = F.col("content").isNull() | F.hex(F.substring("content", 1, SNIFF_BYTES)).rlike("^(..)*?00")
    why = F.when(F.octet_length("content") > NOTE_BYTES, F.lit("over file size limit")).when(zero, F.lit("binary content"))

    def run(batches):
        for b in batches:
            rows = []
            for path, raw in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                text = raw.as_py().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
                fields, body = ({}, text) if path.lower().endswith((".txt", ".rst")) else split_frontmatter(text)
                body, links = render_note(body.strip(), path)
                stated = fields.get("title")
                found = file_title(body.strip(), path)
                title = " ".join(stated.split()) if isinstance(stated, str) and stated.strip() else found if found != path else path.rpartition("/")[2].rpartition(".")[0]
                rows.append((title, body.strip(), tags_of(fields), links))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["source_id", "path", "title", "body", "tags", "links"])

    kind = dict(files.dtypes)["source_id"]
    read = own.filter(why.isNull()).select("source_id", "path", "content").mapInArrow(run, f"source_id {kind}, path string, title string, body string, tags array<string>, links array<string>")
    full = read.filter("body <> ''")
    ranked = full.withColumn("ord", F.row_number().over(Window.partitionBy("source_id").orderBy(note_order(F.col("path")), "path")).cast("long"))
    fits = folds.greedy_cap(ranked.select("source_id", "ord", F.octet_length("body").alias("size")), "source_id", "ord", "size", TEXT_BYTES)
    both = ranked.join(fits, ["source_id", "ord"])
    rejects = refused(own.filter(why.isNotNull()), "read", F.col("path"), why).unionByName(refused(both.filter("not kept"), "cap", F.col("path"), F.lit("over text cap")))
    return located(both.filter("kept").drop("kept").withColumn("key", F.col("path")), ["ord"]).drop("ord"), rejects


def vault_hubs(segments: DataFrame) -> DataFrame:
    """(source_id, path, inbound, rank) of the notes that others link to."""
    own = segments.select(F.col("source_id").alias("vault_id"), "seg_ord", "path")
    links = segments.select(F.col("source_id").alias("vault_id"), F.col("path").alias("src"), F.explode("links").alias("target"))
    return notes.hubs(notes.resolved_links(own, links)).withColumnRenamed("vault_id", "source_id")


def sites(indexes: DataFrame, responses: DataFrame, required: int = 150, text_cap: int = TEXT_BYTES, optional_bytes: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """Documentation sites from their index files (source_id, url, text) and the pages fetched for them."""
    links = docs.parse_index(indexes, "source_id", "text", "url")
    links = contract.first_of(links.withColumn("url", T.defragment(F.col("url"))), ["source_id", "url"], ["ord"])
    cands = links.select(F.concat_ws("\u0001", F.col("source_id").cast("string"), "url").alias("k"), F.posexplode(T.markdown_twins(F.col("url"))).alias("ord", "candidate"))
    twins = F.count("*").over(Window.partitionBy("k")) > 1
    found = http.first_usable(cands.withColumn("probe", twins & (F.col("ord") == 0)), http.texts(responses), "k").withColumnsRenamed({"url": "answered", "text": "page"})
    pages = links.withColumn("k", F.concat_ws("\u0001", F.col("source_id").cast("string"), "url")).join(found, "k", "left")
    plain = pages.filter("not is_html or page is null").withColumn("body", T.strip(F.col("page")))
    marked = html.page_sections(pages.filter("is_html and page is not null").select("k", "page"), "k", "page")
    part = lambda s: F.concat(F.when(s["title"].isNull(), F.lit("")).otherwise(F.concat(F.lit("## "), s["title"], F.lit("\n\n"))), s["body"])
    read = marked.select("k", T.strip(F.array_join(F.transform("sections", part), "\n\n")).alias("body"))
    bodies = plain.select("k", "body").unionByName(read)
    sized = pages.join(bodies, "k", "left").withColumn("size", F.octet_length("body"))
    fates = folds.take_optional(sized.select("source_id", "ord", "optional", "size"), "source_id", "ord", required, text_cap, optional_bytes)
    done = sized.join(fates, ["source_id", "ord"])
    kept = done.filter("outcome = 'kept'").select("source_id", F.when(F.col("optional"), F.col("ord") + 1_000_000).otherwise(F.col("ord")).alias("ord"), F.col("name").alias("title"), "body", "url", "section", "notes", "optional")
    why = F.when(F.col("outcome") == "failed", F.coalesce("reason", F.lit("network error"))).otherwise(F.col("outcome"))
    return located(kept.withColumn("key", F.col("url")), ["ord"]).drop("ord"), refused(done.filter("outcome <> 'kept'"), "pages", F.col("url"), why)


def one_file_sites(files: DataFrame, text_cap: int = TEXT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Sites that publish all text in one file (source_id, url, text); of a file over the cap one byte more than the cap is read, and the cut is logged."""
    cut = F.octet_length("text") > text_cap
    head = F.make_valid_utf8(F.substring(F.col("text").cast("binary"), 1, text_cap + 1).cast("string"))
    refusals = refused(files.filter(cut), "cap", F.col("url"), F.lit("over text cap"))
    files = files.withColumn("text", F.when(cut, head).otherwise(F.col("text")))
    segs = docs.split_full(files, "source_id", "text")
    keyed = contract.unique_keys(segs, ["source_id"], "title", ["ord"]).withColumn("key", F.coalesce("url", "key"))
    return located(keyed, ["ord"]).drop("ord"), refusals


def recordings(cues: DataFrame, chapters: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """Segments with chunk and offset of timed sources: cues (source_id, ord, start_s, text), chapters (source_id, ord, title, start_time)."""
    stated = durations if durations is not None else media.durations(cues, "source_id", "start_s")
    windows = media.fixed_windows(stated, "source_id", "duration_s")
    if chapters is not None:
        own = media.chapter_segments(chapters, "source_id", "ord")
        windows = own.unionByName(windows.join(own, "source_id", "left_anti"))
    return media.rendered(cues, windows, "source_id", "ord", "start_s", "text")


def transcripts(files: DataFrame) -> DataFrame:
    """Subtitle and meeting files (source_id, content as bytes) as recordings; repeated lines stay."""
    read = subtitles.parse_transcripts(files, "source_id", "content")
    cues = read.select("source_id", F.posexplode("cues").alias("ord", "c")).select("source_id", "ord", "c.start_s", "c.text")
    return recordings(cues, durations=read.filter(F.size("cues") > 0).select("source_id", "duration_s"))


def books(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EPUB books (source_id, content as bytes); missing chapters are listed."""
    read = epub.books(files, "source_id", "content")
    rows = read.select("source_id", F.posexplode("chapters").alias("ord", "c")).select("source_id", "ord", "c.*")
    lost = read.select("source_id", F.explode("missing").alias("href"))
    rejects = refused(read.filter("error is not null"), "read", F.lit(None).cast("string"), F.col("error")).unionByName(refused(lost, "spine", F.col("href"), F.lit("not in the archive")))
    return located(rows, ["ord"]).drop("ord"), rejects


def office_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Office documents (source_id, name, content as bytes)."""
    read = office.documents(files, "source_id", "name", "content")
    good = read.filter("error is null")
    rows = good.select("source_id", F.posexplode("sections").alias("ord", "s")).select("source_id", "ord", "s.*")
    return located(rows, ["ord"]).drop("ord"), refused(read.filter("error is not null"), "read", F.lit(None).cast("string"), F.col("error"))


def papers(pages: DataFrame, font_lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Papers from page texts (source_id, page, text): sections with offset, page; no chunks, offsets are into the joined pages."""
    joined = pages.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))
    enough = T.word_count(F.col("text")) >= PDF_WORDS
    good = joined.filter(enough)
    if font_lines is not None:
        good = good.join(paper.larger_lines(font_lines, "source_id"), "source_id", "left")
    found = paper.paper_sections(good, "source_id", "text", "fonts" if font_lines is not None else None)
    rows = found.select("source_id", F.posexplode("sections").alias("i", "s")).select("source_id", (F.col("i") + 1).alias("seg_ord"), "s.title", "s.offset")
    return paper.with_pages(rows, pages, "source_id"), refused(joined.filter(~enough), "read", F.lit(None).cast("string"), F.lit("no text layer"))


def repositories(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repository documentation (source_id, path, content); segments carry path, orphan and stub."""
    read = repo.repositories(files, "source_id")
    kept = read.filter("outcome = 'kept'").withColumnRenamed("seg_ord", "ord").drop("outcome")
    return located(kept, ["ord"]).drop("ord"), refused(read.filter("outcome <> 'kept'"), "select", F.col("path"), F.col("outcome"))
