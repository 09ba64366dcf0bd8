"""Catalogue of the engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.operators import contract, detect, discussions, folds, media, notes, refresh, threads
from strataline.plans.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["ORACLES", "QUERIES"]


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _title(doc_id: str = "doc_id"):
    return F.concat(F.lit("Document "), F.col(doc_id).cast("string"))


@query
def q01_words_per_doc(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query
def q02_est_tokens_per_doc(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.est_tokens(T.word_count(F.col("text"))).alias("est_tokens"))


def _document_segments(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "text").withColumn("title", _title())
    return contract.segments(docs, ["source"], ["doc_id"], "title", "text")


@query
def q03_segment_offsets_by_source(spark, sf_dir):
    return _document_segments(spark, sf_dir).select("source", F.col("seg_ord").cast("long").alias("seg_ord"), "doc_id", "title", "offset", "words", "est_tokens")


@query
def q04_source_summary(spark, sf_dir):
    own = _document_segments(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_segments"), F.sum("words").alias("words"), F.sum("n_chars_chunk").alias("chars"))
    return own.withColumn("est_tokens", T.est_tokens(F.col("words")))


@query
def q05_unique_keys_by_lang(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("title"))
    return contract.unique_keys(docs, ["source"], "title", ["doc_id"]).select("doc_id", "source", "key")


def _capped(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    return folds.greedy_cap(docs, "source", "doc_id", "size", 60_000)


@query
def q06_greedy_text_cap(spark, sf_dir):
    return _capped(spark, sf_dir).filter("kept").select("source", "doc_id")


@query
def q07_dropped_log(spark, sf_dir):
    gone = _capped(spark, sf_dir).filter("not kept")
    return gone.groupBy("source").agg(F.count("*").alias("n_dropped"), F.min("doc_id").alias("first_dropped"), F.max("doc_id").alias("last_dropped")).withColumn("reason", F.lit("over text cap"))


@query
def q08_page_limit_cap(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id")
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.withColumn("position", n).filter("position <= 15").select("source", "doc_id", F.col("position").cast("long").alias("position"))


@query
def q09_exact_dedupe_first_wins(spark, sf_dir):
    # the digest travels, not the text
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query
def q10_stub_flag(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", (F.length("text") < 200).alias("stub"))


@query
def q11_clean_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.clean_lines(F.col("text")).alias("cleaned"))


@query
def q12_snippet_titles(spark, sf_dir):
    first = F.element_at(T.lines(F.col("text")), 1)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), T.snippet(first)).alias("title"))


@query
def q13_segment_slice_roundtrip(spark, sf_dir):
    """Each document cut out of its source's whole text again, by offsets; the text lies in parts, and digests tell whether a slice is the chunk."""
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", contract.chunk(_title(), F.coalesce("text", F.lit(""))).alias("chunk")).withColumn("digest", F.sha2("chunk", 256))
    sizes = docs.select("source", "doc_id", "digest", F.length("chunk").alias("size"))
    segs = contract.with_offsets(sizes, ["source"], ["doc_id", "digest"], F.col("size"))
    segs = segs.withColumn("next", F.lead("offset").over(Window.partitionBy("source").orderBy("offset")))
    parts = contract.text_parts(docs.join(segs.select("source", "doc_id", "digest", "offset"), ["source", "doc_id", "digest"]), ["source"], "chunk")
    cut = segs.join(contract.slices(segs, parts, ["source"]), ["source", "offset"])
    return cut.select("source", "doc_id", F.length("slice").cast("long").alias("n_chars"), (F.sha2("slice", 256) == F.col("digest")).alias("same"))


@query
def q14_tag_counts_sources(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", F.array("lang", F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string"))).alias("tags"))
    return notes.tag_counts(docs, "source", "tags").select("source", "tag", "n", F.col("rank").cast("long").alias("rank"))


#: Addresses of every family beside the pages' own.
SOURCES = [
    "https://www.youtube.com/watch?v=abc", "https://www.youtube.com/watch?v=abc&list=PL1", "https://www.youtube.com/watch?list=PL1", "https://youtu.be/abc",
    "https://www.youtube.com/playlist?list=PL1", "https://www.youtube.com/@name/videos", "youtube.com/channel/UC1", "https://docs.example.org/llms.txt",
    "https://docs.example.org/a/llms-full.txt?x=1", "https://feeds.example.org/show", "https://example.org/feed", "https://podcasts.apple.com/us/podcast/x/id1",
    "https://example.org/a.mp3?x=1", "https://arxiv.org/abs/1706.03762", "https://github.com/owner/repo.git", "https://github.com/owner/repo/tree/main",
    "https://news.ycombinator.com/item?id=1", "https://old.reddit.com/r/x/comments/abc/title", "https://redd.it/abc", "paper.pdf", "book.EPUB", "talk.wav", "deck.pptx", "old.doc", "cues.srt", "unknown.bin",
]


def _sources(spark, sf_dir):
    fixed = spark.createDataFrame([(s,) for s in SOURCES], "source string")
    return _table(spark, sf_dir, "pages").select(F.col("url").alias("source")).union(fixed).distinct()


@query
def q15_detect_source_type(spark, sf_dir):
    return detect.detect(_sources(spark, sf_dir)).select("source", "source_type")


@query
def q16_possible_types_and_forced(spark, sf_dir):
    own = _sources(spark, sf_dir).withColumn("forced", F.when(F.length("source") % 3 == 0, F.lit("article")).when(F.length("source") % 3 == 1, F.lit("audio")))
    found = detect.detect(own, forced="forced")
    return found.select("source", F.array_join("possible", ",").alias("possible"), "source_type", F.col("reason").isNotNull().alias("refused"))


def _pages(spark, sf_dir):
    from strataline.operators.html import page_sections

    return page_sections(_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")


@query
def q17_page_title_slug(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "title", T.slugify(F.col("title")).alias("slug"))


def _article(spark, sf_dir):
    from strataline.operators.html import article_segments

    return article_segments(_pages(spark, sf_dir), "page_id")


@query
def q18_article_words(spark, sf_dir):
    return _article(spark, sf_dir).groupBy("page_id").agg(F.sum("content_words").alias("words"))


@query
def q19_readable_gate(spark, sf_dir):
    own = _article(spark, sf_dir).groupBy("page_id").agg(F.sum("content_words").alias("gate"), F.sum("words").alias("words"))
    return own.filter("gate >= 100").select("page_id", "words", T.est_tokens(F.col("words")).alias("est_tokens"))


@query
def q20_article_language(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "language")


@query
def q21_sections_from_headings(spark, sf_dir):
    return _article(spark, sf_dir).select("page_id", F.col("seg_ord").cast("long").alias("seg_ord"), "title", "offset")


@query
def q22_url_defrag_dedupe(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", T.without_query(F.col("url")).alias("address"))
    return contract.first_of(pages, ["address"], ["page_id"]).select("page_id", "address")


@query
def q23_md_twin_candidates(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.markdown_twins(F.col("url"))).alias("ord", "candidate"))
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), "candidate")


@query
def q24_llms_candidates(spark, sf_dir):
    from strataline.operators.docs import llms_candidates

    rows = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(llms_candidates(F.col("url"))).alias("ord", "candidate"))
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), "candidate")


def _cues(spark, sf_dir):
    """Events as cues of a recording per user: seconds since the user's first event, scaled."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = F.min("us").over(Window.partitionBy("user_id"))
    return e.select("user_id", "event_id", "event_type", (F.floor((F.col("us") - first) / 3_600_000_000) * 10).cast("long").alias("start_s")).withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("start_s", "event_id")).cast("long"))


@query
def q25_cues_from_rendered_vtt(spark, sf_dir):
    from strataline.operators.subtitles import parse_cues

    stamp = F.format_string("%02d:%02d:%02d.000 --> %02d:%02d:%02d.000", *[x for k in (0, 1) for x in (F.floor((F.col("start_s") + k) / 3600), F.floor((F.col("start_s") + k) % 3600 / 60), (F.col("start_s") + k) % 60)])
    block = F.concat(F.col("event_id").cast("string"), F.lit("\n"), stamp, F.lit("\n<v Speaker>"), "event_type", F.lit(" &amp; more</v>\n"))
    own = _cues(spark, sf_dir).withColumn("block", block)
    files = own.groupBy("user_id").agg(F.concat(F.lit("WEBVTT\n\nNOTE rendered\nnot a cue\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]), "\n")).alias("text"))
    return parse_cues(files, "user_id", "text", dedupe=False).select("user_id", F.col("cue_ord").alias("ord"), F.col("start_s").cast("long").alias("start_s"), "text")


@query
def q26_consecutive_dedupe(spark, sf_dir):
    return media.without_repeats(_cues(spark, sf_dir), "user_id", "ord", "event_type").select("user_id", "ord", "event_type")


def _windows(spark, sf_dir):
    return media.fixed_windows(media.durations(_cues(spark, sf_dir), "user_id", "start_s"), "user_id", "duration_s")


@query
def q27_fixed_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query
def q28_cue_to_segment_range_join(spark, sf_dir):
    own = media.assign(_cues(spark, sf_dir), _windows(spark, sf_dir), "user_id", "start_s")
    return own.groupBy("user_id", "seg_ord").agg(F.count("*").alias("n_cues"), F.min("ord").alias("first_cue"), F.max("ord").alias("last_cue"))


@query
def q29_marker_fold(spark, sf_dir):
    cues = _cues(spark, sf_dir).withColumn("since", F.lit(0))
    return folds.mark_times(cues, ["user_id"], "ord", "start_s", "since", 300).filter("marked").select("user_id", "ord", "start_s")


@query
def q30_speakers(spark, sf_dir):
    from strataline.operators.subtitles import speakers

    line = F.concat(F.initcap("role"), F.lit(": "), F.element_at(T.lines(F.col("text")), 1))
    cues = _table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("source_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), line.alias("text"), F.lit(False).alias("voiced"))
    return speakers(cues, "source_id").select("source_id", "name", "n", F.col("position").cast("long").alias("position"))


@query
def q31_duration_rule(spark, sf_dir):
    return media.durations(_cues(spark, sf_dir), "user_id", "start_s")


@query
def q32_deep_links(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    kind = F.col("page_id") % 4
    base = F.regexp_replace(T.without_query(F.col("url")), r"^https?://[^/]+", "")
    origin = F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/watch?v=v"), F.col("page_id").cast("string"), F.lit("#x"))).when(kind == 1, F.concat(F.lit("https://vimeo.com"), base)).when(kind == 2, F.concat(F.lit("https://cdn.example.org"), base, F.lit(".mp3"))).otherwise(F.col("url"))
    return pages.select("page_id", T.at_second(T.deep_link_template(origin), F.col("page_id") * 7).alias("link"))


def _comments(spark, sf_dir):
    """Turns as comments: a binary tree per conversation, every third turn deleted."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2).cast("long"))
    return c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("id"), parent.alias("parent_id"), F.col("turn").alias("ord"), (F.col("turn") % 3 == 1).alias("deleted"), F.col("role").alias("author"), "text")


def _tree(spark, sf_dir):
    return threads.reading_order(threads.promoted(_comments(spark, sf_dir)))


@query
def q33_promote_deleted(spark, sf_dir):
    return _tree(spark, sf_dir).select("thread_id", "id", F.col("depth").cast("long").alias("depth"), "root_id")


def _lines(spark, sf_dir):
    own = _tree(spark, sf_dir).join(_comments(spark, sf_dir).select("thread_id", "id", "author", "text"), ["thread_id", "id"])
    text = F.filter(F.transform(T.lines(F.coalesce("text", F.lit(""))), T.collapse), lambda x: x != "")
    return own.withColumn("line", F.array_join(discussions.comment_lines(F.col("depth"), F.col("author"), F.lit(None).cast("int"), text), "\n"))


@query
def q34_dfs_render_order(spark, sf_dir):
    return _lines(spark, sf_dir).select("thread_id", F.col("pos").cast("long").alias("pos"), "id", "line")


@query
def q35_comment_budget(spark, sf_dir):
    own = _lines(spark, sf_dir).withColumn("size", F.octet_length("line") + 1)
    return folds.take_budget(own, "thread_id", "pos", "size", 4, 900).select("thread_id", F.col("pos").cast("long").alias("pos"), "taken")


@query
def q36_root_ranking(spark, sf_dir):
    roots = _table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("thread_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") % 2 == 0, F.length("text") % 50).alias("score"))
    return threads.ranked_roots(roots, "score", "id").select("thread_id", "id", F.col("rank").cast("long").alias("rank"))


@query
def q37_thread_segments(spark, sf_dir):
    own = _lines(spark, sf_dir).groupBy("thread_id", "root_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("n_comments"))
    return own.select("thread_id", "root_id", "n_comments", F.md5("body").alias("body_md5"))


@query
def q38_comment_counts(spark, sf_dir):
    return _comments(spark, sf_dir).groupBy("thread_id").agg(F.count_if(~F.col("deleted")).alias("n_comments"), F.count("*").alias("n_all"))


def _vault(spark, sf_dir):
    """Documents as notes of one vault per language; each links three others by arithmetic."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("vault_id"), (F.col("doc_id") % 7).alias("folder"))
    path = F.concat(F.lit("f"), F.col("folder").cast("string"), F.lit("/note"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.withColumns({"path": path, "seg_ord": F.col("doc_id")})


def _note_text():
    goal = [F.floor(F.col("doc_id") / 10) * 10, F.pmod(F.col("doc_id") * 3, F.lit(50)), F.col("doc_id")]
    link = [F.concat(F.lit("note"), g.cast("string")) for g in goal]
    return F.concat(F.lit("See [["), link[0], F.lit("|the first]] and [["), link[1], F.lit("#part]].\n```\n[[not-a-link]]\n```\nSelf [["), link[2], F.lit("]] and [other]("), link[0], F.lit(".md).\n"))


def _note_links(spark, sf_dir):
    from strataline.operators.markdown import note_links

    return note_links(_vault(spark, sf_dir).withColumn("text", _note_text()), "doc_id", "text")


@query
def q39_rendered_note_links(spark, sf_dir):
    return _note_links(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), "target")


@query
def q40_hubs_topk(spark, sf_dir):
    vault = _vault(spark, sf_dir)
    links = _note_links(spark, sf_dir).join(vault.select("doc_id", "vault_id", F.col("path").alias("src")), "doc_id").select("vault_id", "src", "target")
    return notes.hubs(notes.resolved_links(vault, links)).select("vault_id", "path", "inbound", F.col("rank").cast("long").alias("rank"))


@query
def q41_frontmatter_roundtrip(spark, sf_dir):
    from strataline.operators.markdown import frontmatter

    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    odd = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("tags: ["), "lang", F.lit(", '"), "source", F.lit("']\n"))).otherwise(F.concat(F.lit("tags:\n  - "), "lang", F.lit("\n  - #"), "source", F.lit("  # why\n")))
    text = F.concat(F.lit('---\ntitle: "Note '), F.col("doc_id").cast("string"), F.lit('"\n'), odd, F.lit("---\nBody "), F.col("n_chars").cast("string"))
    return frontmatter(docs.withColumn("note", text), "doc_id", "note").select("doc_id", "title", F.array_join("tags", ",").alias("tags"), "body")


def _markdown():
    return F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\nintro "), "lang", F.lit("\n```\n# not a heading\n```\n## Part "), "source", F.lit("\nbody "), F.col("n_chars").cast("string"), F.lit("\n## Empty\n"))


@query
def q42_fence_aware_headings(spark, sf_dir):
    from strataline.operators.markdown import headings

    docs = _table(spark, sf_dir, "documents").select("doc_id", _markdown().alias("md"))
    return headings(docs, "doc_id", "md").select("doc_id", F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), "title")


def _index(spark, sf_dir):
    """An llms.txt index per host: required pages, then an Optional section."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("site"), F.octet_length("html").alias("size"))
    p = p.withColumns({"optional": F.col("page_id") % 3 == 0, "path": F.concat(F.lit("/p"), F.col("page_id").cast("string"), F.lit(".md"))})
    item = F.concat(F.lit("- [Page "), F.col("page_id").cast("string"), F.lit("]("), "path", F.lit("): note "), F.col("size").cast("string"))
    lines = p.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("optional", "page_id", item.alias("line")))).alias("a"))
    part = lambda flag: F.array_join(F.transform(F.filter("a", lambda x: x["optional"] == flag), lambda x: x["line"]), "\n")
    text = F.concat(F.lit("# "), "site", F.lit("\n\n> About "), "site", F.lit("\n\nDetails.\n\n## Docs\n\n"), part(False), F.lit("\n\n## Optional\n\n"), part(True), F.lit("\n"))
    return p, lines.select("site", text.alias("text"))


@query
def q43_llms_index_links(spark, sf_dir):
    from strataline.operators.docs import parse_index

    _, files = _index(spark, sf_dir)
    base = F.concat(F.lit("https://"), "site", F.lit("/llms.txt"))
    return parse_index(files.withColumn("base", base), "site", "text", "base").select("site", F.col("ord").cast("long").alias("ord"), "section", "name", "url", "notes", "optional")


@query
def q44_docs_caps_required_optional(spark, sf_dir):
    pages, _ = _index(spark, sf_dir)
    rows = pages.select((F.col("page_id") % 5).alias("site"), F.col("page_id").alias("ord"), "optional", F.when(F.col("page_id") % 11 != 0, F.col("size")).alias("size"))
    return folds.take_optional(rows, "site", "ord", 20, 60_000, 50_000)


@query
def q45_llms_full_split(spark, sf_dir):
    from strataline.operators.docs import split_full

    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("# Page "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("md"))
    files = docs.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "md"))), lambda x: x["md"]), "").alias("text"))
    return split_full(files, "source", "text").select("source", F.col("ord").cast("long").alias("ord"), "title", "body")


@query
def q46_pipe_table(spark, sf_dir):
    from strataline.operators.tables import pipe_table

    n = _table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    cells = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])).alias("rows"))
    head = F.array(F.array(F.lit("key"), F.lit("na|me")))
    return cells.select(F.col("region").cast("long").alias("region"), pipe_table(F.concat(head, "rows")).alias("rendered"))


def _manifests(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"))
    position = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
    return docs.filter("doc_id % 10 <> 0"), docs.filter("doc_id % 7 <> 0").withColumn("position", position)


@query
def q47_manifest_diff_added(spark, sf_dir):
    old, new = _manifests(spark, sf_dir)
    return refresh.added(old, new, "source").select("source", "key", "position")


@query
def q47_manifest_diff_removed(spark, sf_dir):
    old, new = _manifests(spark, sf_dir)
    return refresh.removed(old, new, "source").select("source", "key")


@query
def q47_manifest_diff_unchanged(spark, sf_dir):
    old, new = _manifests(spark, sf_dir)
    return refresh.unchanged(old, new, "source")


@query
def q48_refresh_due(spark, sf_dir):
    kinds = F.array(*[F.lit(t) for t in detect.TYPES])
    own = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.element_at(kinds, (F.col("o_orderkey") % 12 + 1).cast("int")).alias("source_type"))
    age = refresh.age_days(F.col("at"), F.lit("1998-08-02 12:00:00").cast("timestamp"))
    return own.select("o_orderkey", age.alias("age_days"), refresh.refresh_due(F.col("source_type"), age, 400).alias("due"))


@query
def q49_inventory_topics(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "lang", T.est_tokens(T.word_count(F.col("text"))).alias("est"))
    own = docs.groupBy("lang", "source").agg(F.sum("est").alias("est"), F.count("*").alias("n"))
    return own.groupBy("lang").agg(F.count("*").alias("n_sources"), (F.count("*") > 1).alias("topic"), F.sum("est").alias("est_tokens"), F.max("n").alias("most_segments"))


@query
def q50_validate_rules(spark, sf_dir):
    from strataline.operators.validate import frontmatter_errors

    name = F.when(F.col("doc_id") % 4 == 0, F.lit("other")).otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    about = F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.col("text"))
    own = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("folder"), name.alias("name"), about.alias("description"))
    return own.select("doc_id", F.explode(frontmatter_errors(F.col("folder"), F.col("name"), F.col("description"))).alias("error"))


@query
def q51_eval_score(spark, sf_dir):
    own = _table(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("skill"), (F.col("quality") == 1).alias("ok"))
    return refresh.eval_scores(own, "skill", "ok")


@query
def q52_leitner_schedule(spark, sf_dir):
    box = refresh.next_box((F.col("doc_id") % 5 + 1).cast("int"), F.col("quality") == 1)
    own = _table(spark, sf_dir, "labels").select("doc_id", box.alias("box"))
    return own.select("doc_id", F.col("box").cast("long").alias("box"), refresh.next_due(F.lit("2024-01-01").cast("date"), F.col("box")).alias("due"))


@query
def q53_rate_limit_run(spark, sf_dir):
    own = _cues(spark, sf_dir).withColumn("limited", F.col("event_type").isin("error", "view"))
    return media.aborted_runs(own, "user_id", "ord", "limited", 3)


@query
def q54_caption_track_choice(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, F.lit("manual")).otherwise(F.lit("auto"))
    tracks = docs.select((F.col("doc_id") % 40).alias("video"), kind.alias("kind"), F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("-x"))).otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 == 0, F.lit("json")).otherwise(F.lit("vtt")).alias("ext"), F.col("doc_id").alias("fmt_ord"))
    return media.track_choice(tracks, "video").select("video", "kind", "lang", "fmt_ord")


@query
def q55_year_and_doi(spark, sf_dir):
    from strataline.functions.citation import arxiv_year, creation_year, doi

    d = F.col("doc_id")
    text = F.concat(F.lit("doi:10."), (1000 + d % 9000).cast("string"), F.lit("/abc."), d.cast("string"), F.lit(".). More"))
    ident = F.format_string("%02d%02d.%05d", d % 25, d % 12 + 1, d % 99999)
    made = F.concat(F.lit("D:"), (1990 + d % 40).cast("string"), F.lit("0102"))
    return _table(spark, sf_dir, "documents").select("doc_id", doi(text).alias("doi"), arxiv_year(ident).alias("arxiv_year"), creation_year(made).alias("creation_year"))


@query
def q56_listing_entries(spark, sf_dir):
    from strataline.operators.listings import numbered_entries

    n = F.col("page_id")
    video = F.when(n % 7 != 0, F.concat(F.lit("v"), n.cast("string")))
    own = _table(spark, sf_dir, "pages").select((n % 40).alias("listing"), "page_id", video.alias("id"), F.when(n % 3 == 0, F.col("url")).alias("url"), F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("T "), n.cast("string"))).alias("title"), F.lit(20).alias("most"))
    return numbered_entries(own, "listing", "page_id", "most").select("listing", "page_id", F.col("number").cast("long").alias("number"), "title", "url", "reason")


@query
def q57_transcript_choice(spark, sf_dir):
    from strataline.operators.listings import chosen_transcript

    d = F.col("doc_id")
    docs = _table(spark, sf_dir, "documents")
    captions = docs.filter(d % 3 != 0).select(d.alias("video_id"), F.when(d % 2 == 0, F.lit("manual")).otherwise(F.lit("auto")).alias("kind"), F.when(d % 5 == 0, F.lit("  ")).otherwise(F.col("source")).alias("text"))
    speech = docs.filter(d % 4 != 1).select(d.alias("video_id"), F.col("lang").alias("text"))
    return chosen_transcript(docs.select(d.alias("video_id"), (d % 8 == 2).alias("forced")), captions, speech)


@query
def q58_source_captures(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("doc_id").cast("string")
    number = F.concat((1000 + d % 9000).cast("string"), F.lit("."), (10000 + d % 90000).cast("string"), F.lit("v2"))
    kinds = F.array(
        F.concat(F.lit("https://arxiv.org/abs/"), number), F.concat(F.lit("https://github.com/owner"), n, F.lit("/repo-"), n, F.lit(".git")), F.concat(F.lit("https://www.youtube.com/@name"), n, F.lit("/about")),
        F.concat(F.lit("https://news.ycombinator.com/item?id="), n), F.concat(F.lit("https://old.reddit.com/r/x/comments/a"), n, F.lit("/title")), F.concat(F.lit("https://feeds.example.org/show"), n),
    )
    own = _table(spark, sf_dir, "documents").select("doc_id", F.element_at(kinds, (d % 6 + 1).cast("int")).alias("s"))
    repo, thread = detect.repository(F.col("s")), detect.thread_id(F.col("s"))
    limit = detect.default_limit(F.col("s"), F.lit(None).cast("int")).cast("long")
    return own.select("doc_id", detect.arxiv_id(F.col("s")).alias("arxiv_id"), repo["owner"].alias("owner"), repo["repo"].alias("repo"), detect.channel_videos_url(F.col("s")).alias("videos_url"), thread["platform"].alias("platform"), thread["id"].alias("thread_id"), limit.alias("default_limit"))


@query
def q59_skill_file_problems(spark, sf_dir):
    from strataline.operators.validate import broken_links, empty_files

    d, n = F.col("doc_id"), F.col("doc_id").cast("string")
    text = F.concat(F.lit("See [x](f"), (d + 30).cast("string"), F.lit(".md#part), [y](f"), n, F.lit(".md) and [z](https://x.org/z.md)"))
    files = _table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), (d % 30).cast("string")).alias("skill"), F.concat(F.lit("a/f"), n, F.lit(".md")).alias("path"), F.when(d % 9 == 0, F.lit(" \n")).otherwise(text).alias("content"))
    lost = broken_links(files).select("skill", "path", F.concat(F.lit("no file "), "target").alias("problem"))
    return lost.unionByName(empty_files(files).withColumn("problem", F.lit("empty")))


@query
def q60_evaluation_files(spark, sf_dir):
    from strataline.operators.validate import eval_errors

    d, n = F.col("doc_id"), F.col("doc_id").cast("string")
    item = F.struct(d.alias("id"), F.when(d % 6 == 1, F.lit("")).otherwise(F.lit("p")).alias("prompt"), F.when(d % 6 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("expectations"))
    items = F.when(d % 6 == 3, F.slice(F.array(item), 1, 0)).otherwise(F.array(item))
    name = F.when(d % 4 == 0, F.lit("other")).otherwise(F.concat(F.lit("s"), n))
    files = _table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), n).alias("skill"), F.to_json(F.struct(name.alias("skill_name"), items.alias("evals"))).alias("content"))
    return eval_errors(files)


@query
def q61_listing_outcome(spark, sf_dir):
    from strataline.operators.listings import outcome

    n, k = F.col("page_id"), F.floor(F.col("page_id") / 40)
    kind = (k * 7 + n % 40) % 5
    reason = F.when(kind < 2, F.lit("HTTP Error 429")).when((kind == 2) | (n % 40 > 35), F.lit("Too Many Requests")).when(kind == 3, F.lit("private"))
    tries = _table(spark, sf_dir, "pages").select((n % 40).alias("listing"), n.alias("number"), F.when(n % 6 != 0, F.lit("u")).alias("url"), reason.alias("reason"))
    return outcome(tries, "listing")


@query
def q62_citation_strings(spark, sf_dir):
    from strataline.functions.citation import authors, in_text_year, stamped_id, venue_year

    d, n = F.col("doc_id"), F.col("doc_id").cast("string")
    venue = F.when(d % 2 == 0, F.concat(F.lit("at NeurIPS "), (2000 + d % 24).cast("string"), F.lit(", in May"))).otherwise(F.concat(F.lit("ICML '"), F.lpad((d % 24).cast("string"), 2, "0"), F.lit(" and 1850")))
    stamp = F.concat(F.lit("x\narXiv:1706."), F.lpad((d % 99999).cast("string"), 5, "0"), F.lit("v3  [cs.CL]  2 Aug 2023"))
    names = F.element_at(F.array(F.concat(F.lit("Ann A"), n, F.lit("; Bo B and Cy C")), F.concat(F.lit("Ada L"), n, F.lit(", Alan T")), F.concat(F.lit("L"), n, F.lit(", Ada"))), (d % 3 + 1).cast("int"))
    told = F.concat(F.lit("trained on WMT 2014 with 2100 steps"), F.when(d % 4 != 0, F.concat(F.lit(", in "), (1990 + d % 30).cast("string"))).otherwise(F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", venue_year(venue).alias("venue_year"), stamped_id(stamp).alias("stamped_id"), F.array_join(authors(names), "|").alias("authors"), in_text_year(told).alias("text_year"))


@query
def q63_options_hints_paths(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("doc_id").cast("string")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (d % len(x) + 1).cast("int"))
    wrong = detect.option_error(pick("playlist", "youtube", "book"), F.when(d % 5 == 0, F.lit(3)), d % 2 == 0)
    advice = detect.hint(pick("HTTP Error 429", "Too Many Requests", "Sign in to confirm you're not a bot", "HTTP 404"))
    path = F.when(d % 7 == 0, F.lit("/home/u")).otherwise(F.concat(pick("/home/u/", "/home/u2/", "/srv/home/u/"), n))
    return _table(spark, sf_dir, "documents").select("doc_id", wrong.alias("option_error"), advice.alias("hint"), detect.home_redacted(path, "/home/u").alias("path"))
