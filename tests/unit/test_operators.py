"""Operators on small fixtures with the edge cases that the driver's tables lack."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataline.functions import citation
from strataline.functions import text as T
from strataline.operators import contract, detect, docs, folds, html, markdown, media, notes, paper, refresh, subtitles, tables, threads, validate


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["", " a  b c d\x1ce \n", "　x\u0085y ", "one", "\t\n"])
def test_words_as_python_splits(spark, text):
    assert one(spark, T.word_count(F.col("t")), t=text) == len(text.split())
    assert one(spark, T.collapse(F.col("t")), t=text) == " ".join(text.split())
    assert one(spark, T.strip(F.col("t")), t=text) == text.strip()


@pytest.mark.parametrize(("words", "tokens"), [(0, 0), (3, 3), (1000, 1333), (12345, 16455)])
def test_token_estimate_truncates(spark, words, tokens):
    assert one(spark, T.est_tokens(F.col("n")), n=words) == tokens


@pytest.mark.parametrize(("title", "slug"), [("Hello, World!", "hello-world"), ("é", "untitled"), ("a" * 59 + " b", "a" * 59), ("--", "untitled"), ("Ünï x", "n-x")])
def test_slug(spark, title, slug):
    assert one(spark, T.slugify(F.col("t")), t=title) == slug


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("https://www.youtube.com/watch?v=x&list=y", "youtube"), ("https://www.youtube.com/watch?list=y", "playlist"), ("youtu.be/x", "youtube"), ("https://youtube.com/@a.b/streams", "playlist"),
        ("https://x.org/llms.txt#a", "docs"), ("https://x.org/rss", "playlist"), ("https://x.org/a.MP3?b", "audio"), ("arxiv.org/pdf/2406.01234v2", "paper"), ("github.com/a/b?tab=readme", "repo"),
        ("https://github.com/a/b/blob/x", "article"), ("https://redd.it/abc/", "thread"), ("Meeting #4.mp4", "audio"), ("a.RTF", "document"), ("x.vtt", "transcript"), ("x", None),
    ],
)
def test_detection(spark, source, kind):
    row = detect.detect(spark.createDataFrame([(source,)], "source string")).first()
    assert row.source_type == kind and (row.reason is None) == (kind is not None)


def test_detection_parts(spark):
    assert one(spark, detect.repository(F.col("s")), s="https://github.com/own-er/re.po.git#x") == ("own-er", "re.po")
    assert one(spark, detect.thread_id(F.col("s")), s="https://old.reddit.com/r/x/comments/ab1/t") == ("reddit", "ab1")
    assert one(spark, detect.arxiv_id(F.col("s")), s="https://arxiv.org/abs/1706.03762v7") == "1706.03762v7"
    assert one(spark, detect.channel_videos_url(F.col("s")), s="m.youtube.com/c/Name/about") == "https://m.youtube.com/c/Name/videos"
    assert one(spark, detect.home_redacted(F.col("s"), "/home/u"), s="/home/u/a.pdf") == "~/a.pdf"
    assert one(spark, detect.default_limit(F.col("s"), F.lit(None).cast("int")), s="https://feeds.x.org/a") == 5


def test_segments_rebuild_the_text(spark):
    rows = [("s", i, f"T{i % 2}", "bödy " * i) for i in range(1, 6)]
    frame = spark.createDataFrame(rows, "source_id string, ord int, title string, body string")
    segs = contract.segments(frame, ["source_id"], ["ord"], "title", "body").orderBy("ord").collect()
    whole = "".join(f"=== {t} ===\n{b}\n\n" for _, _, t, b in rows)
    ends = [s.offset for s in segs[1:]] + [len(whole)]
    assert [whole[s.offset : e] for s, e in zip(segs, ends, strict=True)] == [f"=== {t} ===\n{b}\n\n" for _, _, t, b in rows]
    assert sum(s.words for s in segs) == len(whole.split())
    keys = contract.unique_keys(frame, ["source_id"], "title", ["ord"]).orderBy("ord").collect()
    assert [k.key for k in keys] == ["T1", "T0", "T1 (2)", "T0 (2)", "T1 (3)"]


def test_greedy_cap_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("a", 1, 200), ("a", 2, 50), ("b", 1, 60), ("b", 2, 50), ("b", 3, 40)], "s string, o long, n long")
    got = {(r.s, r.o): r.kept for r in folds.greedy_cap(rows, "s", "o", "n", 100).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("b", 1): True, ("b", 2): False, ("b", 3): True}
    taken = {(r.s, r.o): r.taken for r in folds.take_budget(rows, "s", "o", "n", 2, 70).collect()}
    assert taken == {("a", 1): True, ("a", 2): False, ("b", 1): True, ("b", 2): True, ("b", 3): False}


VTT = """WEBVTT
Kind: captions

NOTE a comment
00:00:01.000 --> 00:00:02.000
hidden

id-1
00:01.500 --> 00:03.000 align:start
<c.x>Hello</c> &amp; <00:00:02.000>you
[music]

01:00:00,250 --> 01:00:01,000
Hello & you
then [laughs] more
"""


def test_cues():
    assert subtitles.cues(VTT, dedupe=True) == [(1.5, "Hello & you"), (3600.25, "then [laughs] more")]
    assert subtitles.cues(VTT, dedupe=False) == [(1.5, "Hello & you"), (3600.25, "Hello & you"), (3600.25, "then [laughs] more")]


def test_transcripts(spark):
    raw = "﻿Language: de\n1\n00:00:01,000 --> 00:00:09,900\n{\\an8}<v.loud Ann Lee>Hi</v>\n\n2\n00:00:03,000 --> 00:00:04,000\nBob: yes\n\n3\n00:00:05,000 --> 00:00:06,000\nNote: once\nBob: no\n".encode()
    old = "1\n00:00:01,000 --> 00:00:02,000\ncaf\xe9\n".encode("cp1252")
    rows = {r.id: r for r in subtitles.parse_transcripts(spark.createDataFrame([(1, raw), (2, old), (3, None)], "id int, content binary"), "id", "content").collect()}
    assert rows[1].language == "de" and rows[1].duration_s == 9 and rows[1].voices == ["Ann Lee"]
    assert [c.text for c in rows[1].cues] == ["Ann Lee: Hi", "Bob: yes", "Note: once", "Bob: no"]
    assert rows[2].cues[0].text == "café" and rows[3].cues == []
    cues = spark.createDataFrame([(1, i, c.text, c.text.startswith("Ann")) for i, c in enumerate(rows[1].cues)], "id int, ord int, text string, voiced boolean")
    assert [(r.name, r.n) for r in subtitles.speakers(cues, "id").orderBy("position").collect()] == [("Ann Lee", 1), ("Bob", 2)]


def test_cues_to_segments(spark):
    cues = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 2, 29.9, "b"), (1, 3, 35.2, "c"), (1, 4, 700.0, "d")], "id int, ord int, t double, text string")
    chapters = spark.createDataFrame([(1, 1, "One", 20.0), (1, 2, "Empty", 100.0), (1, 3, "Two", 650.0)], "id int, ord int, title string, start_time double")
    segs = media.chapter_segments(chapters, "id", "ord")
    got = media.rendered(cues, segs, "id", "ord", "t", "text").orderBy("seg_ord").collect()
    assert [g.chunk for g in got] == ["=== One [t=20s] ===\na\nb\n[t=35s] c\n\n", "=== Empty [t=100s] ===\n\n\n", "=== Two [t=650s] ===\n[t=700s] d\n\n"]
    assert got[2].offset == len(got[0].chunk) + len(got[1].chunk)
    windows = media.fixed_windows(spark.createDataFrame([(1, 1300.5), (2, None)], "id int, d double"), "id", "d").orderBy("id", "seg_ord").collect()
    assert [(w.id, w.title, w.start_s) for w in windows] == [(1, "Part 1", 0), (1, "Part 2", 600), (1, "Part 3", 1200), (2, "Full transcript", 0)]


PAGE = """<html lang="en"><head><title>Site &amp; more</title><meta property="og:title" content="The  Title"><meta name="author" content="A. Uthor">
<script type="application/ld+json">{"@graph": [{"@id": "#p", "name": "P"}, {"author": {"@id": "#p"}, "datePublished": "2024-01-02"}]}</script></head>
<body><nav>menu<p>x</nav><div>outside</div><article>lead<h2>First</h1><p>Text <b>Label:</b>value<ul><li>one<li>two</ul><img alt="a  chart" src=x><img alt=px width=1>
<table><tr><th>k<th>v|w<tr><td>1<td>2</table><template>no</template><h3>Last"""


def test_page(spark):
    page = html.read_page(PAGE)
    assert page.meta["title"] == "Site & more" and page.meta["ld_author"] == "P" and page.meta["ld_date"] == "2024-01-02"
    found = page.sections()
    assert [t for t, _ in found] == [None, "First", "Last"] and found[0][1] == "lead"
    assert "Label: value" in found[1][1] and "[image: a chart]" in found[1][1] and "px" not in found[1][1]
    assert "| k | v\\|w |\n| --- | --- |\n| 1 | 2 |" in found[1][1]
    rows = html.page_sections(spark.createDataFrame([(1, PAGE), (2, None), (3, "plain words only")], "id int, html string"), "id", "html")
    by = {r.id: r for r in rows.collect()}
    assert by[1].title == "The Title" and by[1].author == "A. Uthor" and by[1].language == "en" and by[2].title == "Untitled article"
    segs = html.article_segments(rows, "id").orderBy("id", "seg_ord").collect()
    assert [(s.id, s.title) for s in segs] == [(1, "Introduction"), (1, "First"), (1, "Last"), (2, "Full text"), (3, "Full text")]
    assert segs[1].offset == len("=== Introduction ===\nlead\n\n")


def test_markdown():
    text = "# A\n~~~\n# no\n```\n~~~\n## B ##\ntext\n####### seven\n"
    assert markdown.heading_lines(text.splitlines()) == [(0, 1, "A"), (5, 2, "B")]
    assert markdown.split_frontmatter("---\n\nprose\n---\nx") == ({}, "---\n\nprose\n---\nx")
    fields, body = markdown.split_frontmatter("---\nTitle: 'Q'\ntags:\n- a\n  - \"#b\"\n# c\nn: [x, 'y']\n---\nBody")
    assert fields == {"title": "Q", "tags": ["a", "#b"], "n": ["x", "y"]} and body == "Body" and markdown.tags_of(fields) == ["a", "b"]
    shown, links = markdown.render_note("[[A|b]] ![[img.png#x]] [[C#D]] [[#E]] [t](sub/n.md#p) [u](https://x/y.md) [v](../../z.md)\n```\n[[no]]\n```", "dir/me.md")
    assert shown.splitlines()[0].startswith("b [embed: img.png] C > D E [t]") and links == ["dir/sub/n", "A", "C"]


def test_docs_index():
    text = "# Site\n\n> One\n> two\n\nMore.\n```\n# code\n```\n## Docs\n- [A b](a.md): note\n* [C](https://x/c \"t\")\n## Optional\n+ [D](/d)\n"
    got = docs.index_of(text, "https://h.org/docs/llms.txt")
    assert got["title"] == "Site" and got["summary"] == "One two" and got["details"] == "More.\n```\n# code\n```"
    assert got["sections"] == [("Docs", [("A b", "https://h.org/docs/a.md", "note"), ("C", "https://x/c", None)]), ("Optional", [("D", "https://h.org/d", None)])]
    assert docs.sections_of("# T\nintro\n## A\nURL: https://x/a\nbody\n## B\n") == [("Introduction", "intro", None), ("A", "body", "https://x/a")]
    assert docs.sections_of("no headings ") == [("Full text", "no headings", None)]


def test_tables(spark):
    grid = F.array(F.array(F.lit("a |b"), F.lit("")), F.array(F.lit("1"), F.lit(" 2 "), F.lit("3")), F.array(F.lit("")))
    assert one(spark, tables.pipe_table(grid)) == "| a \\|b |  |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |"
    assert one(spark, tables.pipe_table(F.array(F.array(F.lit("x"), F.lit("")), F.array(F.lit(""), F.lit("y"))))) == "x\ny"


def test_notes(spark):
    own = spark.createDataFrame([("v", 1, "a/Topic.md"), ("v", 2, "Topic.md"), ("v", 3, "x.md"), ("v", 4, "y.md")], "vault_id string, seg_ord int, path string")
    links = spark.createDataFrame([("v", "x.md", "topic"), ("v", "y.md", "a/Topic"), ("v", "y.md", "Topic"), ("v", "Topic.md", "Topic"), ("v", "a/Topic.md", "b/TOPIC"), ("v", "x.md", "gone")], "vault_id string, src string, target string")
    edges = notes.resolved_links(own, links)
    assert {(r.src, r.dst) for r in edges.collect()} == {("x.md", "Topic.md"), ("y.md", "a/Topic.md"), ("y.md", "Topic.md"), ("Topic.md", "Topic.md"), ("a/Topic.md", "Topic.md")}
    assert [(r.path, r.inbound) for r in notes.hubs(edges).collect()] == [("Topic.md", 3)]


def test_threads(spark):
    rows = [(1, 1, None, 1, True), (1, 2, 1, 1, False), (1, 3, 2, 1, True), (1, 4, 3, 1, False), (1, 5, None, 2, False), (1, 6, 2, 2, False)]
    tree = threads.reading_order(threads.promoted(spark.createDataFrame(rows, "thread_id int, id long, parent_id long, ord int, deleted boolean"))).orderBy("pos").collect()
    assert [(r.id, r.depth, r.root_id) for r in tree] == [(2, 0, 2), (4, 1, 2), (6, 1, 2), (5, 0, 5)]


PAPER = """Title
Abstract
We study. Details in
Appendix C.
1 Introduction
Text
2
Model Architecture
3.1 Sub Part
Contents
9 Too Far
References
[1] A. Author. Convolu-
tional nets. 2017.
12
[2] B. Other. Pages 1-
10.
A Proofs of Things
B we go on with prose
Larger Heading
"""


def test_paper(spark):
    found = paper.sections(PAPER, frozenset({"Larger Heading"}))
    assert [t for t, _ in found] == ["Abstract", "Introduction", "Model Architecture", "References", "Appendix A: Proofs of Things", "Appendix: Larger Heading"]
    assert [PAPER[o:].split("\n", 1)[0] for _, o in found] == ["Abstract", "1 Introduction", "2", "References", "A Proofs of Things", "Larger Heading"]
    assert paper.references(PAPER, found) == ["[1] A. Author. Convolutional nets. 2017.", "[2] B. Other. Pages 1-10."]
    assert paper.sections("no headings") == [("Full text", 0)]
    assert list(paper.entries(["1. One a", "b", "2. Two"])) == ["1. One a b", "2. Two"]
    assert list(paper.entries(["Ann. A work.", "Bob. More", "of it."])) == ["Ann. A work.", "Bob. More of it."]
    lines = [(1, 0, 0, 20.0, "A Great"), (1, 0, 1, 20.2, "Paper*"), (1, 0, 2, 10.0, "body " * 30), (1, 0, 3, 20.0, "Later Line"), (1, 1, 0, 12.0, "Heading")]
    font = spark.createDataFrame(lines, "id int, page int, ord int, size double, text string")
    assert paper.title_by_font(font, "id").first().title == "A Great Paper" and paper.body_size(font, "id").first().body == 10
    pages = spark.createDataFrame([(1, 0, "abc"), (1, 1, "defgh"), (1, 2, "x")], "id int, page int, text string")
    at = spark.createDataFrame([(1, o) for o in (0, 3, 4, 9, 10, 99)], "id int, offset long")
    assert [r.page for r in paper.with_pages(at, pages, "id").orderBy("offset").collect()] == [1, 1, 2, 2, 3, 3]


def test_citations(spark):
    assert one(spark, citation.doi(F.col("t")), t="see doi:10.1000/ab(1).") == "10.1000/ab(1"
    assert one(spark, citation.arxiv_year(F.col("t")), t="hep-th/9901001") == 1999
    assert one(spark, citation.authors(F.col("t")), t="Ada Lovelace, Alan Turing") == ["Ada Lovelace", "Alan Turing"]
    assert one(spark, citation.authors(F.col("t")), t="Lovelace, Ada") == ["Lovelace, Ada"]
    assert one(spark, citation.authors(F.col("t")), t="A B; C D and E") == ["A B", "C D", "E"]


def test_refresh(spark):
    old = spark.createDataFrame([("o", "a"), ("o", "b"), ("o", "b")], "origin string, key string")
    new = spark.createDataFrame([("o", "b", 1), ("o", "c", 2), ("o", "c", 3)], "origin string, key string, position int")
    assert sorted((r.key, r.position) for r in refresh.added(old, new, "origin").collect()) == [("c", 2), ("c", 3)]
    assert [r.key for r in refresh.removed(old, new, "origin").collect()] == ["a"]
    assert refresh.unchanged(old, new, "origin").first().unchanged == 1
    assert one(spark, refresh.next_box(F.lit(5), F.lit(True))) == 5 and one(spark, refresh.next_box(F.lit(3), F.lit(False))) == 1


def test_validation(spark):
    files = spark.createDataFrame([("s", "SKILL.md", "[a](sub/x.md#p) [b](gone.md) [c](https://x/y.md)"), ("s", "sub/x.md", " \n")], "skill string, path string, content string")
    assert [(r.path, r.target) for r in validate.broken_links(files).collect()] == [("SKILL.md", "gone.md")]
    assert [r.path for r in validate.empty_files(files).collect()] == ["sub/x.md"]
    evals = spark.createDataFrame([("s", '{"skill_name": "t", "evals": [{"id": 1, "prompt": "p", "expectations": []}]}'), ("u", "broken"), ("v", '{"skill_name": "v", "evals": [{"prompt": "p", "expectations": ["e"]}]}')], "skill string, content string")
    got = {(r.skill, r.error) for r in validate.eval_errors(evals).collect()}
    assert got == {("s", "skill_name differs from folder"), ("s", "no expectations in item 1"), ("u", "no evals"), ("u", "skill_name differs from folder")}
