"""Whole plans per kind of source."""

from __future__ import annotations

from strataline.plans import extract

WORDS = " ".join(f"w{i}" for i in range(120))


def raw(text: str) -> bytearray:
    return bytearray(text.encode())


def test_articles(spark):
    rows = [(1, "u1", 200, "text/html", None, raw(f"<title>T</title><article><h1>H</h1><p>{WORDS}</article>")), (2, "u2", 200, "text/html", None, raw("<p>short")), (3, "u3", 404, None, None, raw(""))]
    segs, rejects = extract.articles(spark.createDataFrame(rows, "source_id int, url string, status int, media_type string, charset string, body binary"))
    got = segs.collect()
    assert [(s.source_id, s.title, s.key, s.offset, s.words) for s in got] == [(1, "H", "H", 0, 123)]
    assert {(r.source_id, r.reason) for r in rejects.collect()} == {(2, "not readable: 1 words"), (3, "HTTP 404")}
    assert extract.summary(segs, "article").first().est_tokens == 163


def test_vaults(spark):
    files = [
        (1, "z/index.md", raw("# Zed\n[[a]]")), (1, "b.md", raw("---\ntitle: Bee\ntags: x, y\n---\n[[A]] text")), (1, "README.md", raw("hello [[b]] [[a]]")), (1, "a.txt", raw("\r\nplain")), (1, ".git/x.md", raw("no")),
        (1, "empty.md", raw(" \n")), (1, "bin.md", raw("x\0y")), (1, "odd.md", raw("pͰ")), (1, "big.md", raw("x" * 1_000_001)), (1, "pic.png", raw("no")),
    ]
    segs, rejects = extract.vaults(spark.createDataFrame(files, "source_id int, path string, content binary"))
    got = segs.orderBy("seg_ord").collect()
    assert [(s.path, s.title) for s in got] == [("README.md", "README"), ("a.txt", "a"), ("b.md", "Bee"), ("odd.md", "odd"), ("z/index.md", "Zed")]
    assert got[2].tags == ["x", "y"] and got[2].body == "A text" and got[1].offset == len("=== README ===\nhello b a\n\n")
    assert {(r.place, r.reason) for r in rejects.collect()} == {("bin.md", "binary content"), ("big.md", "over file size limit")}
    assert [(r.path, r.inbound) for r in extract.vault_hubs(segs).collect()] == [("a.txt", 3)]


def test_sites(spark):
    index = "# S\n## Docs\n- [One](one.md): n\n- [Two](/two)\n- [Again](one.md#x)\n- [Gone](gone)\n## Optional\n- [Opt](opt.md)\n"
    rows = [("https://h/one.md", 200, "text/plain", None, raw(" first ")), ("https://h/two.md", 200, "text/html", None, raw("<html>shell")), ("https://h/two", 200, "text/html", None, raw("<html><body><h1>Tee</h1><p>second")), ("https://h/opt.md", 200, "text/plain", None, raw("third"))]
    segs, rejects = extract.sites(spark.createDataFrame([(1, "https://h/llms.txt", index)], "source_id int, url string, text string"), spark.createDataFrame(rows, "url string, status int, media_type string, charset string, body binary"))
    assert [(s.title, s.body, s.section, s.optional) for s in segs.orderBy("seg_ord").collect()] == [("One", "first", "Docs", False), ("Two", "## Tee\n\nsecond", "Docs", False), ("Opt", "third", "Optional", True)]
    assert [(r.place, r.reason) for r in rejects.collect()] == [("https://h/gone", "network error")]
    segs, _ = extract.one_file_sites(spark.createDataFrame([(1, "u", "# A\nx\n# B\nSource: https://b\ny\n# A\nz")], "source_id int, url string, text string"))
    assert [(s.title, s.key, s.body) for s in segs.orderBy("seg_ord").collect()] == [("A", "A", "x"), ("B", "https://b", "y"), ("A", "A (2)", "z")]


def test_transcripts(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\nYes.\n\n2\n00:00:40,000 --> 00:10:05,000\nYes.\n"
    got = extract.transcripts(spark.createDataFrame([(1, raw(text))], "source_id int, content binary")).orderBy("seg_ord").collect()
    assert [(s.title, s.chunk) for s in got] == [("Part 1", "=== Part 1 [t=0s] ===\nYes.\n[t=40s] Yes.\n\n"), ("Part 2", "=== Part 2 [t=600s] ===\n\n\n")]


def test_papers_and_repositories(spark):
    pages = [(1, 0, "Abstract\n" + WORDS), (1, 1, "1 Introduction\nmore"), (2, 0, "few words")]
    segs, rejects = extract.papers(spark.createDataFrame(pages, "source_id int, page int, text string"))
    assert [(s.title, s.page) for s in segs.orderBy("seg_ord").collect()] == [("Abstract", 1), ("Introduction", 2)]
    assert [(r.source_id, r.reason) for r in rejects.collect()] == [(2, "no text layer")]
    segs, _ = extract.repositories(spark.createDataFrame([(1, "README.md", "# R\nx"), (1, "docs/a.md", "# R\ny")], "source_id int, path string, content string"))
    assert [(s.key, s.path) for s in segs.orderBy("seg_ord").collect()] == [("R", "README.md"), ("R (2)", "docs/a.md")]


def test_tables_and_figures_of_pages():
    """A rule stands only below a head row, a caption is a line, and a figure's caption is marked."""
    from strataline.operators.html import read_page

    body = lambda inner: read_page(f"<article>lead{inner}</article>").sections()[0][1].split("\n")
    rows = "<tr><td>a<td>b</tr><tr><td>1<td>2</tr>"
    assert body(f"<table>{rows}</table>") == ["lead", "| a | b |", "| 1 | 2 |"]
    assert body("<table><caption> The  caption</caption><thead><tr><td>a<td>b</tr></thead><tbody><tr><td>1<td>2</tr></table>") == ["lead", "The caption", "| a | b |", "| --- | --- |", "| 1 | 2 |"]
    assert body("<table><tr><th>a<td>b</tr><tr><th>1<th>2</tr></table>") == ["lead", "| a | b |", "| 1 | 2 |"]
    assert body("<table><tr><td>x<table><tr><th>in<th>ner</table></td><td>y</table>")[1].split() == ["|", "x", "in", "ner", "|", "y", "|"]
    assert "[figure] A plot" in body("<figure><img src=x><figcaption> <b>A plot</b></figcaption></figure><figure><figcaption></figcaption></figure><p>after")
    assert "[figure]" not in " ".join(body("<figure><figcaption> </figcaption></figure><p>after"))


def test_one_file_over_the_cap_is_cut(spark):
    files = spark.createDataFrame([(1, "u", "# A\nab\n# B\nééé\n"), (2, "v", "# A\nx\n# B\ny")], "source_id int, url string, text string")
    segs, rejects = extract.one_file_sites(files, 13)
    assert [(r.source_id, r.title, r.body) for r in segs.orderBy("source_id", "seg_ord").collect()] == [(1, "A", "ab"), (1, "B", "é�"), (2, "A", "x"), (2, "B", "y")]
    assert [(r.source_id, r.reason) for r in rejects.collect()] == [(1, "over text cap")]
