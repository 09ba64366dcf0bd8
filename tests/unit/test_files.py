"""Books, office documents and archives, built in memory."""

from __future__ import annotations

import io
import tarfile
import zipfile

from strataline.operators import epub, office
from strataline.sources import archives


def packed(files: dict[str, str]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return raw.getvalue()


BOOK = {
    "META-INF/container.xml": '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
    "OPS/p.opf": """<package xmlns="urn:p" xmlns:dc="urn:dc"><metadata><dc:title> A  Book </dc:title><dc:creator>X Y</dc:creator><dc:creator>Z</dc:creator><dc:language>en</dc:language></metadata>
      <manifest><item id="a" href="one%20a.xhtml"/><item id="b" href="two.xhtml"/><item id="c" href="gone.xhtml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>
      <item id="v" href="nav.xhtml" properties="nav x"/></manifest>
      <spine toc="n"><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/><itemref idref="q"/></spine></package>""",
    "OPS/toc.ncx": '<ncx xmlns="urn:n"><navMap><navPoint><navLabel><text>Cover</text></navLabel><content src="one%20a.xhtml#x"/></navPoint></navMap></ncx>',
    "OPS/nav.xhtml": '<nav epub:type="landmarks"><a href="two.xhtml">no</a></nav><nav epub:type="toc x"><a href="two.xhtml">From  nav</a></nav>',
    "OPS/one a.xhtml": "<html><head><title>T1</title></head><body><h1>Head</h1><p>E=mc<sup>2</sup>\u200b</p><pre>  if x:\n    y</pre><table><tr><td>a<td>b<tr><td>1<td>2</table></body></html>",
    "OPS/two.xhtml": "<title>T2</title><body><p>Text &amp; more<br/>next</p></body>",
}


def test_book(spark):
    got = epub.read_book(packed(BOOK))
    assert (got["title"], got["author"], got["language"]) == ("A Book", "X Y, Z", "en") and got["missing"] == ["gone.xhtml", "q"]
    one, two = got["chapters"]
    assert one["title"] == "Cover" and one["front_matter"] and "E=mc^2" in one["body"] and "  if x:\n    y" in one["body"] and "| a | b |" in one["body"]
    assert two == {"title": "T2", "body": "Text & more\nnext", "front_matter": False}
    broken = epub.read_book(packed(BOOK | {"OPS/toc.ncx": "<ncx>&nbsp;"}))
    assert [c["title"] for c in broken["chapters"]] == ["Head", "From nav"]
    rows = epub.books(spark.createDataFrame([(1, packed(BOOK)), (2, b"x"), (3, None), (4, packed({"a": "b"}))], "id int, content binary"), "id", "content").collect()
    assert [len(r.chapters) for r in rows] == [2, 0, 0, 0] and all(r.error for r in rows[1:])


W = 'xmlns:w="urn:w" xmlns:m="urn:m"'


def test_word():
    para = lambda text, extra="": f"<w:p><w:pPr>{extra}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    styles = f'<w:styles {W}><w:style w:styleId="S1"><w:name w:val="heading 2"/></w:style><w:style w:styleId="S2"><w:name w:val="Own"/><w:basedOn w:val="S1"/></w:style><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="L"><w:name w:val="List Bullet 2"/></w:style></w:styles>'
    body = para("The Title", '<w:pStyle w:val="T"/>') + para("lead") + para("Part  one", '<w:pStyle w:val="S2"/>') + para("item", '<w:pStyle w:val="L"/>') + para("deep", '<w:numPr><w:ilvl w:val="2"/></w:numPr>')
    body += "<w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>new</w:t><w:tab/><w:t>text</w:t></w:r></w:ins></w:p>" + para("Outlined", '<w:outlineLvl w:val="0"/>')
    body += "<w:sdt><w:sdtContent><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b|</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:sdtContent></w:sdt>"
    files = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "docProps/core.xml": '<c xmlns:d="urn:d"><d:creator>Me</d:creator><d:created>2024-05-06T07:08Z</d:created></c>'}
    got = office.read_document("x/My_file.docx", packed(files))
    assert (got["title"], got["author"], got["date"], got["error"]) == ("The Title", "Me", "2024-05-06", None)
    assert [(s["title"], s["body"]) for s in got["sections"]] == [("Introduction", "lead"), ("Part one", "  - item\n    - deep\nnew text"), ("Outlined", "| a | b\\| |\n| --- | --- |")]
    assert office.read_document("a.doc", b"")["error"].startswith("legacy") and office.read_document("a.docx", b"no")["error"]


def test_slides():
    shape = lambda text, kind: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda inner, more="": f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a" {more}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    rel = lambda *pairs: '<r xmlns="urn:x">' + "".join(f'<Relationship Id="{i}" Type="t/{t}" Target="{g}"/>' for i, t, g in pairs) + "</r>"
    files = {
        "ppt/presentation.xml": '<p:p xmlns:p="urn:p" xmlns:r="urn:r"><p:sldId id="9" r:id="b"/><p:sldId id="8" r:id="a"/></p:p>',
        "ppt/_rels/presentation.xml.rels": rel(("a", "slide", "slides/slide1.xml"), ("b", "slide", "/ppt/slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape("Late", "title") + shape("7", "sldNum"), 'show="0"'),
        "ppt/slides/slide2.xml": slide(shape("First", "ctrTitle") + shape("point", "body") + '<p:pic><p:nvPicPr><p:cNvPr descr="a  cat"/></p:nvPicPr></p:pic>'),
        "ppt/slides/_rels/slide2.xml.rels": rel(("n", "notesSlide", "../notesSlides/n.xml")),
        "ppt/notesSlides/n.xml": slide(shape("say it", "body") + shape("x", "sldImg")),
    }
    got = office.read_document("deck.pptx", packed(files))["sections"]
    assert [(s["title"], s["body"], s["slide"], s["hidden"]) for s in got] == [("First", "- point\n[image: a cat]\n\nNotes:\nsay it", 1, False), ("Late", "", 2, True)]


def test_opendocument(spark):
    head = '<o xmlns:office="urn:o" xmlns:text="urn:t" xmlns:table="urn:b" xmlns:draw="urn:d" xmlns:pres="urn:p"><office:body>'
    text = '<office:text><text:h text:outline-level="1">Top</text:h><text:p>a<text:s text:c="2"/>b<text:note>no</text:note> c</text:p><text:list><text:list-item><text:p>x</text:p><text:list><text:list-item><text:p>y</text:p></text:list-item></text:list></text:list-item></text:list><text:h text:outline-level="3">Sub</text:h></office:text>'
    deck = '<office:presentation><draw:page><draw:frame pres:class="title"><draw:text-box><text:p>Hi</text:p></draw:text-box></draw:frame><draw:frame pres:class="footer"><draw:text-box><text:p>f</text:p></draw:text-box></draw:frame><draw:frame><draw:image/><draw:desc/><draw:title>pic</draw:title></draw:frame><pres:notes><draw:frame><draw:text-box><text:p>say</text:p></draw:text-box></draw:frame></pres:notes></draw:page></office:presentation>'
    raw = [packed({"content.xml": head + x + "</office:body></o>"}) for x in (text, deck)]
    rows = office.documents(spark.createDataFrame([(1, "a.odt", raw[0]), (2, "b.odp", raw[1]), (3, None, None)], "id int, name string, content binary"), "id", "name", "content").collect()
    assert [(s.title, s.body) for s in rows[0].sections] == [("Top", "a b c\n- x\n  - y\nSub")]
    assert [(s.title, s.body) for s in rows[1].sections] == [("Hi", "[image: pic]\n\nNotes:\nsay")]
    assert rows[2].error


def test_tar(spark):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        for name, kind, link in [("r/README.md", tarfile.REGTYPE, ""), ("../up", tarfile.REGTYPE, ""), ("/abs", tarfile.REGTYPE, ""), ("C:\\x", tarfile.REGTYPE, ""), ("r/l", tarfile.SYMTYPE, "../../x"), ("r/ok", tarfile.SYMTYPE, "README.md"), ("r/dev", tarfile.CHRTYPE, "")]:
            m = tarfile.TarInfo(name)
            m.type, m.linkname, m.size = kind, link, 2 if kind == tarfile.REGTYPE else 0
            t.addfile(m, io.BytesIO(b"hi"))
    rows = archives.tar_members(spark.createDataFrame([(1, raw.getvalue()), (2, b"x")], "id int, content binary"), "id", "content").collect()
    assert {r.name: r.reason is None for r in rows if r.id == 1} == {"r/README.md": True, "../up": False, "/abs": False, "C:\\x": False, "r/l": False, "r/ok": True, "r/dev": False}
    kept = archives.without_wrapper(spark.createDataFrame([(r.id, r.name) for r in rows if r.reason is None], "id int, name string"), "id").collect()
    assert sorted(r.name for r in kept) == ["README.md", "ok"]
