"""EPUB books into chapters."""

from __future__ import annotations

import posixpath
import re
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame

from strataline.operators import xmltree as X
from strataline.operators.html import BLOCKS, LABELS, TABLE_PARTS, Grid, image_marker
from strataline.sources.archives import zip_members

#: Where a book says what it holds, its contents' type, and titles that are no content.
CONTAINER, NCX = "META-INF/container.xml", "application/x-dtbncx+xml"
FRONT = re.compile(r"^(table of contents|contents|contributors|dedications?|copyright( page)?|title page|cover|index|list of (figures|tables))$", re.I)
ZERO_WIDTH = re.compile("[​‌‍⁠﻿]")


class Chapter(HTMLParser):
    """Visible text of a chapter, its first first-level heading and its title; code keeps its indentation."""

    def __init__(self):
        super().__init__()
        self.lines: list[tuple[bool, list[str]]] = [(False, [])]
        self.hidden = self.code = 0
        self.grid: Grid | None = None
        self.caught: dict[str, list[str] | None] = {"h1": None, "title": None}
        self.catching: str | None = None
        self.label_end = False

    def put(self, text: str) -> None:
        if self.grid is not None:
            self.grid.text(text)
            return
        for k, piece in enumerate(text.split("\n")):
            if k:
                self.lines.append((self.code > 0, []))
            self.lines[-1][1].append(piece)

    def line(self) -> None:
        self.grid.text(" ") if self.grid is not None else self.lines.append((self.code > 0, []))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table" and self.grid is None:
            self.line()
            self.grid = Grid()
        elif self.grid is not None and tag in TABLE_PARTS:
            self.grid.tag(tag, True)
        elif tag == "img" and (mark := image_marker(dict(attrs))):
            self.line()
            self.put(mark)
            self.line()
        elif tag == "sup":
            self.put("^")
        elif tag == "br":
            self.line()
        elif tag in BLOCKS:
            self.code += tag == "pre"
            self.line()
            if tag == "figcaption":
                self.put("[figure] ")
        if tag in self.caught and self.caught[tag] is None:
            self.caught[tag], self.catching = [], tag

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
            return
        self.label_end = tag in LABELS
        if self.catching == tag:
            self.catching = None
        if self.grid is not None and tag in TABLE_PARTS:
            if self.grid.tag(tag, False):
                grid, self.grid = self.grid, None
                self.put(grid.rendered())
                self.line()
        elif tag in BLOCKS:
            self.code -= tag == "pre" and self.code > 0
            self.line()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.catching:
            self.caught[self.catching].append(data)
            if self.catching == "title":
                return
        if self.label_end and self.lines[-1][1] and self.lines[-1][1][-1].endswith(":") and data[:1].isalnum():
            data = " " + data
        self.label_end = False
        self.put(data if self.code else re.sub(r"\s+", " ", data))

    def result(self) -> tuple[str, str | None, str | None]:
        if self.grid is not None:
            self.lines.append((False, [self.grid.rendered()]))
        text = "\n".join("".join(p).rstrip() if code else "\n".join(x.strip() for x in "".join(p).split("\n")) for code, p in self.lines)
        flat = lambda key: " ".join("".join(self.caught[key] or ()).split()) or None
        return ZERO_WIDTH.sub("", re.sub(r"\n{3,}", "\n\n", text).strip("\n ")), flat("h1"), flat("title")


class Contents(HTMLParser):
    """Links of the navigation that is typed as table of contents."""

    def __init__(self):
        super().__init__()
        self.navs: list[bool] = []
        self.links: list[tuple[str, list[str]]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "nav":
            self.navs.append("toc" in (own.get("epub:type") or "").split())
        elif tag == "a" and self.navs and self.navs[-1] and own.get("href"):
            self.links.append((own["href"], []))
            self.open = True

    def handle_endtag(self, tag):
        if tag == "nav" and self.navs:
            self.navs.pop()
        self.open &= tag != "a"

    def handle_data(self, data):
        if self.open:
            self.links[-1][1].append(data)


def member(base: str, href: str) -> str | None:
    """The member that a reference inside the archive means."""
    path = unquote(href.partition("#")[0])
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path)) if path else None


def chapter_titles(files: dict[str, bytes], package: str, items: dict[str, dict], toc: str | None) -> dict[str, str]:
    """Titles by member: of the NCX, or, where it is missing or malformed, of the navigation document; first wins."""
    pairs: list[tuple[str, str]] = []
    ncx = items.get(toc) or next((i for i in items.values() if i.get("media-type") == NCX or (i.get("href") or "").lower().endswith(".ncx")), None)
    at = member(package, ncx.get("href") or "") if ncx else None
    if (root := X.parse(files.get(at))) is not None:
        for point in X.every(root, "navPoint"):
            label, target = X.down(point, "navLabel", "text"), X.down(point, "content")
            pairs.append((X.attr(target, "src", ""), (label.text or "") if label is not None else ""))
    else:
        nav = next((i for i in items.values() if "nav" in (i.get("properties") or "").split()), None)
        at = member(package, nav.get("href") or "") if nav else None
        reader = Contents()
        reader.feed(files.get(at, b"").decode("utf-8", "replace"))
        pairs = [(href, "".join(text)) for href, text in reader.links]
    titles: dict[str, str] = {}
    for href, text in pairs:
        goal, title = member(at or "", href), " ".join(text.split())
        if goal and title:
            titles.setdefault(goal, title)
    return titles


def read_book(raw: bytes) -> dict:
    """title, author, language, chapters (title, body, front_matter), missing spine items, and an error instead."""
    out = {"title": None, "author": None, "language": None, "chapters": [], "missing": [], "error": None}
    files = zip_members(raw)
    package = X.attr(next(X.every(X.parse(files.get(CONTAINER)), "rootfile"), None), "full-path")
    root = X.parse(files.get(package))
    if root is None:
        return out | {"error": "not a readable EPUB"}
    items = {X.attr(i, "id"): {k.rpartition("}")[2]: v for k, v in i.attrib.items()} for m in X.every(root, "manifest") for i in X.kids(m, "item")}
    spine = next(X.every(root, "spine"), None)
    titles = chapter_titles(files, package, items, X.attr(spine, "toc"))
    for n, ref in enumerate((r for r in X.kids(spine, "itemref") if X.attr(r, "idref")), 1):
        item = items.get(X.attr(ref, "idref"))
        path = member(package, item.get("href") or "") if item else None
        if path not in files:
            out["missing"].append((item or {}).get("href") or X.attr(ref, "idref"))
            continue
        chapter = Chapter()
        chapter.feed(files[path].decode("utf-8", "replace"))
        chapter.close()
        body, heading, title = chapter.result()
        shown = titles.get(path) or heading or title or f"Chapter {n}"
        out["chapters"].append({"title": shown, "body": body, "front_matter": bool(FRONT.match(shown.strip()))})
    meta = next(X.every(root, "metadata"), None)
    creators = [" ".join(x.text.split()) for x in X.every(meta, "creator") if x.text and x.text.strip()]
    out |= {"title": X.first_text(meta, "title"), "author": ", ".join(creators) or None, "language": X.first_text(meta, "language")}
    return out if out["chapters"] else out | {"error": "no chapter of the spine exists"}


_CHAPTER = pa.struct([("title", pa.string()), ("body", pa.string()), ("front_matter", pa.bool_())])
_BOOK = pa.struct([("title", pa.string()), ("author", pa.string()), ("language", pa.string()), ("chapters", pa.list_(_CHAPTER)), ("missing", pa.list_(pa.string())), ("error", pa.string())])


def books(files: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, title, author, language, chapters, missing, error) of EPUB files as bytes."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *pa.array([read_book(x.as_py() or b"") for x in b.column(1)], _BOOK).flatten()], [id_col, *[f.name for f in _BOOK]])

    schema = "title string, author string, language string, chapters array<struct<title:string,body:string,front_matter:boolean>>, missing array<string>, error string"
    return files.select(id_col, content).mapInArrow(run, f"{id_col} {dict(files.dtypes)[id_col]}, {schema}")
