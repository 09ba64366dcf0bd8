"""Fetched responses as rows: decoding, what an answer is, which of several addresses answered.

Fetching itself happens elsewhere; ``http_responses`` holds url, status, media_type, charset, body.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A charset inside a content type, largest page, bytes in which a page may declare its charset.
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9][A-Za-z0-9._-]*)", re.I)
MOST_BYTES, HEAD_BYTES = 2_000_000, 65_536


class Declaration(HTMLParser):
    """The charset that a page's own meta tags declare; a description that merely mentions one declares nothing."""

    found: str | None = None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "meta" and not self.found:
            typed = CHARSET.search(own.get("content") or "") if (own.get("http-equiv") or "").lower() == "content-type" else None
            self.found = (own.get("charset") or "").strip() or (typed[1] if typed else None)


def declared_charset(raw: bytes) -> str | None:
    page = Declaration()
    page.feed(raw[:HEAD_BYTES].decode("latin-1"))
    return page.found


def decoded(raw: bytes, charset: str | None) -> str:
    """By the answer's charset, else the page's, else UTF-8; what then does not fit becomes a replacement mark."""
    for name in (charset, declared_charset(raw), "utf-8"):
        if name:
            try:
                return raw.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
    return raw.decode("utf-8", "replace")


def texts(responses: DataFrame) -> DataFrame:
    """(url, status, media_type, text, n_bytes) of responses."""

    def run(batches):
        for b in batches:
            raw = [x.as_py() or b"" for x in b.column(3)]
            read = [decoded(x, c) for x, c in zip(raw, b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(read, pa.string()), pa.array([len(x) for x in raw], pa.int64())], ["url", "status", "media_type", "text", "n_bytes"])

    return responses.select("url", F.col("status").cast("int"), "media_type", "body", "charset").mapInArrow(run, "url string, status int, media_type string, text string, n_bytes long")


def looks_html(text: Column, media_type: Column) -> Column:
    head = F.lower(F.substring(F.regexp_replace(text, r"^(?U)\s+", ""), 1, 200))
    return F.coalesce(F.lower(media_type).contains("html"), F.lit(False)) | F.startswith(head, F.lit("<!doctype html")) | head.contains("<html")


def failure(status: Column, n_bytes: Column, most: int = MOST_BYTES) -> Column:
    """Why an answer is of no use; null if it is."""
    return F.when(status.isNull(), F.lit("network error")).when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).when(n_bytes > most, F.lit("over size cap"))


def first_usable(candidates: DataFrame, fetched: DataFrame, by: str, most: int = MOST_BYTES) -> DataFrame:
    """(by, url, text, is_html, reason): of each key's candidates (by, ord, candidate, probe) the first of use.

    A probe (a Markdown twin) that is answered with HTML is passed over; an answer over the cap is final; with none of
    use, the last failure is the reason.
    """
    from pyspark.sql import Window

    own = candidates.join(fetched.withColumnRenamed("url", "candidate"), "candidate", "left")
    why = failure(F.col("status"), F.col("n_bytes"), most)
    own = own.withColumns({"reason": why, "is_html": F.coalesce(looks_html(F.col("text"), F.col("media_type")), F.lit(False))})
    own = own.withColumn("reason", F.when(F.col("reason").isNull() & F.col("probe") & F.col("is_html"), F.lit("HTML answer")).otherwise(F.col("reason")))
    settles = F.col("reason").isNull() | (F.col("reason") == "over size cap")
    order = Window.partitionBy(by).orderBy(~settles, F.when(settles, F.col("ord")).otherwise(-F.col("ord")))
    best = own.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return best.select(by, F.col("candidate").alias("url"), F.when(F.col("reason").isNull(), F.col("text")).alias("text"), "is_html", "reason")


def arxiv_records(feeds: DataFrame) -> DataFrame:
    """(arxiv_id, title, authors, year, doi) of Atom records (arxiv_id, xml); a broken record gives nulls."""
    clean = F.regexp_replace(F.regexp_replace("xml", r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    entry = feeds.withColumn("x", F.regexp_extract(clean, r"(?s)<entry>.*?</entry>", 0)).withColumn("x", F.nullif("x", F.lit("")))
    flat = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    text = lambda tag: F.nullif(flat(F.regexp_extract("x", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    names = F.transform(F.regexp_extract_all("x", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), flat)
    year = F.nullif(F.regexp_extract("x", r"<published>(\d{4})", 1), F.lit("")).cast("int")
    return entry.select("arxiv_id", text("title").alias("title"), names.alias("authors"), year.alias("year"), text("doi").alias("doi"))
