"""Responses: decoding, candidates, records."""

from __future__ import annotations


from strataline.sources import http


def test_charsets():
    assert http.declared_charset(b'<meta charset="latin-1"><p>') == "latin-1"
    assert http.declared_charset(b'<META http-equiv=Content-Type content="text/html; charset=cp1252">') == "cp1252"
    assert http.declared_charset(b'<meta name=description content="charset=utf-16 is odd">') is None
    assert http.declared_charset(b'<!-- <meta charset="x"> -->') is None
    assert http.decoded("é".encode("latin-1"), "latin-1") == "é" and http.decoded("é".encode(), "no-such") == "é"
    assert http.decoded(b'<meta charset=latin-1>\xe9', None).endswith("é") and http.decoded(b"\xff", None) == "�"


def test_candidates(spark):
    body = lambda t: bytearray(t.encode())
    rows = [("a.md", 404, "text/plain", None, body("x")), ("a", 200, "text/html", None, body("<html>a")), ("b.md", 200, "text/html", None, body("<!doctype html>")), ("b", 200, "text/plain", None, body("plain b")), ("c.md", 200, "text/markdown", None, body("# c")), ("d.md", 200, None, None, body("y" * 50)), ("d", 200, None, None, body("z"))]
    fetched = http.texts(spark.createDataFrame(rows, "url string, status int, media_type string, charset string, body binary"))
    cands = spark.createDataFrame([(k, o, k + s, o == 0) for k in "abcde" for o, s in enumerate((".md", ""))], "k string, ord int, candidate string, probe boolean")
    got = {r.k: (r.url, r.text, r.is_html, r.reason) for r in http.first_usable(cands, fetched, "k", most=40).collect()}
    assert got["a"] == ("a", "<html>a", True, None) and got["b"] == ("b", "plain b", False, None) and got["c"] == ("c.md", "# c", False, None)
    assert got["d"][3] == "over size cap" and got["e"] == ("e", None, False, "network error")


def test_records(spark):
    xml = '<feed xmlns="urn:a" xmlns:arxiv="urn:b"><title>no</title><entry><title>A\n  Title</title><published>2017-06-12T00:00:00Z</published><author><name>X  Y</name></author><author><name>Z</name></author><arxiv:doi>10.1/x</arxiv:doi></entry></feed>'
    got = {r.arxiv_id: r for r in http.arxiv_records(spark.createDataFrame([("1", xml), ("2", "<broken"), ("3", None)], "arxiv_id string, xml string")).collect()}
    assert (got["1"].title, got["1"].authors, got["1"].year, got["1"].doi) == ("A Title", ["X Y", "Z"], 2017, "10.1/x")
    assert got["2"].title is None and got["3"].title is None
