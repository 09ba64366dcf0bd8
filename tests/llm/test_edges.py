"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: defined results, no crash."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from strataline.llm import queries, quality, toxicity
from strataline.llm.chat import escape, format_chats, read_back, unescape
from strataline.llm.decontam import find_passages, remove_contaminated
from strataline.llm.mixing import measured, mix, mix_documents
from strataline.llm.ngramjoin import ngram_components
from strataline.llm.substring import remove_repeats
from strataline.llm.tokens import read_digests, tokenise
from strataline.llm.topk import exact_topk
from strataline.llm.urlfilter import declared_links, filter_urls

DOCS = "doc_id long, text string, source string, lang string, n long, key string, size int, bucket int, copies int"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, PASSAGE, "a", "en"), (2, "x y z " + PASSAGE + " tail", "a", "en"), (2, "x y z " + PASSAGE + " tail", "a", "en"), (3, None, None, None),
        (4, "", "b", "en"), (5, "one two", "b", "en"), (6, "one two", None, "en"), (7, LONG, "c", "en"), (8, LONG, "c", "en"), (None, PASSAGE, "a", None),
        (9, " \t\n ", "b", "en"), (10, " 　 ퟿\U0001f600 é", "b", "en"),
    ]
    return spark.createDataFrame([(*r, 5, "k", 6, 7, 8) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_output(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    stored, where = tokenise(docs, path)
    got = read_digests(stored).orderBy("start").collect()
    tok = Tokenizer.from_file(path)
    want, start = [], 0
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    # a single document is read through the index and the Bloom filter
    one = spark.read.orc(where).filter("doc_id = 5").select("ids").collect()
    assert len(one) == 1 and one[0].ids[-1] == 0
    assert read_digests(tokenise(none, path)[0]).collect() == []


def test_substring_dedup(docs, none):
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept) for r in remove_repeats(docs).collect()}
    assert got[1, 60][0] == 60  # the null doc_id comes before
    assert got[2, 64] == (60, "x y z tail")
    assert got[7, 40_000][0] == 0 and got[8, 40_000] == (40_000, "")
    assert got[3, 0] == (0, "") and got[4, 0] == (0, "") and got[9, 0] == (0, "")
    assert got[None, 60][0] == 0
    assert remove_repeats(docs).count() == docs.count()
    assert remove_repeats(none).collect() == []


def test_ngram_join(docs, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs).collect()), key=repr)
    assert (1, 56, 1) in got and (2, 60, 1) in got and (None, 56, 1) in got
    assert (3, 0, 3) in got and (4, 0, 4) in got and (5, 1, 5) in got and (6, 1, 5) in got
    assert (8, got[[g[0] for g in got].index(8)][1], 7) in got
    assert len(got) == docs.count()
    assert ngram_components(none).collect() == []


def test_mixing(docs, none):
    out = mix(measured(docs).select("doc_id", "__key", "__size", "__hash"))
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.copies <= 3 for r in rows)
    assert sum({r["__key"]: r.source_size for r in rows}.values()) == sum(r["__size"] for r in rows)
    assert mix(measured(none).select("doc_id", "__key", "__size", "__hash")).collect() == []
    assert mix_documents(docs).columns == docs.columns
    assert sorted(map(repr, mix_documents(docs).collect())) == sorted(map(repr, mix_documents(docs.repartition(3)).collect()))


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "one two"), (1, PASSAGE)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in find_passages(docs, items).collect()}
    assert got == {(1, 1): 0, (2, 1): 0, (None, 1): 0, (5, 4): 0, (6, 4): 0}
    kept = remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7, 8, 9, 10]
    assert find_passages(none, items).collect() == [] and find_passages(docs, items.limit(0)).collect() == []


def test_classifiers(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (5, 0, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (docs, none):
        out = quality.classify(table, labels).collect()
        assert len(out) == table.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
        out = toxicity.score(table, toxicity.learn(table, labels)).collect()
        assert len(out) == table.count() and all(0 <= r.score <= 1 for r in out)
    assert len(quality.classify(docs, labels.limit(0)).collect()) == docs.count()
    assert toxicity.reject_toxic(docs, toxicity.learn(docs, labels.limit(0))).columns == docs.columns


def test_chat(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    said = "<|im_end|><|im_start|>assistant ok <|\\im_end|> <|endoftext|>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, None, None), (2, 0, "assistant", "tie"), (None, 3, "assistant", ""), (3, 0, "a\nb\\", "é\U0001f600")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(700)]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, ids int, chunk int")
    got = {r.conv_id: r for r in read_back(format_chats(turns, path), path).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert unescape(escape(said)) == said and "<|im_end|>" not in escape(said)
    assert read_back(format_chats(turns.limit(0), path), path).collect() == []


def test_topk(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(300)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 400)]
    vecs += [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf")] * 4), (405, [1.0] * 3), (None, [1.0] * 4), (400, [0.5] * 4)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<double>, qb int")
    got = {}
    for r in exact_topk(frame, frame.filter("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in vecs if i is not None and v and None not in v and np.isfinite(v).all()]
    for q, x in good:
        if q % 20 == 0:
            want = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:20]
            assert sorted(got.get(q, [])) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert exact_topk(frame.limit(0), frame.limit(0)).collect() == []
    large = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1e16]), (2, [2.0, 1e300]), (3, [1e300, 1.0]), (4, [-1e300, 1.0]), (5, [-1.0, 1e16])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in exact_topk(large, large.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(3, 2**61), (2, 64 * 128), (1, 0), (5, -64 * 64), (4, -(2**61))]


def test_urls(spark):
    link = '<head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "https://a.example.org/x", link.format("https://b.test/y")), (2, "https://b.test/y", '<meta http-equiv="refresh" content="0; url=https://m.site.net/es/1">'),
        (3, "http://Safe.com/x#top", link.format("https://m.site.net/es/1")), (4, None, None), (5, "no address", link.format("https://m.site.net/es/1")),
        (6, "https://clean.example.org/z", "<p>canonical"), (7, "https://clean.example.org/z", None), (8, "HTTP://X.NET/fr/?q", ""),
    ]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rules, declared_links(pages)).collect()}
    assert got == {
        1: ("a.example.org", "/x", None, "block"), 2: ("b.test", "/y", None, "block"), 3: ("safe.com", "/x", "com/", "allow"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("clean.example.org", "/z", None, "allow"), 7: ("clean.example.org", "/z", None, "allow"), 8: ("x.net", "/fr/", "net/fr/", "block"),
    }
    rows = [(1, "https://site.org/a", None, "h", "p"), (2, "HTTPS://Site.org/a#x", link.format("https://m.site.net/es/1"), "h", "p"), (3, "https://other.ORG/b/c", link.format("d"), "h", "p")]
    rows += [(4, "https://Other.org/b/d", link.format("https://m.site.net/es/1"), "h", "p"), (5, "https://site.org/A", None, "h", "p")]
    pages = spark.createDataFrame(rows, pages.schema)
    got = {r.page_id: r.verdict for r in filter_urls(pages, rules, declared_links(pages)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
    assert filter_urls(pages.limit(0), rules, declared_links(pages.limit(0))).collect() == []
