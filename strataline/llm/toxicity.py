"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability comes from the weights of its words; a document's is
the noisy-or of its sentences': 1 - prod(1 - p).  The weights are fitted from
document labels alone, so that the model has to find the sentences that carry
the label, and scoring names them.

The model is fitted on the driver from a bounded sample of labelled documents
(``SAMPLE_DOCS`` of either label in hash order, less those of 20 * ``SAMPLE_WORDS``
characters or more, which teach nothing); it holds one weight per word that occurs in
enough of them, which bounds it too.  All rows are scored whole; as the bias is never
fitted on longer texts, clean ones of such lengths score too high.

Defined results: null and empty texts have no sentences and score 0; labels
that are null or not 0 or 1 teach nothing; a document labelled both ways counts
as toxic; rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.runtime import text_blocks, tidy

#: Labelled documents of either label that a model learns from, and a 20th of the characters that they stay below.
SAMPLE_DOCS, SAMPLE_WORDS = 4000, 4000
#: Byte lengths of the word beginnings that are features beside the whole words.
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
#: A feature gets a weight if its documents differ by label at least so much (log-likelihood ratio); so many at most do.
LEAST_G2, MOST_FEATURES = 15.0, 4000
#: Passes over the sample, step size, pull of the weights to 0, and the log odds a sentence starts with.
EPOCHS, RATE, DECAY, START = 200, 0.1, 1e-3, -5.0

#: ASCII letters are lowered, other ASCII but digits is space; ends of sentences become newlines.
_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 10 if chr(c) in ".!?\n" else 32 for c in range(256)).lower()


def sentences(text: str) -> list[list[bytes]]:
    """Words of each sentence, lower case; sentences end at . ! ? and line ends."""
    return [line.split() for line in text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split(b"\n")]


def features(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings (marked, so that they are no words)."""
    return [word, *[b"^" + word[:n] for n in PREFIXES if n <= len(word)]]


def telling(bags: list[list[list[bytes]]], toxic: np.ndarray) -> dict[bytes, int]:
    """Features whose document counts differ by label, numbered; the log-likelihood ratio picks them."""
    both, bad = Counter(), Counter()
    for bag, y in zip(bags, toxic, strict=True):
        own = {f for s in bag for w in s for f in features(w)}
        both.update(own)
        if y:
            bad.update(own)
    total, ill = max(1, len(bags)), max(1, int(np.sum(toxic)))
    names = sorted(f for f, n in both.items() if n >= 3)
    n, k = np.array([both[f] for f in names], float), np.array([bad[f] for f in names], float)

    def part(seen, by_chance):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(by_chance, 1e-9)), 0.0)

    g2 = 2 * (part(k, n * ill / total) + part(n - k, n * (total - ill) / total) + part(ill - k, ill - n * ill / total) + part(total - ill - n + k, (total - n) * (total - ill) / total))
    best = np.argsort(-g2, kind="stable")[:MOST_FEATURES]
    return {names[i]: j for j, i in enumerate(i for i in best if g2[i] >= LEAST_G2)}


def fit(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Feature weights and bias from whole-document labels, by Adam on the noisy-or likelihood."""
    one: dict[bytes, bytes] = {}
    bags = [[[one.setdefault(w, w) for w in s] for s in sentences(t) if s] for t in texts]
    vocab = telling(bags, toxic)
    ids, sent, owner = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            own = [vocab[f] for w in set(s) for f in features(w) if f in vocab]
            ids += own
            sent += [len(owner)] * len(own)
            owner.append(d)
    ids, sent, owner = (np.array(x, np.int32) for x in (ids, sent, owner))
    y = np.asarray(toxic, np.float64)
    w, b = np.zeros(len(vocab)), START
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = np.bincount(sent, weights=w[ids], minlength=len(owner)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        none = np.minimum(np.exp(log_none), 1 - 1e-9)
        # d loss / d z of a sentence: p where the document is clean, -p none/(1 - none) where it is toxic
        g = p * np.where(y[owner] > 0.5, -(none / (1 - none))[owner], 1.0) / max(1, len(y))
        gw, gb = np.bincount(ids, weights=g[sent], minlength=len(w)) + DECAY / max(1, len(w)) * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = RATE * min(1.0, 2 * (epochs - t + 1) / epochs)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return {"bias": float(b), "features": {f: float(w[i]) for f, i in vocab.items()}}


def learn(docs: DataFrame, labels: DataFrame, folds: int | None = 5, fold: int = 0) -> dict:
    """Model from the labelled rows whose crc32(doc_id) mod ``folds`` is not ``fold``; from all, if folds is None."""
    known = labels.filter(F.col("toxic").isin(0, 1))
    if folds:
        known = known.filter(~held_out("doc_id", folds, fold))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.select("doc_id", "text").filter(F.length("text") < 20 * SAMPLE_WORDS)
    picked = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = picked(0).unionByName(picked(1))
    rows = short.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "text"])
    if rows.empty:
        return {"bias": START, "features": {}}
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy())


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


class WordScores(dict):
    """Log odds that a word adds: its features' weights, summed up once for each word seen."""

    def __init__(self, model: dict):
        super().__init__()
        self.bias, self.weights = model["bias"], model["features"]

    def __missing__(self, word: bytes) -> float:
        get = self.weights.get
        total = get(word, 0.0) + sum([get(b"^" + word[:n], 0.0) for n in PREFIXES if n <= len(word)])
        if len(self) > 300_000:
            self.clear()
        self[word] = total
        return total


def sentence_logits(bag: list[list[bytes]], scores: WordScores) -> np.ndarray:
    at, bias = scores.__getitem__, scores.bias
    return np.array([bias + sum(map(at, set(s))) for s in bag if s])


def noisy_or(z: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0


def spans(text: str, scores: WordScores, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, end, p) in characters of the sentences that carry a text to probability ``least``, in text order.

    The likeliest go first, until what is left stays below ``least``; a text below it has none.
    """
    found = []
    for piece in re.finditer(r"[^.!?\n]+", text):
        z = sentence_logits(sentences(piece[0]), scores)
        if len(z):
            found.append((float(np.logaddexp(0, z).sum()), piece.start(), piece.end(), noisy_or(z)))
    found.sort(key=lambda x: (x[0], -x[1]))
    reached = -np.expm1(-np.cumsum([x[0] for x in found]))
    return sorted(x[1:] for x, p in zip(found, reached, strict=True) if p >= least)


def _score(handle):
    def run(batches):
        scores = WordScores(handle.value)
        for rows in text_blocks(batches):
            out = []
            for _, text in rows:
                p = noisy_or(sentence_logits(sentences(text or ""), scores))
                out.append((p, spans(text, scores) if p >= 0.5 else []))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "score": pa.array([p for p, _ in out], pa.float64()),
                    "offending": pa.array([[{"start": s, "end": e, "p": q} for s, e, q in found] for _, found in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))),
                }
            )

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and the offending sentences (start, end, p; in characters) of every row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(_score(handle)), "doc_id long, score double, offending array<struct<start:int,end:int,p:double>>")


def reject_toxic(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with all their columns."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scores = WordScores(handle.value)
        for b in batches:
            clean = [noisy_or(sentence_logits(sentences(x.as_py() or ""), scores)) < least for x in b.column(at)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
