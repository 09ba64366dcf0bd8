"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

A first pass over all texts accumulates word vectors: a token (a word, or the
punctuation at its ends) has a fixed sparse random index vector, and its context
vector is the sum of its neighbours' index vectors over the whole corpus.  Tokens
share ``SLOTS`` hashed slots, so that the table has one size for any corpus; each
task adds up its own part and slices of the table are summed in parallel.  A
second pass pools the vectors of a document: their mean, their mean square, the
mean product of neighbours (which tells text from repetition), and its length.  A two-layer network learns labels from a bounded sample of labelled
rows (``SAMPLE``, in hash order), a fifth of which sets the temperature of its
probabilities.

Defined results: null and empty texts pool to zeros and get a score like any
other; labels that are null or not 0 or 1 teach nothing; a document labelled both
ways counts as low; with no label at all every score is 0.5; rows that repeat a
doc_id are scored each.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.runtime import durable, text_blocks

#: Size of the table of word vectors, nonzeros of an index vector, neighbours on either side.
SLOTS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
#: Slots of a slice of the table, the unit in which tasks' parts are summed.
SLICE = 1024
#: Labelled rows to learn from; hidden units; passes, batch and step size.
SAMPLE, HIDDEN, EPOCHS, BATCH, RATE = 12_000, 32, 40, 256, 0.01
#: Tokens of one document that are handled at a time.
CHUNK = 1 << 20

_EDGES = re.compile(rb"^([!-/:-@\[-`{-~]*)(.*?)([!-/:-@\[-`{-~]*)$", re.S)
_FEATURES = 3 * DIM + 1


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, DIM, (SLOTS, NONZERO)).astype(np.int32), rng.choice([-1, 1], (SLOTS, NONZERO)).astype(np.int8)


class Tokens(dict):
    """Slots of a word's parts: what stands before it, its core, what stands after it (-1: nothing)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        parts = [zlib.crc32(p) % SLOTS if p else -1 for p in _EDGES.match(word).groups()]
        code = ((parts[0] + 1) * (SLOTS + 1) + parts[1] + 1) * (SLOTS + 1) + parts[2] + 1
        self[word] = code
        return code


def token_slots(text: str, seen: Tokens) -> np.ndarray:
    """Slots of a text's tokens in order; case does not matter."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    code = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    base = SLOTS + 1
    flat = np.stack([code // (base * base), code // base % base, code % base], axis=1).ravel() - 1
    return flat[flat >= 0].astype(np.int32)


def _accumulate(batches):
    place, sign = _index_vectors()
    total = np.zeros(SLOTS * DIM, np.int64)
    counts = np.zeros(SLOTS, np.int64)
    seen = Tokens()

    def add(t: np.ndarray) -> None:
        nonlocal counts
        counts += np.bincount(t[t >= 0], minlength=SLOTS)
        for gap in range(1, REACH + 1):
            a, b = t[:-gap], t[gap:]
            both = (a >= 0) & (b >= 0)
            a, b = a[both], b[both]
            for x, y in ((a, b), (b, a)):
                for j in range(NONZERO):
                    at, s = x * DIM + place[y, j], sign[y, j]
                    total.__iadd__(np.bincount(at[s > 0], minlength=SLOTS * DIM))
                    total.__isub__(np.bincount(at[s < 0], minlength=SLOTS * DIM))

    for rows in text_blocks(batches, column=0):
        # documents follow each other, apart by more than the reach
        gap, held, n = np.full(REACH, -1, np.int32), [], 0
        for (text,) in rows:
            own = token_slots(text or "", seen)
            for k in range(0, len(own), CHUNK):
                held += [own[k : k + CHUNK + REACH * (k + CHUNK < len(own))], gap]
                n += len(held[-2])
                if n > CHUNK:
                    add(np.concatenate(held))
                    held, n = [], 0
        if held:
            add(np.concatenate(held))
    for k in range(0, SLOTS, SLICE):
        if counts[k : k + SLICE].any():
            part = np.concatenate([total[k * DIM : (k + SLICE) * DIM], counts[k : k + SLICE]]).astype("<i8")
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()), "part": [zlib.compress(part.tobytes(), 1)]})


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = np.frombuffer(zlib.decompress(part.as_py()), "<i8")
            sums[k] = sums[k] + own if k in sums else own
    for k, own in sums.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "part": [zlib.compress(own.tobytes(), 1)]})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS x DIM context vectors over all documents, of unit length; the table's size never grows."""
    schema = "slice int, part binary"
    parts = docs.select(text).mapInArrow(_accumulate, schema).repartition(SLOTS // SLICE, "slice").mapInArrow(_add_up, schema)
    vectors, counts = np.zeros((SLOTS, DIM)), np.zeros(SLOTS)
    for row in parts.toLocalIterator():
        own = np.frombuffer(zlib.decompress(row["part"]), "<i8")
        k = row["slice"] * SLICE
        vectors[k : k + SLICE] = own[: SLICE * DIM].reshape(SLICE, DIM)
        counts[k : k + SLICE] = own[SLICE * DIM :]
    # what any token's neighbours add up to says nothing about a token
    usual = vectors.sum(axis=0) / max(1.0, counts.sum())
    vectors = vectors - counts[:, None] * usual
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, mean square and mean product of neighbours of the tokens' vectors, and the logarithm of their number."""
    out = np.zeros(_FEATURES)
    if len(slots):
        kinds, n = np.unique(slots, return_counts=True)
        share = n / len(slots)
        own = vectors[kinds]
        out[:DIM], out[DIM : 2 * DIM], out[-1] = share @ own, share @ (own * own), np.log1p(len(slots))
        for k in range(0, len(slots) - 1, 1 << 16):
            near = slots[k : k + (1 << 16) + 1]
            out[2 * DIM : -1] += np.einsum("ij,ij->j", vectors[near[:-1]], vectors[near[1:]])
        out[2 * DIM : -1] /= max(1, len(slots) - 1)
    return out.astype(np.float32)


def document_vectors(docs: DataFrame, vectors: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id and pooled features of every row."""
    handle = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        own, seen = handle.value, Tokens()
        for b in batches:
            pooled = [pool(token_slots(x.as_py() or "", seen), own).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pooled, pa.binary())], ["doc_id", "pooled"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, pooled binary")


class Network:
    """Two layers; scores are probabilities after division of the log odds by a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(11)
        order = rng.permutation(len(y))
        held, kept = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[kept].mean(axis=0), x[kept].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        steps = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for k in range(0, len(kept), BATCH):
                own = rng.permutation(kept)[:BATCH] if k == 0 else kept[(np.arange(BATCH) + k) % len(kept)]
                h = np.tanh(z[own] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[own]) / len(own)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[own].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                steps += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**steps)) / (np.sqrt(v[i] / (1 - 0.999**steps)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, t = self.logits(x[held]), y[held]
        if len(t):
            heats = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.logaddexp(0, np.where(t > 0.5, -logits, logits) / h).mean() for h in heats]
            self.temperature = float(heats[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def learn(pooled: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> Network | None:
    """Network from the labelled rows whose crc32(doc_id) mod ``folds`` is not ``fold``."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out("doc_id", folds, fold))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = pooled.join(F.broadcast(sample), "doc_id").toPandas().sort_values(["doc_id", "pooled"])
    if rows["quality"].nunique() < 2:
        return None
    x = np.frombuffer(b"".join(rows["pooled"]), np.float32).reshape(-1, _FEATURES).astype(np.float64)
    return Network(x, rows["quality"].to_numpy(np.float64))


def score(pooled: DataFrame, network: Network | None) -> DataFrame:
    """doc_id and score of every row."""
    handle = pooled.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        own = handle.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, _FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.score(x) if own else np.full(len(x), 0.5))], ["doc_id", "score"])

    return pooled.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    pooled = durable(document_vectors(docs, word_vectors(docs)), "quality-pooled")
    scored = score(pooled, learn(pooled, labels, folds, fold))
    return scored.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
