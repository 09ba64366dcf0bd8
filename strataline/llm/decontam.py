"""Benchmark decontamination: passages within a few word edits of a benchmark item.

Texts become words (lower case, ASCII punctuation as space) and words 64-bit
symbols.  The CGK walk turns edits into Hamming distance: from a window's start it
reads a symbol at every step and moves on, or stays, by a coin that the step and
the symbol toss; after an edit two walks soon meet again.  A repetition samples
``BITS`` steps of the walk; equal samples make a candidate.  One walk serves all
window sizes, as a shorter window's walk is its beginning.

Windows are of item size (the greatest size class an item reaches) and of the
smaller classes, so that an item with edits all over still has quiet windows.
Documents give windows at every ``STRIDE``-th word, items at ``STRIDE`` consecutive
offsets, so that some pair is aligned wherever a passage begins.  Each candidate
is then settled by the exact edit distance of the whole item to the text around
it (bit-parallel, free at the text's ends): at most ``EDITS`` of the item's words.
Sizes, repetitions and bits aim at a recall of 0.95 for passages with edits in a
tenth of their words; exact copies are always found.

Items of fewer than ``SHORTEST`` words have no room for windows; they are found by all
their edits instead: with k edits allowed, one of k + 1 segments of the item is left
whole, so that every place that holds a segment is a candidate, and recall is 1.

Defined results: null and empty texts and items match nothing; items of fewer than
five words allow no edit; repeated items count each; ``start`` is the first word of
the nearest alignment that ends first (of equal ones the one nearest the item's
length); an item
occurring several times in a document gives one row, the nearest, then first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.runtime import text_blocks, tidy
from strataline.llm.shingles import arrow_blocks
from strataline.llm.substring import Hashes, _rolled

#: Window sizes in words, steps of the walk per word of a window, and every how many words a document has a window.
SIZES, PACE, STRIDE = (8, 12, 16, 24, 32, 48), 1.5, 4
#: Items of fewer words are found by their segments.
SHORTEST = 16
#: Repetitions of the sampling, and sampled steps of each.
REPEATS, BITS = 4, 4
#: Share of an item's words that may be edited.
EDITS = 0.2
#: Words of benchmark items that one pass over the documents looks for; more items take more passes.
PASS_WORDS = 2_000_000
#: Windows handled at a time (they fit a core's cache), and bits of the table that dismisses most of them.
TILE, TABLE_BITS = 1 << 15, 22

_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_STEPS = int(SIZES[-1] * PACE)
_RNG = np.random.default_rng(23)
_COINS = _RNG.integers(1 << 62, 1 << 63, _STEPS, dtype=np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9FB21C651E98DF25)
#: steps sampled by each repetition of each size, in ascending order
_SAMPLES = [[sorted(_RNG.choice(int(size * PACE), BITS, replace=False).tolist()) for _ in range(REPEATS)] for size in SIZES]
_AT_STEP = [[(c, r) for c in range(len(SIZES)) for r in range(REPEATS) if step in _SAMPLES[c][r]] for step in range(_STEPS)]


def symbols(text: str, hashes: Hashes) -> np.ndarray:
    words = text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def sampled_keys(stream: np.ndarray, starts: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Keys {size: [repetition][window]} of the walks from ``starts``; ``stream`` needs _STEPS zeros at its end."""
    keys = {c: np.full((REPEATS, len(starts)), np.uint64(c + 1)) for c in sizes}
    at = starts.copy()
    for step in range(int(SIZES[max(sizes)] * PACE)):
        v = stream[at]
        for c, r in _AT_STEP[step]:
            if c in keys:
                own = keys[c][r]
                own ^= v
                own *= _PRIME
                own ^= own >> np.uint64(31)
        v *= _COINS[step]
        v >>= np.uint64(63)
        at += v.view(np.int64)
    return keys


class Benchmark:
    """Items of one pass: their walks' keys, and masks for exact verification."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes = Hashes()
        self.ids, self.words, self.masks, self.own = [], [], [], []
        keys, owners, segments = [], [], {}
        used = set()
        for item, text in items:
            own = symbols(text or "", hashes)
            if not len(own):
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(len(own))
            masks: dict[int, int] = {}
            for i, w in enumerate(own.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
            self.own.append(own)
            if len(own) < SHORTEST:
                cuts = [i * len(own) // (int(EDITS * len(own)) + 1) for i in range(int(EDITS * len(own)) + 2)]
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    segments.setdefault(e - s, []).append((int(_rolled(own[s:e], e - s)[0]), k, s))
                continue
            fits = [c for c, size in enumerate(SIZES) if size + STRIDE - 1 <= len(own)]
            stream = np.r_[own, np.zeros(_STEPS, np.uint64)]
            for c in fits:
                tiles = range(0, len(own) - SIZES[c] + 1, SIZES[c] // 2)
                starts = np.array(sorted({t + o for t in tiles for o in range(STRIDE) if t + o + SIZES[c] <= len(own)}), np.int64)
                for r, row in enumerate(sampled_keys(stream, starts, [c])[c]):
                    keys.append(row)
                    owners.append(np.stack([np.full(len(starts), c * REPEATS + r), np.full(len(starts), k), starts], axis=1))
                used.add(c)
        #: size: (sorted hashes, items and offsets) of the segments of short items
        self.segments = {n: (np.array([x[0] for x in sorted(own)], np.uint64), np.array([x[1:] for x in sorted(own)], np.int64)) for n, own in segments.items()}
        self.sizes = sorted(used)
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        self.owners = np.concatenate(owners) if owners else np.empty((0, 3), np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], self.owners[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def candidates(self, stream: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(item, where it would begin in the stream) of windows that share a sample with it."""
        found: set[tuple[int, int]] = set()
        if not len(starts) or not self.sizes:
            return found
        for k in range(0, len(starts), TILE):
            tile = starts[k : k + TILE]
            for c, rows in sampled_keys(stream, tile, self.sizes).items():
                for r in range(REPEATS):
                    hit = np.flatnonzero(self.table[(rows[r] >> np.uint64(64 - TABLE_BITS)).view(np.int64)])
                    if not len(hit):
                        continue
                    lo, hi = (np.searchsorted(self.keys, rows[r][hit], side) for side in ("left", "right"))
                    for i, a, z in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                        for own, item, offset in self.owners[a:z].tolist():
                            if own == c * REPEATS + r:
                                found.add((item, int(tile[i]) - offset))
        return found

    def whole_segments(self, stream: np.ndarray) -> set[tuple[int, int]]:
        """(item, where it would begin in the stream) of all places that hold a segment of a short item."""
        found: set[tuple[int, int]] = set()
        for size, (keys, owners) in self.segments.items():
            if len(stream) < size:
                continue
            rolled = _rolled(stream, size)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            hit = np.flatnonzero(table[(rolled >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            lo, hi = (np.searchsorted(keys, rolled[hit], side) for side in ("left", "right"))
            for i, a, z in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update((item, i - offset) for item, offset in owners[a:z].tolist())
        return found

    def begin(self, item: int, words: list[int], end: int, edits: int) -> int:
        """Where the part of ``words`` that ends at ``end``, so many edits from the item, begins."""
        n = self.words[item]
        if not edits:
            return end - n
        back = np.array(words[max(0, end - n - edits) : end][::-1], np.uint64)
        places = np.arange(len(back) + 1)
        row = places
        for w in self.own[item][::-1]:
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (back != w))
            row = np.minimum.accumulate(new - places) + places
        nearest = np.flatnonzero(row == row.min())
        return end - int(nearest[np.argmin(np.abs(nearest - n))])

    def distance(self, item: int, words: list[int]) -> tuple[int, int]:
        """Least edits between the item and a part of ``words``, and where that part ends."""
        n, get = self.words[item], self.masks[item].get
        full, high = (1 << n) - 1, 1 << (n - 1)
        up, down, score = full, 0, n
        best = (n, 0)
        for j, w in enumerate(words):
            eq = get(w, 0)
            x = eq | down
            d = ((((x & up) + up) ^ up) | x) & full
            rise, fall = down | (full & ~(d | up)), up & d
            if rise & high:
                score += 1
            elif fall & high:
                score -= 1
            rise, fall = (rise << 1) & full, (fall << 1) & full
            up, down = fall | (full & ~(x | rise)), rise & x
            if score < best[0]:
                best = (score, j + 1)
        return best

    def search(self, texts: list[str | None], hashes: Hashes) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, edits) of the passages in a block of texts."""
        own = [symbols(t or "", hashes) for t in texts]
        pad = np.zeros(_STEPS, np.uint64)
        begins = np.cumsum([0] + [len(o) + _STEPS for o in own])
        stream = np.concatenate([x for o in own for x in (o, pad)] or [pad])
        least = SIZES[self.sizes[0]] if self.sizes else 0
        starts = np.concatenate([np.arange(b, b + max(0, len(o) - least + 1), STRIDE) for b, o in zip(begins[:-1].tolist(), own, strict=True)] or [np.empty(0, np.int64)])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item, at in sorted(self.candidates(stream, starts.astype(np.int64)) | self.whole_segments(stream)):
            n = self.words[item]
            slack = int(EDITS * n)
            text = self._text_of(begins, at, n)
            got = best.get((text, item))
            if got is not None and got[0] == 0:
                continue
            lo, hi = max(int(begins[text]), at - slack), min(int(begins[text]) + len(own[text]), at + n + slack)
            words = stream[lo:hi].tolist()
            masks = self.masks[item]
            if sum(w in masks for w in words) < n - slack:
                continue
            edits, end = self.distance(item, words)
            if edits <= slack and (got is None or edits < got[0]):
                best[text, item] = (edits, lo + self.begin(item, words, end, edits) - int(begins[text]))
        for (text, item), (edits, where) in best.items():
            yield text, self.ids[item], where, edits

    @staticmethod
    def _text_of(begins: np.ndarray, at: int, n: int) -> int:
        """The text that holds most of [at, at + n): the one that its middle lies in."""
        return min(max(int(np.searchsorted(begins, at + n // 2, "right")) - 1, 0), len(begins) - 2)


def passes(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The items in parts of bounded size, whatever the size of the benchmark."""
    held, words = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        words += len((row["text"] or "").split())
        if words >= PASS_WORDS:
            yield Benchmark(held)
            held, words = [], 0
    if held:
        yield Benchmark(held)


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word), edits of every item found in a document."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, start long, edits int"
    out = spark.createDataFrame([], schema)
    for items in passes(benchmark):
        handle = spark.sparkContext.broadcast(items)

        def run(batches, handle=handle):
            own, hashes = handle.value, Hashes()
            for rows in text_blocks(batches, limit=4 << 20):
                found = [(rows[t][0], item, at, edits) for t, item, at, edits in own.search([r[1] for r in rows], hashes)]
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "start", "edits"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema))
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start")).alias("m")).select("doc_id", "item_id", F.col("m.start").alias("start"), F.col("m.edits").alias("edits"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    at = docs.columns.index("text")
    for items in passes(benchmark):
        handle = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, handle=handle):
            own, hashes = handle.value, Hashes()
            for part in arrow_blocks(batches, at, 4 << 20):
                bad = {t for t, *_ in own.search(part.column(at).to_pylist(), hashes)}
                yield part.filter(pa.array([t not in bad for t in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
