"""Substring deduplication by super-k-mers.

A window is ``WINDOW`` consecutive words.  Every window has a minimiser: the least
hash among its runs of ``RUN`` words.  Equal windows have equal minimisers, so
consecutive windows that share one travel together, as one packed string (a
super-k-mer, some 70 words for some 20 windows) to the minimiser's bucket.  There
the windows are sorted, equal ones meet, and each is kept by the smallest doc_id
and removed elsewhere.

A task first settles what it can by itself: of equal windows in its own block only
those of the smallest doc_id travel, the others are removed in any case.  So a
passage that a third of all documents share reaches its bucket once per block.

Defined results: null and empty texts have no words; a document shorter than a
window loses nothing; windows repeated inside one document, or in rows of the
same doc_id, do not remove each other; a null doc_id comes before all others.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.runtime import durable, partitions_of, text_blocks

#: Words of a window, and of the runs among which its minimiser is.
WINDOW, RUN = 50, 6
#: Buckets that a partition of the input adds; a bucket's size then does not grow with the corpus.
BUCKETS = 8
#: Text of a block that settles its own repeats.
BLOCK = 8 << 20
#: Sorts before every doc_id.
NO_ID = -(1 << 63)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_CUT_SCHEMA = "doc_id long, text_key long, cuts binary"


class Hashes(dict):
    """64-bit hash of each word seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive entries, by doubling: runs of n from runs of n // 2."""
    if n == 1:
        return h
    half = _rolled(h, n // 2)
    own = _mixed(half[: len(half) - n // 2] * _ROLL + half[n // 2 :])
    return own if n % 2 == 0 else _mixed(own[: len(own) - 1] * _ROLL + h[n - 1 :])


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive entries, by doubling."""
    done = 1
    while done * 2 <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word intervals that windows at these (sorted) starts cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + window).tolist(), strict=True))


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _travel(window: int, run_len: int, buckets: int):
    """Rows (bucket, kind, payload): kind 0 holds super-k-mers, kind 1 cuts that are settled already."""

    def block(rows):
        hashes = Hashes()
        doc_of, key_of, words, sizes = [], [], [], []
        for i, text in rows:
            if text:
                own = text.encode("utf-8", "surrogatepass").split()
                if len(own) >= window:
                    doc_of.append(NO_ID if i is None else i)
                    key_of.append(text_key(text))
                    words.append(own)
                    sizes.append(len(own))
        if not words:
            return
        h = np.fromiter((hashes[w] for own in words for w in own), np.uint64, sum(sizes))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.arange(len(h)) <= (ends - window)[owner]
        at = np.flatnonzero(inside)
        full = _rolled(h, window)[at]
        least = _least(_rolled(h, run_len), window - run_len + 1)[at]
        ids = np.array(doc_of)[owner[at]]
        # equal windows of this block: those of the smallest doc_id stay open, the others are settled
        order = np.lexsort((ids, full))
        new = np.r_[True, full[order][1:] != full[order][:-1]]
        first = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        settled = np.zeros(len(at), bool)
        settled[order] = ids[order] != first
        # hashes only propose: what is settled here has the words of its group's first window, else the bucket decides
        head = np.zeros(len(at), np.int64)
        head[order] = at[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        proposed, span = np.flatnonzero(settled), np.arange(window)
        for k in range(0, len(proposed), 1 << 15):
            own = proposed[k : k + (1 << 15)]
            settled[own] = (h[at[own][:, None] + span] == h[head[own][:, None] + span]).all(axis=1)
        cuts: dict[int, list] = defaultdict(list)
        where = owner[at]
        for d in np.unique(where[settled]).tolist():
            lo, hi = np.searchsorted(where, [d, d + 1])
            starts = at[lo:hi][settled[lo:hi]] - begins[d]
            cuts[hash((doc_of[d], key_of[d])) % buckets].append((doc_of[d], key_of[d], _spans(starts, window)))
        # stretches of open windows with one minimiser in one document
        same = np.r_[False, (least[1:] == least[:-1]) & (at[1:] == at[:-1] + 1) & (where[1:] == where[:-1]) & ~settled[1:] & ~settled[:-1]]
        heads = np.flatnonzero(~same & ~settled)
        stop = np.flatnonzero(~same | settled)
        tails = np.r_[stop, len(at)][np.searchsorted(stop, heads, "right")]
        del h, full, order, new, first, inside, head
        packs: dict[int, list] = defaultdict(list)
        for a, z, key in zip(heads.tolist(), tails.tolist(), (least[heads] % np.uint64(buckets)).tolist(), strict=True):
            d = int(where[a])
            start = int(at[a] - begins[d])
            packs[key].append((doc_of[d], key_of[d], start, b" ".join(words[d][start : start + (z - a) + window - 1])))
        squeeze = zstandard.ZstdCompressor(level=1)
        out = []
        for key, own in packs.items():
            nums = np.array([(i, k, s) for i, k, s, _ in own], "<i8").tobytes()
            out.append((key, 0, len(own).to_bytes(4, "little") + squeeze.compress(nums + b"\n".join(p for *_, p in own))))
        for key, own in cuts.items():
            flat = [x for i, k, spans in own for x in (i, k, len(spans), *[y for s in spans for y in s])]
            out.append((key, 1, squeeze.compress(np.array(flat, "<i8").tobytes())))
        for k in range(0, len(out), 512):
            part = out[k : k + 512]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int32()), pa.array([p[2] for p in part], pa.binary())], ["bucket", "kind", "payload"])

    def run(batches):
        for rows in text_blocks(batches, limit=BLOCK):
            yield from block(rows)

    return run


def _cut_batch(docs, keys, spans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([None if d == NO_ID else d for d in docs], pa.int64()), pa.array(keys, pa.int64()), pa.array([np.array(s, "<i4").tobytes() for s in spans], pa.binary())], ["doc_id", "text_key", "cuts"])


def _count(window: int):
    """Settles a bucket: sorts its windows and cuts those that a smaller doc_id has too."""

    def bucket(payloads: list[bytes]):
        unsqueeze = zstandard.ZstdDecompressor()
        number: dict[bytes, int] = {}
        docs, keys, starts, seqs = [], [], [], []
        for p in payloads:
            raw, n = unsqueeze.decompress(p[4:]), int.from_bytes(p[:4], "little")
            nums = np.frombuffer(raw[: 24 * n], "<i8").reshape(n, 3)
            docs.append(nums[:, 0])
            keys.append(nums[:, 1])
            starts.append(nums[:, 2])
            seqs += raw[24 * n :].split(b"\n")
        docs, keys, starts = (np.concatenate(x) for x in (docs, keys, starts))
        # the bucket's own numbers for its words make comparisons exact
        coded = [np.array([number.setdefault(w, len(number)) for w in s.split(b" ")], np.int32) for s in seqs]
        sizes = np.array([len(c) for c in coded])
        flat = np.concatenate(coded)
        del coded, seqs
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(np.arange(len(flat)) <= (ends - window)[owner])
        full = _rolled(_mixed(flat.astype(np.uint64) + np.uint64(1)), window)[at]
        ids = docs[owner[at]]
        order = np.lexsort((ids, full))
        full, at = full[order], at[order]
        new = np.r_[True, full[1:] != full[:-1]]
        head = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = ids[order] != docs[owner[head]]
        # hashes only propose: a window is cut if its words equal those of its group's first
        proposed = np.flatnonzero(gone)
        for k in range(0, len(proposed), 1 << 16):
            own = proposed[k : k + (1 << 16)]
            span = np.arange(window)
            differ = (flat[at[own][:, None] + span] != flat[head[own][:, None] + span]).any(axis=1)
            if differ.any():
                _by_words(flat, at, full, docs[owner], gone, own[differ], window)
        cut = np.sort(at[gone])
        place = owner[cut]
        local = cut - (ends - sizes)[place] + starts[place]
        out: dict[tuple, list] = defaultdict(list)
        edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]) if len(place) else np.array([0])
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d = place[s]
            out[int(docs[d]), int(keys[d])] += _spans(local[s:e], window)
        return out

    def run(sent: pa.Table) -> pa.Table:
        open_, found = [], defaultdict(list)
        for b in sent.to_batches():
            for kind, payload in zip(b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if kind == 0:
                    open_.append(payload)
                    continue
                flat, i = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), "<i8").tolist(), 0
                while i < len(flat):
                    n = flat[i + 2]
                    found[flat[i], flat[i + 1]] += list(zip(flat[i + 3 : i + 3 + 2 * n : 2], flat[i + 4 : i + 4 + 2 * n : 2], strict=True))
                    i += 3 + 2 * n
        if open_:
            for k, spans in bucket(open_).items():
                found[k] += spans
        return pa.Table.from_batches([_cut_batch([d for d, _ in found], [t for _, t in found], found.values())])

    return run


def _by_words(flat, at, full, doc_at, gone, odd, window) -> None:
    """Windows whose hash equals another's but whose words differ: settled again by the words themselves."""
    for value in np.unique(full[odd]):
        same = np.flatnonzero(full == value)
        first: dict[bytes, int] = {}
        for i in same.tolist():
            body = flat[at[i] : at[i] + window].tobytes()
            first[body] = min(first.get(body, doc_at[at[i]]), doc_at[at[i]])
        for i in same.tolist():
            gone[i] = doc_at[at[i]] != first[flat[at[i] : at[i] + window].tobytes()]


def repeated_spans(docs: DataFrame, window: int = WINDOW, run_len: int = RUN) -> DataFrame:
    """(doc_id, text_key, cuts): word intervals (pairs of int32) that windows of smaller doc_ids cover."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = partitions_of(rows) * BUCKETS
    sent = rows.mapInArrow(_travel(window, run_len, buckets), "bucket long, kind int, payload binary")
    return sent.groupBy("bucket").applyInArrow(_count(window), _CUT_SCHEMA)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row."""
    cuts = durable(repeated_spans(docs, window), "substring-cuts")
    merged = cuts.groupBy("doc_id", "text_key").agg(F.collect_list("cuts").alias("cuts"))

    def keyed(batches):
        for b in batches:
            keys = [text_key(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], ["id", "text", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(keyed, "id long, text string, key long")
    joined = rows.join(merged, rows["id"].eqNullSafe(merged["doc_id"]) & (rows["key"] == merged["text_key"]), "left").select(F.col("id").alias("doc_id"), "text", "cuts")

    def cut(batches):
        for b in batches:
            total, removed, kept = [], [], []
            for text, cuts in zip(b.column(1), b.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if cuts.is_valid:
                    gone = np.zeros(len(words) + 1, np.int32)
                    for part in cuts.as_py():
                        own = np.frombuffer(part, "<i4").reshape(-1, 2)
                        np.add.at(gone, own[:, 0], 1)
                        np.add.at(gone, own[:, 1], -1)
                    stays = np.cumsum(gone[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
