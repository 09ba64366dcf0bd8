"""Token ids in ORC files: ascending ids, read and skipped stripe by stripe.

Texts are dealt out by ranges of doc_id and sorted before they are encoded, so
what moves is text, not ids.  ORC stores the ids of a stripe with its integer
run-length encoding; row indexes hold the least and greatest doc_id of every
group of rows, and Bloom filters on doc_id answer single-document reads.

Encoding cuts a block of texts, at ASCII white space and punctuation, into what the
tokenizer's own pre-tokens cannot cross, sorts the pieces by hash (and compares their
bytes), and keeps a bounded table of their ids; most repeat.  What is new goes to the
library: ASCII words to its merges, all else to its encoder, in one call, so that its
own pattern and Unicode tables decide.  A text with
a piece that begins or ends in other white space goes through the library whole,
as does every text where the tokenizer is not a byte-level one without normaliser.

Defined results: a null text is an empty one (only the end id); control strings
of the vocabulary inside a text are ordinary text; rows repeating a doc_id follow
each other, by a hash of the text; null doc_ids come first.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.runtime import durable, scratch_path, slices, tidy
from strataline.llm.shingles import arrow_blocks, hashed_places, ranges, same_places, text_bytes, word_places

#: Bytes of pieces that the table holds before it starts anew (some 50 more for each piece).
TABLE_BYTES = 12 << 20
#: Bytes of text that are encoded at a time; a block's own arrays take some 70 times as much.
TEXT_BYTES = 1 << 20
#: Bytes of an ORC stripe and rows of an index entry: the units of parallel reads and of skipping.
STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1000
#: Fixed value: the pre-tokenizer for which ASCII white space bounds pieces as below.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

#: Bytes that are ASCII letters or digits (1), and other printable ones but the apostrophe (2).
_KIND = np.array([1 if chr(b).isalnum() else 2 if 32 < b < 127 and b != 39 else 0 for b in range(128)] + [0] * 128, np.int8)


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts begin, and their bytes; together they are all of every text.

    A word takes the one space before it; of other white space before a word the last
    character stands alone; what is left, or ends a text, is one piece.  Punctuation
    after an ASCII letter or digit begins another piece (but for the apostrophe, of
    which the tokenizer's pattern makes more).
    """
    begins, sizes, where = word_places(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(where))
    spaced = (begins > offsets[owner]) & (data[begins - 1] == 0x20)
    ends = begins + sizes
    begins = begins - spaced
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
    left = np.where(first, offsets[owner], np.r_[0, ends[:-1]]) if len(owner) else begins
    gap = begins - left
    alone = (gap > 0) & ~spaced
    last = offsets[:-1].copy()
    last[owner] = ends  # the last word of a text is written last
    tail = offsets[1:] - last
    kind = _KIND[data]
    points = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
    points = points[~np.isin(points, offsets)]
    at = np.concatenate([begins, points, left[gap - alone > 0], begins[alone] - 1, last[tail > 0]])
    at.sort()
    return at, np.diff(at, append=offsets[-1])


def _held(table: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether a sorted table holds each of the numbers asked for."""
    at = np.searchsorted(table, asked)
    return (at < len(table)) & (table[np.minimum(at, len(table) - 1)] == asked) if len(table) else np.zeros(len(asked), bool)


class Encoder:
    """Ids of texts, equal to the library's encoding of each whole text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_pieces = spec.get("normalizer") is None and spec.get("truncation") is None and all(cut.get(k) == v for k, v in BYTE_LEVEL.items())
        line = self.whole("\n")
        self.line = int(line[0]) if len(line) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.hashes, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)  # sorted; the piece of each
        self.text, self.at, self.size = np.zeros(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids, self.starts, self.lens = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: list[bytes], hashes: np.ndarray) -> None:
        """Ids of pieces not met before; length -1 for those that do not stand for themselves."""
        lens, starts = np.full(len(keys), -1, np.int32), np.zeros(len(keys), np.int64)
        plain, parts, size = [], [], len(self.ids)
        merges, flat = self.tok.model.tokenize, []
        for i, key in enumerate(keys):
            body = key[1:] if key[0] == 32 else key
            if body.isalpha():
                got = merges(("\u0120" if body is not key else "") + body.decode())  # the byte alphabet's space
                starts[i], lens[i] = size + len(flat), len(got)
                flat += [t.id for t in got]
        parts.append(np.array(flat, np.uint32))
        size += len(flat)
        for i in np.flatnonzero(lens < 0).tolist():
            key = keys[i]
            if not key.isascii():
                t = key.decode("utf-8", "replace")
                body = t[1:] if t[0] == " " else t
                if body and not body[0].isspace() and not body[-1].isspace() and body[0] != "\u180e" != body[-1]:
                    plain.append(i)
            elif key.strip():
                plain.append(i)
            else:  # white space only
                parts.append(self.whole(key.decode()))
                starts[i], lens[i] = size, len(parts[-1])
                size += lens[i]
        if plain:
            # a line end between two pieces is a pre-token of its own
            text = b"\n".join([keys[i] for i in plain]).decode("utf-8", "replace")
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.r_[-1, np.flatnonzero(ids == self.line), len(ids)]
            if len(cuts) == len(plain) + 1:
                parts.append(ids)
                starts[plain], lens[plain] = size + cuts[:-1] + 1, np.diff(cuts) - 1
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, *parts])
        sizes = np.fromiter(map(len, keys), np.int32, len(keys))
        self.at = np.concatenate([self.at, len(self.text) + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(keys), np.uint8)])
        number = np.concatenate([self.number, np.arange(len(self.size) - len(keys), len(self.size), dtype=np.int32)])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number = hashes[order], number[order]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), and where each text's begin and end."""
        data, offsets = text_bytes(texts)
        if not self.by_pieces or self.line is None:
            return self._spliced(data, offsets, np.arange(len(texts)), np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        if len(self.text) > TABLE_BYTES:
            self.forget()
        at, size = pieces_of(data, offsets)
        where = np.searchsorted(at, offsets)
        h = hashed_places(data, at, size)
        order = np.argsort(h)
        new = np.r_[True, h[order][1:] != h[order][:-1]][: len(h)]
        heads = order[new]
        code = np.empty(len(h), np.int64)
        code[order] = np.cumsum(new) - 1
        alike = same_places(data, at, size, at[heads][code], size[heads][code])
        own = h[heads]
        missing = np.flatnonzero(~_held(self.hashes, own))
        if len(missing):
            raw = data.tobytes()
            self._learn([raw[b : b + n] for b, n in zip(at[heads[missing]].tolist(), size[heads[missing]].tolist(), strict=True)], own[missing])
        number = self.number[np.searchsorted(self.hashes, own)]
        known = np.concatenate([self.text, data])
        alike &= same_places(known, at[heads] + len(self.text), size[heads], self.at[number], self.size[number])[code]
        number = number[code]
        lens = self.lens[number]
        odd = np.flatnonzero((lens < 0) | ~alike)
        kept = np.maximum(lens, 0)
        flat = self.ids[ranges(self.starts[number], kept)]
        bounds = np.r_[0, np.cumsum(kept)][where]
        if len(odd):
            return self._spliced(data, offsets, np.unique(np.searchsorted(where, odd, "right") - 1), flat, bounds)
        return flat, bounds

    def _spliced(self, data, offsets, odd, flat, bounds) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of some texts replaced by the library's for the whole text."""
        parts, sizes, done = [], np.diff(bounds), 0
        for d in odd.tolist():
            own = self.whole(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
            parts += [flat[bounds[done] : bounds[d]], own]
            sizes[d], done = len(own), d + 1
        return np.concatenate([*parts, flat[bounds[done] :], np.empty(0, np.uint32)]), np.r_[0, np.cumsum(sizes)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, end: int):
    def run(batches):
        enc = encoder(path)
        for block in arrow_blocks(batches, 1, TEXT_BYTES):
            ids, offsets = enc.column(block.column(1))
            closed = offsets + np.arange(len(offsets))
            out = np.full(int(closed[-1]), end, np.int32)
            out[ranges(closed[:-1], np.diff(offsets))] = ids.astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(closed.astype(np.int32)), pa.array(out))], ["doc_id", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    """Write (part, seq, doc_id, ids) as ORC, parts and rows in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("turn"))
    # the hash parts rows of one doc_id, if they are many; the range bounds then hold numbers only
    ranged = rows.repartitionByRange(slices(docs), F.col("doc_id").asc(), F.col("turn").asc()).sortWithinPartitions("doc_id", "turn", "text")
    coded = ranged.select("doc_id", "text").mapInArrow(tidy(_encode(tokenizer, end)), "doc_id long, ids array<int>")
    numbered = coded.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), "doc_id", "ids")
    options = {
        "compression": "zstd",
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.create.index": "true",
        "orc.row.index.stride": str(INDEX_ROWS),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    numbered.write.options(**options).orc(path)


def _digest(batches):
    for b in batches:
        ids = b.column(2)
        flat, offs = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[s:e]) for s, e in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(3), pa.array(np.diff(offs).astype(np.int64)), pa.array(sums, pa.int64())], ["part", "seq", "doc_id", "n_tokens", "ids_crc32"])


def read_digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files; start is a prefix sum over parts, then inside each."""
    own = durable(stored.select("part", "seq", "ids", "doc_id").mapInArrow(tidy(_digest), "part int, seq long, doc_id long, n_tokens long, ids_crc32 long"), "token-digests")
    whole = own.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    ahead = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(whole.select("part", ahead.alias("ahead")), "part").select("doc_id", (F.col("ahead") + inside).alias("start"), "n_tokens", "ids_crc32")


def tokenise(docs: DataFrame, tokenizer: str, end: int = 0, label: str = "tokens") -> tuple[DataFrame, str]:
    """Write ``docs`` to a new folder of the shared scratch space; the files as a DataFrame, and their path."""
    spark = docs.sparkSession
    path = scratch_path(spark, label)
    write_tokens(docs, path, tokenizer, end)
    return spark.read.schema("part int, seq long, doc_id long, ids array<int>").orc(path), path
