"""Words and shingle sets of whole Arrow columns: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from strataline.llm.substring import _ROLL, _mixed, _rolled

#: Words of a shingle.
SHINGLE = 5
_SEED_SHORT = 5


def arrow_blocks(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches of at most ``limit`` bytes in a text or binary column (or of one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        at = 0
        while at < b.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield b.slice(at, end - at)
            at = end


#: The bytes of white space, as a table.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Masks that keep the first k bytes of a little-endian 64-bit number.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_WIDE = 64


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, followed by eight zeros, and where each begins and ends."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if where else np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return np.concatenate([own, np.zeros(8, np.uint8)]), offsets - offsets[0]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin, their bytes, and each text's first and last word in those lists."""
    size = int(offsets[-1])
    space = _SPACE[data[:size]]
    after, before = np.ones(size + 1, bool), np.ones(size + 1, bool)
    after[1:size] = space[:-1]
    before[: size - 1] = space[1:]
    edges = offsets[np.r_[True, np.diff(offsets) > 0]]
    after[edges] = True
    before[edges[edges > 0] - 1] = True
    begins = np.flatnonzero(~space & after[:size])
    ends = np.flatnonzero(~space & before[:size]) + 1
    return begins, ends - begins, np.searchsorted(begins, offsets)


def hashed_places(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of every word; words of up to eight bytes and equal length never share one."""
    eights = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    got = sizes.astype(np.uint64) * _ROLL
    at, left, todo = begins, sizes, np.arange(len(begins))
    while len(todo):
        got[todo] = _mixed(got[todo] ^ (eights[at] & _KEEP[np.minimum(left, 8)]))
        more = (left > 8) & (sizes[todo] <= _WIDE)
        at, left, todo = at[more] + 8, left[more] - 8, todo[more]
    for i in np.flatnonzero(sizes > _WIDE).tolist():
        got[i] = xxhash.xxh3_64_intdigest(data[begins[i] : begins[i] + sizes[i]].tobytes())
    return got


def same_places(data: np.ndarray, one: np.ndarray, size: np.ndarray, two: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the bytes at two places are the same, of places with equal hashes."""
    same = size == other
    eights = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    todo = np.flatnonzero(same & (size > 8) & (one != two))
    a, b, left = one[todo], two[todo], size[todo]
    while len(todo):
        same[todo] &= ((eights[a] ^ eights[b]) & _KEEP[np.minimum(left, 8)]) == 0
        more = (left > 8) & (left <= _WIDE * 8)
        wide = np.flatnonzero(left > _WIDE * 8)
        for i in wide.tolist():
            same[todo[i]] &= data[a[i] : a[i] + left[i]].tobytes() == data[b[i] : b[i] + left[i]].tobytes()
        a, b, left, todo = a[more] + 8, b[more] + 8, left[more] - 8, todo[more]
    return same


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) of every text, and where each text's words begin and end."""
    data, offsets = text_bytes(pc.ascii_lower(pc.fill_null(texts, "")))
    begins, sizes, where = word_places(data, offsets)
    return hashed_places(data, begins, sizes), where


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers start .. start + len - 1 of all pairs, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin and end.

    A text of fewer words than a shingle has its whole word sequence as one, an empty one none.
    """
    h, offsets = word_hashes(texts)
    words = np.diff(offsets)
    full = words >= SHINGLE
    counts = np.where(full, words - SHINGLE + 1, (words > 0).astype(np.int64))
    ends = np.cumsum(counts)
    begins = ends - counts
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    if full.any():
        flat[ranges(begins[full], counts[full])] = _rolled(h, SHINGLE)[ranges(offsets[:-1][full], counts[full])]
    for i in np.flatnonzero(~full & (words > 0)).tolist():
        flat[begins[i]] = xxhash.xxh3_64_intdigest(h[offsets[i] : offsets[i + 1]].tobytes(), _SEED_SHORT)
    for s, e in zip(begins[full].tolist(), ends[full].tolist(), strict=True):
        flat[s:e].sort()
    first = np.zeros(len(flat), bool)
    first[begins[counts > 0]] = True
    new = first.copy()
    new[1:] |= flat[1:] != flat[:-1]
    return flat[new], np.r_[0, np.cumsum(new)][np.r_[0, ends]]
