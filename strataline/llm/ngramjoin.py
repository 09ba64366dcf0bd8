"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds the hashes of its distinct shingles.  Texts are shingled
once: sets are stored, one per class of documents with equal sets, and every later
step reads them.  Shingles have one global order, frequent ones last.  Of sets that
link, the first n - ceil(3n / 4) + l shingles share at least l, so that only these
prefixes are indexed (l grows with n).  Index lists are sorted by set size; a pair is
skipped if its sizes, or the positions at which the two sets hold the shingle, leave
too small an overlap, and a set leaves a long list if no block of it can hold a partner.

Lists of at most ``SMALL`` sets give their remaining pairs; a pair that such lists
give l times, together with the long lists of either set, is compared.  The sets that
are in l longer lists meet in groups, one for all lists of much the same sets, into
which every set travels once.  There one set's overlaps with all others are counted
over the group's own index; those of a highly similar set are derived from them, by
the lists of the shingles that differ.  A set whose partners are all known is closed,
and only sets of different components need an answer, so that a group ends as soon as
its open sets are connected.  A group hands on the links that join components, fewer
than it has sets: never its pairs.  Groups too large for a task are cut into parts;
parts meet only where components still differ.

The order rests on the frequencies of all shingles in all sets; it decides costs, never results.

Defined results: null and empty texts have an empty set and link with nothing; a
text of fewer than five words is one shingle; repeated rows are one class; null
doc_ids are members of components but never name one.  Sets are compared by 64-bit
hashes of their shingles, and words of up to eight bytes have hashes of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.components import connected_components
from strataline.llm.runtime import durable, tidy, tidy_group
from strataline.llm.shingles import arrow_blocks, ranges, shingle_sets

#: Longest list that gives its pairs at once; least block of a longer list.
SMALL, BLOCK = 32, 64
#: Weight of the sets that one task compares; a set weighs one, or one per ``UNIT`` shingles.
SPLIT, UNIT = 4096, 256
#: Shingles of sets in an index bucket, and buckets of a partition.
BUCKET_ENTRIES, BUCKETS = 600_000, 4
#: Sets that make a shingle frequent, and most frequent shingles that the order puts last.  The order decides costs, never results, so the bound is safe.
OFTEN, HEAVY = 9, 1 << 18
#: Most rows (of two numbers each) of a side that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text, or of sets, that a task works on at a time.
TEXT_BYTES, SET_BYTES = 4 << 20, 8 << 20


def required(a, b):
    """Least overlap of linked sets of sizes a and b."""
    return -((-3 * (a + b)) // 7)


def shared_least(n):
    """l: how many shingles of their prefixes linked sets share, the smaller of which has n."""
    return 1 + -((-3 * n) // 4) // 8


def _shared_least(n):
    """The same of a column."""
    return 1 + F.floor(F.ceil(3 * n / 4) / 8)


def room(n, pos, m, at):
    """Most overlap of sets of sizes n and m that hold one shingle at positions pos and at."""
    return np.minimum(pos, at) + np.minimum(n - pos, m - at)


_FEATURES = "doc_id long, n long, cls long, at long, body binary"


def _features(batches):
    """Rows (doc_id, n, cls, at, body); at and body, the set, only where its class is new to the task."""
    seen, serial = set(), TaskContext.get().partitionId() << 33
    for block in arrow_blocks(batches, 1, TEXT_BYTES):
        flat, offsets = shingle_sets(block.column(1))
        sizes = np.diff(offsets)
        held = memoryview(flat).cast("B")
        classes, places, bodies = [], [], []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = held[8 * s : 8 * e]
            cls = xxhash.xxh3_64_intdigest(own) - (1 << 63) if e > s else None
            new = cls is not None and cls not in seen
            classes.append(cls)
            places.append(serial if new else None)
            bodies.append(own.tobytes() if new else None)
            if new:
                seen.add(cls)
                serial += 1
        yield pa.RecordBatch.from_arrays(
            [block.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(places, pa.int64()), pa.array(bodies, pa.binary())],
            ["doc_id", "n", "cls", "at", "body"],
        )


def bodies_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets of a binary column as one array, and where each begins and ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view("<u8"), (offsets - offsets[0]) // 8


def _packed(x: np.ndarray) -> bytes:
    """Bytes of numbers, all lowest ones first: the high ones, mostly zero, then vanish when compressed."""
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


#: Bits of a shingle's hash that its frequency is counted without: of shingles alike in the rest all count as frequent.
COARSE = np.uint64(24)
#: Bits that the index leaves out, too: shingles alike in the rest share a list, which gives more pairs, never fewer.
FINE = np.uint64(16)


def _cut(keys: np.ndarray, buckets: int) -> tuple[list[int], list[int], list[int]]:
    """Sorted hashes by buckets: their numbers, first and last places."""
    own = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.zeros(1, np.int64)
    return own[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()


def _payloads(rows: list[tuple[int, bytes]]):
    for k in range(0, len(rows), 512):
        part = rows[k : k + 512]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in part], pa.int64()), pa.array([o[1] for o in part], pa.binary())], ["bucket", "payload"])


def _tallies(buckets: int):
    """Rows (bucket, payload): all shingles of a block's sets, sorted."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for block in arrow_blocks(batches, 0, SET_BYTES):
            h = np.sort(bodies_of(block.column(0))[0])
            coarse = h >> COARSE
            yield from _payloads([(k, squeeze.compress(_packed(np.diff(coarse[s:e], prepend=np.uint64(0))))) for k, s, e in zip(*_cut(h, buckets), strict=True)])

    return run


def _frequent(least: int):
    """Shingles (without the last bits) that at least so many sets hold, and how many."""

    def run(sent: pa.Table) -> pa.Table:
        unsqueeze = zstandard.ZstdDecompressor()
        h = np.concatenate([np.cumsum(_unpacked(unsqueeze.decompress(x.as_py()), "<u8"), dtype=np.uint64) for x in sent.column("payload")])
        h.sort()
        cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
        times = np.diff(cuts)
        often = times >= least
        return pa.table({"h": h[cuts[:-1]][often].view(np.int64), "n": times[often]})

    return run


def _prefixes(handle, buckets: int):
    """Rows (bucket, payload): the prefix entries (shingle, class, size, position) of a block's sets."""

    def entries(block: pa.RecordBatch, heavy: np.ndarray, rank: np.ndarray, maybe: np.ndarray):
        flat, offsets = bodies_of(block.column(1))
        n = np.diff(offsets)
        p = n - -(-3 * n // 4) + shared_least(n)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.full(len(flat), -1, np.int64)  # rank among the frequent
        if len(heavy):
            asked = np.flatnonzero(maybe[(flat >> np.uint64(42)).astype(np.int64)])
            coarse = flat[asked] >> COARSE
            at = np.minimum(np.searchsorted(heavy, coarse), len(heavy) - 1)
            hit = heavy[at] == coarse
            order[asked[hit]] = rank[at[hit]]
        early = order < 0
        before = np.cumsum(early) - early
        before -= before[np.minimum(offsets[:-1], len(flat) - 1)][owner]
        chosen = early & (before < p[owner])
        rest = p - np.bincount(owner[early], minlength=len(n))
        parts = [(np.flatnonzero(chosen), before[chosen])]
        for i in np.flatnonzero(rest > 0).tolist():
            late = offsets[i] + np.flatnonzero(~early[offsets[i] : offsets[i + 1]])
            late = late[np.argsort(order[late], kind="stable")][: rest[i]]
            parts.append((late, p[i] - rest[i] + np.arange(len(late))))
        at, pos = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        return flat[at], np.array(block.column(0))[owner[at]], n[owner[at]].astype(np.int32), pos.astype(np.int32)

    def run(batches):
        heavy, rank = handle.value  # (sorted hashes, their rank: the rarest first)
        maybe = np.zeros(1 << 22, bool)
        maybe[(heavy >> (np.uint64(42) - COARSE)).astype(np.int64)] = True
        squeeze = zstandard.ZstdCompressor(level=1)
        for block in arrow_blocks(batches, 1, SET_BYTES):
            h, cls, n, pos = entries(block, heavy, rank, maybe)
            order = np.argsort(h)
            h, cls, n, pos = h[order], cls[order], n[order], pos[order]
            out = []
            for k, s, e in zip(*_cut(h, buckets), strict=True):
                body = squeeze.compress(_packed(np.diff(h[s:e] >> FINE, prepend=np.uint64(0))) + _packed(n[s:e]) + _packed(pos[s:e]))
                out.append((k, (e - s).to_bytes(4, "little") + cls[s:e].tobytes() + body))
            yield from _payloads(out)

    return run


#: Pairs (a, b, na, nb) of short lists, and sets (head, b, nb) of long ones, each with how often.
_LISTED = "head long, a long, b long, na int, nb int, times int"


def _lists(small: int):
    def run(sent: pa.Table) -> pa.Table:
        return _listed(sent, small)

    return run


def _listed(sent: pa.Table, small: int) -> pa.Table:
    """The rows of one bucket of the index."""
    unsqueeze = zstandard.ZstdDecompressor()
    cols = ([], [], [], [])
    for x in sent.column("payload"):
        raw = x.as_buffer()
        k = int.from_bytes(raw[:4].to_pybytes(), "little")
        body = unsqueeze.decompress(raw[4 + 8 * k :])
        cols[0].append(np.cumsum(_unpacked(body[: 8 * k], "<u8"), dtype=np.uint64))
        cols[1].append(np.frombuffer(raw[4 : 4 + 8 * k], np.int64))
        cols[2].append(_unpacked(body[8 * k : 12 * k], "<i4"))
        cols[3].append(_unpacked(body[12 * k :], "<i4"))
    h, cls, n, pos = (np.concatenate(c) for c in cols)
    del cols
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    met = order[np.r_[same, False] | np.r_[False, same]]  # most shingles are one set's own
    h, cls, n, pos = h[np.r_[same, False] | np.r_[False, same]], cls[met], n[met], pos[met]
    order = np.lexsort((pos, cls, n, h))
    h, cls, n, pos = h[order], cls[order], n[order], pos[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]) | (pos[1:] != pos[:-1])][: len(h)]
    h, cls, n, pos = h[once], cls[once], n[once], pos[once]
    cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]) if len(h) else np.zeros(1, np.int64)
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    short = np.flatnonzero((size > 1) & (size <= small))
    found = []
    for k in range(1, small):
        i = short[short + k < len(h)]
        i = i[h[i] == h[i + k]]
        if not len(i):
            break
        j = i + k
        need = required(n[i].astype(np.int64), n[j])
        ok = (room(n[i], pos[i], n[j], pos[j]) >= need) & (4 * n[i].astype(np.int64) >= 3 * n[j]) & (cls[i] != cls[j])
        i, j = i[ok], j[ok]
        swap = cls[i] > cls[j]
        found.append(np.stack([np.where(swap, cls[j], cls[i]), np.where(swap, cls[i], cls[j]), np.where(swap, n[j], n[i]), np.where(swap, n[i], n[j])], axis=1))
    pairs, times = _counted(np.concatenate(found) if found else np.empty((0, 4), np.int64))
    out = [_rows(None, *pairs.T, times)]
    long_ones = [np.empty((0, 3), np.int64)]
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if e - s > small:
            own = s + np.flatnonzero(_has_room(n[s:e].astype(np.int64), pos[s:e].astype(np.int64)))
            if len(own):
                long_ones.append(np.stack([np.full(len(own), cls[own].min()), cls[own], n[own]], axis=1))
    once, times = _counted(np.concatenate(long_ones))
    return pa.concat_tables([*out, _rows(once[:, 0], None, once[:, 1], None, once[:, 2], times)])


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers, told apart by the first two, and how often each was there."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    cuts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1), True]) if len(rows) else np.zeros(1, np.int64)
    return rows[cuts[:-1]], np.diff(cuts)


def _rows(head, a, b, na, nb, times) -> pa.Table:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    cols = [pa.nulls(len(times), t) if x is None else pa.array(np.asarray(x), pa.int64()).cast(t) for x, t in zip((head, a, b, na, nb, times), types, strict=True)]
    return pa.table(cols, ["head", "a", "b", "na", "nb", "times"])


def _has_room(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which sets of one list, sorted by size, some block of it may hold a partner of.

    At best a set of the block holds the shingle as early and as late as any of the block does.
    """
    k = len(n)
    step = max(BLOCK, k // 512)
    starts = np.arange(0, k, step)
    least, most = n[starts], np.maximum.reduceat(n, starts)
    early, late = np.maximum.reduceat(pos, starts), np.maximum.reduceat(n - pos, starts)
    alone = np.diff(np.r_[starts, k]) == 1
    out = np.zeros(k, bool)
    for b in range(len(starts)):
        ok = (4 * n >= 3 * least[b]) & (3 * n <= 4 * most[b])
        ok &= np.minimum(pos, early[b]) + np.minimum(n - pos, late[b]) >= required(n, least[b])
        if alone[b]:
            ok[starts[b]] = False
        out |= ok
    return out


class Group:
    """Sets of one group: an index of their own shingles, and the components found so far."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, comp: np.ndarray, side: np.ndarray | None = None):
        m = len(offsets) - 1
        self.n = np.diff(offsets)
        self.comp, self.side, self.links = comp.copy(), side, []
        self.closed = np.zeros(m, bool)
        owner = np.repeat(np.arange(m, dtype=np.int32), self.n)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1], True])
        lens = np.diff(cuts)
        # shingles of one set only say nothing about overlaps
        kept = np.repeat(lens > 1, lens)
        self.lens = lens[lens > 1]
        self.starts = np.cumsum(self.lens) - self.lens
        self.holders = owner[order[kept]]
        code = np.full(len(flat), -1, np.int64)
        code[order[kept]] = np.repeat(np.arange(len(self.lens)), self.lens)
        shared = code >= 0
        self.codes = code[shared]
        self.at = np.r_[0, np.cumsum(np.bincount(owner[shared], minlength=m))]

    def own(self, x: int) -> np.ndarray:
        return self.codes[self.at[x] : self.at[x + 1]]

    def counted(self, codes: np.ndarray) -> np.ndarray:
        """How many of these shingles each set holds."""
        return np.bincount(self.holders[ranges(self.starts[codes], self.lens[codes])], minlength=len(self.n))

    def partners(self, x: int) -> np.ndarray:
        """Sets whose link with x is open: sizes that can link, another component, x not yet asked by them."""
        ok = (self.comp != self.comp[x]) & ~self.closed & (4 * self.n >= 3 * self.n[x]) & (3 * self.n <= 4 * self.n[x])
        return ok if self.side is None else ok & (self.side != self.side[x])

    def settle(self, x: int, over: np.ndarray, open_: np.ndarray) -> None:
        for z in np.flatnonzero(open_ & (7 * over >= 3 * (self.n + self.n[x]))).tolist():
            old = self.comp[z]
            if old != self.comp[x]:
                self.links.append((x, z))
                self.comp[self.comp == old] = self.comp[x]
        self.closed[x] = True

    def run(self) -> list[tuple[int, int]]:
        """Links that join the components of all linked sets."""
        mark = np.zeros(len(self.lens) + 1, bool)
        _, where, members = np.unique(self.comp, return_inverse=True, return_counts=True)
        # sets of large components last: they need no answer once all others are closed
        for x in np.lexsort((self.n, members[where])).tolist():
            if self.closed[x]:
                continue
            open_ = self.partners(x)
            if not open_.any():
                continue  # whoever finds a partner later asks itself
            own = self.own(x)
            over = self.counted(own)
            self.settle(x, over, open_)
            mark[own] = True
            apart = np.diff(self.at)[x] + np.diff(self.at) - 2 * over
            for z in np.flatnonzero(~self.closed & (2 * apart < np.diff(self.at))).tolist():
                open_ = self.partners(z)
                if not open_.any():
                    continue
                other = self.own(z)
                more = other[~mark[other]]
                mark[other] = False
                less = own[mark[own]]
                mark[own] = True
                self.settle(z, over + self.counted(more) - self.counted(less), open_)
            mark[own] = False
        return self.links


_SENT, _EDGES = "bucket long, payload binary", "a long, b long"


def _grouped(rows: pa.Table) -> pa.Table:
    """Links inside one group (or between two parts of one) that join components."""
    rows = rows.combine_chunks()
    cls, comp, part = (rows.column(c).to_numpy() for c in ("b", "comp", "part"))
    body = rows.column("body")
    flat, offsets = bodies_of(body.chunk(0) if body.num_chunks else pa.array([], pa.binary()))
    known, comp = np.unique(comp, return_inverse=True)
    side = part if len(part) and part.min() != part.max() else None
    links = Group(flat, offsets, comp, side).run() if len(known) > 1 else []
    a, b = (cls[[x[k] for x in links]] if links else np.empty(0, np.int64) for k in (0, 1))
    return pa.table({"a": a, "b": b})


def _compared(batches):
    """Overlaps of pairs; a set's own row (null b) comes before the rows of its partners."""
    now, own = None, np.empty(0, np.uint64)
    for batch in batches:
        for rows in arrow_blocks([batch], 4, SET_BYTES):
            flat, offsets = bodies_of(rows.column(4))
            over = []
            for a, b, s, e in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b is None:
                    now, own = a, flat[s:e].copy()
                    over.append(None)
                else:
                    assert a == now
                    both = np.concatenate([own, flat[s:e]])
                    both.sort()
                    over.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(over, pa.int32())], ["a", "b", "na", "nb", "over"])


def _checked(df: DataFrame) -> DataFrame:
    """A table read from the shared folder, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _bodies(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, body), once for each of the wanted classes; only their sets travel."""
    places = durable(sets.select("cls", "at").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("at").alias("at")).select("at"), "ngram-places")
    return sets.join(_checked(places), "at").select("cls", "body")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, over) of distinct pairs of classes: the size of their sets' intersection."""
    pairs = durable(pairs.select("a", "b", "na", "nb"), "ngram-pairs")
    bodies = _bodies(sets, pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
    nothing = F.lit(None)
    partners = bodies.withColumnRenamed("cls", "b").join(_checked(pairs), "b").select("a", "b", "na", "nb", "body")
    firsts = bodies.join(_checked(durable(pairs.select(F.col("a").alias("cls")).distinct(), "ngram-firsts")), "cls")
    firsts = firsts.select(F.col("cls").alias("a"), nothing.cast("long").alias("b"), nothing.cast("int").alias("na"), nothing.cast("int").alias("nb"), "body")
    met = firsts.unionByName(partners).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b"))
    return durable(met.mapInArrow(tidy(_compared), "a long, b long, na int, nb int, over int").filter("b is not null"), "ngram-overlap")


#: The condition of a link on a row of ``overlaps``.
_LINKED = "7 * `over` >= 3 * (na + nb)"


def _met(entries: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """Links inside groups of entries (b, comp, part and the group's keys)."""
    entries = durable(entries, "ngram-entries")
    bodies = _bodies(sets, entries.select(F.col("b").alias("cls")).distinct()).withColumnRenamed("cls", "b")
    return durable(bodies.join(_checked(entries), "b").groupBy(*keys).applyInArrow(tidy_group(_grouped), _EDGES), "ngram-links")


def _parts(entries: DataFrame, split: int, *order: str) -> DataFrame:
    """Parts of at most about ``split`` weight of every head's sets, in the given order."""
    before = Window.partitionBy("head").orderBy(*order, "nb", "b").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("part", F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0)) / split).cast("int"))


def group_links(entries: DataFrame, sets: DataFrame, edges: DataFrame, split: int) -> DataFrame:
    """Links (a, b) that join what is linked inside the groups ``entries`` (head, b, nb, weight) to what ``edges`` join."""
    heads = durable(entries.groupBy("head").agg(F.sum("weight").alias("held")), "ngram-sizes")
    large = heads.filter(F.col("held") > split).select("head")
    whole = entries.join(large, "head", "left_anti").select("head", "b", F.lit(0).alias("part"), F.col("b").alias("comp"))
    if large.isEmpty():
        return _met(whole, sets, ["head"])
    # large groups: each part for itself, then only what still differs
    entries = durable(entries.join(large, "head", "left_semi"), "ngram-large")
    first = _parts(entries, split).select("head", "b", "part", F.col("b").alias("comp"))
    links = _met(whole.unionByName(first), sets, ["head", "part"])
    comp = durable(connected_components(edges.unionByName(links)), "ngram-comp").withColumnsRenamed({"node": "b", "component": "comp"})
    entries = entries.join(comp, "b", "left").withColumn("comp", F.coalesce("comp", "b"))
    differ = entries.groupBy("head").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("head")
    entries = durable(_parts(entries.join(differ, "head", "left_semi"), split, "comp"), "ngram-parts")
    parts = durable(entries.groupBy("head", "part").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("nb").alias("n0"), F.max("nb").alias("n1")), "ngram-ranges")
    one, two = parts.alias("one"), parts.alias("two")
    meets = one.join(two, (F.col("one.head") == F.col("two.head")) & (F.col("one.part") <= F.col("two.part")))
    meets = meets.filter("not (one.c0 = one.c1 and two.c0 = two.c1 and one.c0 = two.c0)").filter("4 * one.n1 >= 3 * two.n0 and 4 * two.n1 >= 3 * one.n0")
    meets = durable(meets.select(F.col("one.head").alias("head"), F.col("one.part").alias("lo"), F.col("two.part").alias("hi")), "ngram-meets")
    sent = meets.select("head", "lo", "hi", F.col("lo").alias("part")).unionByName(meets.filter("lo < hi").select("head", "lo", "hi", F.col("hi").alias("part")))
    rest = _met(entries.join(sent, ["head", "part"]).select("head", "lo", "hi", "b", "part", "comp"), sets, ["head", "lo", "hi"])
    return links.unionByName(rest)


def _one_head(entries: DataFrame) -> DataFrame:
    """Entries with the groups of much the same sets under one head.

    A head is a set; where the first group that holds it holds at least half of its own group, too, the
    two become one.  A group of more pairs than needed is as exact.
    """
    first = entries.groupBy("b").agg(F.min("head").alias("to"))
    moves = entries.select("head").distinct().join(first, F.col("head") == F.col("b")).filter("to < head").select("head", "to")
    there = entries.select(F.col("head").alias("to"), "b")
    counts = entries.join(moves, "head").join(there.withColumn("there", F.lit(1)), ["to", "b"], "left").groupBy("head", "to").agg(F.count("*").alias("rows"), F.count("there").alias("both"))
    moves = counts.filter("2 * both >= rows").select("head", "to")
    return entries.join(moves, "head", "left").select(F.coalesce("to", "head").alias("head"), "b", "nb").distinct()


def ngram_components(docs: DataFrame, small: int = SMALL, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    known = durable(rows.mapInArrow(tidy(_features), _FEATURES), "ngram-sets", compression="uncompressed")
    members = known.select("doc_id", "n", "cls")
    sets = known.filter("at is not null").select("at", "cls", "n", "body")
    size = sets.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + size // BUCKET_ENTRIES
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // BUCKETS)

    told = sets.select("body").mapInArrow(tidy(_tallies(buckets)), _SENT).repartition(spread, "bucket")
    often = durable(told.groupBy("bucket").applyInArrow(tidy_group(_frequent(OFTEN)), "h long, n long"), "ngram-frequent")
    last = often.orderBy(F.desc("n"), "h").limit(HEAVY).toPandas()
    hashes, rank = last["h"].to_numpy(np.int64).view(np.uint64), np.argsort(np.lexsort((last["h"], last["n"])))
    order = np.argsort(hashes)
    handle = spark.sparkContext.broadcast((hashes[order], rank[order]))
    sent = sets.select("cls", "body").mapInArrow(tidy(_prefixes(handle, buckets)), _SENT).repartition(spread, "bucket")
    listed = durable(sent.groupBy("bucket").applyInArrow(tidy_group(_lists(small)), _LISTED), "ngram-lists")

    # with no short list in common, sets that link share enough long ones; a partner has three quarters of the size at least
    met = listed.filter("head is not null")
    held = durable(met.groupBy("b").agg(F.sum("times").alias("held"), F.max("nb").alias("n")), "ngram-held")
    fit = held.filter(F.col("held") >= _shared_least(F.ceil(3 * F.col("n") / 4))).select("b")
    entries = durable(_one_head(durable(met.select("head", "b", "nb").join(fit, "b", "left_semi").distinct(), "ngram-groups")), "ngram-heads")
    entries = entries.withColumn("weight", F.greatest(F.lit(1.0), F.col("nb") / UNIT))

    # other pairs: what they share in short lists, and at most share in long ones
    side = _checked(held)
    short = listed.filter("head is null").groupBy("a", "b", "na", "nb").agg(F.sum("times").alias("times"))
    for x in ("a", "b"):
        short = short.join(side.select(F.col("b").alias(x), F.col("held").alias(f"held_{x}")), x, "left")
    most = F.col("times") + F.coalesce(F.when(F.col("held_a") < F.col("held_b"), F.col("held_a")).otherwise(F.col("held_b")), F.lit(0))
    often_met = short.filter(F.when(F.col("held_a").isNull() | F.col("held_b").isNull(), F.col("times")).otherwise(most) >= _shared_least(F.least("na", "nb")))
    edges = overlaps(often_met, sets).filter(_LINKED).select("a", "b")
    if not entries.isEmpty():
        edges = edges.unionByName(group_links(entries, sets, edges, split))
    comp = durable(connected_components(edges), "ngram-comp").withColumnRenamed("node", "cls")
    labelled = members.join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = labelled.filter("cls is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(names, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
