"""Chat formatting assembled from token ids.

Role and text of every turn are encoded by themselves; the reserved ids that
open and close a turn are spliced in between, so no text can ever produce one.
Control strings inside texts are also escaped reversibly (a backslash goes in
after ``<|``, one more than stood there), so that the decoded string cannot be
misread either.  A turn's segments carry flags, and the loss mask is the flags
spread over the segments' lengths, by prefix sums of those lengths.

Rows of a conversation travel together, sorted by turn, and stream through one
task; output rows hold at most ``TURNS`` turns, so a conversation of any length
needs bounded memory.  Rows of the output: conv_id, chunk, n_turns, ids, mask.

Defined results: null roles and texts are empty; null conv_ids are one
conversation; rows repeating a turn are turns each, ordered by role and text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.shingles import arrow_blocks
from strataline.llm.tokens import TEXT_BYTES, encoder

#: Turns of one output row.
TURNS = 256
#: The control strings; their ids follow the tokenizer's own.
START, END = "<|im_start|>", "<|im_end|>"

_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")
#: A role is one line of the template; these are its own escapes.
_ROLE_OUT, _ROLE_IN = {"\\": "\\\\", "\n": "\\n"}, {"\\\\": "\\", "\\n": "\n"}

_SCHEMA = "conv_id long, chunk long, n_turns long, ids array<int>, mask binary"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<|\1\\\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", text)


def _role_out(role: str) -> str:
    return escape(re.sub(r"[\\\n]", lambda m: _ROLE_OUT[m[0]], role))


def _role_in(role: str) -> str:
    return re.sub(r"\\[\\n]", lambda m: _ROLE_IN[m[0]], unescape(role))


def _ids(enc, texts: list[str]) -> list[np.ndarray]:
    """Ids of every text, some at a time."""
    out = []
    for block in arrow_blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])], 0, TEXT_BYTES):
        ids, offsets = enc.column(block.column(0))
        out += [ids[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return out


def _encode(path: str, train_roles: frozenset[str]):
    def run(batches):
        enc = encoder(path)
        size = enc.tok.get_vocab_size()
        opens, closes, line = np.array([size], np.uint32), np.array([size + 1], np.uint32), enc.whole("\n")
        now, chunk, ids, lens, flags, turns = None, 0, [], [], [], 0
        out: list[tuple] = []

        def flush():
            ends = np.cumsum(lens)
            mask = np.zeros(ends[-1], np.uint8)
            for i in np.flatnonzero(flags):
                mask[ends[i] - lens[i] : ends[i]] = 1
            out.append((now[0], chunk, turns, np.concatenate(ids).astype(np.int32), mask.tobytes()))

        def batch():
            table = pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([o[0] for o in out], pa.int64()),
                    "chunk": pa.array([o[1] for o in out], pa.int64()),
                    "n_turns": pa.array([o[2] for o in out], pa.int64()),
                    "ids": pa.array([o[3] for o in out], pa.list_(pa.int32())),
                    "mask": pa.array([o[4] for o in out], pa.binary()),
                }
            )
            out.clear()
            return table

        for b in batches:
            convs, roles, texts = (c.to_pylist() for c in b.columns[:3])
            heads = _ids(enc, [_role_out(r) for r in roles])
            bodies = _ids(enc, [escape(t) for t in texts])
            for conv, role, head, body in zip(convs, roles, heads, bodies, strict=True):
                if now != (conv,) or turns >= TURNS:
                    if turns:
                        flush()
                    chunk = 0 if now != (conv,) else chunk + 1
                    now, ids, lens, flags, turns = (conv,), [], [], [], 0
                learn = role in train_roles
                for part, flag in ((opens, 0), (head, 0), (line, 0), (body, learn), (closes, 0), (line, 0)):
                    ids.append(part)
                    lens.append(len(part))
                    flags.append(flag)
                turns += 1
            if len(out) >= 256:
                yield batch()
        if turns:
            flush()
        if out:
            yield batch()

    return run


def _decode(path: str):
    def run(batches):
        tok = encoder(path).tok
        size = tok.get_vocab_size()
        line = tok.encode("\n", add_special_tokens=False).ids
        now, sums, out = None, None, []

        def close():
            out.append((now[0], sums["n"], sums["turns"].hexdigest(), sums["loss_chars"], sums["loss"].hexdigest(), sums["chars"]))

        def batch():
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for i in range(b.num_rows):
                conv = b.column(0)[i].as_py()
                if now != (conv,):
                    if now:
                        close()
                    now, sums = (conv,), {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                ids = b.column(1)[i].values.to_numpy()
                mask = np.frombuffer(b.column(2)[i].as_py(), np.uint8)
                starts, ends = np.flatnonzero(ids == size), np.flatnonzero(ids == size + 1)
                pieces, cuts = [], []
                for s, e in zip(starts, ends, strict=True):
                    at = s + 1
                    while ids[at] != line[0]:
                        at += 1
                    on = np.flatnonzero(mask[s:e])
                    pieces += [ids[s + 1 : at].tolist(), ids[at + 1 : e].tolist(), ids[s:e][on].tolist()]
                    cuts.append(bool(len(on)))
                texts = tok.decode_batch(pieces, skip_special_tokens=False)
                for head, body, loss, learn in zip(texts[::3], texts[1::3], texts[2::3], cuts, strict=True):
                    sums["n"] += 1
                    sums["chars"] += len(START) + len(head) + 1 + len(body) + len(END) + 1
                    sums["turns"].update(f"{_role_in(head)}\n{unescape(body)}\n".encode())
                    if learn:
                        plain = unescape(loss)
                        sums["loss_chars"] += len(plain)
                        sums["loss"].update(plain.encode())
            if len(out) >= 4096:
                yield batch()
        if now:
            close()
        if out:
            yield batch()

    return run


def format_chats(turns: DataFrame, tokenizer: str, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Token ids and loss mask (one byte a token) of every conversation, in rows of at most TURNS turns."""
    rows = turns.select(F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    together = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.select("conv_id", "role", "text").mapInArrow(_encode(tokenizer, frozenset(train_roles)), _SCHEMA)


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each conversation from its ids and mask alone."""
    together = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "ids", "mask")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return together.mapInArrow(_decode(tokenizer), schema)
