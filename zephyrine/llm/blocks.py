"""Counts over the whole corpus for keys of each part of it, exchanged as packed blocks.

Documents are dealt to parts by their position in the table, so equal rows spread like any others. A part sends each of its keys once, sorted, cut into shards by value and packed as differences; a shard adds up what all parts sent and answers each part in the part's own order. A key that a third of all rows hold costs one entry for each part, so no key is hot, and a part's rows meet no other part's rows. Whoever asks computes the same keys again to read the answers.

A key is one 64-bit name, or of two (128 bits) where equal keys must be equal things. With fewer bits an answer is an upper bound: different keys may share it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrine.session import settled

#: Bytes of text of a part and of a shard: they grow with the root of the input, so that a packed block keeps its size, up to what a task can hold.
LEAST, MOST, BLOCK = 10 << 20, 48 << 20, 24 << 10
SENT = "part bigint, shard int, keys binary, more binary, counts binary"
REPLY = "part bigint, shard int, totals binary"

Keys = Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]]


class Corpus:
    """docs in parts: frame has part, doc_id and text. Null texts stay null; ids keep their type. The number of actions is one: the size of all texts."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.id_type = docs.schema[id_col].dataType.simpleString()
        # the cast lets fields of an id be null, as they come back from Python
        rows = settled(docs.select(F.col(id_col).cast(self.id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
        self.bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.parts = self.shards = max(1, math.ceil(self.bytes / min(max(LEAST, math.isqrt(self.bytes * BLOCK)), MOST)))
        self.frame = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(self.parts)).alias("part"), "doc_id", "text")

    def upper_bits(self) -> int:
        """Bits of a key for upper bounds: so many beyond the size of the corpus that of 16 million keys less than one meets another by chance."""
        return min(64, int(self.bytes).bit_length() + 24)

    def ask(self, keys_of, earlier: DataFrame | None = None, bits: int = 64) -> DataFrame:
        """Replies to the keys of each part. keys_of(table) gives (keys, counts or None) for a part's rows; with earlier replies, keys_of(table, replies). Keys are an array of 64-bit names, of which the highest `bits` count, or two columns of them."""
        shards, names = self.shards, [x.split()[0] for x in SENT.split(", ")]

        def send(part: int, keys: np.ndarray, counts: np.ndarray | None) -> pa.Table:
            if keys.ndim == 2:
                (keys, more), counts = unique_pairs(keys, counts)
            else:
                (keys, counts), more = unique(keys, counts, bits), None
            at = np.searchsorted(shard_of(keys, shards, bits), np.arange(shards + 1))
            some = np.flatnonzero(at[1:] > at[:-1])
            rows = [[part] * len(some), some.tolist(), [pack(keys[at[i] : at[i + 1]]) for i in some], [None if more is None else more[at[i] : at[i + 1]].tobytes() for i in some], [planes(counts[at[i] : at[i + 1]]) for i in some]]
            return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

        if earlier is None:
            sent = self.frame.groupBy("part").applyInArrow(lambda key, t: send(key[0].as_py(), *keys_of(t)), SENT)
        else:
            sent = self.frame.groupBy("part").cogroup(earlier.groupBy("part")).applyInArrow(lambda key, t, replies: send(key[0].as_py(), *keys_of(t, replies)), SENT)
        return sent.groupBy("shard").applyInArrow(answer, REPLY)

    def read(self, replies: DataFrame, use, schema: str) -> DataFrame:
        """use(table, replies) for each part, as rows of schema."""
        return self.frame.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(lambda key, t, r: use(t, r), schema)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate(([True], new)))


def unique(keys: np.ndarray, counts: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys = keys >> np.uint64(64 - bits)
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def unique_pairs(keys: np.ndarray, counts: np.ndarray | None) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    high, low = keys[order, 0], keys[order, 1]
    first = _firsts(high, low)
    counts = np.ones(len(keys), np.int64) if counts is None else counts[order]
    return (high[first], low[first]), np.add.reduceat(counts, first) if len(first) else counts


def totals(keys: np.ndarray, replies: pa.Table, bits: int = 64) -> np.ndarray:
    """For each key its total, from the replies to a part that sent these keys, in any order and number."""
    if keys.ndim == 2:
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        first = _firsts(keys[order, 0], keys[order, 1])
        inverse = np.empty(len(keys), np.int64)
        inverse[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        number = len(first)
    else:
        found, inverse = np.unique(keys >> np.uint64(64 - bits), return_inverse=True)
        number = len(found)
    order = np.argsort(replies.column("shard").to_numpy())
    packed = replies.column("totals").to_pylist()
    parts = [unplanes(packed[i]) for i in order]
    got = np.concatenate(parts) if parts else np.empty(0, np.int64)
    if len(got) != number:
        raise ValueError(f"{len(got)} totals for {number} keys")
    return got[inverse]


def shard_of(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    high = keys >> np.uint64(max(bits - 32, 0))
    return (high * np.uint64(shards)) >> np.uint64(min(bits, 32))


def answer(table: pa.Table) -> pa.Table:
    """Totals of a shard's keys, for each part in the order in which it sent them."""
    parts, shards = table.column("part"), table.column("shard")
    blocks = [unpack(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unplanes(x) for x in table.column("counts").to_pylist()])
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    keys, more = np.concatenate(blocks), b"".join(x or b"" for x in table.column("more").to_pylist())
    columns = [keys, np.frombuffer(more, np.uint64)] if more else [keys]
    order = np.lexsort(columns[::-1]) if more else np.argsort(keys, kind="stable")
    first = _firsts(*(c[order] for c in columns))
    sums = np.add.reduceat(counts[order], first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    ends = np.cumsum(sizes)
    return pa.Table.from_arrays([parts, shards, pa.array([planes(x) for x in np.split(out, ends[:-1])], pa.binary())], ["part", "shard", "totals"])


def planes(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, lowest first; planes beyond the largest value are left out; the highest, and those in which one value stands out, are compressed."""
    n = len(values)
    most = int(values.max()) if n else 0
    width = max(1, (most.bit_length() + 7) // 8)
    table = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T)
    out = [n.to_bytes(4, "little"), bytes([width])]
    for i, row in enumerate(table):
        raw = row.tobytes()
        few = np.bincount(row[:4096], minlength=256).max(initial=0) > 0.3 * min(n, 4096)
        data = zlib.compress(raw, 1) if few or i == width - 1 else raw
        small = len(data) < n
        out += [bytes([small]), (len(data) if small else n).to_bytes(4, "little"), data if small else raw]
    return b"".join(out)


def unplanes(data: bytes) -> np.ndarray:
    n, width, at = int.from_bytes(data[:4], "little"), data[4], 5
    table = np.zeros((n, 8), np.uint8)
    for i in range(width):
        small, size = data[at], int.from_bytes(data[at + 1 : at + 5], "little")
        raw = data[at + 5 : at + 5 + size]
        table[:, i] = np.frombuffer(zlib.decompress(raw) if small else raw, np.uint8)
        at += 5 + size
    return table.reshape(-1).view("<i8")


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data).view(np.uint64), dtype=np.uint64)
