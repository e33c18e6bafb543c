"""Substring deduplication by recompression: rounds name runs and pairs of symbols, the same everywhere, so equal passages get equal symbols inside; a window that repeats shares its highest inner symbol with its copies, and only windows whose symbol repeats are compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Corpus, totals
from .words import Stream, as_bytes, join_keys, mix

#: Words of a window, and rounds of naming.
WINDOW, ROUNDS = 35, 6
_RUN = np.uint64(0xD1B54A32D192ED03)


class Level:
    """Symbols of a round. low and high bound the words that decide each: its own and those that were looked at beside them. Both never fall from symbol to symbol."""

    def __init__(self, symbol, low, high, bar):
        self.symbol, self.low, self.high, self.bar = symbol, low, high, bar

    def named(self, round_: int) -> Level:
        """Name runs of one symbol, then pairs of a left and a right symbol. A symbol's bit of this round says which it is, so pairs never overlap and both neighbours decide alike wherever they stand."""
        symbol, low, high, bar = self.symbol, self.low, self.high, self.bar
        same = (symbol[1:] == symbol[:-1]) & ~bar[1:] & ~bar[:-1]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        last = np.append(first[1:], len(symbol)) - 1
        size = last - first + 1
        # a run ends where its neighbours differ: they were looked at
        symbol, bar = np.where(size > 1, mix(join_keys(symbol[first], size.astype(np.uint64)) ^ _RUN), symbol[first]), bar[first]
        low, high = low[np.maximum(first - 1, 0)], high[np.minimum(last + 1, len(high) - 1)]

        right = (symbol >> np.uint64(40 + round_)) & np.uint64(1) == 1
        opens = np.concatenate((~right[:-1] & right[1:] & ~bar[:-1] & ~bar[1:], [False]))
        closes = np.concatenate(([False], opens[:-1]))
        n, after, before = len(symbol), np.minimum(np.arange(len(symbol)) + 1, len(symbol) - 1), np.maximum(np.arange(len(symbol)) - 1, 0)
        # a left symbol alone was decided by its successor, a right one by its predecessor
        new_low = np.where(opens | ~right, low, low[before])
        new_high = np.where(opens | ~right, high[after], high)
        keep = np.flatnonzero(~closes)
        joined = symbol.copy()
        joined[opens] = join_keys(symbol[opens], symbol[np.flatnonzero(opens) + 1]) if n else joined[opens]
        return Level(joined[keep], new_low[keep], new_high[keep], bar[keep])


def anchors(stream: Stream, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows, for each the number of its anchor, key of each anchor). A window's anchor is the first symbol of the highest round that the window alone decides; equal windows have equal anchors at equal places."""
    docs = np.arange(len(stream.lengths))
    at = np.arange(len(stream.ids)) + np.repeat(docs, stream.lengths) + 1  # a bar before each document and one at the end
    n = len(stream.ids) + len(docs) + 1
    symbol, bar = np.zeros(n, np.uint64), np.ones(n, bool)
    symbol[at], bar[at] = stream.ids, False
    place = np.arange(n)
    levels = [Level(symbol, place, place + 1, bar)]
    for r in range(rounds):
        levels.append(levels[-1].named(r))
    starts = np.flatnonzero(stream.left() >= window)
    begin = at[starts]
    chosen = np.full(len(starts), -1)
    keys, held = [], 0
    for number in range(rounds, -1, -1):
        level, open_ = levels[number], np.flatnonzero(chosen < 0)
        if not len(open_):
            break
        found = np.searchsorted(level.low, begin[open_])
        inside = found < len(level.low)
        found = np.minimum(found, len(level.low) - 1)
        hit = inside & (level.high[found] <= begin[open_] + window) & ~level.bar[found]
        used, own = np.unique(found[hit], return_inverse=True)
        chosen[open_[hit]] = held + own
        keys.append(mix(level.symbol[used] + np.uint64(number)))
        held += len(used)
    return starts, chosen, np.concatenate(keys) if keys else np.empty(0, np.uint64)


def digests(texts: list[bytes], stream: Stream, starts: np.ndarray, window: int) -> np.ndarray:
    """128-bit digests (two columns) of the words of the windows at starts, which rise."""
    out = []
    bounds = np.searchsorted(starts, stream.starts)
    for d in np.flatnonzero(np.diff(bounds)):
        words = texts[d].split()
        data = memoryview(b" ".join(words))
        begin = np.cumsum([0, *(len(w) + 1 for w in words)])
        own = starts[bounds[d] : bounds[d + 1]] - stream.starts[d]
        out += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begin[own].tolist(), (begin[own + window] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


def repeated(docs: DataFrame, *, window: int = WINDOW, rounds: int = ROUNDS, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a space).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of so many consecutive words that covers it also starts anywhere else, same document included; windows are judged on the input. Null, empty and short texts lose nothing. Repeated rows are documents each, so they repeat one another. Null ids stay null, and ids keep their type; other columns are not read; an empty table gives no rows. bits: of the names that choose windows to compare; the result doesn't depend on it.
    """
    corpus = Corpus(docs, id_col, text_col)
    bits = bits or corpus.upper_bits()

    def of_anchors(table: pa.Table):
        return anchors(Stream(as_bytes(table.column("text"))), window, rounds)[2], None

    def windows(texts: list[bytes], stream: Stream, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(starts, digests) of the windows whose anchors repeat."""
        starts, chosen, keys = anchors(stream, window, rounds)
        if len(starts):
            starts = starts[(totals(keys, replies, bits) > 1)[chosen]]
        return starts, digests(texts, stream, starts, window)

    def of_windows(table: pa.Table, replies: pa.Table):
        texts = as_bytes(table.column("text"))
        return windows(texts, Stream(texts), replies)[1], None

    def use(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts = as_bytes(table.column("text"))
        stream = Stream(texts)
        second = replies.filter(pa.compute.equal(replies.column("asked"), 2))
        starts, keys = windows(texts, stream, replies.filter(pa.compute.equal(replies.column("asked"), 1)))
        starts = starts[totals(keys, second) > 1]
        edge = np.zeros(len(stream.ids) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.bincount(stream.doc_of()[gone], minlength=len(stream.lengths))
        kept = []
        for text, a, n, size in zip(texts, stream.starts, removed, stream.lengths, strict=False):
            if n == size:
                kept.append(b"")
            else:
                words = text.split()
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone[a : a + size])] if n else words))
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(stream.lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    first = corpus.ask(of_anchors, bits=bits)
    second = corpus.ask(of_windows, first)
    both = first.withColumn("asked", F.lit(1)).unionByName(second.withColumn("asked", F.lit(2)))
    return corpus.read(both, use, f"doc_id {corpus.id_type}, n_words bigint, n_removed bigint, kept string")

