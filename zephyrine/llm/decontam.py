"""Benchmark decontamination: the CGK random walk embeds windows of an item's size so that edit distance becomes Hamming distance; repeated bit sampling of the embeddings finds candidates to a target recall; an exact edit distance decides.

Windows that share no short run of words with any item cannot be near enough to one (of k + 1 equal stretches of an item with at most k edits, one is untouched), so only windows at shared runs are embedded.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Stream, as_bytes, fresh, join_keys, mix, run_keys

#: Edits that match, as a share of the item's words.
EDITS = 0.2
#: Positions of a sample; the share of equal positions for which the target recall holds.
SAMPLE, EQUAL, RECALL = 3, 0.5, 0.999
#: Most items that are broadcast at once; more are searched for block by block.
ITEMS = 20_000
#: Words of windows that are embedded at once, and documents that are searched at once.
EMBEDDED, SEARCHED = 1 << 14, 4000

#: ASCII letters and digits in lower case, other ASCII as space, all else as it is.
_PLAIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_END = np.uint64(0xE4D)
#: UTF-8 of characters of scripts without spaces: Thai to Lao, Myanmar, Khmer, kana, hangul letters and ideographs.
_UNIT = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe3[\x81-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xaf][\x80-\xbf]{2}")


def plain(data: bytes) -> bytes:
    """Words apart by spaces: lower case, no ASCII marks, each character of a script without spaces a word."""
    out = data.translate(_PLAIN)
    return out if out.isascii() else _UNIT.sub(rb" \g<0> ", out)


def repetitions(recall: float = RECALL, sample: int = SAMPLE, equal: float = EQUAL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - equal**sample))


def embed(words: np.ndarray, sizes: np.ndarray, repeat: int, steps: int) -> np.ndarray:
    """Symbols (step, repetition, row) of the embedding of each row of words, of which the first `sizes` count: the walk copies the symbol it stands on, and a random bit of repetition, step and symbol says whether it moves on. Past the end it copies a filler."""
    n = len(words)
    padded = np.concatenate((words, np.full((n, 1), _END)), 1)
    padded[np.arange(padded.shape[1]) >= sizes[:, None]] = _END
    seeds = mix(np.arange(1, repeat + 1, dtype=np.uint64) << np.uint64(20))[:, None]
    at, rows, out = np.zeros((repeat, n), np.int64), np.arange(n), np.empty((steps, repeat, n), np.uint64)
    for step in range(steps):
        symbol = out[step] = padded[rows, at]
        coin = mix(symbol ^ (seeds + np.uint64(step))) >> np.uint64(63)
        at = np.minimum(at + coin.astype(np.int64), sizes)
    return out


@lru_cache(1024)
def sampled(size: int, repeat: int, sample: int = SAMPLE) -> np.ndarray:
    """Positions (repetition, sample) of the embedding, 3 x size long, that are compared."""
    return np.stack([np.random.default_rng((r, size)).choice(3 * size, sample, replace=False) for r in range(repeat)])


def buckets(words: np.ndarray, sizes: np.ndarray, repeat: int) -> np.ndarray:
    """Keys (row, repetition) of the sampled symbols of each row and of its size."""
    places = np.stack([sampled(int(m), repeat) for m in sizes], 1)  # repetition, row, sample
    symbols = embed(words, sizes, repeat, int(places.max()) + 1)
    key = (np.arange(repeat, dtype=np.uint64)[:, None] << np.uint64(32)) + sizes.astype(np.uint64)
    for j in range(places.shape[2]):
        key = join_keys(key, symbols[places[:, :, j], np.arange(repeat)[:, None], np.arange(len(words))])
    return key.T


def by_class(sizes: np.ndarray):
    """Rows in groups of one size class each (powers of two), of EMBEDDED words at most but for a single row."""
    kinds = np.ceil(np.log2(sizes)).astype(np.int64) if len(sizes) else sizes
    for kind in np.unique(kinds):
        rows, step = np.flatnonzero(kinds == kind), max(1, EMBEDDED >> int(kind))
        for at in range(0, len(rows), step):
            yield rows[at : at + step]


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(least edit distance of item to any stretch of text, its start, its end); the first of equals, the longest of those."""
    row, start = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    step = np.arange(len(text) + 1)
    for i, word in enumerate(item):
        swap = row[:-1] + (text != word)
        drop = row[1:] + 1
        new = np.concatenate(([i + 1], np.where(swap <= drop, swap, drop)))
        begin = np.concatenate(([0], np.where(swap <= drop, start[:-1], start[1:])))
        # words of text that the item lacks: the least of what stands to the left, one more for each
        level = new - step
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, step, 0))
        row, start = low + step, begin[source]
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


class Items:
    """Items to look for, with the runs that they share and the buckets of their embeddings. Items too short for an edit are looked for as the run that they are."""

    def __init__(self, rows: list[tuple[int, str]], edits: float = EDITS, repeat: int | None = None):
        self.repeat = repetitions() if repeat is None else repeat
        listed = [(i, Stream([plain((t or "").encode())]).ids) for i, t in rows]
        listed = [(i, w) for i, w in listed if len(w)]
        self.ids = [i for i, _ in listed]
        self.words = [w for _, w in listed]
        self.most = [int(edits * len(w) + 1e-9) for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        grams = defaultdict(list)
        for number, (words, k) in enumerate(zip(self.words, self.most, strict=True)):
            size = len(words) // (k + 1)
            grams[size, k > 0] += [(key, number, at) for at, key in enumerate(run_keys(words, size))]
        for (size, edited), found in grams.items():
            key = np.array([x[0] for x in found], np.uint64)
            order = np.argsort(key, kind="stable")
            marks = np.zeros(1 << 20, bool)
            marks[(key >> np.uint64(44)).astype(np.int64)] = True
            self.runs[size, edited] = (marks, key[order], np.array([x[1] for x in found])[order], np.array([x[2] for x in found])[order])
        keys, numbers = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        edited = np.flatnonzero(np.array(self.most, np.int64) > 0)
        for rows_ in by_class(self.sizes[edited]):
            own = edited[rows_]
            stack = np.full((len(own), int(self.sizes[own].max())), _END)
            for row, number in enumerate(own):
                stack[row, : self.sizes[number]] = self.words[number]
            keys.append(buckets(stack, self.sizes[own], self.repeat).ravel())
            numbers.append(np.repeat(own, self.repeat))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        self.keys, self.numbers = every[order], np.concatenate(numbers)[order]

    def places(self, stream: Stream, edited: bool) -> tuple[np.ndarray, np.ndarray]:
        """(start of the item in the stream if a run of it stands at its place, number of the item), for each run that the stream shares."""
        left, found = stream.left(), [np.empty((0, 2), np.int64)]
        for (size, kind), (marks, keys, number, offset) in self.runs.items():
            if kind != edited:
                continue
            here = run_keys(stream.ids, size)
            some = np.flatnonzero(marks[(here >> np.uint64(44)).view(np.int64)])
            some = some[left[some] >= size]
            row, entry = _matches(keys, here[some])
            found.append(np.stack((some[row] - offset[entry], number[entry]), 1))
        every = np.concatenate(found)
        return every[:, 0], every[:, 1]

    def candidates(self, stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, of the item, start) of the windows whose embedding meets the item's in a bucket."""
        starts, items = self.places(stream, True)
        every = np.unique(np.stack((starts, self.sizes[items]), 1), axis=0)
        starts, sizes = every[:, 0], every[:, 1]
        # a window may reach over its document's ends; what is outside is filler
        doc = np.searchsorted(stream.starts, np.clip(starts + sizes // 2, 0, len(stream.ids) - 1), "right") - 1
        found = [np.empty((0, 3), np.int64)]
        for rows in by_class(sizes):
            at = starts[rows, None] + np.arange(int(sizes[rows].max()))
            outside = (at < stream.starts[doc[rows]][:, None]) | (at >= stream.starts[doc[rows] + 1][:, None])
            keys = buckets(np.where(outside, _END, stream.ids[np.clip(at, 0, len(stream.ids) - 1)]), sizes[rows], self.repeat)
            hit, entry = _matches(self.keys, keys.ravel())
            row = rows[hit // self.repeat]
            found.append(np.unique(np.stack((doc[row], self.numbers[entry], starts[row]), 1), axis=0))
        every = np.unique(np.concatenate(found), axis=0)
        return every[:, 0], every[:, 1], every[:, 2]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, item id, first word, number of words, distance) for each text and item that match, the nearest place of each."""
        stream = Stream([plain(t) for t in texts])
        if not len(stream.ids) or not self.words:
            return []
        out = []
        starts, items = self.places(stream, False)
        docs = np.searchsorted(stream.starts, starts, "right") - 1
        by = np.lexsort((starts, items, docs))
        for row in by[np.diff(docs[by] * np.int64(len(self.ids)) + items[by], prepend=-1) != 0]:
            out.append((int(docs[row]), self.ids[items[row]], int(starts[row] - stream.starts[docs[row]]), int(self.sizes[items[row]]), 0))
        docs, items, starts = self.candidates(stream)
        change = np.flatnonzero((np.diff(docs, prepend=-1) != 0) | (np.diff(items, prepend=-1) != 0))
        for rows in np.split(np.arange(len(docs)), change[1:]) if len(docs) else []:
            doc, item = int(docs[rows[0]]), int(items[rows[0]])
            k, words = self.most[item], self.words[item]
            best = None
            for a, b in _regions(starts[rows].tolist(), len(words), k):
                low, high = max(a, int(stream.starts[doc])), min(b, int(stream.starts[doc + 1]))
                distance, first, last = best_match(words, stream.ids[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, low + first - int(stream.starts[doc]), last - first)
            if best:
                out.append((doc, self.ids[item], best[1], best[2], best[0]))
        return out


def _matches(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of asked, entry of keys, which rise) of all pairs that are equal."""
    first = np.searchsorted(keys, asked)
    n = np.searchsorted(keys, asked, "right") - first
    entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(np.arange(len(asked)), n), entry


def _regions(starts: list[int], size: int, k: int):
    """Stretches in which the windows at starts can hold a match; those that overlap are one."""
    low, high = starts[0] - k, starts[0] + size + k
    for s in starts[1:]:
        if s - k > high:
            yield low, high
            low = s - k
        high = s + size + k
    yield low, high


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, block: int = ITEMS) -> DataFrame:
    """A row for each document and item of which the document holds a copy with at most `edits` x its words edited: doc_id, item_id, start and n_words (where, in words) and distance, for the nearest place, the first of equals, the longest of those.

    Words are runs of letters and digits, ASCII in lower case; white space, case and ASCII marks do not count; of scripts without spaces each character is a word. Items too short for an edit (under five words) match exactly. Null texts hold nothing; null items and those without words are not looked for. Items with null ids count, with null. Repeated rows give a row each; repeated items give one each; empty tables give none. Ids of documents keep their type; other columns are not read. Documents are read whole, once for each block of items; nothing is shuffled.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("doc_id").schema.simpleString()[7:-1] + ",item_id:bigint,start:bigint,n_words:bigint,distance:bigint"
    names = ["doc_id", "item_id", "start", "n_words", "distance"]
    number = max(1, math.ceil(wanted.count() / block))
    out = None
    for n in range(number):
        own = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == n)
        shared = spark.sparkContext.broadcast(Items(sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), edits))

        def search(batches, shared=shared):
            for batch in batches:
                ids, texts = batch.column(0), as_bytes(batch.column(1))
                found = [(at + d, *rest) for at in range(0, len(texts), SEARCHED) for d, *rest in shared.value.search(texts[at : at + SEARCHED])]
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(x, pa.int64()) for x in columns[1:])], names)

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold an item; all columns stay, whatever their names. Rows with equal ids are told apart by a 128-bit hash of their texts."""
    key = fresh("key", docs.columns)
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col).cast("string"))).alias("text")))
    bad = contaminated(keyed, items, id_col=key, text_col=text_col, **options).select(F.col("doc_id").alias("bad")).distinct()
    return keyed.join(bad, keyed[key].eqNullSafe(bad["bad"]), "left_anti").drop(key)
