"""Words, their 64-bit ids, and keys of runs of words, in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Bytes of text that are cut into words at once, but for a single text; and the longest word whose id comes from the table.
CHUNK, SHORT = 2 << 20, 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_cache: dict = {}


def worker_cache(key, build):
    """What a worker remembers between tasks under key. Only one cache is kept: another operator's takes its place, so that the operators of a pipeline don't add up in a worker's memory."""
    if key not in _cache:
        if _cache:
            _cache.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # give the freed pages back, where the C library can
                ctypes.CDLL(None).malloc_trim(0)
        _cache[key] = build()
    return _cache[key]


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores, that is none of taken (in any case)."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += "_"
    return name


def carried(docs: DataFrame, keep: list, text_col: str, new: tuple[str, ...]) -> tuple[DataFrame, int, int | None]:
    """(the columns of keep, but for those named like a new one, and the text; where the text is; the same if it only comes to be read, or None): a text that is kept anyway goes to Python once."""
    kept = docs.select(*keep)
    old = [n for n in kept.columns if n.lower() in new]
    if text_col in [k for k in keep if isinstance(k, str)] and text_col.lower() not in new:
        frame = kept.withColumn(text_col, kept[text_col].cast("string")).drop(*old)
        return frame, frame.columns.index(text_col), None
    frame = docs.select(*keep, docs[text_col].cast("string").alias(fresh("text", [*kept.columns, *new]))).drop(*old)
    return frame, len(frame.columns) - 1, len(frame.columns) - 1


def kept_schema(frame: DataFrame, extra: int | None, new: str) -> str:
    """The columns that stay, and the new ones."""
    own = (frame if extra is None else frame.drop(frame.columns[extra])).schema.simpleString()[7:-1]
    return ",".join(filter(None, (own, new)))


def kept_part(batch: pa.RecordBatch, extra: int | None) -> tuple[list[pa.Array], list[str]]:
    """Columns and names of a batch without a text that only came to be read."""
    at = [i for i in range(batch.num_columns) if i != extra]
    return [batch.column(i) for i in at], [batch.schema.names[i] for i in at]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def join_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a pair from the keys of its halves; order matters."""
    return mix(left * _ODD + mix(right + _ODD))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWER = np.cumprod(np.full(SHORT, _ODD, np.uint64), dtype=np.uint64)


def _ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where each word of data begins, its id). data ends with white space."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    if sizes.max() > SHORT:
        place = np.minimum(place, SHORT - 1)
    ids = mix(np.add.reduceat(_VALUE[raw[inside]] * _POWER[place], first) + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > SHORT):
        ids[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return starts, ids


class Stream:
    """Word ids of many documents end to end. A word is `[^\\x20\\x09-\\x0D]+`; its id is a hash of its bytes. starts has one more entry than there are documents. prepare changes bytes one by one."""

    def __init__(self, texts: list[bytes], prepare=None):
        counts, ids, at = [], [], 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) < CHUNK):
                held += len(texts[end]) + 1
                end += 1
            group = texts[at:end]
            data = b"\n".join([*group, b""])
            starts, own = _ids(prepare(data) if prepare else data)
            bounds = np.cumsum([len(x) + 1 for x in group])
            counts.append(np.diff(np.searchsorted(starts, bounds), prepend=0))
            ids.append(own)
            at = end
        self.lengths = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.uint64)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def left(self) -> np.ndarray:
        """Words from each position to its document's end, itself included."""
        return np.repeat(self.starts[1:], self.lengths) - np.arange(len(self.ids))


def run_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """Key of the n words that start at each position; the last n - 1 positions have none. Built by doubling."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    have, power, out, done = ids, 1, None, 0
    while True:
        if n & power:
            if out is None:
                out = have
            else:
                m = len(ids) - done - power + 1
                out = join_keys(out[:m], have[done : done + m])
            done += power
        if done == n:
            return mix(out + np.uint64(n))
        have, power = join_keys(have[:-power], have[power:]), power * 2
