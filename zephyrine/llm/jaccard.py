"""Exact Jaccard join of word shingles, by set relations: index lists are skipped in blocks by position, and a set's answers are derived from those of a highly similar set.

Shingles are ranked by how many documents hold them. Two sets that are similar enough share a shingle of both prefixes, so the sets that any chain of shared prefix shingles joins are a family, and no link leaves a family. Within a family sets are drawn around pivots that are highly similar to them; every set is kept as what it lacks of its pivot and what it adds. The overlap of two sets is then the pivot's own answer, corrected by the short lists of their differences.

Equal sets are one, by a 126-bit digest. Shingles have 64-bit names, of which documents are compared; how often one is held is an upper bound, which decides nothing but an order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrine.session import cut

from .blocks import Corpus, pack, totals, unpack
from .components import components
from .words import Stream, as_bytes, run_keys

#: Words of a shingle, and the least percentage of the union that two sets share.
SHINGLE, PERCENT = 5, 80
#: Sets of a family that one task compares with as many others; shingles of small families that share a task; and the parts into which the sets of a shingle are dealt.
BLOCK, SHARED, SALTS = 1024, 3 << 20, 32


class Sets:
    """Distinct shingles of documents, by shingle and then by document. Documents with fewer words than a shingle have all their words as one."""

    def __init__(self, texts: list[bytes], size: int = SHINGLE):
        stream = Stream(texts, bytes.lower)
        left, doc = stream.left(), stream.doc_of()
        keys, docs = [run_keys(stream.ids, size)[left[: max(len(left) - size + 1, 0)] >= size]], [doc[left >= size]]
        for n in range(1, size):
            short = np.flatnonzero(stream.lengths == n)
            if len(short):
                keys.append(run_keys(stream.ids, n)[stream.starts[short]])
                docs.append(short)
        token, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))) if len(token) else np.empty(0, bool)
        self.token, self.doc = token[new], doc[new]
        self.n = np.bincount(self.doc, minlength=len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.n)))
        # rows of a document stand in rising order of their shingles once ordered by document
        order = np.argsort(self.doc, kind="stable")
        self.token, self.doc = self.token[order], self.doc[order]

    def digests(self) -> pa.Array:
        """126 bits of each set as a decimal, null for the empty one."""
        raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(self.token[a:b].tobytes()) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)), np.uint64).reshape(-1, 2).copy()
        raw[:, 1] &= np.uint64((1 << 62) - 1)
        valid = pa.array(self.n > 0).buffers()[1]
        return pa.Array.from_buffers(pa.decimal128(38, 0), len(self.n), [valid, pa.py_buffer(raw.tobytes())])


def prefixes(table: pa.Table, replies: pa.Table, size: int, percent: int, bits: int) -> pa.Table:
    """Rows of sets: prefix has the shingles of the document's prefix that some other document may hold too; tokens has all of its shingles where prefix is not empty."""
    sets = Sets(as_bytes(table.column("text")), size)
    held = totals(sets.token, replies, bits) if len(table) else np.empty(0, np.int64)
    order = np.lexsort((sets.token, held, sets.doc))
    token, held = sets.token[order], held[order]
    length = sets.n - (percent * sets.n + 99) // 100 + 1
    inside = (np.arange(len(token)) - sets.starts[sets.doc] < length[sets.doc]) & (held > 1)
    signed, ends = token.view(np.int64)[inside], np.concatenate(([0], np.cumsum(inside)))[sets.starts]
    prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed, pa.int64()))
    some = np.diff(ends) > 0
    tokens = [pack(sets.token[a:b]) if ok else None for ok, a, b in zip(some, sets.starts[:-1], sets.starts[1:], strict=True)]
    return pa.Table.from_arrays([table.column("doc_id"), sets.digests(), pa.array(sets.n, pa.int64()), prefix, pa.array(tokens, pa.binary())], ["doc_id", "sig", "n_shingles", "prefix", "tokens"])


class Index:
    """Lists of set numbers by token, each in rising order, end to end."""

    def __init__(self, token: np.ndarray, number: np.ndarray, count: int):
        self.values, dense = np.unique(token, return_inverse=True)
        self.count = count
        self.entries = np.sort(dense * np.int64(count) + number)

    def overlaps(self, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of tokens each set of [low, high) holds. Whatever lies before low or after high in a list is skipped by position."""
        at = np.searchsorted(self.values, tokens)
        some = at < len(self.values)
        at, tokens = at[some], tokens[some]
        at = at[self.values[at] == tokens]
        first = np.searchsorted(self.entries, at * np.int64(self.count) + low)
        size = np.searchsorted(self.entries, at * np.int64(self.count) + high) - first
        total = int(size.sum())
        if not total:
            return np.zeros(high - low, np.int64)
        where = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
        return np.bincount(self.entries[where] % self.count - low, minlength=high - low)


def linked(sets: list[np.ndarray], percent: int = PERCENT, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among sets (rising tokens) that join all that are similar, directly or through others: one for each two groups that meet. side: only sets of different sides are compared.

    Each set belongs to the first pivot that it is near to (2 x percent - 100); a pivot's circle has all sets up to 3 x percent - 200, and so, as 1 - similarity is a metric, all that are similar to one that belongs to it.
    """
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) and (side is None or side[0] != side[1]) else []
    sizes = np.fromiter(map(len, sets), np.int64, n)
    order = np.argsort(sizes, kind="stable")
    ranked, by_size = [sets[i] for i in order], sizes[order]
    sides = None if side is None else side[order]
    near = max(2 * percent - 100, percent // 2)
    far = max(near + percent - 100, 0)
    index = _index(ranked)
    root, owned, found = np.arange(n), np.zeros(n, bool), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for pivot in range(n):
        if owned[pivot]:
            continue
        size = by_size[pivot]
        low, high = int(np.searchsorted(by_size, -(-far * size // 100))), int(np.searchsorted(by_size, 100 * size // far, "right")) if far else n
        both = index.overlaps(ranked[pivot], low, high)
        every = by_size[low:high] + size - both
        circle = np.flatnonzero(100 * both >= far * every) + low
        own = ~owned[circle] & (100 * both >= near * every)[circle - low]
        owned[circle[own]] = True
        for x, y in _around(ranked[pivot], [ranked[i] for i in circle], by_size[circle], both[circle - low], np.flatnonzero(own), percent) if len(circle) > 1 else ():
            x, y = int(circle[x]), int(circle[y])
            if sides is not None and sides[x] == sides[y]:
                continue
            a, b = top(x), top(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(order[x]), int(order[y])))
    return found


def _index(parts: list[np.ndarray]) -> Index:
    return Index(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts]), len(parts))


def _around(pivot: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, shared: np.ndarray, own: np.ndarray, percent: int):
    """Similar pairs (by number) of sets of rising sizes, of which one is of own, the pivot's sets. shared: how many tokens each has in common with the pivot."""

    def similar(y: int, both: np.ndarray, low: int, high: int):
        for x in np.flatnonzero(100 * both >= percent * (sizes[low:high] + sizes[y] - both)) + low:
            if x != y:
                yield int(x), int(y)

    if len(own) == 1:  # the pivot alone, whose answers are there
        yield from similar(int(own[0]), shared, 0, len(sets))
        return
    number = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, tokens), len(pivot) - 1)
    held = pivot[at] == tokens
    has = np.zeros((len(sets), len(pivot)), bool)
    has[number[held], at[held]] = True
    set_of, place = np.nonzero(~has)
    added, adder = tokens[~held], number[~held]
    without, with_ = Index(place, set_of, len(sets)), Index(added, adder, len(sets))
    ends = np.searchsorted(adder, np.arange(len(sets) + 1))
    lacking = len(pivot) - shared
    for y in own:
        low, high = int(np.searchsorted(sizes, -(-percent * sizes[y] // 100))), int(np.searchsorted(sizes, 100 * sizes[y] // percent, "right"))
        # the pivot's answer, less what either lacks, and back what both lack; then what both add
        both = len(pivot) - lacking[low:high] - lacking[y] + without.overlaps(np.flatnonzero(~has[y]), low, high) + with_.overlaps(added[ends[y] : ends[y + 1]], low, high)
        yield from similar(int(y), both, low, high)


def _compare(percent: int):
    def run(key, table):
        family, unit = table.column("family").combine_chunks(), table.column("unit").to_numpy()
        sig, tokens = table.column("sig").combine_chunks(), table.column("tokens").to_pylist()
        _, kind = np.unique(family.to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if len(table) else (None, np.empty(0, np.int64))
        a, b = [], []
        order = np.argsort(kind, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            side = unit[rows] if key[1].as_py() != key[2].as_py() else None
            for x, y in linked([unpack(tokens[i]) for i in rows], percent, side) if len(rows) > 1 else ():
                a.append(rows[x])
                b.append(rows[y])
        return pa.Table.from_arrays([sig.take(pa.array(x, pa.int64())) for x in (a, b)], ["a", "b"])

    return run


def families(sets: DataFrame, salts: int = SALTS) -> DataFrame:
    """(id, root) of the sets that shared prefix shingles join. Each set is tied to the least set of its part of a shingle, and that to the shingle's least, so a frequent shingle gives as many rows as it has sets, not pairs, and no task has them all."""
    entries = sets.select(F.explode("prefix").alias("token"), "sig").withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(salts)).cast("int")).distinct()
    near = entries.groupBy("token", "salt").agg(F.min("sig").alias("hub"))
    middle = near.groupBy("token").agg(F.min("hub").alias("top"))
    first = entries.join(near, ["token", "salt"]).select(F.col("sig").alias("a"), F.col("hub").alias("b"))
    second = near.join(middle, "token").select(F.col("hub").alias("a"), F.col("top").alias("b"))
    return components(first.unionByName(second).where("a <> b"))


def links(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): links between set digests that join all similar sets of each family. A family beyond one block is cut into bands of sizes, of which only neighbours can hold similar sets, and these into blocks; each pair of blocks is a task of its own. Small families share tasks, as many as their shingles need."""
    of = families(sets)
    unique = sets.where("size(prefix) > 0").groupBy("sig").agg(F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n"))
    band = F.floor(F.log("n") / (math.log(100 / min(percent, 99)) * (1 + 1e-9))).cast("int")
    rows = unique.join(of.select(F.col("id").alias("sig"), F.col("root").alias("family")), "sig").withColumn("band", band)
    rows = cut(rows, "rows")
    counted = rows.groupBy("family", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    grown = cut(counted.groupBy("family").agg(F.sum("c").alias("size"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("c") / block).cast("int").alias("blocks")))).alias("bands")), "families")
    tasks = max(1, math.ceil((grown.where(F.col("size") <= block).agg(F.sum("n")).first()[0] or 0) / SHARED))
    rows = rows.join(grown.drop("n"), "family")

    def unit(of_band: Column, number: Column) -> Column:
        return of_band.cast("long") * (1 << 32) + number

    def units(shift: int) -> Column:
        of_band = F.col("band") + shift
        number = F.coalesce(F.col("bands")[of_band], F.lit(0))
        return F.when(number > 0, F.transform(F.sequence(F.lit(1), F.greatest(number, F.lit(1))), lambda x: unit(of_band, x - 1))).otherwise(F.array().cast("array<bigint>"))

    own = unit(F.col("band"), F.pmod(F.xxhash64("sig"), F.col("bands")[F.col("band")]))
    beside = F.concat(units(0), units(1), units(-1))
    alone = F.array(F.struct(F.pmod(F.xxhash64("family"), F.lit(tasks)).alias("task"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
    pairs = F.transform(beside, lambda x: F.struct(F.xxhash64("family").alias("task"), F.least(x, F.col("unit")).alias("i"), F.greatest(x, F.col("unit")).alias("j")))
    rows = rows.withColumn("unit", own)
    dealt = rows.withColumn("to", F.explode(F.when(F.col("size") <= block, alone).otherwise(pairs))).select("to.*", "family", "unit", "sig", "tokens")
    return dealt.groupBy("task", "i", "j").applyInArrow(_compare(percent), "a decimal(38,0), b decimal(38,0)")


def similar(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, bits: int | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach, itself included) and set_id, the same for equal sets.

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`. Documents with equal sets link; so do those whose sets share at least `percent` of the union. Null and empty texts have no set, and null for set_id, and link with nothing. Repeated rows are documents each. Null ids are no component's id; a component of null ids only has null. Ids keep their type; other columns are not read; an empty table gives no rows. bits: of the names by which shingles are counted; the result doesn't depend on it. A shingle or a set that very many documents share is dealt to many tasks, or its narrow join is left to Spark's adaptive handling of skew. Actions run while the result is being built.
    """
    corpus = Corpus(docs, id_col, text_col)
    bits = bits or corpus.upper_bits()
    asked = corpus.ask(lambda t: (Sets(as_bytes(t.column("text")), size).token, None), bits=bits)
    schema = f"doc_id {corpus.id_type}, sig decimal(38,0), n_shingles bigint, prefix array<bigint>, tokens binary"
    sets = cut(corpus.read(asked, lambda t, r: prefixes(t, r, size, percent, bits), schema), "sets")
    classes = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    joined = components(links(sets, percent, block))
    classes = cut(classes.join(joined.withColumnRenamed("id", "sig"), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = cut(classes.join(least, "root").select("sig", "component_id"), "classes")
    own = sets.where("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("sig").alias("set_id"))
    return sets.where("sig is not null").join(ids, "sig").select("doc_id", "n_shingles", "component_id", F.col("sig").alias("set_id")).unionByName(own)
