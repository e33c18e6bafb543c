"""Language-model scoring by stupid backoff: counts of all n-grams of the corpus in tables by hash, joined to each document's n-grams, and summed by document.

`score` moves the n-grams of a part of the corpus in sorted, packed blocks, a shard of the tables being one hash range; `by_rows` is the same relation with a row for each n-gram, for inputs that have the disk for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyrine.session import settled

from .blocks import Corpus, totals
from .words import Stream, as_bytes, join_keys, mix

#: Longest n-gram, factor of a step back, and the count from which an n-gram of two words or more is in its table: one that is there once is there in the very document that is scored, and says nothing of it.
ORDER, ALPHA, LEAST = 3, 0.4, 2
_ALL = np.array([0], np.uint64)


def _grams(stream: Stream, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By length: the key of the n-gram that ends at each position, and where there is one."""
    begun = np.arange(len(stream.ids)) - np.repeat(stream.starts[:-1], stream.lengths)
    chain, keys, ok = stream.ids, [mix(stream.ids + np.uint64(1))], [np.ones(len(begun), bool)]
    for n in range(2, order + 1):
        new = np.zeros(len(chain), np.uint64)
        new[1:] = join_keys(chain[:-1], stream.ids[1:])
        chain = new
        keys.append(mix(chain + np.uint64(n)))
        ok.append(begun >= n - 1)
    return keys, ok


class Counts:
    """Counts of a part's n-grams, by length. Single words and pairs are asked for first; a longer n-gram only where both of its parts that are a word shorter are in the tables, as it can't be there without them."""

    def __init__(self, table: pa.Table, order: int, least: int):
        self.stream, self.least = Stream(as_bytes(table.column("text"))), least
        self.keys, self.ok = _grams(self.stream, order)
        self.counts: list[np.ndarray] = []
        self.every = 1

    def wanted(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(keys to ask for next, how often each is there, for each length the places that they are of)."""
        n = len(self.counts)
        if not n:
            where = self.ok[:2]
            keys = np.concatenate([_ALL, *(k[o] for k, o in zip(self.keys, where, strict=False))])
            return keys, np.concatenate(([len(self.stream.ids)], np.ones(len(keys) - 1, np.int64))), where
        there = self.counts[n - 1] >= self.least
        at = self.ok[n] & there
        at[1:] &= there[:-1]
        return self.keys[n][at], np.ones(int(at.sum()), np.int64), [at]

    def learn(self, replies: pa.Table, rounds: list[int]) -> Counts:
        for number in rounds:
            keys, _, where = self.wanted()
            got = totals(keys, replies.filter(pa.compute.equal(replies.column("asked"), number)))
            if not self.counts:
                self.every, got = max(int(got[0]), 1), got[1:]
            for at in where:
                c = np.zeros(len(at), np.int64)
                c[at], got = got[: int(at.sum())], got[int(at.sum()) :]
                self.counts.append(c)
        return self


def score(docs: DataFrame, *, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and log_score (decimal logarithm of the product of all words' scores).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word's score is f(n-gram) / f(its first n - 1 words) for the longest n-gram that ends at it, lies in the document and has a count of at least `least`; each step back costs the factor alpha, and a single word scores f(word) / number of all words. Counts are over all documents, each row counted. Null and empty texts have no words and log_score 0. Null ids stay null, and ids keep their type; repeated rows are scored each; other columns are not read; an empty table gives no rows.
    """
    corpus = Corpus(docs, id_col, text_col)

    def use(table: pa.Table, replies: pa.Table) -> pa.Table:
        found = Counts(table, order, least).learn(replies, rounds)
        counts, ok, stream = found.counts, found.ok, found.stream
        value = np.log10(np.maximum(counts[0], 1) / found.every)
        steps = np.zeros(len(value))
        for n in range(2, order + 1):
            before = np.zeros(len(value), np.int64)
            before[1:] = counts[n - 2][:-1]
            hit = ok[n - 1] & (counts[n - 1] >= least)
            steps = np.where(hit, 0, steps + ok[n - 1])
            value = np.where(hit, np.log10(np.maximum(counts[n - 1], 1) / np.maximum(before, 1)), value)
        value += steps * np.log10(alpha)
        sums = np.bincount(stream.doc_of(), value, len(stream.lengths)) if len(value) else np.zeros(len(stream.lengths))
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(stream.lengths, pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "n_words", "log_score"])

    rounds = [0, *range(3, order + 1)]
    replies = corpus.ask(lambda t: Counts(t, order, least).wanted()[:2]).withColumn("asked", F.lit(0))
    for i, n in enumerate(rounds[1:], 1):
        more = corpus.ask(lambda t, r, n=n, i=i: Counts(t, n, least).learn(r, rounds[:i]).wanted()[:2], replies)
        replies = replies.unionByName(more.withColumn("asked", F.lit(n)))
    return corpus.read(replies, use, f"doc_id {corpus.id_type}, n_words bigint, log_score double")


def by_rows(docs: DataFrame, *, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As score: each n-gram is a row of its document and position, joined to the counts by its 64-bit key."""
    words = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), text_col)).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.least(i, F.lit(order))), lambda n: F.struct(i.alias("pos"), n.alias("n"), F.xxhash64(n, F.slice("w", i - n + 1, n)).alias("key")))))
    said = rows.where(F.size("w") > 0).select("row", F.inline(grams))
    tables = said.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    counted = said.join(tables, "key").groupBy("row", "pos").agg(*(F.max(F.when(F.col("n") == n, F.col("f"))).alias(f"f{n}") for n in range(1, order + 1)))
    every = counted.agg(F.count(F.lit(1))).first()[0]
    before = Window.partitionBy("row").orderBy("pos")
    counted = counted.withColumns({f"b{n}": F.lag(f"f{n}").over(before) for n in range(1, order)})
    value, steps = F.log10(F.col("f1") / F.lit(max(every, 1))), F.lit(0)
    for n in range(2, order + 1):
        there, hit = F.col(f"f{n}").isNotNull(), F.col(f"f{n}") >= least
        value = F.when(there & hit, F.log10(F.col(f"f{n}") / F.col(f"b{n - 1}"))).otherwise(value)
        steps = F.when(there & hit, 0).when(there, steps + 1).otherwise(steps)
    summed = counted.groupBy("row").agg(F.sum(value + steps * float(np.log10(alpha))).alias("log_score"))
    sizes = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"))
    return sizes.join(summed, "row", "left").select("doc_id", "n_words", F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
