"""Quality classification: interpolated modified Kneser-Ney models of character n-grams in words, trained on all trusted text: texts are dealt to folds, and those of a fold are judged by the model of the others, so that no document is judged by a model that has counted it. Counts are sharded by n-gram and joined to their contexts by hash; documents get a perplexity, and an adapted one whose context crosses words: word pairs that the document has had already, with the characters' model behind them. Quantiles of each language's trusted documents bound the first from above and the second from below."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrine.session import cut

from .words import as_bytes, carried, fresh, join_keys, kept_part, kept_schema, mix, worker_cache

#: Longest n-gram, and the marks at a word's ends.
ORDER, OPEN, CLOSE = 5, "\x02", "\x03"
#: Folds of the texts; each has a model of the trusted texts of the others.
FOLDS = 2
#: Trusted documents of each language, in expectation, where a caller asks `sampled` for a smaller model.
TRAIN = 600
#: Shares of trusted documents that a language's threshold may keep, loosest first; what the threshold allows beyond; and the share of labelled rejects that a stricter one must catch more for each share of trusted documents that it loses.
QUANTILES, SLACK, PRICE = (0.999, 0.998, 0.995, 0.99), 1.15, 10
#: What a document's own word pairs have of the adapted probability.
OWN = 0.5
#: Buckets of a unit of log perplexity, in which values are counted before quantiles are looked up.
FINE = 2000
#: N-grams of a model that is broadcast (24 bytes each); a larger one is joined.
MODEL_ROWS = 2_000_000
#: Ids of training documents that are broadcast.
BROADCAST_IDS = 1_000_000
#: Words whose scores a worker remembers.
REMEMBERED = 400_000
_MARK = np.uint64(0x9E3779B97F4A7C15)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, part): part `held` for all trusted documents (quality 1, not toxic), `reject` for documents of quality 0."""
    return _known(docs, labels).select("doc_id", "lang", F.when(F.col("good"), "held").otherwise("reject").alias("part"))


def _known(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = F.max(F.coalesce(F.expr("quality = 1 and coalesce(toxic, 0) = 0"), F.lit(False))).alias("good")
    judged = labels.groupBy("doc_id").agg(good, F.max(F.coalesce(F.expr("quality = 0"), F.lit(False))).alias("bad")).where("good or bad")
    return docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang")).join(judged, "doc_id").distinct()


def sampled(docs: DataFrame, labels: DataFrame, *, train: int = TRAIN, held: int | None = None) -> DataFrame:
    """(doc_id, lang, part): part `train` for about `train` trusted documents (quality 1, not toxic) of each language by hash of their id, `held` for the other trusted ones (about `held` of them, or all), `reject` for documents of quality 0. A document's hash decides, so the parts are the same on every run."""
    known = _known(docs, labels).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) / float(1 << 20))
    sizes = known.groupBy("lang").agg(F.sum(F.col("good").cast("long")).alias("n"))
    # of a small language half is for training
    share = F.least(F.lit(0.5), F.try_divide(F.lit(train), F.col("n")))
    rest = F.lit(1.0) if held is None else share + F.least(F.lit(0.5), F.try_divide(F.lit(held), F.col("n")))
    part = F.when(~F.col("good"), "reject").when(F.col("u") < share, "train").when(F.col("u") < rest, "held")
    return known.join(sizes, "lang").withColumn("part", part).where("part is not null").select("doc_id", "lang", "part")


def gram_tables(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(n, gram, weight, back) from (word, n): weight is the discounted share of the n-gram after its context, back what its own continuations leave to the next shorter context (null where it has none).

    The longest n-grams, and those that begin a word, have their counts; the others have the number of different characters before them.
    """
    spelt = words.where("word <> ''").select(F.concat(F.lit(OPEN), "word", F.lit(CLOSE)).alias("s"), F.col("n").alias("c"))
    ends = spelt.select("s", "c", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("i"))
    raw = ends.select(F.substr("s", F.greatest(F.col("i") - order + 1, F.lit(1)), F.least(F.col("i"), F.lit(order))).alias("gram"), "c").groupBy("gram").agg(F.sum("c").alias("a"))
    raw = cut(raw.withColumn("n", F.length("gram")), "grams")
    every, longer = raw.where(F.col("n") == order), raw.where(F.col("n") == order)
    for n in range(order - 1, 0, -1):
        shorter = longer.groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(F.count(F.lit(1)).alias("a")).withColumn("n", F.lit(n))
        begins = raw.where(F.col("n") == n)
        # an n-gram that begins a word has nothing before it; any other may stand behind one that does
        longer = cut(shorter.unionByName(begins), "grams")
        every = every.unionByName(longer)
    every = cut(every, "grams")
    c = every.groupBy("n").agg(*(F.sum((F.col("a") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(float(k)), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5))))

    discounts = c.select("n", discount(1).alias("d1"), discount(2).alias("d2"), discount(3).alias("d3"))
    cutting = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    counted = every.join(F.broadcast(discounts), "n").withColumn("d", cutting).withColumn("context", F.substr("gram", F.lit(1), F.col("n") - 1))
    contexts = counted.groupBy("n", "context").agg(F.sum("a").alias("s"), F.sum("d").alias("left"))
    shares = counted.join(contexts, ["n", "context"]).select("n", "gram", ((F.col("a") - F.col("d")) / F.col("s")).alias("weight"))
    backs = contexts.select((F.col("n") - 1).alias("n"), F.col("context").alias("gram"), (F.col("left") / F.col("s")).alias("back"))
    return shares.join(backs, ["n", "gram"], "full")


def keys_of(points: np.ndarray, begins: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length the key of the n-gram that ends at each point, and where it lies within its word."""
    keys, inside = [], []
    place = np.arange(len(points)) - begins
    for n in range(1, order + 1):
        key = np.zeros(len(points), np.uint64)
        for i in range(n):
            key[n - 1 :] = (key[n - 1 :] ^ points[i : len(points) - n + 1 + i]) * _MARK
            key[n - 1 :] ^= key[n - 1 :] >> np.uint64(31)
        keys.append(mix(key + np.uint64(n)))
        inside.append(place >= n - 1)
    return keys, inside


@dataclass
class Model:
    """keys rise; weight and back belong to them; floor is the probability of a character that no table has; empty is what the shortest n-grams leave to it."""

    keys: np.ndarray
    weight: np.ndarray
    back: np.ndarray
    floor: float
    empty: float
    order: int = ORDER

    @staticmethod
    def of(tables: DataFrame, order: int = ORDER) -> Model:
        def keyed(batches):
            for batch in batches:
                lengths = batch.column(0).to_numpy(zero_copy_only=False)
                spelt = [np.frombuffer(g.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) for g in batch.column(1).to_pylist()]
                key = np.zeros(len(lengths), np.uint64)
                for n in range(1, order + 1):
                    own = np.flatnonzero(lengths == n)
                    if len(own):
                        points = np.concatenate([spelt[i] for i in own])
                        key[own] = keys_of(points, np.repeat(np.arange(len(own)) * n, n), n)[0][n - 1][n - 1 :: n]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key.view(np.int64)), batch.column(2), batch.column(3)], ["n", "key", "weight", "back"])

        # bounded, see perplexities; the n-grams themselves stay with the workers
        rows = tables.select(F.col("n").cast("int"), "gram", "weight", "back").mapInArrow(keyed, "n int, key bigint, weight double, back double").toArrow()
        n, key, weight, back = (rows.column(c).to_numpy() for c in ("n", "key", "weight", "back"))
        if not len(n):  # nothing to learn from: a key that no n-gram has
            return Model(np.zeros(1, np.uint64), np.zeros(1), np.ones(1), 1.0, 1.0, order)
        empty = back[n == 0]
        characters = int(((n == 1) & ~np.isnan(weight)).sum()) + 1
        own = np.flatnonzero(n > 0)
        own = own[np.argsort(key[own].view(np.uint64))]
        return Model(key[own].view(np.uint64), np.nan_to_num(weight[own]), np.nan_to_num(back[own], nan=1.0), 1 / characters, float(empty[0]) if len(empty) else 1.0, order)

    def log_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(natural logarithm of each word's probability, its end counted; number of characters with the end)."""
        text = "".join([f"{OPEN}{w.decode()}{CLOSE}" for w in words])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.fromiter((len(w.decode()) + 2 for w in words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        keys, inside = keys_of(points, np.repeat(starts, sizes), self.order)
        p = np.full(len(points), self.floor)
        back = np.full(len(points), self.empty)
        for key, ok in zip(keys, inside, strict=True):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = ok & (self.keys[at] == key)
            p = np.where(ok, np.where(hit, self.weight[at], 0) + back * p, p)
            # what this n-gram leaves is for the longer one that ends a character later
            back = np.concatenate(([1.0], np.where(hit, self.back[at], 1.0)[:-1]))
        scores = np.log(np.maximum(p, 1e-300))
        scores[starts] = 0
        return np.add.reduceat(scores, starts) if len(words) else scores, sizes - 1


class _Scores(dict):
    """Words to numbers; values and sizes by number."""

    def __init__(self, model: Model):
        self.model, self.new = model, []
        self.values, self.sizes = np.empty(0), np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the logarithm of its probability, the adapted one, and its size."""
        if len(self) > REMEMBERED:
            self.clear()
            self.values, self.sizes = np.empty(0), np.empty(0, np.int64)
        numbers = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in map(bytes.split, texts)]
        if self.new:
            for at in range(0, len(self.new), 50_000):
                value, size = self.model.log_scores(self.new[at : at + 50_000])
                self.values, self.sizes = np.concatenate((self.values, value)), np.concatenate((self.sizes, size))
            self.new = []
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
        word = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        value = self.values[word]
        sums = lambda x: np.bincount(doc, x, len(texts))
        return sums(value), sums(adapted(doc, word, value)), sums(self.sizes[word])


def earlier(keys: np.ndarray) -> np.ndarray:
    """How often each key stands before."""
    order = np.argsort(keys, kind="stable")
    first = np.diff(keys[order], prepend=keys[order[:1]] ^ np.uint64(1)) != 0
    place = np.arange(len(keys))
    out = np.empty(len(keys), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return out


def adapted(doc: np.ndarray, word: np.ndarray, value: np.ndarray, own: float = OWN) -> np.ndarray:
    """value, the log probability of each word, mixed with the word's share of what has followed the word before it so far in its document."""
    out = value + math.log(1 - own)
    if len(word) > 1:
        here = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        context = join_keys(doc[here].astype(np.uint64), word[here - 1].astype(np.uint64))
        pair = earlier(join_keys(context, word[here].astype(np.uint64)))
        again = pair > 0
        out[here[again]] = np.logaddexp(out[here[again]], np.log(own * pair[again] / earlier(context)[again]))
    return out


def fold_of(text: Column) -> Column:
    """The fold of a text: equal texts share one."""
    return F.pmod(F.xxhash64(text.cast("string")), F.lit(FOLDS))


def _words(docs: DataFrame, ids: DataFrame, *by: Column) -> DataFrame:
    ids = ids.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").where("text is not null")
    words = texts.select(*by, F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return words.groupBy(*words.columns).agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, sample: DataFrame, *, order: int = ORDER) -> DataFrame:
    """The n-gram tables of the sample's training documents, written."""
    return cut(gram_tables(_words(docs, sample.where("part = 'train'")), order), "tables")


def train_folds(docs: DataFrame, parts: DataFrame, *, order: int = ORDER) -> list[DataFrame]:
    """For each fold the n-gram tables of all trusted documents (part `held`) whose text is of another, written."""
    words = cut(_words(docs, parts.where("part = 'held'"), fold_of(F.col("text")).alias("fold")), "words")
    others = (words.where(F.col("fold") != k).groupBy("word").agg(F.sum("n").alias("n")) for k in range(FOLDS))
    return [cut(gram_tables(w, order), "tables") for w in others]


def perplexities(docs: DataFrame, tables: DataFrame, *, keep: list[str], text_col: str = "text", order: int = ORDER, model_rows: int = MODEL_ROWS) -> DataFrame:
    """The columns of keep, n_symbols (characters of words, and their ends), perplexity of a character and the adapted perplexity; null without words. Texts are scored whole. Tables of at most model_rows n-grams are broadcast as a model; beyond that documents' words are joined to the tables."""
    if tables.count() <= model_rows:
        return by_model(docs, Model.of(tables, order), keep=keep, text_col=text_col)
    return by_joins(docs, tables, keep=keep, text_col=text_col, order=order)


def word_scores(words: DataFrame, tables: DataFrame, order: int = ORDER) -> DataFrame:
    """(word, value, size) of different words (word): the logarithm of the word's probability, its end counted, from joins of its n-grams and their contexts to the tables."""
    spelt = words.select("word", F.concat(F.lit(OPEN), "word", F.lit(CLOSE)).alias("s"))
    ends = spelt.select("word", "s", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("i"))
    grams = ends.select("word", "i", "s", F.explode(F.sequence(F.lit(1), F.least(F.col("i"), F.lit(order)))).alias("n"))
    grams = grams.select("word", "i", "n", F.substr("s", F.col("i") - F.col("n") + 1, F.col("n")).alias("gram"), F.substr("s", F.col("i") - F.col("n") + 1, F.col("n") - 1).alias("context"))
    weights = tables.where("weight is not null").select("n", "gram", "weight")
    backs = tables.where("back is not null").select((F.col("n") + 1).alias("n"), F.col("gram").alias("context"), "back")
    found = grams.join(weights, ["n", "gram"], "left").join(backs, ["n", "context"], "left")
    steps = F.sort_array(F.collect_list(F.struct("n", F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("back", F.lit(1.0)).alias("b"))))
    floor = tables.agg(1 / (F.count_if((F.col("n") == 1) & F.col("weight").isNotNull()) + 1)).first()[0]
    p = F.aggregate(steps, F.lit(floor), lambda acc, x: x["w"] + x["b"] * acc)
    each = found.groupBy("word", "i").agg(F.log(F.greatest(p, F.lit(1e-300))).alias("v"))
    return each.groupBy("word").agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("size"))


def by_joins(docs: DataFrame, tables: DataFrame, *, keep: list[str], text_col: str = "text", order: int = ORDER, own: float = OWN) -> DataFrame:
    """As perplexities, for a model of any size: equal texts are scored once, by a 256-bit digest."""
    new = ("n_symbols", "perplexity", "adapted")
    key = fresh("digest", [*docs.columns, *new])
    rows = docs.withColumn(key, F.sha2(docs[text_col].cast("string"), 256))
    texts = rows.groupBy(F.col(key).alias("t")).agg(F.first(F.col(text_col).cast("string")).alias("text"))
    listed = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    words = cut(texts.where("text is not null").select("t", F.posexplode(listed).alias("pos", "word")), "words")
    scores = cut(word_scores(words.select("word").distinct(), tables, order), "words")
    said = words.join(scores, "word").withColumn("before", F.lag("word").over(Window.partitionBy("t").orderBy("pos")))
    context = F.row_number().over(Window.partitionBy("t", "before").orderBy("pos")) - 1
    pair = F.row_number().over(Window.partitionBy("t", "before", "word").orderBy("pos")) - 1
    again = F.when(F.col("before").isNotNull() & (pair > 0), own * pair / context).otherwise(0.0)
    summed = said.select("t", "value", "size", F.log((1 - own) * F.exp("value") + again).alias("a"), F.col("value").alias("v"), again.alias("again"))
    # a word too unlikely for a double has its share of the character model as a logarithm
    adapted = F.when(F.col("again") > 0, F.col("a")).otherwise(F.col("v") + math.log(1 - own))
    by_text = summed.groupBy("t").agg(F.sum("value").alias("value"), F.sum(adapted).alias("own"), F.sum("size").alias("size"))
    wide = rows.join(by_text, rows[key] == by_text["t"], "left")
    return wide.select(*(c for c in keep if c not in new), F.coalesce("size", F.lit(0)).alias("n_symbols"), F.exp(-F.col("value") / F.col("size")).alias("perplexity"), F.exp(-F.col("own") / F.col("size")).alias("adapted"))


def by_model(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """As perplexities, by a model that every worker has."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, place, extra = carried(docs, keep, text_col, ("n_symbols", "perplexity", "adapted"))
    schema = kept_schema(kept, extra, "n_symbols:bigint,perplexity:double,adapted:double")

    def score(batches):
        model = shared.value
        words = worker_cache(("kneser_ney", id(model)), lambda: _Scores(model))  # which holds the model, so that its id stays its own
        for batch in batches:
            texts = as_bytes(batch.column(place))
            parts = [words.score(texts[at : at + 200]) for at in range(0, len(texts), 200)]
            value, own, size = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(3))
            each = [pa.array(np.exp(-x / np.maximum(size, 1)), pa.float64(), mask=size == 0) for x in (value, own)]
            columns, names = kept_part(batch, extra)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size.astype(np.int64)), *each], [*names, "n_symbols", "perplexity", "adapted"])

    return kept.mapInArrow(score, schema)


def exact_quantiles(values: DataFrame, shares: tuple[float, ...]) -> dict[tuple[str, str], list[float]]:
    """By (of, side) the quantiles of x over all rows, interpolated as percentile does: counts by narrow buckets say which of them hold the ranks, and only the values of those are fetched."""
    spark = values.sparkSession
    placed = values.withColumn("b", F.floor(F.col("x") * FINE).cast("long"))
    counts = defaultdict(list)
    for r in placed.groupBy("of", "side", "b").count().collect():
        counts[r[0], r[1]].append((r[2], r[3]))
    places, wanted = {}, set()
    for key, found in counts.items():
        found.sort()
        ends = np.cumsum([n for _, n in found])
        places[key] = [(q * (int(ends[-1]) - 1)) for q in shares]
        for rank in {r for x in places[key] for r in (math.floor(x), math.ceil(x))}:
            at = int(np.searchsorted(ends, rank, "right"))
            wanted.add((*key, found[at][0], int(ends[at]) - found[at][1]))
    if not wanted:
        return {}
    asked = spark.createDataFrame(sorted(wanted), "of string, side string, b long, low long").dropDuplicates(["of", "side", "b"])
    held = defaultdict(list)
    for r in placed.join(F.broadcast(asked), ["of", "side", "b"]).groupBy("of", "side", "low", "x").count().collect():
        held[r[0], r[1]].append((r[2], r[3], r[4]))
    out = {}
    for key, found in held.items():
        found.sort()
        last, at, ends = None, 0, []  # rank after each value
        for low, _, n in found:
            at = (low if low != last else at) + n
            last = low
            ends.append(at)
        value = lambda rank, ends=ends, found=found: found[int(np.searchsorted(ends, rank, "right"))][1]
        out[key] = [value(math.floor(x)) + (x - math.floor(x)) * (value(math.ceil(x)) - value(math.floor(x))) for x in places[key]]
    return out


def bounds(judged: DataFrame, *, quantiles: tuple[float, ...] = QUANTILES, slack: float = SLACK) -> dict[str, tuple[float, float]]:
    """By language the most perplexity and the least adapted perplexity, of judged: of, part (`held` or `reject`), perplexity, adapted.

    Each is the quantile of all held rows, widened by slack, that does best: labelled rejects caught, less PRICE times trusted documents lost, as shares of their language; of equals the loosest.
    """
    sides = F.explode(F.array(F.struct(F.lit("most").alias("side"), F.log("perplexity").alias("x")), F.struct(F.lit("least").alias("side"), (-F.log("adapted")).alias("x")))).alias("s")
    values = cut(judged.select("of", "part", sides).select("of", "part", "s.*"), "judged")
    found = exact_quantiles(values.where("part = 'held'"), quantiles)
    if not found:
        return {}
    limits = {key: [x + math.log(slack) for x in xs] for key, xs in found.items()}
    listed = values.sparkSession.createDataFrame([(*key, xs) for key, xs in sorted(limits.items())], "of string, side string, xs array<double>")
    over = [F.avg((F.col("x") > F.col("xs")[i]).cast("double")) for i in range(len(quantiles))]
    shares = {(r[0], r[1], r[2]): r[3] for r in values.join(F.broadcast(listed), ["of", "side"]).groupBy("of", "side", "part").agg(F.array(*over)).collect()}
    none = [0.0] * len(quantiles)
    chosen = {}
    for (of, side), xs in limits.items():
        gain = [c - PRICE * lost for c, lost in zip(shares.get((of, side, "reject"), none), shares[of, side, "held"], strict=True)]
        chosen[of, side] = xs[gain.index(max(gain))]
    return {of: (math.exp(chosen[of, "most"]), math.exp(-chosen[of, "least"])) for of, side in chosen if side == "most"}


def classify(docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, quantile: float | None = None, slack: float = SLACK, train_docs: int | None = None, held_docs: int | None = None, model_rows: int = MODEL_ROWS) -> DataFrame:
    """docs' columns (or those of keep), n_symbols, perplexity, adapted, threshold, least and keep: false where perplexity is above the language's threshold, or adapted below its least.

    All trusted documents are counted, and all set thresholds: a document is judged by the model of the trusted texts of the other folds. With train_docs given, there is one model, of a sample of about so many of each language, and thresholds come from all trusted documents outside it (or about held_docs of a language). Thresholds also weigh labelled rejects, see bounds; with a quantile given, they are that one. Where nothing is trusted that a model could learn from, there is no perplexity. Languages without trusted documents, null among them, take the loosest thresholds of the others, and without any trusted document nothing is rejected. Documents without words are kept: they have no perplexity. labels: doc_id, quality, toxic; repeated and null labels are fine. Columns of docs named like the new ones are replaced; an empty table of documents gives no rows. Actions run while the result is being built.
    """
    if train_docs is None:
        sample = cut(labelled(docs, labels), "sample")
        tables = train_folds(docs, sample)
    else:
        sample = cut(sampled(docs, labels, train=train_docs, held=held_docs), "sample")
        tables = [train(docs, sample)]
    rows = docs.drop("n_symbols", "perplexity", "adapted", "threshold", "least", "keep")
    kept = keep or rows.columns
    sizes = [t.count() for t in tables]
    models = [Model.of(t) if n <= model_rows else t for t, n in zip(tables, sizes, strict=True)]

    def scores(columns: list[str]) -> DataFrame:
        found = []
        for k, (model, n) in enumerate(zip(models, sizes, strict=True)):
            own = rows if len(models) == 1 else rows.where(fold_of(F.col("text")) == k)
            one = by_model(own, model, keep=columns) if isinstance(model, Model) else by_joins(own, model, keep=columns)
            found.append(one if n else one.withColumns({c: F.lit(None).cast("double") for c in ("perplexity", "adapted")}))
        return reduce(DataFrame.unionByName, found)

    # texts are not written: where they are kept, they are scored again
    narrow = cut(scores(["doc_id", "lang"] if "text" in kept else list(dict.fromkeys([*kept, "doc_id", "lang"]))), "scores")
    scored = narrow.where("perplexity is not null").select("doc_id", F.coalesce("lang", F.lit("und")).alias("of"), "perplexity", "adapted")
    judged = scored.join(sample.where("part <> 'train'").withColumnRenamed("lang", "of"), ["doc_id", "of"])
    limits = bounds(judged, quantiles=QUANTILES if quantile is None else (quantile,), slack=slack)
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    most, least = F.lit(max((x for x, _ in limits.values()), default=math.inf)), F.lit(min((x for _, x in limits.values()), default=0.0))
    for name, (high, low) in limits.items():
        most, least = F.when(lang == name, F.lit(high)).otherwise(most), F.when(lang == name, F.lit(low)).otherwise(least)
    out = scores(kept) if "text" in kept else narrow
    out = out.withColumn("threshold", most).withColumn("least", least)
    good = (F.col("perplexity") <= F.col("threshold")) & (F.col("adapted") >= F.col("least"))
    return out.withColumn("keep", F.coalesce(good, F.lit(True))).select(*kept, "n_symbols", "perplexity", "adapted", "threshold", "least", "keep")
