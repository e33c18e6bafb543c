"""Language identification: multinomial naive Bayes over hashed character n-grams. Counting is distributed; the log-probability matrix is broadcast; documents are scored in sparse batches with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import carried, kept_part, kept_schema

#: Lengths of n-grams.
ORDERS = (1, 2, 3)
#: Buckets that n-grams are hashed to: with the number of languages this bounds the matrix, at any size of the corpus.
BUCKETS = 1 << 15
#: Most characters that are hashed at once.
CHUNK = 1_000_000
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    return _letters


def features(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, number of the text of each, texts with a letter): lower case, each run of other characters as one space."""
    joined = "".join("\x00" + (x.replace("\x00", " ") if "\x00" in x else x) for x in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    first = points == 0
    doc = np.cumsum(first) - 1
    letter = letters()[points]
    some = np.bincount(doc[letter], minlength=len(texts)) > 0
    # a character stays if it is a letter or follows one, and so does the break that each text begins with
    keep = letter | np.concatenate(([False], letter[:-1])) | first
    points, doc, letter = points[keep], doc[keep], letter[keep]
    points = np.where(letter, points, 32).astype(np.uint64)
    out, docs = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, np.uint64)
        for i in range(n):
            key = (key ^ points[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        same = doc[:m] == doc[n - 1 :]
        out.append((key[same] % np.uint64(buckets)).astype(np.int64))
        docs.append(doc[:m][same])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), some
    return np.concatenate(out), np.concatenate(docs), some


def _chunks(texts: list[str]):
    """(first, end) of groups of texts; a single text can be longer than CHUNK."""
    first, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > CHUNK:
            yield first, i
            first, held = i, 0
        held += len(x) + 1
    if first < len(texts):
        yield first, len(texts)


@dataclass
class Model:
    """languages in alphabetical order; weights: log-probabilities, a row for each bucket; prior: of each language."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        said: list[str] = []
        scores: list[float] = []
        for a, b in _chunks(texts):
            bucket, doc, some = features(texts[a:b], self.weights.shape[0])
            n, k = b - a, len(self.languages)
            total = np.empty((n, k))
            for j in range(k):
                total[:, j] = np.bincount(doc, self.weights[bucket, j], n) if len(doc) else 0
            total += self.prior
            best = total.argmax(1) if k else np.zeros(n, np.int64)
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if k else np.zeros(n)
            known = some & (k > 0)
            said += [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
            scores += [float(x) if ok else 0.0 for x, ok in zip(p, known, strict=True)]
        return said, scores


def train(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """Fit on every row with text and label. Each task sends the counts of its own rows, so the shuffle holds at most tasks x languages x buckets counts and the driver gets languages x buckets."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for label in set(labels):
                own = [t for t, x in zip(texts, labels, strict=True) if x == label]
                rows[label] = rows.get(label, 0) + len(own)
                have = sums.setdefault(label, np.zeros(buckets, np.int64))
                for a, b in _chunks(own):
                    have += np.bincount(features(own[a:b], buckets)[0], minlength=buckets)
        for label, have in sums.items():
            at = np.flatnonzero(have)
            at, n = np.append(at, -1), np.append(have[at], rows[label])  # bucket -1: number of rows
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["label", "bucket", "n"])

    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("text is not null and label is not null")
    counts = known.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique())
    weights, prior = np.zeros((buckets, len(languages)), np.float32), np.zeros(len(languages))
    for j, label in enumerate(languages):
        own = counts[counts["label"] == label]
        grams = own[own["bucket"] >= 0]
        n = np.full(buckets, smoothing)
        n[grams["bucket"]] += grams["n"]
        weights[:, j] = np.log(n / n.sum())
        prior[j] = np.log(own[own["bucket"] < 0]["n"].sum())
    return Model(languages, weights, prior - np.logaddexp.reduce(prior) if languages else prior)


def predict(spark: SparkSession, docs: DataFrame, model: Model, *, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns of keep, lang_pred and score, the probability of lang_pred. Only the text decides.

    Null texts and texts without a letter are `und` with score 0, and so are all texts if nothing was learned. Equal probabilities go to the first language of the alphabet. Long texts are scored whole. Columns of keep named lang_pred or score are replaced; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(model)
    kept, place, extra = carried(docs, keep, text_col, ("lang_pred", "score"))

    def score(batches):
        for batch in batches:
            said, scores = shared.value.score([x or "" for x in batch.column(place).to_pylist()])
            columns, names = kept_part(batch, extra)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return kept.mapInArrow(score, kept_schema(kept, extra, "lang_pred:string,score:double"))
