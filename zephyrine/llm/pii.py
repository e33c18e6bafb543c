"""Personal data: exact patterns, and a semi-Markov conditional random field that scores whole candidate spans and chooses boundaries and types jointly by dynamic programming over entities of bounded length."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import carried, kept_part, kept_schema

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]++){3})")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches that do not overlap, found from each @: the part before it is the longest run of its characters since the last match or @."""
    low, at = 0, text.find("@")
    while at >= 0:
        local = text[low:at]
        start = at - (len(local) - len(local.rstrip(_LOCAL)))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start, then by kind as listed. A match that fails its check is dropped and its text is not tried again."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(_part(x) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]]))


def _part(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) <= 3 and (not x or int(x) <= 255)


# --- the model

#: Labels of segments; the first is a single token that is no entity.
LABELS = ("none", *KINDS)
#: Most tokens of an entity, of context at each side of a region, and buckets of features.
LONGEST, AROUND, BUCKETS = 6, 2, 1 << 12
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9@][^\x20\x09-\x0D]*+")
#: Forms of addresses without @: (at) and [at], names with dots, and `x at y dot z`.
_SPELT = re.compile(r"[(\[]\x20?(?i:at)\x20?[)\]]|\.(?<=[A-Za-z]\.)(?=[A-Za-z])|[\x20\x09-\x0D](?i:at)[\x20\x09-\x0D]++[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++(?i:dot)[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)+")
_AT = re.compile(r"(?i)[(\[]at[)\]]|(?<= )at(?= )")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_EDGES = ".,;:!?\"'<>[]{}|"


@dataclass
class Region:
    """Neighbouring tokens of which some hold a digit or @, or spell an address."""

    spans: list[tuple[int, int]]
    words: list[str]


def _marks(text: str) -> list[tuple[int, int]]:
    """Where tokens hold a digit or @ or spell an address, by start; none overlap."""
    found = []
    for form in (_TRIGGER, _SPELT):
        last = 0
        for m in form.finditer(text):
            a, b = m.span()
            if b <= last:
                continue
            while text[a] in _SPACES:
                a += 1
            while a > last and text[a - 1] not in _SPACES:
                a -= 1
            while b < len(text) and text[b] not in _SPACES:
                b += 1
            found.append((a, b))
            last = b
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _tokens_before(text: str, at: int, number: int) -> list[tuple[int, int]]:
    """The last tokens that end before a place."""
    found: list[tuple[int, int]] = []
    while len(found) < number:
        while at and text[at - 1] in _SPACES:
            at -= 1
        end = at
        while at and text[at - 1] not in _SPACES:
            at -= 1
        if at == end:
            break
        found.append((at, end))
    return found[::-1]


def _spans(matches) -> list[tuple[int, int]]:
    return [m.span() for m in matches]


def regions(text: str) -> list[Region]:
    """Runs of tokens with a digit or @ or a spelt address, of which neighbours are at most LONGEST - 1 places apart, so that one entity can hold them, with AROUND tokens at each side. Every token from which an entity could begin is in one."""
    marks = _marks(text)
    out, i = [], 0
    while i < len(marks):
        j = i
        while j + 1 < len(marks) and len(_spans(islice(_TOKEN.finditer(text, marks[j][1], marks[j + 1][0]), LONGEST - 1))) < LONGEST - 1:
            j += 1
        tokens = _spans(_TOKEN.finditer(text, marks[i][0], marks[j][1]))
        spans = _tokens_before(text, marks[i][0], AROUND) + tokens + _spans(islice(_TOKEN.finditer(text, marks[j][1]), AROUND))
        out.append(Region(spans, [text[a:b] for a, b in spans]))
        i = j + 1
    return out


def _shape(text: str) -> str:
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "d", text))
    return re.sub(r"[^\x00-\x7f]+", "u", shape)[:40]


def _form(text: str) -> str:
    """What is left of a text's shape if runs of letters and digits, also with dots or ` dot ` between, are one."""
    return re.sub(r"w(?:\.w)+", "W", re.sub(r"[A-Za-z0-9]+", "w", _AT.sub("@", re.sub(r"(?i) dot (?=[a-z0-9])", ".", text))))[:40]


def _hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def segment_features(words: list[str], i: int, n: int) -> list[int]:
    """Features of the whole segment words[i:i + n]: its shape, digits, checks and neighbours."""
    text = " ".join(words[i : i + n]).strip(_EDGES)
    digits = _DIGITS.sub("", text)
    groups = re.findall("[0-9]+", text)
    before = words[i - 1].lower().strip(_EDGES) if i else "^"
    last = words[i + n - 1] if n else ""
    return [
        _hashed(x)
        for x in (
            f"n{n}",
            f"shape {_shape(text)}",
            f"digits {min(len(digits), 20)}",
            f"groups {min(len(groups), 6)} {n}",
            f"sizes {' '.join(str(len(g)) for g in groups[:6])}",
            f"luhn {12 <= len(digits) <= 19 and luhn(digits)}",
            f"octets {len(groups) == 4 and all(_part(g) for g in groups)}",
            f"at {text.count('@')} dots {min(text.count('.'), 5)}",
            f"plus {text.startswith('+')} paren {'(' in text}",
            f"letters {bool(re.search('[A-Za-z]', text))} {n}",
            f"ends {last[-1:] in _EDGES}",
            f"before {_shape(before)}",
            f"form {_form(text)}",
            f"spelt {bool(_AT.search(text))} {_form(text).count(' ')}",
        )
    ]


@dataclass
class SemiCrf:
    """weights: labels x buckets; moves: label after label."""

    weights: np.ndarray
    moves: np.ndarray

    def score(self, words: list[str], i: int, n: int) -> np.ndarray:
        """Scores of the labels of words[i:i + n] as a segment; only single tokens can be no entity."""
        s = self.weights[:, segment_features(words, i, n)].sum(1)
        if n > 1:
            s[0] = -np.inf
        return s

    def decode(self, words: list[str]) -> list[tuple[int, int, int]]:
        """The best segmentation as (start, length, label), of any number of words."""
        n, k = len(words), len(LABELS)
        best = np.full((n + 1, k), -np.inf)
        size_of, label_of = np.zeros((n + 1, k), np.int8), np.full((n + 1, k), -1, np.int8)
        reach = np.zeros((n + 1, k))  # best of what ends at a place, by the label that follows, and the label before
        before = np.full((n + 1, k), -1, np.int8)
        for end in range(1, n + 1):
            for size in range(1, min(LONGEST, end) + 1):
                value = reach[end - size] + self.score(words, end - size, size)
                better = value > best[end]
                best[end][better], size_of[end][better], label_of[end][better] = value[better], size, before[end - size][better]
            to = best[end][:, None] + self.moves
            reach[end], before[end] = to.max(0), to.argmax(0)
        out, end, y = [], n, int(best[n].argmax()) if n else 0
        while end:
            size, y_before = int(size_of[end, y]), int(label_of[end, y])
            out.append((end - size, size, y))
            end, y = end - size, y_before
        return out[::-1]

    def expected(self, words: list[str], features: dict[tuple[int, int], list[int]]) -> tuple[float, dict[tuple[int, int], np.ndarray], np.ndarray]:
        """(logarithm of the sum over all segmentations, probability of each label of each segment, expected number of each move), by sums ahead and behind."""
        n, k = len(words), len(LABELS)
        scores = {}
        for (i, s), found in features.items():
            scores[i, s] = self.weights[:, found].sum(1)
            if s > 1:
                scores[i, s][0] = -np.inf
        ahead, behind, arrive = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        arrive[0], behind[n] = 0, 0  # arrive: sums over what ends at a place, by the label that follows
        for end in range(1, n + 1):
            ahead[end] = np.logaddexp.reduce([arrive[end - s] + scores[end - s, s] for s in range(1, min(LONGEST, end) + 1)])
            arrive[end] = np.logaddexp.reduce(ahead[end][:, None] + self.moves, axis=0)
        total = np.logaddexp.reduce(ahead[n])
        moves = np.zeros_like(self.moves)
        for at in range(n - 1, 0, -1):
            leave = np.logaddexp.reduce([scores[at, s] + behind[at + s] for s in range(1, min(LONGEST, n - at) + 1)])
            behind[at] = np.logaddexp.reduce(self.moves + leave[None, :], axis=1)
            moves += np.exp(ahead[at][:, None] + self.moves + leave[None, :] - total)
        return float(total), {(i, s): np.exp(arrive[i] + score + behind[i + s] - total) for (i, s), score in scores.items()}, moves

    def gradient(self, words: list[str], gold: list[tuple[int, int, int]], rate: float, decay: float, features: dict[tuple[int, int], list[int]] | None = None) -> None:
        """One step along the log-likelihood of gold: what it has, less what is expected."""
        features = features or all_features(words)
        _, labels, moves = self.expected(words, features)
        self.moves -= rate * moves
        self.weights *= 1 - rate * decay
        for at, p in labels.items():
            if p.max() > 1e-4:
                np.add.at(self.weights, (slice(None), features[at]), -rate * p[:, None])
        for x, (i, s, y) in enumerate(gold):
            np.add.at(self.weights[y], features[i, s], rate)
            if x:
                self.moves[gold[x - 1][2], y] += rate


def all_features(words: list[str]) -> dict[tuple[int, int], list[int]]:
    return {(i, n): segment_features(words, i, n) for i in range(len(words)) for n in range(1, min(LONGEST, len(words) - i) + 1)}


def silver(region: Region, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """The segmentation that the patterns give: tokens that a span touches are its segment if there are at most LONGEST."""
    out, i = [], 0
    while i < len(region.words):
        a, b = region.spans[i]
        hit = next((s for s in spans if s[1] < b and s[2] > a), None)
        n = 1
        if hit:
            while i + n < len(region.words) and region.spans[i + n][0] < hit[2]:
                n += 1
        out.append((i, n, LABELS.index(hit[0])) if hit and n <= LONGEST else (i, 1, 0))
        i += n if hit and n <= LONGEST else 1
    return out


def varied(region: Region, gold: list[tuple[int, int, int]]) -> list[tuple[Region, list[tuple[int, int, int]]]]:
    """Forms that the patterns miss and the model is to learn: phone numbers without their prefix, e-mail addresses spelt with (at), [at], or at and dot, also without digits and shorter; and what is none: an address's domain alone or behind its name and a dot, a phone number's digits as one plain number, an address of the net that lacks a part."""
    out = []

    def put(x: int, words: list[str], y: int) -> None:
        """The region with other words for segment x: one segment of label y, or single tokens of none."""
        i, n, _ = gold[x]
        own = [(i, len(words), y)] if y else [(i + k, 1, 0) for k in range(len(words))]
        more = len(words) - n
        spans = region.spans[:i] + [region.spans[i]] * len(words) + region.spans[i + n :]
        out.append((Region(spans, region.words[:i] + words + region.words[i + n :]), [*gold[:x], *own, *((a + more, b, c) for a, b, c in gold[x + 1 :])]))

    for x, (i, n, y) in enumerate(gold):
        words = region.words[i : i + n]
        if LABELS[y] == "phone" and n > 1 and re.fullmatch(r"\+[0-9]{1,3}", words[0]):
            put(x, words[1:], y)
            put(x, [_DIGITS.sub("", "".join(words[1:]))], 0)
        elif LABELS[y] == "email" and n == 1:
            name, _, domain = words[0].rstrip(_EDGES).partition("@")
            letters = re.sub("[^A-Za-z.]", "", name).strip(".") or "x"
            short = ".".join(re.sub("[^A-Za-z.]", "", domain).split(".")[-2:])
            for who, where in ((name, domain), (letters, short), (letters.split(".")[0], short)):
                for form in ([f"{who}(at){where}"], [f"{who}[at]{where}"], [who, "at", *where.replace(".", " dot ").split()]):
                    if len(form) <= LONGEST:
                        put(x, form, y)
                for form in (where, f"{who}.{where}"):
                    put(x, [form], 0)
        elif LABELS[y] == "ip" and n == 1:
            put(x, [".".join(words[0].split(".")[:3])], 0)
            put(x, [".".join(words[0].split(".")[:2])], 0)
    return out


def train(docs: DataFrame, *, text_col: str = "text", most_regions: int = 300, most_words: int = 40, most_chars: int = 800, epochs: int = 5) -> SemiCrf:
    """Fit on at most most_regions different regions, of at most most_words words and most_chars characters, the first by hash among those of all documents with a match of a pattern's opening, and on the forms that varied makes of them. Labels come from the patterns. Regions are found where the texts are; only those that are trained on reach the driver. The bounds hold at every size; without regions the model knows nothing and finds nothing."""
    marked = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(r"@[A-Za-z0-9]|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9]{12}"))

    def extract(batches):
        least: dict[tuple[int, str], list[tuple[int, int, int]]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = None
                for region in regions(text):
                    said = "\n".join(region.words)
                    key = (zlib.crc32(said.encode()), said)
                    if len(region.words) <= most_words and len(said) <= most_chars and key not in least:
                        spans = base_spans(text) if spans is None else spans
                        least[key] = silver(region, spans)
            least = {k: least[k] for k in sorted(least)[:most_regions]}
        keys = list(least)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([[x for seg in least[k] for x in seg] for k in keys], pa.list_(pa.int32()))], ["mark", "said", "gold"])

    found = marked.mapInArrow(extract, "mark long, said string, gold array<int>").groupBy("mark", "said").agg(F.min("gold").alias("gold"))
    examples = []
    for _, said, gold in found.orderBy("mark", "said").limit(most_regions).collect():
        words = said.split("\n")
        region, gold = Region([(0, 0)] * len(words), words), list(zip(gold[::3], gold[1::3], gold[2::3], strict=True))
        examples.append((region.words, gold))
        examples += [(r.words, g) for r, g in varied(region, gold)]
    examples = [(words, gold, all_features(words)) for words, gold in sorted(examples, key=lambda e: zlib.crc32(" ".join(e[0]).encode()))]
    model = SemiCrf(np.zeros((len(LABELS), BUCKETS)), np.zeros((len(LABELS), len(LABELS))))
    for epoch in range(epochs):
        for words, gold, features in examples:
            model.gradient(words, gold, 0.2 / (1 + epoch), 1e-4, features)
    return model


def all_spans(text: str, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base spans and those that the model adds where no base span is)."""
    base, added = base_spans(text), []
    starts, ends = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    for region in regions(text):
        for i, n, y in model.decode(region.words):
            if not y:
                continue
            a, b = region.spans[i][0], region.spans[i + n - 1][1]
            while a < b and text[a] in _EDGES:
                a += 1
            while b > a and text[b - 1] in _EDGES:
                b -= 1
            before = bisect_left(starts, b)
            if b > a and (not added or a >= added[-1][2]) and not (before and ends[before - 1] > a):
                added.append((LABELS[y], a, b))
    return base, sorted([*base, *added], key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def find(spark: SparkSession, docs: DataFrame, model: SemiCrf, *, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """The columns of keep, and base and spans: arrays of (kind, start, end) in code points, end exclusive, by start, then kind.

    Null texts are empty and have none; an empty table gives no rows. Texts are read whole, and each region is decoded as one, so a long text costs in proportion. Columns of keep named base or spans are replaced. Equal scores go to the shorter segment and the first label.
    """
    shared = spark.sparkContext.broadcast(model)
    kept, place, extra = carried(docs, keep, text_col, ("base", "spans"))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    schema = kept_schema(kept, extra, f"base:{span},spans:{span}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def search(batches):
        for batch in batches:
            base, every = [], []
            for text in batch.column(place).to_pylist():
                b, e = all_spans(text or "", shared.value)
                base.append(named(b))
                every.append(named(e))
            columns, names = kept_part(batch, extra)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base, kind), pa.array(every, kind)], [*names, "base", "spans"])

    return kept.mapInArrow(search, schema)


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of spans that overlap the first counts."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(before, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    done = F.aggregate(spans, zero, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["parts"], ""), F.substr(text, (done["at"] + 1).cast("int"))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
