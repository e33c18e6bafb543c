"""Operators on texts against plain versions of their definitions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrine.llm import blocks, components, decontam, jaccard, langid, media, packing, pii, stupid_backoff, substring, words
from zephyrine.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, shard int, lang string, part string, key string"


def corpus(seed=5, n=60):
    """Random texts over few words, with copies, near copies, nulls, odd white space and one long text."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "a,b", "x" * 300, "<|endoftext|>", "Don't"]
    passage = [r.choice(vocabulary) for _ in range(50)]
    texts = [None, "", "  \n\t", "one", "one", "a b c", "A B c", "a\x0bb c  d"]
    for i in range(n):
        w = [r.choice(vocabulary) + str(r.randrange(200)) for _ in range(r.randrange(1, 120))]
        if i % 4 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage[: r.randrange(30, 50)]
        texts.append(r.choice([" ", "\n", "  "]).join(w))
        if i % 7 == 0:
            texts.append(texts[-1])
        if i % 5 == 0:
            w[r.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    texts.append(" ".join(r.choice(vocabulary) for _ in range(3000)))
    rows = [(i, t, 1, "en", "p", "k") for i, t in enumerate(texts)]
    return rows + [rows[-3], rows[-3], (None, "some null id", 1, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return (text or "").encode().split()


def as_counter(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_word_ids_follow_the_words():
    texts = [(t or "").encode() for _, t, *_ in corpus()]
    stream = words.Stream(texts)
    every = [w for t in texts for w in t.split()]
    assert stream.lengths.tolist() == [len(t.split()) for t in texts]
    known = {}
    for w, i in zip(every, stream.ids.tolist(), strict=True):
        assert known.setdefault(w, i) == i
    assert len(set(known.values())) == len(known)
    keys = words.run_keys(stream.ids, 7)
    assert [tuple(every[i : i + 7]) for i in range(3)] and len(keys) == len(every) - 6
    seen = {}
    for i, k in enumerate(keys.tolist()):
        assert seen.setdefault(tuple(every[i : i + 7]), k) == k


def test_blocks_pack_without_loss():
    r = np.random.default_rng(1)
    for n in (0, 1, 5000):
        keys = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        assert (blocks.unpack(blocks.pack(keys)) == keys).all()
        values = r.integers(0, 300, n) ** 2
        assert (blocks.unplanes(blocks.planes(values)) == values).all()


def test_equal_rows_spread_over_all_parts(spark):
    df = spark.range(200_000).selectExpr("cast(null as long) doc_id", "repeat('equal rows ', 30) text")
    shared = blocks.Corpus(df)
    sizes = [r[0] for r in shared.frame.groupBy("part").count().select("count").collect()]
    assert len(sizes) == shared.parts > 5 and max(sizes) < 1.2 * min(sizes)


def test_wide_keys_are_told_apart():
    keys = np.array([[5, 1], [5, 2], [7, 1], [5, 1]], np.uint64)
    (high, low), counts = blocks.unique_pairs(keys, None)
    assert high.tolist() == [5, 5, 7] and low.tolist() == [1, 2, 1] and counts.tolist() == [2, 1, 1]


@pytest.mark.parametrize("window,rounds,bits", [(35, 6, None), (35, 6, 12), (6, 3, 12), (2, 1, None)])
def test_repeated_windows(docs, window, rounds, bits):
    rows = [(d, split(t)) for d, t, *_ in corpus()]
    count = collections.Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
    want = collections.Counter()
    for d, w in rows:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        want[d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    assert as_counter(substring.repeated(docs, window=window, rounds=rounds, bits=bits).collect()) == want


def test_runs_of_one_word(spark):
    rows = [(i, "la " * n) for i, n in enumerate((34, 35, 36, 80, 0))]
    out = {r.doc_id: r.n_removed for r in substring.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: 0, 1: 35, 2: 36, 3: 80, 4: 0}


@pytest.mark.parametrize("order,least", [(3, 2), (2, 1), (4, 2), (1, 2)])
def test_stupid_backoff(docs, order, least):
    rows = [(d, split(t)) for d, t, *_ in corpus()]
    c, n = collections.Counter(), 0
    for _, w in rows:
        n += len(w)
        for k in range(1, order + 1):
            c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = collections.Counter()
    for d, w in rows:
        total = 0.0
        for i in range(len(w)):
            factor = 1.0
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    total += math.log10(factor * c[g] / n)
                elif c[g] >= least:
                    total += math.log10(factor * c[g] / c[g[:-1]])
                    break
                else:
                    factor *= 0.4
        want[d, len(w), round(total, 6)] += 1
    for form in (stupid_backoff.score, stupid_backoff.by_rows) if order == 3 else (stupid_backoff.score,):
        assert collections.Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in form(docs, order=order, least=least).collect()) == want


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(sets, percent=80):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("bits", [None, 12])
def test_jaccard_join(docs, bits):
    rows = [(d, shingles(t)) for d, t, *_ in corpus()]
    tops = brute_components([s for _, s in rows])
    least = {}
    for t, (d, _) in zip(tops, rows, strict=True):
        if d is not None:
            least[t] = min(d, least.get(t, d))
    want = collections.Counter((d, len(s), least.get(t)) for t, (d, s) in zip(tops, rows, strict=True))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs, bits=bits).collect()) == want


@pytest.mark.parametrize("sizes", [(0, 4), (0, 60)], ids=["alike", "of many sizes"])
def test_large_family_in_blocks(spark, sizes):
    r = random.Random(2)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(60)] = f"e{r.randrange(10**6)}"
        w = w[: 60 - r.randrange(*sizes)] + [f"more{x}" for x in range(r.randrange(*sizes))]
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    got = {x.doc_id: x.component_id for x in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), block=16, bits=12).collect()}
    assert got == dict(enumerate(brute_components(sets)))


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_links_of_sets_around_pivots(percent):
    r = np.random.default_rng(percent)
    for _ in range(60):
        sets, k = [], r.integers(2, 30)
        while len(sets) < k:
            base = sets[r.integers(len(sets))] if sets and r.random() < 0.8 else np.empty(0, np.uint64)
            base = base[r.random(len(base)) < 1 - r.random() * 0.3]
            sets.append(np.union1d(base, r.integers(0, 400, r.integers(1, 12)).astype(np.uint64)))
        side = r.integers(0, 2, k) if r.random() < 0.5 else None
        root = list(range(k))

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for x in range(k):
            for y in range(x):
                both = len(np.intersect1d(sets[x], sets[y]))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both) and (side is None or side[x] != side[y]):
                    root[max(top(x), top(y))] = min(top(x), top(y))
        got = list(range(k))
        for x, y in jaccard.linked(sets, percent, side):
            both = len(np.intersect1d(sets[x], sets[y]))
            assert 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both)
            a, b = top(x, got), top(y, got)
            got[max(a, b)] = min(a, b)
        assert [top(i) for i in range(k)] == [top(i, got) for i in range(k)]


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {x.id: x.root for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: top(i) for i in root}


def test_packing_is_a_round_trip(docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = packing.decompose(docs, tokenizer_path(), longest=256).toPandas()
    want = collections.Counter(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, x, *_ in corpus())
    got, held = collections.Counter(), []
    for row in out.sort_values("sequence_id").itertuples():  # a document's sequences follow one another
        assert row.length == len(row.ids) // 4 == 1 << row.bucket and row.offset == 0 and row.start == sum(map(len, held)) // 4
        held.append(row.ids)
        if row.start + row.length == row.doc_tokens:
            got[b"".join(held)] += 1
            held = []
    assert got == want and out.sequence_id.is_unique and not held
    assert packing.lengths_of(5 + 2 * 8, 8) == [8, 8, 4, 1]


def test_packing_forgets_words_without_harm(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    kept, plain = packing._Words(tokenizer_path()), packing._Words(tokenizer_path())
    r = random.Random(7)
    for _ in range(60):
        text = " ".join(r.choice("abcdef") * r.randrange(1, 9) + r.choice(["", ".", "'s", "Ü"]) for _ in range(20)).encode()
        assert kept.encode([text]) == [np.array(plain.whole.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(kept.pieces) < 200


def test_media_round_trip_and_damage(docs, spark, tmp_path):
    out = media.media_columns(docs)
    want = collections.Counter((d, media.padded((t or "").encode()), len((t or "").encode())) for d, t, *_ in corpus())
    rows = out.collect()
    assert collections.Counter((r.doc_id, bytes(r.payload), r.n_bytes) for r in rows) == want
    assert len({bytes(r.media) for r in rows}) == len({bytes(r.payload) for r in rows})
    folder = f"file://{tmp_path}/a"
    n = media.write_archives(docs, folder, archive_bytes=4000)
    assert n > 3
    (tmp_path / "a/archives/lost.zip").write_bytes(b"left by a lost task")
    victim = next(p for p in sorted((tmp_path / "a/archives").iterdir()) if p.name != "lost.zip")
    data = bytearray(victim.read_bytes())
    data[80] ^= 255  # inside the first member
    victim.write_bytes(data)
    again = media.read_archives(spark, folder, rangebytes="1500", attempts="2").collect()
    assert len(again) == len(rows) and sum(r.error is not None for r in again) == 1
    assert not media.media_columns(empty(spark)).collect()


def test_language_id(spark):
    r = random.Random(4)
    sound = {"en": "the and of ing tion", "fr": "le la que é eau", "de": "der die und sch ung"}
    rows = [(i, " ".join("".join(r.choices(sound[g].split(), k=2)) for _ in range(r.randrange(2, 60))), g) for i, g in enumerate(r.choices(list(sound), k=200))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 4 <> 2"))
    ask = spark.createDataFrame([*rows, (900, None, None), (901, "12 !! \x00", None), (902, "", "en"), (903, rows[0][1] * 500, None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.predict(spark, ask, model, keep=[F.col("doc_id")]).collect()}
    assert sum(got[i].lang_pred == g for i, _, g in rows if i % 4 == 2) >= 0.95 * sum(i % 4 == 2 for i, *_ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == rows[0][2]
    # a plain version of the model gives the same, whatever the texts beside it
    for i, t, _ in rows[:20]:
        bucket, doc, some = langid.features([t])
        total = model.prior + model.weights[bucket].sum(0, dtype=float)
        assert model.languages[int(total.argmax())] == got[i].lang_pred and some.all() and not doc.any()
    none = langid.train(df.limit(0))
    assert [x.lang_pred for x in langid.predict(spark, df.limit(2), none, keep=[F.col("doc_id")]).collect()] == ["und", "und"]


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(12, 60)))) for i in range(25)] + [(90, None), (91, "too few"), (92, "")]
    rows, want = [], set()
    for d in range(160):
        w = r.choices(vocabulary, k=r.randrange(0, 150))
        if d % 2:
            i, text = items[r.randrange(25)]
            part = text.split()
            k = r.randrange(0, int(0.2 * len(part)) + 3)
            for _ in range(k):
                at = r.randrange(len(part))
                kind = r.randrange(3)
                part[at : at + (kind != 0)] = [] if kind == 2 else [r.choice(vocabulary)]
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() + r.choice(["", ",", "!"]) for x in part]
        rows.append((d, " ".join(w)))
    rows += [(900, None), (901, "")]
    for d, t in rows:
        tokens = decontam.plain((t or "").encode()).split()
        for i, text in items:
            item = decontam.plain((text or "").encode()).split()
            if item and plain_distance(item, tokens) <= int(0.2 * len(item) + 1e-9):
                want.add((d, i))
    df, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contaminated(df, wanted).collect()
    got = {(x.doc_id, x.item_id) for x in out}
    assert len(want) > 50 and got <= want and len(got) >= 0.99 * len(want)
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(df, wanted, block=7).collect()} == got
    for x in out[:20]:
        part = decontam.plain(dict(rows)[x.doc_id].encode()).split()[x.start : x.start + x.n_words]
        assert plain_distance(part, decontam.plain(dict(items)[x.item_id].encode()).split()) <= x.distance + abs(len(part))
    assert {x.doc_id for x in decontam.clean(df.withColumn("item_id", F.lit("clash")), wanted).collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontam.contaminated(df, wanted.limit(0)).count() == decontam.contaminated(df.limit(0), wanted).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Alpha"), (2, "beta, gamma"), (3, "one two three four"), (4, "\u6211\u4eec\u5728\u5b66\u4e60\u65b0\u7684\u8bed\u8a00"), (5, "\u3042")]
    texts = [(1, "x alpha y ALPHA"), (2, "beta gamma"), (3, "beta\ngamma! delta one two three four"), (4, "one two three fou"), (5, "abc\u4ed6\u8bf4\u6211\u4eec\u5728\u5b66\u4e60\u65b0\u7684\u8a9e\u8a00def"), (6, "alphabet"), (7, "\u3042\u3042"), (8, None)]
    out = decontam.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in out) == [(1, 1, 1, 1, 0), (2, 2, 0, 2, 0), (3, 2, 0, 2, 0), (3, 3, 3, 4, 0), (5, 4, 3, 9, 1), (7, 5, 0, 1, 0)]


@pytest.mark.parametrize("kinds", [(0, 1, 2), (2,), (1,)], ids=["mixed", "deletions", "insertions"])
def test_recall_on_edited_long_items(kinds):
    r = random.Random(len(kinds) + kinds[0])
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocabulary, k=size))) for i, size in enumerate([10, 50, 200, 400] * 5)]
    texts = []
    for i, text in items:
        part = text.split()
        for at in sorted(r.sample(range(len(part)), int(0.19 * len(part))), reverse=True):
            kind = r.choice(kinds)
            part[at : at + (kind != 1)] = [] if kind == 2 else [r.choice(vocabulary)]
        texts.append(" ".join([*r.choices(vocabulary, k=300), *part, *r.choices(vocabulary, k=300)]).encode())
    found = {(d, i) for d, i, *_ in decontam.Items(items).search(texts)}
    assert len(found & {(i, i) for i, _ in items}) >= 0.95 * len(items)


def test_one_very_long_item_and_text(spark):
    r = random.Random(1)
    long = [f"u{r.randrange(10**6)}" for _ in range(20_000)]
    items = decontam.Items([(1, " ".join(long)), *((i, f"short item number {i} of these five") for i in range(2, 400))])
    assert items.keys.nbytes < 1 << 20
    copy = list(long)
    for at in r.sample(range(20_000), 800):
        copy[at] = "edit"
    found = items.search([" ".join(["x"] * 50 + copy).encode(), b"short item number 7 of those five"])
    assert [(d, i) for d, i, *_ in found if i in (1, 7)] == [(0, 1), (1, 7)] and found[0][4] <= 800


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "the cat", "a", 2, 3.0), (2, None, "b", 2, None)], "doc_id long, text string, lang_pred string, base int, score double").withColumn("spans", F.lit(1)).withColumn("__text", F.lit("x")).withColumn("key", F.lit(1)).withColumn("KEY_", F.lit(1))
    out = langid.predict(spark, df, langid.train(df.withColumn("lang", F.lit("en"))), keep=list(df.columns))
    assert out.columns == ["doc_id", "text", "base", "spans", "__text", "key", "KEY_", "lang_pred", "score"] and {r.lang_pred for r in out.collect()} == {"en", "und"}
    found = pii.find(spark, df, pii.train(df), keep=list(df.columns))
    assert found.columns[-2:] == ["base", "spans"] and len({c.lower() for c in found.columns}) == len(found.columns) and found.count() == 2
    odd = df.withColumnRenamed("text", "score2").withColumnRenamed("__text", "text")
    assert langid.predict(spark, odd, langid.train(df.limit(0).withColumn("lang", F.lit("x"))), keep=[F.col("doc_id"), F.col("text")], text_col="score2").columns == ["doc_id", "text", "lang_pred", "score"]
    clean = decontam.clean(df, spark.createDataFrame([(1, "cat")], "item_id long, text string"))
    assert clean.columns == df.columns and [r.doc_id for r in clean.collect()] == [2]


def test_ties(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, "ab", "b"), (3, "ab", "m")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(spark, df, langid.train(df), keep=[F.col("doc_id")]).collect()} == {"b"}
    # two places equally near: the first
    out = decontam.Items([(1, "a b c d e f")]).search([b"a b x d e f and a b c d e y"])
    assert [o[2:] for o in out] == [(0, 6, 1)]


def test_empty_tables(spark):
    none = empty(spark)
    model = langid.train(none)
    assert langid.predict(spark, none, model, keep=[F.col("doc_id")]).count() == stupid_backoff.by_rows(none).count() == 0
    assert pii.find(spark, none, pii.train(none), keep=["doc_id"]).count() == 0
    assert decontam.clean(none, spark.createDataFrame([(1, "x y")], "item_id long, text string")).count() == 0
    assert substring.repeated(none).count() == stupid_backoff.score(none).count() == jaccard.similar(none).count() == packing.decompose(none, tokenizer_path()).count() == 0
