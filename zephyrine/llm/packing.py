"""Packing by power-of-two decomposition: every document is cut into pieces of binary length and pieces of one length share a bucket, so no sequence holds two documents."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import as_bytes, worker_cache

#: Most words whose ids a worker remembers.
REMEMBERED = 1_200_000
#: Plain words that are encoded as one text.
JOINED = 512
#: Ids that one outgoing batch holds at most, but for a single document.
BATCH_IDS = 2_000_000

#: Words that the tokenizer leaves as one piece, and marks that are a piece each.
_PLAIN, _MARKS = re.compile("[a-zß-öø-ÿ]+"), ".,;:!?"


class _Words(dict):
    """Words to numbers of pieces, which are ids as little-endian unsigned 32-bit integers. The tokenizer never joins across white space, so a text's ids are those of its words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, "rb") as file:
            text = file.read().decode()
        self.whole = Tokenizer.from_str(text)
        # for words of small Latin letters alone nothing is to normalise; many are encoded as one text and told apart by their last tokens
        known = json.loads(text)
        suffix = known["model"].get("end_of_word_suffix")
        pieces = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(known | {"normalizer": None, "added_tokens": [], "pre_tokenizer": pieces})) if suffix else None
        self.last = np.zeros(max(known["model"]["vocab"].values()) + 1, bool)
        self.last[[i for t, i in known["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        if self.plain and hasattr(self.plain.model, "_resize_cache"):
            self.plain.model._resize_cache(0)  # each word comes once
        self.pieces: list[bytes] = []
        self.new: list[bytes] = []
        self.old: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        if word in self.old:
            number = self[word] = self.old[word]
            return number
        self.new.append(word)
        number = self[word] = len(self.pieces)
        self.pieces.append(b"")
        return number

    def age(self) -> None:
        """Forget the words that were not met since this was last done; the others are old now, and stay if they are met again."""
        words = list(self)
        self.pieces = [self.pieces[self[w]] for w in words]
        self.old = dict(zip(words, range(len(words)), strict=True))
        self.clear()

    def learn(self) -> None:
        """Encode the new words; a plain word with one mark after it is the word and the mark."""
        plain, other, marked = [], [], []
        for word in self.new:  # grows meanwhile
            text = word.decode()
            if self.plain and _PLAIN.fullmatch(text):
                plain.append(text)
            elif text[-1] in _MARKS and _PLAIN.fullmatch(text[:-1]):
                marked.append((word, self[word[:-1]], self[word[-1:]]))
            else:
                other.append(text)
        if plain:
            found = self.plain.encode_batch_fast([" ".join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            raw, starts = ids.tobytes(), np.concatenate(([0], ends[:-1]))
            for text, a, b in zip(plain, starts.tolist(), ends.tolist(), strict=True):
                self.pieces[self[text.encode()]] = raw[a:b]
        for text, found in zip(other, self.whole.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.pieces[self[text.encode()]] = array("I", found.ids).tobytes()
        for word, a, b in marked:
            self.pieces[self[word]] = self.pieces[a] + self.pieces[b]
        self.new = []

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > REMEMBERED // 2:
            self.age()
        # lower case first shares more words; a text with an opening that could become a control token is left as it is
        numbers = [list(map(self.__getitem__, (x if b"<|" in x else x.lower()).split())) for x in texts]
        self.learn()
        return [b"".join(map(self.pieces.__getitem__, x)) for x in numbers]


def lengths_of(total: int, longest: int) -> list[int]:
    """Full pieces first, then the binary digits of the rest from the highest: 11 at 8 is 8, 2, 1."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def decompose(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece: doc_id, start, length, bucket (log2 of the length), sequence_id, offset, doc_tokens and ids (binary, little-endian unsigned 32-bit).

    tokenizer: path of a tokenizer file of the tokenizers library that drops white space. Each document is its ids and end_id. Each piece is a sequence of its own with a power of two as its length, so it needs no padding, and offset is 0. sequence_id is the number of the task and a count within it: unique however often ids repeat. Only the split of the input decides it; a repeated task writes the same.
    Null and empty texts are end_id alone. Null ids stay null. Repeated rows and ids are packed each by itself. Other columns are not read. A long text is a single row of input, and its pieces leave in batches. Nothing is shuffled.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = "doc_id long, start long, length long, bucket int, sequence_id long, offset long, doc_tokens long, ids binary"
    names = [x.split()[0] for x in schema.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches):
        words, sequence = worker_cache(("packing", tokenizer), lambda: _Words(tokenizer)), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            rows, held = [], 0
            for at in range(0, len(texts), 500):
                for doc, data in zip(ids[at : at + 500], words.encode(texts[at : at + 500]), strict=True):
                    data += end
                    total, start = len(data) // 4, 0
                    for n in lengths_of(total, longest):
                        rows.append((doc, start, n, n.bit_length() - 1, sequence, 0, total, data[4 * start : 4 * (start + n)]))
                        start, sequence = start + n, sequence + 1
                    held += total
                    if held >= BATCH_IDS:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """A folder of Parquet for each length, as a trainer that draws batches of one length reads it."""
    pieces.write.partitionBy("bucket").parquet(path)
