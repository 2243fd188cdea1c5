"""Language identification by prediction by partial matching.

For each language, byte contexts of up to ``ORDER`` bytes keep the counts of the bytes that followed;
a byte unseen in a context escapes to the next shorter one (escape probability: distinct followers
over occurrences plus distinct followers), down to a uniform choice. Statistics are frozen; a text's
exact code length is the sum over its bytes, and the language with the shortest code wins.

Texts are reduced to words of letters (ASCII letters in lower case, Latin-1 letters likewise, other
non-ASCII bytes as they are), joined by one space and closed by a newline.

The classifier is fitted on a documented bound of about ``ROWS`` texts and ``BYTES`` bytes for each
language, chosen by the hash of id and text; the code lengths of all byte strings seen there are worked out beforehand for
all languages, those of unseen ones when they occur.

Cases: a null text, or one without letters, is ``und`` with score 0; equal code lengths go to the
language that sorts first; without training texts all is ``und``; repeated rows repeat; an empty
table gives an empty table. Only the named columns are read, and a prediction only reads the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, HashIndex, unique_counts, words
from .common import crc_mod, slices, strings
from .ctw import _grams

ORDER = 4
ROWS = 2000
BYTES = 16 << 20
#: Bytes that end a word: ASCII other than letters.
_BREAK = np.ones(256, bool)
_BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


def _letters(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte letters of Latin-1."""
    data = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    low = data[after]
    data[after] = np.where((low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 0x20, low)
    return data


def _strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _grams(words(_letters(data), offsets, _BREAK, lower=False), ORDER)


@dataclass
class PpmModel:
    """Per language and order: contexts with escape code length, byte strings with code length."""

    languages: list[str]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)
    followers: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bits: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    _index: HashIndex | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_index": None}

    def add(self, grams: np.ndarray, n: np.ndarray) -> None:
        """The statistics of one more language from its (order + 1)-byte strings."""
        contexts, followers = [], []
        for d in range(ORDER + 1):
            key, c = unique_counts(grams & np.uint64((1 << (8 * (d + 1))) - 1), n)
            context, first = np.unique(key >> np.uint64(8), return_index=True)
            total, kinds = np.add.reduceat(c, first), np.diff(np.append(first, len(key)))
            contexts.append((context, np.log2(total + kinds) - np.log2(kinds)))
            followers.append((key, np.repeat(np.log2(total + kinds), kinds) - np.log2(c)))
        self.contexts.append(contexts)
        self.followers.append(followers)

    def walk(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of each string's last byte, for each language."""
        out = np.zeros((len(grams), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            bits, open_ = np.zeros(len(grams)), np.arange(len(grams))
            for d in range(ORDER, -1, -1):
                key = grams[open_] & np.uint64((1 << (8 * (d + 1))) - 1)
                known, cost = self.followers[k][d]
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                bits[open_[hit]] += cost[at[hit]]
                open_, key = open_[~hit], key[~hit]
                context, escape = self.contexts[k][d]
                at = np.minimum(np.searchsorted(context, key >> np.uint64(8)), len(context) - 1)
                hit = context[at] == key >> np.uint64(8)
                bits[open_[hit]] += escape[at[hit]]
            bits[open_] += 8
            out[:, k] = bits
        return out

    def lengths(self, grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text for each language."""
        if self._index is None:
            self._index = HashIndex(self.seen)
        at = self._index.find(grams)
        bits = self.bits[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, back = np.unique(grams[missing], return_inverse=True)
            bits[missing] = self.walk(new)[back]
        return np.add.reduceat(bits, offsets[:-1], axis=0, dtype=np.float64)


def fit(train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS, size: int = BYTES) -> PpmModel:
    """Statistics from about ``rows`` texts and ``size`` bytes of each language at most, chosen by the hash of id and text."""
    base = train.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = sorted((r["lang"], r["n"], r["size"]) for r in base.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect())
    model = PpmModel([x for x, _, _ in counts])
    if not counts:
        return model
    chosen = F.lit(False)
    for x, n, bytes_ in counts:
        rate = min(1 << 20, -(-(rows << 20) // n), -(-(size << 20) // max(bytes_, 1)))
        chosen = chosen | ((F.col("lang") == x) & (F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < rate))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = strings(batch.column(1))
            for k in sorted(set(langs)):
                own = [i for i, x in enumerate(langs) if x == k]
                parts = [_strings(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0] for i in own]
                key, n = unique_counts(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

    table = base.filter(chosen).select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    lang_, key, n = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64), table.column(2).to_numpy()
    model.languages = [x for x in model.languages if (lang_ == x).any()]
    for x in model.languages:
        own = lang_ == x
        model.add(key[own], n[own])
    model.seen = np.unique(key)
    model.bits = model.walk(model.seen)
    return model


def predict(docs: DataFrame, model: PpmModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``lang_pred`` and ``score`` (posterior of the best language under equal priors)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[doc_id].dataType.simpleString()
    ascii_letter = ~_BREAK & (np.arange(256) < 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in slices(offsets):
                own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                plain = np.concatenate([[0], np.cumsum(ascii_letter[own])])
                some = plain[ends[1:]] > plain[ends[:-1]]
                for k in np.flatnonzero(~some & (np.diff(ends) > 0)):
                    some[k] = any(c.isalpha() for c in own[ends[k] : ends[k + 1]].tobytes().decode("utf-8", "replace"))
                best, score = np.full(j - i, -1), np.zeros(j - i)
                if m.languages:
                    length = m.lengths(*_strings(own, ends))
                    best = length.argmin(1)
                    gap = length - length.min(1, keepdims=True)
                    score = np.where(some, 1 / np.exp2(-gap).sum(1), 0.0)
                names = [m.languages[b] if s and b >= 0 else "und" for b, s in zip(best, some)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], names=[doc_id, "lang_pred", "score"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"`{doc_id}` {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3) -> DataFrame:
    """Fit on documents whose id's crc32 modulo ``folds`` is not 1, predict all; ``held_out`` marks the others."""
    model = fit(docs.filter(crc_mod(F.col(doc_id), folds) != 1), doc_id, text, lang)
    return predict(docs, model, doc_id, text).withColumn("held_out", crc_mod(F.col(doc_id), folds) == 1)
