"""Secret scan: fixed patterns, and guess-cost dynamic programming over credential values.

Patterns find assignments, access keys and long hexadecimal runs. Beside them, a value that stands in
a credential context (a credential word, a separator, a value) is costed as a password: dynamic
programming cuts it into words, dates, repeats, keyboard walks and brute-force spans at the least
total of log2 guesses, over all cuts. A value of ``GUESS_BITS`` or more that no pattern span overlaps
is a span of kind ``guess``; ``bits`` gives the cost of every assigned or guessed value.

Words are those of a vocabulary file (its entries that end a word, in the file's order of frequency)
beside common password words. A credential word stands alone or behind ``_``, ``-`` or a small letter
that its capital follows; behind ``is`` a value must hold something other than letters.

Cases: a null or empty text has no spans; texts and values of any length are scanned whole, in time
linear in their length; repeated rows repeat; an empty table gives an empty table. Only the id and
text columns are read. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import json
import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from math import inf, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings

KINDS = ("assign", "access", "hex", "guess")
#: log2 guesses from which a value in a credential context counts as a secret.
GUESS_BITS = 30.0
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that introduce a credential.
CONTEXT_WORDS = ("password", "passphrase", "passcode", "passwd", "pass", "pwd", "secret", "token", "credential", "credentials", "auth", "bearer", "login", "key", "pin")
_WORDS = "|".join(sorted(CONTEXT_WORDS, key=len, reverse=True))
_CAPITALS = "|".join(w.capitalize() for w in sorted(CONTEXT_WORDS, key=len, reverse=True))
_CONTEXT = re.compile(rf"(?:(?<![A-Za-z])(?i:{_WORDS})|(?<=[a-z])(?:{_CAPITALS}))[_-]?[0-9]*[\"']?\x20*(?:[:=]|=>|(\bis\b))\x20*[\"']?([^\s\"'<>,;]{{6,}})", re.A)
_STEMS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "login", "key", "pin")
#: Common password words, commonest first.
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "letmein", "master", "dragon", "monkey", "secret", "love", "user", "test", "pass", "root", "hello", "summer",
    "winter", "spring", "autumn", "sunshine", "princess", "football", "baseball", "soccer", "shadow", "superman", "batman", "freedom", "trust", "access",
    "flower", "cheese", "computer", "internet", "server", "system", "guest", "default", "changeme", "please", "company", "office", "home", "the", "and",
    "for", "you", "this", "that", "with", "from", "have", "one", "two", "three", "my", "new", "old", "key", "token", "example", "sample", "demo", "dev",
    "prod", "stage", "local", "public", "private", "open", "code", "data", "base", "world", "star", "king", "queen", "tiger", "eagle", "angel", "blue",
    "red", "green", "black", "white", "gold", "silver", "money", "power", "magic", "happy", "lucky", "family", "friend",
)
#: Rows of a keyboard, and the orders of digits and letters.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789", "qazwsxedcrfvtgbyhnujmikolp")
_NEXT = {(a, b) for row in WALKS for a, b in (*zip(row, row[1:]), *zip(row[1:], row))}
_DATES = (
    (re.compile(r"(?:19|20)\d\d([-./_]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), log2(365 * 120)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-./_]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"), log2(365 * 120)),
    (re.compile(r"(?:19|20)\d\d"), log2(120)),
)
#: Bits for one more segment, and for the length of a walk or the count of a repeat.
_SEGMENT, _LENGTH = 1.0, 4.0
#: Least characters of a walk or a repeat, and the longest block that repeats.
_LEAST, _BLOCK = 3, 8


def _char_bits(c: str) -> float:
    return log2(10) if c in "0123456789" else log2(26) if c.isascii() and c.isalpha() else log2(33) if c.isascii() else log2(4096)


class Guesser:
    """The least log2 guesses for a value, over all segmentations into words, dates, repeats, walks and brute force."""

    def __init__(self, words: list[str] = ()):
        """words: further words, commonest first, behind the common password words."""
        ranked = dict.fromkeys((*COMMON_WORDS, *words))
        self.bits_of = {w: log2(i + 2) for i, w in enumerate(ranked)}
        self.longest = max(map(len, ranked))
        self.bits = lru_cache(4096)(self._bits)

    def _word(self, value: str, low: str) -> float:
        """Bits of a dictionary word with its capitals."""
        bits = self.bits_of.get(low, inf)
        return bits if value == low else bits + (1.0 if value[1:] == low[1:] else len(low) / 2)

    def _bits(self, value: str) -> float:
        n, low = len(value), value.lower()
        if len(low) != n:
            low = value
        char = [_char_bits(c) for c in value]
        brute_sum = [0.0]
        for x in char:
            brute_sum.append(brute_sum[-1] + x)
        dates: dict[int, list[tuple[int, float]]] = {}
        for pattern, bits in _DATES:
            for i in range(n):
                if value[i].isdigit() and (m := pattern.match(value, i)):
                    dates.setdefault(m.end(), []).append((i, bits))
        best, brute = [0.0], inf
        # What a walk, or a repeat of a block of k, that is long enough and goes on costs so far; repeats by place modulo k.
        walk, walked = inf, 1
        repeat, equal = {k: [inf] * k for k in range(1, _BLOCK + 1)}, dict.fromkeys(range(1, _BLOCK + 1), 0)
        for j in range(1, n + 1):
            brute = min(brute, best[j - 1] + _SEGMENT) + char[j - 1]
            least = brute
            for i in range(max(0, j - self.longest), j - 1):
                if low[i:j] in self.bits_of:
                    least = min(least, best[i] + _SEGMENT + self._word(value[i:j], low[i:j]))
            for i, bits in dates.get(j, ()):
                least = min(least, best[i] + _SEGMENT + bits)
            walked = walked + 1 if j > 1 and (low[j - 2], low[j - 1]) in _NEXT else 1
            if walked < _LEAST:
                walk = inf
            else:
                walk = min(walk, best[j - _LEAST] + _SEGMENT + log2(47) + _LENGTH)
                least = min(least, walk)
            for k, held in repeat.items():
                if j > k and value[j - 1] == value[j - 1 - k]:
                    equal[k] += 1
                else:
                    equal[k] = 0
                    held[:] = [inf] * k
                need = max(2 * k, _LEAST)
                if equal[k] >= need - k:
                    i = j - need
                    held[j % k] = min(held[j % k], best[i] + _SEGMENT + brute_sum[i + k] - brute_sum[i] + _LENGTH)
                    least = min(least, held[j % k])
            best.append(least)
        return best[n]


def vocabulary_words(path: str) -> list[str]:
    """Words of a tokenizer file, in its order: entries of ASCII letters, three or more, that end a word."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"] or ""
    words = [t[: len(t) - len(end)] for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1]) if t.endswith(end)]
    return [w for w in words if len(w) >= 3 and w.isascii() and w.isalpha()]


def scan(text: str, guesser: Guesser) -> list[tuple[str, int, int, float | None]]:
    """Spans (kind, start, end, bits) by start, then in the order of ``KINDS``."""
    out: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                out.append(("assign", m.start(), m.end(), guesser.bits(m[2])))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    if any(s in low for s in _STEMS):
        taken = sorted((s, e) for _, s, e, _ in out)
        for m in _CONTEXT.finditer(text):
            s, e = m.span(2)
            if m[1] and m[2].isalpha():
                continue
            at = bisect(taken, (e,)) - 1
            # Spans of one kind do not overlap: of three kinds, the last three before the end decide.
            if not any(b > s for _, b in taken[max(0, at - 2) : at + 1]) and (bits := guesser.bits(m[2])) >= GUESS_BITS:
                out.append(("guess", s, e, bits))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Id and ``spans`` (array of kind, start, end, bits) of every text.

    ``vocabulary``: a tokenizer file whose words are the dictionary; read on the driver and broadcast
    (its size does not depend on data).
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    words = docs.sparkSession.sparkContext.broadcast(vocabulary_words(vocabulary) if vocabulary else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(words.value)
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in slices(offsets):
                raw, ends = data[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                found = [[dict(zip(("kind", "start", "end", "bits"), s)) for s in scan(raw[a:b].decode("utf-8", "replace"), guesser)] for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.list_(_SPAN))], names=[doc_id, "spans"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"`{doc_id}` {id_type}, spans array<struct<kind: string, start: bigint, end: bigint, bits: double>>")
