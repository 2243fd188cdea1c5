"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest vocabulary entries. Such a cut is what the ordered
merges produce exactly if every token reproduces itself and every adjacent pair is compatible, that
is, no merge across the border would have come before the merges inside both tokens. The pairs of
all new words of a batch are tested together with numpy; only failing words are merged exactly.

The tokenizer file describes NFC, white space and lower-case normalisation, a pattern split, byte
characters, an end-of-word suffix and no decoder, so decoding joins the token strings by a blank.
Added tokens found in a text are tokens of their own, as the tokenizers library does by default.
Letters and numbers are what that library's patterns take for them; texts with characters that this
Python's Unicode tables do not know are normalised by the library's own normaliser.

Cases: a null or empty text has no tokens and decodes to the empty string; texts of any length are
encoded whole; repeated rows repeat; an empty table gives an empty table. Only the id and text
columns are read. Results do not depend on batch or cache sizes.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import BYTE_VALUE, HashIndex, mix64
from .common import release_memory, slices, strings

#: Chunks of text between white space that a worker remembers; when full, it starts afresh.
CACHE_CHUNKS = 300_000
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACE_RUN = re.compile(f"[{_SPACES}]+")
#: What str.split() takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
_FAR = 1 << 40
#: An odd number and its inverse modulo 2**64.
_POWER = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: Bytes up to which failing words are merged in step; longer ones by a heap each.
LOCKSTEP = 48


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def _ranges(points: list[int]) -> str:
    """The inside of a bracket expression with the given code points, sorted."""
    ranges: list[list[int]] = []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@cache
def character_tables() -> dict[str, str]:
    """Bracket expressions: L and N by the tokenizers library's patterns, and characters whose normal form is left to the library.

    The last are those that this Python's Unicode tables leave unassigned, or order in another way
    among combining marks.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    every, out = "".join(map(chr, points)), {}
    for category in "LN":
        found = pre_tokenizers.Split(Regex(rf"\p{{{category}}}"), "removed", invert=True).pre_tokenize_str(every)
        out[category] = _ranges(sorted(ord(c) for piece, _ in found for c in piece))
    kind = {c: unicodedata.category(chr(c)) for c in points if c >= 0x80}
    # A mark of each of the common combining classes stands before and behind every mark.
    probes = ["\u0334", "\u093c", "\u094d", "\u0327", "\u0323", "\u0301", "\u0345", "\u035c"]
    marks = [(c, f"x{p}{chr(c)}x{chr(c)}{p}") for c, k in kind.items() if k[0] == "M" for p in probes]
    theirs = normalizers.NFC().normalize_str("\n".join(x for _, x in marks)).split("\n")
    moved = {c for (c, x), y in zip(marks, theirs) if unicodedata.normalize("NFC", x) != y}
    out["unknown"] = _ranges(sorted(moved | {c for c, k in kind.items() if k == "Cn"}))
    return out


class Bpe:
    """A tokenizer file's vocabulary, with the tables for verification and exact merging."""

    def __init__(self, text: str, tables: dict[str, str] | None = None):
        tables = tables or character_tables()
        spec = json.loads(text)
        self.text, self._library = text, None
        self.unknown = re.compile(f"[{tables['unknown']}]")
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        named = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.one = list(range(max(named) + 1))
        self.token, self.number = [named.get(i, "") for i in self.one], [str(i) for i in self.one]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added_pattern = re.compile("|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True))) if self.added else None
        pattern = steps[0]["pattern"]["Regex"].replace(r"\s", _SPACES)
        self.split = re.compile(pattern.replace(r"\p{L}", tables["L"]).replace(r"\p{N}", tables["N"]))
        self.byte = byte_characters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        size = max(self.vocab.values()) + 1
        # Rank of the merge that makes a token (-1: a single symbol), and its two halves.
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        pairs, rank = [], []
        for k, (a, b) in enumerate(merges):
            i, j, t = self.vocab[a], self.vocab[b], self.vocab[a + b]
            pairs.append((i << 32) | j)
            rank.append(k)
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = k, i, j
        self.pairs, self.pair_rank = HashIndex(np.array(pairs, np.uint64)), np.array(rank, np.int64)
        self.result = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        single = [[self.vocab.get(c + end, -1) for c in self.byte] for end in ("", self.suffix)]
        # Words of characters without a token of their own are merged one by one.
        self.alphabet = np.array(single, np.int64) if min(map(min, single)) >= 0 else None
        whole = self._whole()
        self.entries = {t: i for t, i in self.vocab.items() if whole[i]}
        # The longest entry that begins with two given characters.
        self.reach: dict[str, int] = {}
        for t in self.entries:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 0), len(t))
        # The same by hashes of bytes, for words cut in step: entries without and with the suffix, and the reach of two bytes.
        self.body, self.last = self._table(False), self._table(True)
        self.reach_of = np.ones(1 << 16, np.int64)
        for t in self._bytes(False):
            if len(t) > 1:
                self.reach_of[t[0] << 8 | t[1]] = max(self.reach_of[t[0] << 8 | t[1]], len(t))
        self.known_pairs: dict[int, bool] = {}
        # Pieces with their token ids; the numbers are those of one list, so that each exists once.
        self.cache: dict[str, tuple[int, ...]] = {}

    def _bytes(self, last: bool) -> dict[bytes, int]:
        """Entries by their bytes: those that bear the suffix, or those that do not."""
        byte, out = {c: b for b, c in enumerate(self.byte)}, {}
        for t, i in self.entries.items():
            body = t[: len(t) - len(self.suffix)] if last and self.suffix else t
            if (not last or t.endswith(self.suffix)) and body and all(c in byte for c in body):
                out[bytes(byte[c] for c in body)] = i
        return out

    def _table(self, last: bool) -> tuple[HashIndex, np.ndarray]:
        found = self._bytes(last)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(map(len, found), default=1), _POWER)]))
        keys = [(BYTE_VALUE[np.frombuffer(t, np.uint8)] * power[: len(t)]).sum() + np.uint64(len(t)) for t in found]
        return HashIndex(mix64(np.array(keys, np.uint64))), np.array(list(found.values()), np.int64)

    def _whole(self) -> np.ndarray:
        """Tokens that the merges rebuild from their own symbols: single ones, or halves that are whole and meet no earlier merge at their border than their own."""
        whole, made = self.made < 0, np.flatnonzero(self.made >= 0)
        meets = np.zeros(len(whole), bool)
        meets[made] = self.compatible(self.left[made], self.right[made], self.made[made])
        for t in made[np.argsort(self.made[made])].tolist():
            whole[t] = meets[t] and whole[self.left[t]] and whole[self.right[t]]
        return whole

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For pairs of tokens side by side: no merge across the border comes before those inside.

        The later of the two last merges is undone step by step; a merge of the two tokens at the
        border counts if its rank is below that of the merge undone last (ties go to the left one).
        """
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        limit = np.full(len(a), _FAR) if before is None else 2 * before
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = self.pairs.find((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
            # Twice the rank, and one more on the right side: equal ranks are merged from the left.
            bad = (at >= 0) & (2 * self.pair_rank[at] < limit[live])
            out[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            mx, my = self.made[x], self.made[y]
            on = (mx >= 0) | (my >= 0)
            live, x, y, mx, my = live[on], x[on], y[on], mx[on], my[on]
            undo = mx > my
            limit[live] = np.where(undo, 2 * mx, 2 * my + 1)
            a[live] = np.where(undo, self.right[x], x)
            b[live] = np.where(undo, y, self.left[y])
        return out

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over the word's byte characters; the last token bears the suffix."""
        symbols = "".join([self.byte[x] for x in word.encode()]) + self.suffix
        end, entries, out, i = len(symbols), self.entries, [], 0
        body = end - len(self.suffix)
        while i < body:
            far = i + self.reach.get(symbols[i : i + 2], 1)
            if end <= far and (t := entries.get(symbols[i:])) is not None:
                out.append(t)
                break
            # Only the last token bears the suffix, and it must.
            for j in range(min(body - 1 if self.suffix else body, far), i, -1):
                if (t := entries.get(symbols[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    def merge(self, word: str) -> list[int]:
        """The ordered merges, exactly: always the pair of lowest rank, from the left; a heap over a linked list."""
        parts: list[str | None] = [self.byte[x] for x in word.encode()]
        parts[-1] += self.suffix
        rank, end = self.rank, len(parts)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # An entry whose pair has changed since is stale.
            if parts[i] is None or j == end or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j], after[i] = None, after[j]
            if after[i] < end:
                before[after[i]] = i
                if (r := rank.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [self.vocab[p] for p in parts if p is not None and p in self.vocab]

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """``merge`` of many words: those of up to ``LOCKSTEP`` bytes in step, one merge of each word at a time."""
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        out: list[list[int]] = [[] for _ in raw]
        short = [i for i in order if len(raw[i]) <= LOCKSTEP]
        for i in order[len(short) :] if self.alphabet is not None else order:
            out[i] = self.merge(words[i])
        for at in range(0, len(short) if self.alphabet is not None else 0, 4096):
            rows = short[at : at + 4096]
            n = np.array([len(raw[i]) for i in rows])
            width = int(n.max()) + 1
            symbol = np.full((len(rows), width), -1, np.int64)
            symbol[np.arange(width) < n[:, None]] = self.alphabet[0][np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8)]
            symbol[np.arange(len(rows)), n - 1] = self.alphabet[1][[raw[i][-1] for i in rows]]
            rank = self._ranks(symbol[:, :-1], symbol[:, 1:])
            live = np.arange(len(rows))
            while len(live):
                k = rank.argmin(1)
                every = np.arange(len(live))
                best = rank[every, k]
                done = best == _FAR
                for r in np.flatnonzero(done).tolist():
                    out[rows[live[r]]] = symbol[r, : n[r]].tolist()
                if done.any():
                    symbol, rank, live, k, best, n = (x[~done] for x in (symbol, rank, live, k, best, n))
                    every = np.arange(len(live))
                if not len(live):
                    break
                # What stands behind the pair moves up by one; the pairs at the merged symbol are ranked anew.
                symbol[every, k] = self.result[best]
                move = np.arange(width - 1) + (np.arange(width - 1) > k[:, None])
                symbol = np.column_stack([np.take_along_axis(symbol, move, 1), np.full(len(live), -1)])
                move = np.arange(width - 2) + (np.arange(width - 2) >= k[:, None]) if width > 2 else np.zeros((len(live), 0), np.int64)
                rank = np.column_stack([np.take_along_axis(rank, move, 1), np.full(len(live), _FAR)])
                n = n - 1
                for side in (k - 1, k):
                    some = np.flatnonzero(side >= 0)
                    rank[some, side[some]] = self._ranks(symbol[some, side[some]], symbol[some, side[some] + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two symbols; far if there is none or either is missing (-1)."""
        at = self.pairs.find(((a.astype(np.uint64) << np.uint64(32)) | (b & 0xFFFFFFFF).astype(np.uint64)).ravel()).reshape(a.shape)
        return np.where((at >= 0) & (a >= 0) & (b >= 0), self.pair_rank[at], _FAR)

    def cut_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``propose`` of many words of up to ``LOCKSTEP`` bytes in step: tokens, the word of each in order, and which words have a cut."""
        size = np.array([len(w) for w in words])
        end = np.cumsum(size)
        data = np.frombuffer(b"".join(words), np.uint8)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _POWER)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUE[data] * power[:-1])])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _BACK)]))

        def find(index: HashIndex, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return index.find(mix64((sums[j] - sums[i]) * back[i] + (j - i).astype(np.uint64)))

        first = data.astype(np.int64) << 8
        first[:-1] |= data[1:]
        live, at = np.arange(len(words)), end - size
        good = np.ones(len(words), bool)
        tokens, owner = [], []
        while len(live):
            # Only the last token bears the suffix, and it must.
            hit = find(self.last[0], at, end[live])
            done = hit >= 0
            tokens.append(self.last[1][hit[done]]), owner.append(live[done])
            live, at = live[~done], at[~done]
            reach = np.minimum(end[live] - at - 1, self.reach_of[first[at]]) if len(live) else at
            token = np.full(len(live), -1, np.int64)
            left = np.flatnonzero(reach > 0)
            while len(left):
                hit = find(self.body[0], at[left], at[left] + reach[left])
                found = hit >= 0
                token[left[found]] = self.body[1][hit[found]]
                left = left[~found]
                reach[left] -= 1
                left = left[reach[left] > 0]
            good[live[token < 0]] = False
            live, at, token = live[token >= 0], (at + reach)[token >= 0], token[token >= 0]
            tokens.append(token), owner.append(live)
        tokens, owner = np.concatenate(tokens), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order], good

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair are compatible; pairs met before are remembered."""
        key, place = np.unique((a << 32) | b, return_inverse=True)
        known = self.known_pairs
        good = [known.get(k) for k in key.tolist()]
        new = np.array([k for k, g in enumerate(good) if g is None], np.int64)
        if len(new):
            fresh = self.compatible(key[new] >> 32, key[new] & 0xFFFFFFFF).tolist()
            if len(known) > 4 * CACHE_CHUNKS:
                known.clear()
            for k, g in zip(new.tolist(), fresh):
                good[k] = g
            known.update(zip(key[new].tolist(), fresh))
        return np.array(good, bool)[place]

    def words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word: proposals, one vectorised test of all pairs, merges where it fails."""
        raw = [w.encode() for w in words]
        short = [k for k, r in enumerate(raw) if len(r) <= LOCKSTEP]
        tokens, owner, good = self.cut_all([raw[k] for k in short]) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        out: list[list[int]] = [[] for _ in words]
        if len(short) < len(words):
            cuts = {k: self.propose(words[k]) for k, r in enumerate(raw) if len(r) > LOCKSTEP}
            pairs = [p for c in cuts.values() if c for p in zip(c, c[1:])]
            sound = dict(zip(pairs, self.verified(*np.array(pairs, np.int64).T).tolist())) if pairs else {}
            for k, c in cuts.items():
                out[k] = c if c is not None and all([sound[p] for p in zip(c, c[1:])]) else self.merge(words[k])
        if short:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            good[owner[inner[~self.verified(tokens[inner], tokens[inner + 1])]]] = False
            edge = np.searchsorted(owner, np.arange(len(short) + 1)).tolist()
            flat = tokens.tolist()
            for n, (k, g) in enumerate(zip(short, good.tolist())):
                if g:
                    out[k] = flat[edge[n] : edge[n + 1]]
            failing = [short[n] for n in np.flatnonzero(~good).tolist()]
            for k, ids in zip(failing, self.merge_all([words[k] for k in failing])):
                out[k] = ids
        return out

    def pieces(self, text: str) -> list[str]:
        """Text between white space; an added token is a piece of its own, marked by a leading blank."""
        if self.added_pattern is None or "<|" not in text or not self.added_pattern.search(text):
            return self._pieces(text)
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += self._pieces(text[at : m.start()]) + [" " + m.group()]
            at = m.end()
        return out + self._pieces(text[at:])

    @staticmethod
    def _pieces(text: str) -> list[str]:
        return [p for p in _SPACE_RUN.split(text) if p] if _ODD.search(text) else text.split()

    def normal(self, piece: str) -> str:
        """NFC and lower case; no white space composes with its neighbours, so pieces can be normalised apart. Added tokens stay as they are."""
        if piece.isascii():
            return piece if piece[0] == " " else piece.lower()
        if self.unknown.search(piece):
            return self._library_form(piece)
        if not unicodedata.is_normalized("NFC", piece):
            piece = unicodedata.normalize("NFC", piece)
        # Lower case goes by single characters: no final sigma.
        return piece.replace("Σ", "σ").lower()

    def _library_form(self, text: str) -> str:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.text).normalizer
        return self._library.normalize_str(text)

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.cache.clear()
            new = list(pieces)
        # A piece of letters alone is a word; letters that this Python does not know are no letters to it.
        split = [[p] if p.isalpha() or p[0] == " " else self.split.findall(p) for p in map(self.normal, new)]
        words = list({w for s in split for w in s if w[0] != " "})
        one = self.one
        made = {w: tuple([one[i] for i in ids]) for w, ids in zip(words, self.words(words))}
        made.update({" " + a: (one[i],) for a, i in self.added.items()})
        cache = self.cache
        for p, s in zip(new, split):
            cache[p] = made[s[0]] if len(s) == 1 else tuple([i for w in s for i in made[w]])

    def ids(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text."""
        cut = [self.pieces(t) for t in texts]
        # Nothing here makes cycles: the collector would only walk what is about to be kept or freed.
        gc.disable()
        try:
            self.learn(set().union(*cut) if cut else set())
        finally:
            gc.freeze()
            gc.enable()
        cache = self.cache
        for pieces in cut:
            yield list(chain.from_iterable([cache[p] for p in pieces]))

    def decimal(self, ids: list[int]) -> str:
        return " ".join([self.number[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, decimal ids joined by a blank, decoded text."""
        for ids in self.ids(texts):
            yield len(ids), self.decimal(ids), self.decode(ids)


_LOADED: dict[int, Bpe] = {}
#: Output columns and their types.
COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode and decode every text with the tokenizer file; ``columns`` are chosen from ``COLUMNS``.

    ``ids_sha256`` hashes the decimal ids joined by one blank, ``decoded_sha256`` the decoded text
    in UTF-8. The file is read once, on the driver, and broadcast (its size does not depend on data).
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), character_tables()))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value[0])
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Bpe(*spec.value)
        bpe = _LOADED[key]
        for batch in batches:
            release_memory()
            data, offsets = strings(batch.column(1))
            for i, j in slices(offsets):
                raw = data[offsets[i] : offsets[j]].tobytes()
                ends = (offsets[i : j + 1] - offsets[i]).tolist()
                out: dict[str, list] = {c: [] for c in columns}
                for ids in bpe.ids([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]):
                    for c in columns:
                        out[c].append(
                            len(ids) if c == "n_tokens" else ids if c == "ids" else bpe.decode(ids) if c == "decoded"
                            else hashlib.sha256((bpe.decimal(ids) if c == "ids_sha256" else bpe.decode(ids)).encode()).hexdigest()
                        )
                types = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(out[c], types[COLUMNS[c]]) for c in columns)], names=[doc_id, *columns])

    schema = f"`{doc_id}` {id_type}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)
