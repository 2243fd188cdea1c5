"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``MATCH`` tokens (running Karp-Rabin hashes of token hashes); seeds that a text
shares with a benchmark item are joined through an exact index. For a text and an item whose seeds
can cover enough of the item, the longest non-overlapping matches are marked repeatedly until no
match of ``MATCH`` tokens is left, and the marked share of the item is its coverage. Tiles may come
in any order, so reordered passages count.

Tokens are runs of letters and digits, lower-cased (A-Z); other non-ASCII bytes count as letters.
The benchmark is read in blocks of about ``BLOCK_BYTES`` and an item; one block at a time lies on the
driver and is broadcast, all texts pass it, and what they found is written before the next block. An
item with fewer tokens than ``MATCH`` is its own single seed. Seeds that repeat, in a text and in an
item, are first counted once each; only pairs that can reach the coverage are expanded, a bounded
number of hits at a time, and hits on one diagonal become one match.

Cases: null or empty texts and items have no tokens and never match; texts of any length are read
whole; equal coverages go to the smaller item id; items of null id are skipped; repeated rows repeat;
an empty table or benchmark gives rows without matches. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import HashIndex, mix64, words
from .common import slices, strings, written

MATCH = 4
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
#: Seed hits of a text and an item that are expanded at once.
HITS = 1 << 18
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def seed_hashes(token: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all runs of ``size`` tokens inside one text, and where they start."""
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _ROLL + token[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix64(out[at] + np.uint64(size)), at


def diagonals(t: np.ndarray, start: np.ndarray, stop: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Matches (text place, item place, seeds in a row) from seed hits.

    A text place ``t`` (ascending) hits the item at ``place[start:stop]``. Hits on a diagonal without
    gaps are one match; expansions of ``HITS`` at most are joined where they meet.
    """
    many = stop - start
    upto = np.cumsum(many)
    runs, a = [], 0
    while a < len(t):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, side="right")))
        n = many[a:b]
        post = np.repeat(start[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        x, p = np.repeat(t[a:b], n), place[post]
        order = np.lexsort((x, x - p))
        x, p = x[order], p[order]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1] + 1) | (p[1:] != p[:-1] + 1)]))
        runs.append(np.column_stack([x[new], p[new], np.diff(np.append(new, len(x)))]))
        a = b
    if not runs:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(runs)
    if a and len(runs):
        runs = runs[np.lexsort((runs[:, 0], runs[:, 0] - runs[:, 1]))]
        meets = (runs[1:, 0] == runs[:-1, 0] + runs[:-1, 2]) & (runs[1:, 1] == runs[:-1, 1] + runs[:-1, 2])
        first = np.flatnonzero(np.concatenate([[True], ~meets]))
        runs = np.column_stack([runs[first, 0], runs[first, 1], np.add.reduceat(runs[:, 2], first)])
    return runs


def tile(matches: np.ndarray, size: int, length: int) -> tuple[int, int]:
    """Greedy string tiling from matches (text place, item place, seeds) with an item of ``length`` tokens: marked tokens, tiles.

    The longest match comes first, ties by item and text place; what an earlier tile has taken is cut
    out of it, and the rests go back in line, until fewer tokens of the item are free than a match has.
    """
    line = [(-(n + size - 1), p, t) for t, p, n in matches.tolist()]
    heapq.heapify(line)
    item: set[int] = set()
    text: set[int] = set()
    tiles = 0
    while line and length - len(item) >= size:
        n, p, t = heapq.heappop(line)
        free = [k for k in range(-n) if p + k not in item and t + k not in text]
        if len(free) == -n:
            item.update(range(p, p - n))
            text.update(range(t, t - n))
            tiles += 1
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= size:
                    heapq.heappush(line, (-(k - start), p + free[start], t + free[start]))
                start = k
    return len(item), tiles


class Items:
    """Benchmark items: their seeds with postings (item number, place), by seed length."""

    def __init__(self, ids: list[int], texts: list[str], match: int):
        self.ids = ids
        raw = [(x or "").encode() for x in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        w = words(np.frombuffer(b"".join(raw), np.uint8), offsets, _BREAK)
        self.length = w.per_doc
        first = np.concatenate([[0], np.cumsum(self.length)])
        self.seeds = []
        for size in sorted({min(int(n), match) for n in self.length if n}):
            key, at = seed_hashes(w.hash, w.doc, size)
            item = w.doc[at]
            own = np.minimum(self.length[item], match) == size
            key, at, item = key[own], at[own], item[own]
            order = np.lexsort((at, item, key))
            key, place, item = key[order], (at - first[item])[order], item[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            # Of each seed the items that have it, and of each such pair its places in the item.
            pair = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (item[1:] != item[:-1])]))
            self.seeds.append((size, HashIndex(key[new]), np.append(np.searchsorted(pair, new), len(pair)), item[pair], np.append(pair, len(key)), place))


def _covered(data: np.ndarray, offsets: np.ndarray, items: Items, coverage: float) -> tuple[np.ndarray, dict[int, list[tuple[float, int, int]]]]:
    """Tokens of each text; by text the items with enough coverage: (coverage, item id, tiles)."""
    w = words(data, offsets, _BREAK)
    found: dict[int, list[tuple[float, int, int]]] = {}
    for size, index, start, item, places, place in items.seeds:
        key, at = seed_hashes(w.hash, w.doc, size)
        hit = index.find(key)
        some = np.flatnonzero(hit >= 0)
        if not len(some):
            continue
        hit, at = hit[some], at[some]
        # Every seed of a text once: the places that it has in an item bound the coverage from above.
        order = np.lexsort((at, hit, w.doc[at]))
        hit, at, doc = hit[order], at[order], w.doc[at[order]]
        new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1]) | (doc[1:] != doc[:-1])]))
        times = np.diff(np.append(new, len(hit)))
        many = start[hit[new] + 1] - start[hit[new]]
        own = np.repeat(np.arange(len(new)), many)
        link = np.arange(int(many.sum())) + np.repeat(start[hit[new]] - (np.cumsum(many) - many), many)
        pair = doc[new][own] * len(items.ids) + item[link]
        order = np.argsort(pair, kind="stable")
        pair, own, link = pair[order], own[order], link[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])), len(pair))
        held = np.add.reduceat(places[link + 1] - places[link], edge[:-1])
        need = coverage * items.length[item[link[edge[:-1]]]]
        for k in np.flatnonzero(held * size >= need).tolist():
            seeds, posts = own[edge[k] : edge[k + 1]], link[edge[k] : edge[k + 1]]
            n = times[seeds]
            t = at[np.repeat(new[seeds] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            first, last = np.repeat(places[posts], n), np.repeat(places[posts + 1], n)
            order = np.argsort(t, kind="stable")
            i, d = int(item[posts[0]]), int(doc[new[seeds[0]]])
            marked, tiles = tile(diagonals(t[order], first[order], last[order], place), size, int(items.length[i]))
            if marked >= need[k]:
                found.setdefault(d, []).append((marked / int(items.length[i]), items.ids[i], tiles))
    return w.per_doc, found


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null")
    for row in rows.toLocalIterator():
        ids.append(row["i"]), texts.append(row["t"])
        size += len(row["t"])
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_STATE = "n_tokens long, n_items long, best_item long, best_coverage double, best_tiles long"


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, match: int = MATCH
) -> DataFrame:
    """One row for each text: id, n_tokens, n_items covered enough, best_item, best_coverage, best_tiles, contaminated."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = [x.split()[0] for x in _STATE.split(", ")]
    state = docs.select(F.col(doc_id), F.col(text).alias("__text"), *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _STATE.split(", ")))
    for items, last in _broadcast(docs, benchmark, item_id, item_text, match):

        def run(batches: Iterator[pa.RecordBatch], items=items, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = strings(batch.column(1))
                for i, j in slices(offsets):
                    n, found = _covered(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], items.value, coverage)
                    old = [batch.column(2 + c).slice(i, j - i).to_pylist() for c in range(1, 5)]
                    rows = list(zip(*old))
                    for d in range(j - i):
                        count, item, cover, tiles = rows[d]
                        own = [(-c, x, y) for c, x, y in found.get(d, ())] + ([(-cover, item, tiles)] if item is not None else [])
                        best = min(own, default=(None, None, None))
                        rows[d] = ((count or 0) + len(found.get(d, ())), best[1], -best[0] if own else None, best[2])
                    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))]
                    texts = [] if last else [batch.column(1).slice(i, j - i)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *texts, pa.array(n.astype(np.int64)), *columns], names=[doc_id, *(["__text"] if texts else []), *names])

        state = state.mapInArrow(run, f"`{doc_id}` {id_type}, " + ("" if last else "__text string, ") + _STATE)
        if not last:
            state = written(state, "tiling")
            items.destroy()
    return state.withColumn("contaminated", F.col("n_items") > 0)


def _broadcast(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, match: int):
    """Every block as a broadcast index, and whether it is the last; without items one empty block."""
    blocks = _blocks(benchmark, item_id, item_text)
    ahead = next(blocks, ([], []))
    while ahead is not None:
        ids, texts = ahead
        ahead = next(blocks, None)
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        yield docs.sparkSession.sparkContext.broadcast(Items([ids[k] for k in order], [texts[k] for k in order], match)), ahead is None


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, match: int = MATCH) -> DataFrame:
    """The rows of ``docs``, all columns, that cover no benchmark item enough; one pass for each block, no join."""
    at = docs.columns.index(text)
    out = docs
    for items, last in _broadcast(docs, benchmark, item_id, item_text, match):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = strings(batch.column(at))
                for i, j in slices(offsets):
                    _, found = _covered(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], items.value, coverage)
                    yield batch.slice(i, j - i).filter(pa.array([d not in found for d in range(j - i)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
        if not last:
            out = written(out, "tiling")
            items.destroy()
    return out
