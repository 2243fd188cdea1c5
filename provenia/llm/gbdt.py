"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from vectorised passes over the bytes of whole texts. Trees are grown on the
driver from at most ``SAMPLE_ROWS`` labelled rows (a documented bound; the rows with the smallest hash
of the id, an id once, with its statistics of the smallest hash), with binned features, logistic loss and a fixed depth, and are flattened into arrays:
scoring walks all rows of a batch through a tree one level at a time.

Cases: a null text counts as empty; an empty text gets the score of all-zero statistics; labels that
repeat are averaged, null labels and labels without a document are left out; without any label the
score is 0.5; repeated rows repeat; an empty table gives an empty table. Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import words
from .common import crc_mod, slices, strings

SAMPLE_ROWS = 20_000
BINS = 64
FEATURES = (
    "bytes", "words", "lines", "mean_word", "spread_word", "long_words", "short_words", "upper", "digit", "punctuation", "symbol", "wide", "space", "newline",
    "bar", "bang", "distinct_words", "distinct_pairs", "distinct_bytes", "top_word", "same_next", "same_after_next", "words_per_line", "stops",
)
_CLASS = np.zeros((256, 9), np.int64)
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
for _c in b".,;:?!'\"()-":
    _CLASS[_c, 2] = 1
for _c in b"#$%&*|@^~<>=+/\\_{}[]`":
    _CLASS[_c, 3] = 1
_CLASS[128:, 4] = 1
_CLASS[[9, 11, 12, 13, 32], 5] = 1
_CLASS[10, 6] = 1
_CLASS[ord("|"), 7] = 1
_CLASS[ord("!"), 8] = 1


def _per_doc(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=docs)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    docs = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    byte_doc = np.repeat(np.arange(docs), np.diff(offsets))
    table = np.bincount(byte_doc * 256 + data, minlength=docs * 256).reshape(docs, 256) if len(data) else np.zeros((docs, 256))
    shares = (table @ _CLASS) / np.maximum(size, 1)[:, None]
    w = words(data, offsets)
    n = w.per_doc.astype(float)
    length = (w.end - w.start).astype(float)
    some, lines = np.maximum(n, 1), table[:, 10] + (size > 0)
    mean = _per_doc(length, w.doc, docs) / some
    spread = np.sqrt(np.maximum(_per_doc(length**2, w.doc, docs) / some - mean**2, 0))
    share = lambda mask: _per_doc(mask.astype(float), w.doc, docs) / some

    def distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(key):
            return np.zeros(docs), np.zeros(docs)
        # Document in the high bits, so that one sort groups both.
        bits = max(1, int(docs).bit_length())
        mixed = np.sort((doc.astype(np.uint64) << np.uint64(64 - bits)) | (key >> np.uint64(bits)))
        new = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
        owner = (mixed[new] >> np.uint64(64 - bits)).astype(np.int64)
        most = np.zeros(docs)
        np.maximum.at(most, owner, np.diff(np.append(new, len(mixed))))
        return np.bincount(owner, minlength=docs).astype(float), most

    kinds, top = distinct(w.hash, w.doc)
    follows = lambda k: np.concatenate([(w.doc[k:] == w.doc[:-k]) & (w.hash[k:] == w.hash[:-k]), np.zeros(min(k, len(w.doc)), bool)]) if len(w.doc) > k else np.zeros(len(w.doc), bool)
    if len(w.doc) > 1:
        inside = w.doc[1:] == w.doc[:-1]
        pairs, _ = distinct((w.hash[:-1] * np.uint64(3) + w.hash[1:])[inside], w.doc[:-1][inside])
    else:
        pairs = np.zeros(docs)
    last = LAST_BYTE[w.data[w.end - 1]] if len(w.end) else np.zeros(0, bool)
    columns = [
        np.log1p(size), np.log1p(n), np.log1p(lines), mean, spread, share(length >= 15), share(length <= 3), *shares.T, kinds / some, pairs / np.maximum(n - 1, 1),
        (table > 0).sum(1), top / some, share(follows(1)), share(follows(2)), n / np.maximum(lines, 1), share(last),
    ]
    return np.column_stack(columns).astype(np.float32)


LAST_BYTE = np.zeros(256, bool)
LAST_BYTE[list(b".,!?;")] = True


@dataclass
class Forest:
    """Trees as arrays of one length each: a node's feature, threshold and left child; leaves have feature -1."""

    start: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                at = np.where(inner, self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at]), at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, l2: float = 1.0, least: float = 5.0) -> Forest:
    """Boosted trees of logistic loss; ``y`` lies in 0..1. Each split takes the best gain over binned features."""
    none = np.zeros(0, np.int64)
    if not len(x):
        return Forest(0.0, depth, none, none, np.zeros(0), none, np.zeros(0))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_1 / (1 - rate_1)))
    margin = np.full(len(x), start)
    roots, feature, threshold, left, value = [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        base = len(feature)
        roots.append(base)
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        at = np.full(len(x), base)
        level = [base]
        for d in range(depth + 1):
            number = {node: k for k, node in enumerate(level)}
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            own = slot[at]
            live = own >= 0
            sums_g, sums_h = (np.bincount(own[live], weights=v[live], minlength=len(level)) for v in (g, h))
            best = np.full(len(level), 1e-6)
            choice = [(-1, 0)] * len(level)
            if d < depth:
                for f in range(x.shape[1]):
                    key = own[live] * BINS + binned[live, f]
                    cg, ch = (np.cumsum(np.bincount(key, weights=v[live], minlength=len(level) * BINS).reshape(-1, BINS), 1)[:, :-1] for v in (g, h))
                    rg, rh = sums_g[:, None] - cg, sums_h[:, None] - ch
                    gain = cg**2 / (ch + l2) + rg**2 / (rh + l2) - (sums_g**2 / (sums_h + l2))[:, None]
                    gain[(ch < least / 4) | (rh < least / 4)] = 0
                    cut = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(len(level)), cut] > best):
                        if cut[k] < len(edges[f]):
                            best[k], choice[k] = gain[k, cut[k]], (f, int(cut[k]))
            following = []
            for node, k in number.items():
                f, cut = choice[k]
                if f < 0:
                    value[node] = rate * sums_g[k] / (sums_h[k] + l2)
                    continue
                feature[node], threshold[node], left[node] = f, float(edges[f][cut]), len(feature)
                for _ in range(2):
                    following.append(len(feature))
                    feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
            f, t, l = np.array(feature), np.array(threshold), np.array(left)
            moving = live & (f[at] >= 0)
            at[moving] = l[at[moving]] + (x[moving, f[at[moving]]] > t[at[moving]])
            level = following
            if not level:
                break
        margin += np.array(value)[at]
    return Forest(start, depth, np.array(roots), np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(value))


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for i, j in slices(offsets, 1 << 20):
            yield batch.column(0).slice(i, j - i), statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, rows: int = SAMPLE_ROWS) -> Forest:
    """Grow the trees from labelled documents whose id's crc32 modulo ``folds`` is not 0."""
    chosen = (
        labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y"))
        .filter(F.col("__y").isNotNull() & F.col("__id").isNotNull() & (crc_mod(F.col("__id"), folds) != 0))
        .groupBy("__id").agg(F.avg("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, x in _matrix(iter([batch.select([0, 2])])):
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(at, len(x)), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "y", "x"])
                at += len(x)

    # The chosen rows are ``rows`` at most: an id and a number each. What is gathered are statistics, one row for each id.
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    id_type = docs.schema[doc_id].dataType.simpleString()
    each = sample.select("__id", "__y", "__text").mapInArrow(run, f"id {id_type}, y double, x array<float>")
    table = each.groupBy("id").agg(F.min_by(F.struct("y", "x"), F.xxhash64("x")).alias("s")).select("s.y", "s.x").toArrow()
    if not table.num_rows:
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    y = table.column("y").to_numpy()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    order = np.lexsort((y, *x.T))
    return grow(x[order], y[order])


def score(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and ``score`` (0 to 1) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrix(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(shared.value.probability(x))], names=[doc_id, "score"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"`{doc_id}` {id_type}, score double")


def keep(docs: DataFrame, forest: Forest, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(at))
            for i, j in slices(offsets, 1 << 20):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield batch.slice(i, j - i).filter(pa.array(shared.value.probability(x) >= least))

    return docs.mapInArrow(run, docs.schema)
