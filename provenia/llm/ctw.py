"""Language-model scoring by context-tree weighting over bytes.

Texts are lower-cased (A-Z) and split into words; the modelled byte string is the words joined by
one space and closed by one newline. Each byte is decomposed into eight binary decisions. A tree
node is (the last d bytes, the bits of this byte so far); every node keeps Krichevsky-Trofimov
counts and the tree mixes the estimates of all depths 0..``depth`` with the weighting recursion
``Pw = (Pe + product of the children's Pw) / 2``. Statistics are frozen after training, so the
mixture along a path is computed once for each node.

Every context that training saw counts, so the model grows with the corpus; it lies in tables in the
shared folder. What lies below one context of ``BRANCH`` bytes is a branch: a task takes whole
branches, sorted, and weighs them with numpy. A branch has at most 256 ** (depth - BRANCH + 1)
different byte strings, whatever the corpus. The few levels above are weighted by joins; only nodes of
contexts shorter than ``BRANCH`` - 1 bytes, 65,791 at most, are broadcast.

For scoring, texts are cut into blocks. A block asks for its distinct words and byte strings, packed by
bucket (of words, or of branches); the task of a bucket weighs its branches and answers; the block is
scored with its answers. Byte strings that training did not see are answered by the deepest node of
their path. Buckets are as many as the session's shuffle partitions.

Cases: a null or empty text is the closing newline alone; a null id counts as the empty string
for the split (held out); repeated rows are scored, and counted, once each; with an empty training
set every bit has probability 1/2. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import HashIndex, Words, mix64, unique_counts, words
from .common import crc_mod, drop_written, release_memory, slices, strings, written

DEPTH = 5
#: Bytes of context that make a branch.
BRANCH = 3
#: Rows of branches that are weighed at once, more only where one branch has more.
BRANCH_ROWS = 1 << 17
#: Bytes of text whose words and byte strings are looked up, and which one task gets to score, at once.
BLOCK_BYTES = 32 << 20
#: Bytes of text that are scored at once: each takes some 40 bytes meanwhile.
SCORE_BYTES = 1 << 19
#: Parts of a context of ``BRANCH`` - 1 bytes that lie in different buckets.
SPREAD = 8
SMOOTHING = 0.1
_NEWLINE, _BLANK = 10, 32
_TOKEN, _GRAM = 0, 1
#: The token that closes every text.
END = int(mix64(np.array([2**63 + 10], np.uint64))[0])
_FLUSH = 3_000_000
#: Bits for the number of a part within its task.
_PART = 36
_LN_HALF = float(np.log(0.5))


def _stream(w: Words, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The modelled bytes, ``depth`` newlines before each text, which of them count, and text offsets."""
    docs = len(w.offsets) - 1
    size = w.end - w.start + 1
    body = np.bincount(w.doc, weights=size, minlength=docs).astype(np.int64)
    body[body == 0] = 1
    base = np.concatenate([[0], np.cumsum(body + depth)])
    out = np.full(base[-1], _NEWLINE, np.uint8)
    if len(size):
        before = np.cumsum(size) - size
        first = np.flatnonzero(np.concatenate([[True], w.doc[1:] != w.doc[:-1]]))
        inside = before - np.repeat(before[first], np.diff(np.append(first, len(size))))
        at = base[w.doc] + depth + inside
        place = np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
        out[np.repeat(at, size - 1) + place] = w.data[np.repeat(w.start, size - 1) + place]
        last = np.concatenate([w.doc[1:] != w.doc[:-1], [True]])
        out[(at + size - 1)[~last]] = _BLANK
    counts = np.ones(len(out), bool)
    for j in range(depth):
        counts[base[:-1] + j] = False
    return out, counts, np.concatenate([[0], np.cumsum(body)])


def _grams(w: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(depth + 1)-byte strings ending at each modelled byte, and the offsets of texts among them."""
    out, counts, offsets = _stream(w, depth)
    key = out.astype(np.uint64)
    for j in range(1, depth + 1):
        key[j:] |= out[:-j].astype(np.uint64) << np.uint64(8 * j)
    return key[counts], offsets


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return unique_counts(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def _rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 1 << 16):
        k = keys[i : i + (1 << 16)].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + (1 << 16)])], names=["kind", "key", "n"])


def _counter(depth: int):
    def emit(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for kind, parts in held.items():
            if parts:
                yield from _rows(kind, *_merge(parts))
                parts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {_TOKEN: [], _GRAM: []}
        size = 0
        for batch in batches:
            data, offsets = strings(batch.column(0))
            for i, j in slices(offsets):
                w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                tokens, n = unique_counts(w.hash)
                held[_TOKEN] += [(tokens, n), (np.array([END], np.uint64), np.array([j - i]))]
                held[_GRAM].append(unique_counts(_grams(w, depth)[0]))
                size += len(tokens) + len(held[_GRAM][-1][0])
                if size > _FLUSH:
                    for kind in held:
                        held[kind] = [_merge(held[kind])]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > _FLUSH // 2:
                        yield from emit(held)
                        size = 0
        yield from emit(held)
        held.clear()
        release_memory()

    return count


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; error below 1e-12."""
    x = np.asarray(x, float)
    low = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    half = 0.5723649429247001  # ln gamma(1/2)
    return _ln_gamma(np.add(n0, 0.5)) + _ln_gamma(np.add(n1, 0.5)) - 2 * half - _ln_gamma(np.add(n0, n1) + 1.0)


def _ln_gamma_of(x: Column) -> Column:
    """``_ln_gamma`` as a column."""
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(reduce(lambda a, k: a * (x + k), range(1, 8), x))


def _kt_log_of(n0: Column, n1: Column) -> Column:
    half = 0.5723649429247001
    return _ln_gamma_of(n0 + 0.5) + _ln_gamma_of(n1 + 0.5) - F.lit(2 * half) - _ln_gamma_of(n0 + n1 + 1.0)


def branch_depth(depth: int) -> int:
    return min(BRANCH, depth)


#: A byte string's node at one bit of its last byte, as (context, bits so far), and its bit there.
_NODE = "(shiftleft(shiftright(key, 8), 8) | shiftleft(1L, bit) | shiftright(key & 255L, 8 - bit))"
_BIT = "(shiftright(key & 255L, 7 - bit) & 1L)"


def _mask(depth: int) -> int:
    """Keeps ``depth`` bytes of a node's context, and its bits."""
    return (1 << (8 * (depth + 1))) - 1


def _up(depth: int) -> Column:
    """The node's parent at ``depth``: the context without its earliest byte."""
    return F.col("node").bitwiseAND(F.lit(_mask(depth)).cast("long"))


def _steps(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For byte strings the eight nodes of the last byte at full depth, and the bits taken there."""
    last, bit = keys & np.uint64(255), np.arange(8, dtype=np.uint64)
    prefix = (np.uint64(1) << bit) | (last[:, None] >> (np.uint64(8) - bit))
    return (keys & ~np.uint64(255))[:, None] | prefix, ((last[:, None] >> (np.uint64(7) - bit)) & np.uint64(1)).astype(np.int8)


@dataclass
class _Level:
    """Nodes of one depth, sorted: counts, log of the weighted probability, place of the parent above."""

    node: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    estimate: np.ndarray
    weighted: np.ndarray
    parent: np.ndarray | None = None


def _weigh(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[_Level]:
    """Levels ``top``..``depth`` of the tree over whole branches of counted byte strings."""
    nodes, one = _steps(keys)
    node, place = np.unique(nodes.ravel(), return_inverse=True)
    n1 = np.bincount(place, weights=(one * n[:, None]).ravel(), minlength=len(node))
    n0 = np.bincount(place, weights=np.repeat(n, 8), minlength=len(node)) - n1
    estimate = kt_log(n0, n1)
    levels = [_Level(node, n0, n1, estimate, estimate)]
    for d in range(depth - 1, top - 1, -1):
        low = levels[0]
        node, low.parent = np.unique(low.node & np.uint64(_mask(d)), return_inverse=True)
        n0, n1, children = (np.bincount(low.parent, weights=x, minlength=len(node)) for x in (low.n0, low.n1, low.weighted))
        estimate = kt_log(n0, n1)
        levels.insert(0, _Level(node, n0, n1, estimate, np.logaddexp(estimate, children) + _LN_HALF))
    return levels


def _zeros(levels: list[_Level], mixed: np.ndarray, remains: np.ndarray) -> list[np.ndarray]:
    """P(bit = 0) of each node on the path up to it, from what lies above the first level."""
    out = []
    for k, x in enumerate(levels):
        deepest = k == len(levels) - 1
        if k:
            mixed, remains = mixed[x.parent], remains[x.parent]
        weight = 1.0 if deepest else np.exp(_LN_HALF + x.estimate - x.weighted)
        mixed, remains = mixed + remains * weight * (x.n0 + 0.5) / (x.n0 + x.n1 + 1), remains * (1 - weight)
        # Beyond the node nothing was seen: the estimate of no counts, 1/2.
        out.append(np.clip(mixed + remains * 0.5, 1e-12, 1 - 1e-12))
    return out


def _whole_branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by branch (first column), regrouped so that no branch is cut."""
    held, size = [], 0
    for batch in batches:
        held, size = [*held, batch], size + batch.num_rows
        if size >= BRANCH_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            branch = table.column(0).to_numpy()
            cut = int(np.searchsorted(branch, branch[-1]))
            if cut:
                yield table.slice(0, cut)
                held, size = table.slice(cut).combine_chunks().to_batches(), len(branch) - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _weigher(depth: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_branches(batches):
            x = _weigh(table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy(), depth, top)[0]
            yield pa.RecordBatch.from_arrays([pa.array(x.node.view(np.int64)), *map(pa.array, (x.n0, x.n1, x.weighted))], names=["node", "n0", "n1", "below"])
            del table, x
        release_memory()

    return run


def _by_branch(rows: DataFrame, top: int) -> DataFrame:
    """Rows (key, ...) of byte strings with their branch first, whole branches together and sorted."""
    branch = F.expr(f"shiftright(key, 8) & {(1 << (8 * top)) - 1}L").alias("branch")
    return rows.select(branch, *rows.columns).repartition("branch").sortWithinPartitions("branch")


def build(grams: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The frozen tree above the branches, of all counted byte strings (key, n).

    Gives the nodes above (depth, node, zero: P(bit = 0) on the path up to this node) and, for each
    node at which a branch begins, what the path above it leaves (node, mixed, remains).
    """
    top = branch_depth(depth)
    n0, n1, half = F.col("n0"), F.col("n1"), F.lit(_LN_HALF)
    levels = [written(_by_branch(grams, top).mapInArrow(_weigher(depth, top), "node long, n0 double, n1 double, below double"), "ctw-branches")]
    for d in range(top - 1, -1, -1):
        nodes = levels[0].groupBy(_up(d).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("children")).withColumn("pe", _kt_log_of(n0, n1))
        high, least = F.greatest("pe", "children"), F.least("pe", "children")
        levels.insert(0, written(nodes.select("node", "n0", "n1", "pe", (high + F.log1p(F.exp(least - high)) + half).alias("below")), "ctw-up"))
    above, down = None, []
    for d, nodes in enumerate(levels):
        if above is None:
            nodes = nodes.withColumns({"mixed": F.lit(0.0), "remains": F.lit(1.0)})
        else:
            nodes = nodes.withColumn("parent", _up(d - 1)).join(above.select(F.col("node").alias("parent"), "mixed", "remains"), "parent")
        if d < top:
            weight = F.exp(half + F.col("pe") - F.col("below"))
            nodes = nodes.select("node", (F.col("mixed") + F.col("remains") * weight * (n0 + 0.5) / (n0 + n1 + 1)).alias("mixed"), (F.col("remains") * (1 - weight)).alias("remains"))
        above = written(nodes.select("node", "mixed", "remains"), "ctw-down")
        if d < top:
            zero = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("mixed") + F.col("remains") * 0.5))
            down.append(above.select(F.lit(d).alias("depth"), "node", zero.alias("zero")))
    drop_written(*levels)
    return reduce(DataFrame.unionByName, down), above


@dataclass
class Fit:
    depth: int
    #: Counts of byte strings (key, n) and words (key, n), the tree above the branches, and what is left at each branch.
    grams: DataFrame
    words: DataFrame
    nodes: DataFrame
    starts: DataFrame
    tokens: int
    vocabulary: int


def fit(train: DataFrame, text: str = "text", depth: int = DEPTH) -> Fit:
    """Count words and byte strings of all training texts, then weigh the tree; two sums come to the driver. Depths are 1 to 6."""
    if not 1 <= depth <= 6:
        raise ValueError("a byte string of the context and one byte must fit seven bytes")
    counted = train.select(F.col(text)).mapInArrow(_counter(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = written(counted, "ctw-counts")
    words_, grams = (counts.filter(F.col("kind") == k).select("key", "n") for k in (_TOKEN, _GRAM))
    tokens, vocabulary = words_.agg(F.sum("n"), F.count("*")).first()
    return Fit(depth, grams, words_, *build(grams, depth), tokens or 0, vocabulary)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deals consecutive rows into parts of a block at most; the number of the task stands above ``_PART`` bits."""
    context = TaskContext.get()
    base = context.partitionId() << _PART if context else 0
    size = 0
    for batch in batches:
        _, offsets = strings(batch.column(1))
        part = base + (size + offsets[:-1]) // BLOCK_BYTES
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.diff(offsets)), batch.column(0), batch.column(1)], names=["part", "size", "id", "text"])
        size += int(offsets[-1])


def _bucket(kind: int, keys: np.ndarray, top: int, buckets: int) -> np.ndarray:
    """Words by hash; byte strings by their context of top - 1 bytes and a share of the byte before it."""
    if kind == _GRAM:
        context = keys >> np.uint64(8)
        low = np.uint64((1 << (8 * (top - 1))) - 1)
        keys = (context & low) * np.uint64(SPREAD) + ((context >> np.uint64(8 * (top - 1))) & np.uint64(255)) % np.uint64(SPREAD)
    return ((mix64(keys + np.uint64(kind)) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


#: What is brought to a bucket: counts and nodes first (role 0 to 3), then what blocks ask for.
_COUNT, _START, _NODE_ABOVE, _ASKED = 0, 1, 2, 3
_LOOKUP = "bucket int, role int, kind int, block long, key long, n long, mixed double, remains double, keys binary"


def _asked(depth: int, buckets: int):
    """Distinct words and byte strings of each block, packed by bucket; a block that two tasks read comes in two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[np.ndarray]]] = {}

        def emit(block: int) -> Iterator[pa.RecordBatch]:
            for kind, keys in held.pop(block).items():
                keys = np.unique(np.concatenate(keys))
                bucket = _bucket(kind, keys, branch_depth(depth), buckets)
                order = np.argsort(bucket, kind="stable")
                keys, bucket = keys[order], bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                rows = len(edge) - 1
                same = lambda x, t: pa.array(np.full(rows, x, t))
                gap = pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.float64())
                packed = pa.array([keys[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), same(_ASKED, np.int32), same(kind, np.int32), same(block, np.int64), *gap, packed], names=[x.split()[0] for x in _LOOKUP.split(", ")])

        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = strings(batch.column(1))
            edge = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1], [True]])) if len(numbers) else []
            for a, b in zip(edge[:-1], edge[1:]):
                for done in [x for x in held if x != numbers[a]]:
                    yield from emit(done)
                part = offsets[a : b + 1] - offsets[a]
                own = held.setdefault(int(numbers[a]), {_TOKEN: [np.array([END], np.uint64)], _GRAM: []})
                for i, j in slices(part):
                    w = words(data[offsets[a] + part[i] : offsets[a] + part[j]], part[i : j + 1] - part[i])
                    own[_TOKEN].append(unique_counts(w.hash)[0])
                    own[_GRAM].append(unique_counts(_grams(w, depth)[0])[0])
        for block in list(held):
            yield from emit(block)
        release_memory()

    return run


class _Bucket:
    """What training knows of the words and branches of one bucket."""

    def __init__(self, depth: int, role: np.ndarray, kind: np.ndarray, key: np.ndarray, n: np.ndarray, mixed: np.ndarray, remains: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]]):
        top = branch_depth(depth)
        own = (role == _COUNT) & (kind == _TOKEN)
        self.words, self.counts = HashIndex(key[own]), np.append(n[own], 0).astype(np.float64)
        own, start, upper = (role == _COUNT) & (kind == _GRAM), role == _START, role == _NODE_ABOVE
        node, first = np.unique(key[upper], return_index=True)
        # From the deepest level up: nodes and their P(bit = 0).
        self.levels = [(top - 1, node, mixed[upper][first]), *((d, *above[d]) for d in range(top - 2, -1, -1))]
        self.grams, self.log10 = HashIndex(key[own]), np.zeros(0)
        if own.any():
            levels = _weigh(key[own], n[own], depth, top)
            order = np.argsort(key[start])
            zeros = _zeros(levels, mixed[start][order], remains[start][order])
            self.levels = [*((d, x.node, z) for d, x, z in zip(range(depth, top - 1, -1), levels[::-1], zeros[::-1])), *self.levels]
            nodes, one = _steps(key[own])
            self.log10 = _log10(zeros[-1][np.searchsorted(levels[-1].node, nodes.ravel())], one)

    def answer(self, kind: int, keys: np.ndarray) -> np.ndarray:
        if kind == _TOKEN:
            return self.counts[self.words.find(keys)]
        at = self.grams.find(keys)
        out = np.append(self.log10, 0.0)[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            nodes, one = _steps(keys[new])
            nodes = nodes.ravel()
            zero, left = np.full(len(nodes), 0.5), np.arange(len(nodes))
            for d, node, z in self.levels:
                if len(node):
                    want = nodes[left] & np.uint64(_mask(d))
                    place = np.minimum(np.searchsorted(node, want), len(node) - 1)
                    found = node[place] == want
                    zero[left[found]] = z[place[found]]
                    left = left[~found]
            out[new] = _log10(zero, one)
        return out


def _log10(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 of each byte from P(bit = 0) at its eight nodes and the bits taken."""
    return np.log10(np.where(one.ravel() == 1, 1 - zero, zero)).reshape(-1, 8).sum(1)


def _answers(depth: int, above):
    """For each bucket, sorted by role: answers to what blocks ask (block, kind, keys, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, bucket = None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1], [True]])) if len(numbers) else []
            for a, b in zip(edge[:-1], edge[1:]):
                if numbers[a] != now:
                    now, held, bucket = numbers[a], [], None
                rows = batch.slice(a, b - a)
                role = rows.column(1).to_numpy(zero_copy_only=False)
                cut = int(np.searchsorted(role, _ASKED))
                if cut:
                    held.append(rows.slice(0, cut))
                if cut < len(role):
                    if bucket is None:
                        table = pa.Table.from_batches(held, batch.schema).combine_chunks()
                        column = [table.column(c).to_numpy() for c in ("role", "kind", "key", "n", "mixed", "remains")]
                        bucket = _Bucket(depth, column[0], column[1], column[2].astype(np.int64).view(np.uint64), column[3], column[4], column[5], above.value)
                        held = []
                    asked = rows.slice(cut)
                    kinds, keys = asked.column(2).to_numpy(zero_copy_only=False), [np.frombuffer(x, np.uint64) for x in asked.column(8).to_pylist()]
                    whole = {k: np.concatenate([x for x, y in zip(keys, kinds) if y == k] or [np.zeros(0, np.uint64)]) for k in (_TOKEN, _GRAM)}
                    values, at = {k: bucket.answer(k, x).astype(np.float32 if k == _GRAM else np.float64) for k, x in whole.items()}, {_TOKEN: 0, _GRAM: 0}
                    packed = []
                    for k, x in zip(kinds.tolist(), keys):
                        packed.append(values[k][at[k] : at[k] + len(x)].tobytes())
                        at[k] += len(x)
                    yield pa.RecordBatch.from_arrays([asked.column(3), asked.column(2), asked.column(8), pa.array(packed, pa.binary())], names=["block", "kind", "keys", "values"])
        held, bucket = [], None
        release_memory()

    return run


_SCORED = {"id": pa.int64(), "tokens": pa.int64(), "known": pa.int64(), "bytes": pa.int64(), "base": pa.float64(), "score": pa.float64()}


def _scorer(depth: int, tokens: int, vocabulary: int):
    """Scores the texts of a block with the answers to what it asked."""
    scale = np.log10(tokens + SMOOTHING * (vocabulary + 1))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        release_memory()
        index, value = {}, {}
        for kind, form in ((_TOKEN, np.float64), (_GRAM, np.float32)):
            own = answers.filter(pc.equal(answers.column("kind"), kind))
            keys, values = (np.frombuffer(b"".join(own.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("values", form)))
            keys, first = np.unique(keys, return_index=True)
            index[kind], value[kind] = HashIndex(keys), values[first].astype(np.float64)
        seen, log10 = value[_TOKEN] > 0, np.log10(value[_TOKEN] + SMOOTHING) - scale
        out = []
        for batch in texts.to_batches():
            data, offsets = strings(batch.column("text"))
            for i, j in slices(offsets, SCORE_BYTES):
                w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                docs = j - i
                grams, at = _grams(w, depth)
                total = np.add.reduceat(value[_GRAM][index[_GRAM].find(grams)], at[:-1])
                found = index[_TOKEN].find(np.concatenate([w.hash, np.full(docs, END, np.uint64)]))
                owner = np.concatenate([w.doc, np.arange(docs)])
                base, known = (np.bincount(owner, weights=x[found], minlength=docs) for x in (log10, seen))
                columns = [batch.column("id").slice(i, docs).cast(pa.int64()), *map(pa.array, (w.per_doc + 1, known.astype(np.int64), np.diff(at), base, total))]
                out.append(pa.RecordBatch.from_arrays(columns, names=list(_SCORED)))
        return pa.Table.from_batches(out, pa.schema(_SCORED))

    return score


def _known(rows: DataFrame, role: int, kind: int, *columns: str, salt: str | None = None) -> DataFrame:
    """Rows of the tree for the lookup (key or node, and the named columns); ``salt`` stands in the byte before the context."""
    key = F.col("node") if "node" in rows.columns else F.col("key")
    given = {c: F.col(c) if c in columns else F.lit(None) for c in ("n", "mixed", "remains")}
    return rows.select(F.lit(role).alias("role"), F.lit(kind).alias("kind"), key.alias("key"), *(v.cast("long" if c == "n" else "double").alias(c) for c, v in given.items()), (F.col(salt) if salt else F.lit(-1)).alias("salt"))


def _to_buckets(top: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role, kind, key, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 6))
            key = key.view(np.uint64)
            place = np.where(salt >= 0, key | (np.maximum(salt, 0).astype(np.uint64) << np.uint64(8 * top)), key)
            bucket = np.where(kind == _TOKEN, _bucket(_TOKEN, place, top, buckets), _bucket(_GRAM, place, top, buckets)).astype(np.int32)
            gap = pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *(batch.column(c) for c in (0, 1)), gap[0], *(batch.column(c) for c in (2, 3, 4, 5)), gap[1]], names=[x.split()[0] for x in _LOOKUP.split(", ")])

    return run


def score(docs: DataFrame, fitted: Fit, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: id, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte."""
    spark, top = docs.sparkSession, branch_depth(fitted.depth)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_blocks, "part long, size long, id long, text string"), "ctw-blocks", "zstd")
    size, tasks = parts.agg(F.sum("size"), F.max("part")).first()
    # Small parts of neighbouring tasks make one block.
    join = max(1, BLOCK_BYTES * ((tasks >> _PART) + 1) // max(size, 1)) if size else 1
    block = F.expr(f"shiftleft(shiftright(part, {_PART}) div {join}L, {_PART}) | (part & {(1 << _PART) - 1}L)").alias("block")
    blocks = parts.select(block, "id", "text")
    asked = blocks.select("block", "text").mapInArrow(_asked(fitted.depth, buckets), _LOOKUP)
    above = []
    for d in range(top - 1):
        table = fitted.nodes.filter(F.col("depth") == d).select("node", "zero").toArrow()
        order = np.argsort(node := table.column(0).to_numpy().view(np.uint64))
        above.append((node[order], table.column(1).to_numpy()[order]))
    rows = [_known(fitted.words, _COUNT, _TOKEN, "n"), _known(fitted.grams, _COUNT, _GRAM, "n"), _known(fitted.starts, _START, _GRAM, "mixed", "remains")]
    salted = fitted.nodes.filter(F.col("depth") == top - 1).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows.append(_known(salted.withColumn("mixed", F.col("zero")), _NODE_ABOVE, _GRAM, "mixed", salt="salt"))
    known = reduce(DataFrame.unionByName, rows).mapInArrow(_to_buckets(top, buckets), _LOOKUP)
    sorted_ = known.unionByName(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", "role")
    answers = sorted_.mapInArrow(_answers(fitted.depth, spark.sparkContext.broadcast(above)), "block long, kind int, keys binary, values binary")
    schema = "id long, tokens long, known long, bytes long, base double, score double"
    rows = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(fitted.depth, fitted.tokens, fitted.vocabulary), schema)
    return rows.select(
        F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(fitted.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("score"), (-F.col("score") * F.lit(float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte"),
    )


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Fit on texts whose id's crc32 modulo ``folds`` is not 0, score all; ``held_out`` marks the others."""
    fitted = fit(docs.filter(crc_mod(F.col(doc_id), folds) != 0), text)
    out = score(docs, fitted, doc_id, text)
    return out.withColumn("held_out", crc_mod(F.col("doc_id"), folds) == 0)
