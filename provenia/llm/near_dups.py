"""Near-duplicate groups by a MinHash LSH forest.

A document's set holds its distinct runs of ``shingle`` words (lower-cased A-Z; with fewer words the
whole sequence is one element). Documents with equal sets are one node. Every node gets
``FUNCTIONS`` MinHash values; each tree orders them by its own permutation of the functions. Nodes
that share the first ``DEPTH`` values of a tree lie in one region, sorted by the further values, so
that neighbours have the longest common prefixes: crowded regions are thus told apart by deeper
values, small ones by none. Neighbours are candidates. Candidates whose signatures agree enough are
confirmed on their full sets; links form components.

The forest is searched in two rounds. After the first, with few trees, nodes know their component;
in the second, with the other trees, all members of a region that belong to different components are
compared. In a region of at most ``CROWD`` components these are pairs. Larger regions that share
members form a crowd, whose signatures and sets are brought together in blocks of bounded size; each
pair of blocks is compared in memory, likeliest pairs first, and only links come out, so a crowd costs
no pairs of rows. Its time grows with the rows outside its largest component times its rows: a crowd
that lies just below the threshold has no cheaper exact answer. At a Jaccard similarity of 0.8 a pair
shares a region of no tree with a probability of about 1e-7, less above.

Cases: null or empty texts, and texts without words, have empty sets and stand alone; rows of null
id stand alone with a null component and are kept; equal rows with one id are one document; where
one id stands first in several classes of equal sets, these are one node, compared by the set of the
least fingerprint; ids in the result are longs; extra columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import mix64, words
from .common import slices, strings, written
from .components import components

FUNCTIONS = 128
DEPTH = 5
#: Further values that order a region.
TAIL = 4
ROUNDS = (8, 32)
#: Neighbours looked at in each round; none: every member of the region.
NEIGHBOURS = (1, None)
#: Components of a region up to which their members are paired as rows.
CROWD = 16
#: Bytes of signatures and sets in a block of a crowd.
BLOCK_BYTES = 8 << 20
#: Share of equal signature values below which a pair is not confirmed; 0.8 lies over five standard deviations above.
SIGNATURE = 0.6
#: Candidate ids of this many bytes at most are broadcast to pick texts; beyond that a join does it.
BROADCAST_BYTES = 32 << 20
_A = mix64(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)).astype(np.uint32)
_B = (mix64(np.arange(1001, 1001 + FUNCTIONS, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word runs."""
    w = words(data, offsets)
    n = len(w.hash)
    per = w.per_doc
    first = np.concatenate([[0], np.cumsum(per)])
    mixed = np.zeros(max(0, n - shingle + 1), np.uint64)
    for k in range(shingle):
        mixed = mixed * np.uint64(0xD1342543DE82EF95) + w.hash[k : k + len(mixed)]
    mixed = mix64(mixed)
    out = []
    for d in range(len(per)):
        a, count = first[d], per[d]
        if count == 0:
            out.append(np.zeros(0, np.uint64))
        elif count < shingle:
            value = np.uint64(count)
            for h in w.hash[a : a + count]:
                value = mix64(np.array([value ^ h]))[0]
            out.append(np.array([value]))
        else:
            s = np.sort(mixed[a : a + count - shingle + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``FUNCTIONS`` MinHash values (16 bits of each) of non-empty sets, a row each."""
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), FUNCTIONS), np.uint16)
    for j in range(FUNCTIONS):
        out[:, j] = np.minimum.reduceat((low ^ _A[j]) * _B[j], start).astype(np.uint16)
    return out


def _describe(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in slices(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                n = np.array([len(s) for s in sets])
                f1 = np.array([mix64(s).sum() if len(s) else 0 for s in sets], np.uint64)
                f2 = np.array([np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x5DEECE66D))) if len(s) else 0 for s in sets], np.uint64)
                some = [s for s in sets if len(s)]
                sig = iter([x.tobytes() for x in signatures(some)] if some else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([next(sig) if k else None for k in n], pa.binary())],
                    names=["id", "n", "f1", "f2", "sig"],
                )

    return run


def _tree_rows(trees: range):
    """For each node and tree: region key, further values, id, component."""
    order = [np.argsort(mix64(np.arange(FUNCTIONS, dtype=np.uint64) + np.uint64(7919 * (t + 1)))) for t in trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, FUNCTIONS).astype(np.uint64)
            for t, o in zip(trees, order):
                key = np.full(len(sig), np.uint64(t + 1), np.uint64)
                for f in o[:DEPTH]:
                    key = mix64(key ^ sig[:, f])
                tail = np.zeros(len(sig), np.uint64)
                for f in o[DEPTH : DEPTH + TAIL]:
                    tail = (tail << np.uint64(16)) | sig[:, f]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tail.view(np.int64)), batch.column(0), batch.column(2)], names=["key", "tail", "id", "comp"])

    return run


def _neighbours(width: int):
    """Pairs of each row with the nearest earlier rows of its region that belong to another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            key, node, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if last is not None:
                key, node, comp = (np.concatenate([a, b]) for a, b in zip(last, (key, node, comp)))
            skip = 0 if last is None else len(last[0])
            found = []
            # The nearest earlier row of another component stands before the run of equal components.
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])])
            run_start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            for back in range(1, width + 1):
                for at in (run_start - back, np.arange(len(key)) - back):
                    rows = np.flatnonzero((at >= 0) & (np.arange(len(key)) >= skip))
                    other = at[rows]
                    rows, other = (x[(key[rows] == key[other]) & (comp[rows] != comp[other])] for x in (rows, other))
                    found.append((np.minimum(node[rows], node[other]), np.maximum(node[rows], node[other])))
            a, b = (np.concatenate(x) for x in zip(*found))
            if len(a):
                pair = np.unique(np.column_stack([a, b]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])
            # Kept for the next batch: the last few rows, from a border between components.
            keep = max(0, min(len(key) - width, int(run_start[-1]) - width))
            keep = max(keep, len(key) - 4096)
            last = (key[keep:], node[keep:], comp[keep:])

    return run


def _across(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of all members of a region (key) that belong to different components; groups: (key, comp) of the regions wanted."""
    both = groups.toDF("key", "ca").join(groups.toDF("key", "cb"), "key").filter("ca < cb")
    pairs = both.join(rows.toDF("key", "x", "ca"), ["key", "ca"]).join(rows.toDF("key", "y", "cb"), ["key", "cb"])
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _crowds(members: DataFrame) -> DataFrame:
    """(id, crowd): members (key, id) of crowded regions; regions that share a member are one crowd."""
    least = members.groupBy("id").agg(F.min("key").alias("least"))
    joined = components(members.join(least, "id").filter("key != least").select(F.col("key").alias("a"), F.col("least").alias("b")))
    return least.join(joined.toDF("least", "crowd"), "least", "left").select("id", F.coalesce("crowd", "least").alias("crowd"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (crowd, comp, bytes, ...) with ``owner`` and ``block``: a large component has blocks of its own, the others are pooled."""
    own = rows.groupBy("crowd", "comp").agg(F.sum("bytes").alias("own"))
    pool = own.filter(F.col("own") <= BLOCK_BYTES).groupBy("crowd").agg(F.sum("own").alias("pool"))
    rows = rows.join(own, ["crowd", "comp"]).join(pool, "crowd", "left")
    large = F.col("own") > BLOCK_BYTES
    parts = lambda c: F.ceil(F.col(c) / F.lit(BLOCK_BYTES)).cast("long")
    place = F.when(large, F.pmod(F.xxhash64("id"), parts("own"))).otherwise(F.pmod(F.xxhash64("comp"), parts("pool")))
    owner = F.when(large, F.col("comp"))
    return rows.withColumn("owner", owner).withColumn("block", F.xxhash64("crowd", "owner", place)).drop("own", "pool")


def _crowd_links(percent: int):
    """Links that join components, of two blocks (side 0 and 1) or within one (side 0 alone)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, ids, comp = (table.column(c).to_numpy() for c in ("side", "id", "comp"))
        order = np.lexsort((ids, side))
        side, ids, comp = side[order], ids[order], comp[order]
        picked = table.take(pa.array(order))
        sig = np.frombuffer(b"".join(picked.column("sig").to_pylist()), np.uint16).reshape(-1, FUNCTIONS)
        sets = [np.frombuffer(x, np.uint64) for x in picked.column("elements").to_pylist()]
        size = np.array([len(x) for x in sets])
        start, flat = np.cumsum(size) - size, np.concatenate(sets)
        root = np.unique(comp, return_inverse=True)[1]
        right = np.flatnonzero(side == side.max())
        within = side.max() == 0
        found = []
        for x in np.flatnonzero(side == 0).tolist():
            y = right[right > x] if within else right
            y = y[(root[y] != root[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
            if not len(y):
                continue
            agree = (sig[y] == sig[x]).sum(1)
            best = np.argsort(-agree, kind="stable")
            y = y[best[: int((agree >= SIGNATURE * FUNCTIONS).sum())]]
            step = 4
            while len(y):
                now, y, step = y[:step], y[step:], step * 8
                n = size[now]
                at = np.repeat(start[now] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                place = np.minimum(np.searchsorted(sets[x], flat[at]), size[x] - 1)
                both = np.add.reduceat((sets[x][place] == flat[at]).astype(np.int64), np.cumsum(n) - n)
                for z in now[100 * both >= percent * (n + size[x] - both)].tolist():
                    if root[z] != root[x]:
                        root[root == root[z]] = root[x]
                        found.append((min(ids[x], ids[z]), max(ids[x], ids[z])))
                y = y[root[y] != root[x]]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _links_in_crowds(nodes: DataFrame, texts: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between components among members (key, id) of crowded regions."""
    rows = written(_crowds(members).join(nodes, "id").select("crowd", "id", "comp", "sig", "f1"), "crowds")
    sets = _sets_of(texts, rows.select("id", "f1"), shingle)
    rows = rows.drop("f1").join(sets, "id").withColumn("bytes", F.length("elements") + F.length("sig"))
    rows = written(_blocks(rows), "crowd-blocks")
    blocks = rows.select("crowd", "block", "owner").distinct()
    both = blocks.toDF("crowd", "left", "lo").join(blocks.toDF("crowd", "right", "ro"), "crowd").filter("left <= right and (lo is null or ro is null or lo != ro)").select("left", "right")
    own = ("id", "comp", "sig", "elements")
    sided = both.join(rows.select(F.col("block").alias("left"), *own), "left").withColumn("side", F.lit(0))
    sided = sided.unionByName(both.filter("left != right").join(rows.select(F.col("block").alias("right"), *own), "right").withColumn("side", F.lit(1)))
    return written(sided.groupBy("left", "right").applyInArrow(_crowd_links(percent), "a long, b long"), "links")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, FUNCTIONS) for c in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= SIGNATURE * FUNCTIONS))


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(c[k].as_py(), np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(shingle: int):
    """The set of each text whose fingerprint is the one wanted of its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            wanted = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                own = np.array([mix64(s).sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64) == wanted[i:j]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(pa.array(own)), pa.array([s.tobytes() for s, k in zip(sets, own) if k], pa.binary())], names=["id", "elements"])

    return run


def _sets_of(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, elements) of the wanted (id, f1), once each; few ids are broadcast, more are joined."""
    wanted = written(wanted.distinct(), "wanted")
    if 16 * wanted.count() <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    sets = texts.join(wanted, "id").select("id", "text", "f1").mapInArrow(_sets(shingle), "id long, elements binary")
    return written(sets.groupBy("id").agg(F.first("elements").alias("elements")), "candidate-sets")


def _confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those that are links: first by signature, then by the full sets."""
    sig = nodes.select("id", "sig")
    alike = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_alike, "a long, b long")
    alike = written(alike, "candidates")
    ids = alike.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "f1"), "id")
    sets = _sets_of(texts, ids, shingle)
    both = alike.join(sets.toDF("a", "ea"), "a").join(sets.toDF("b", "eb"), "b").select("a", "b", "ea", "eb")
    return written(both.mapInArrow(_confirmed(percent), "a long, b long"), "links")


def _links(nodes: DataFrame, texts: DataFrame, trees: range, width: int | None, shingle: int, percent: int) -> list[DataFrame]:
    """Confirmed links (a < b) between nodes of different components that are neighbours, or without a width members of one region, in some tree."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("id", "sig", "comp").mapInArrow(_tree_rows(trees), "key long, tail long, id long, comp long")
    if width is not None:
        rows = rows.repartitionByRange(parts, "key", "tail", "id").sortWithinPartitions("key", "tail", "id")
        return [_confirm(rows.select("key", "id", "comp").mapInArrow(_neighbours(width), "a long, b long").distinct(), nodes, texts, shingle, percent)]
    rows = written(rows.select("key", "id", "comp"), "regions")
    groups = written(rows.select("key", "comp").distinct(), "region-components")
    size = groups.groupBy("key").count()
    few = written(groups.join(size.filter((F.col("count") > 1) & (F.col("count") <= CROWD)).select("key"), "key", "left_semi"), "region-few")
    members = written(rows.join(size.filter(F.col("count") > CROWD).select("key"), "key", "left_semi").select("key", "id"), "region-crowds")
    return [_confirm(_across(rows, few).distinct(), nodes, texts, shingle, percent), _links_in_crowds(nodes, texts, members, shingle, percent)]


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    described = written(texts.mapInArrow(_describe(shingle), "id long, n long, f1 long, f2 long, sig binary"), "signatures")
    own = described.filter("n > 0 and id is not null")
    reps = written(own.groupBy("f1", "f2").agg(F.min("id").alias("rep")), "classes")
    # A representative's own row carries the signature; ids that repeat count once.
    nodes = written(own.join(reps, ["f1", "f2"]).filter("id = rep").groupBy("id").agg(F.first("sig").alias("sig"), F.min("f1").alias("f1")), "nodes")
    comp, links, first = None, [], 0
    for count, width in zip(ROUNDS, NEIGHBOURS):
        labelled = nodes.withColumn("comp", F.col("id")) if comp is None else nodes.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id"))
        links += _links(labelled, texts, range(first, first + count), width, shingle, percent)
        comp = components(reduce(DataFrame.unionByName, links))
        first += count
    classes = reps.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = described.select("id", "n", "f1", "f2").join(classes, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that ``group`` keeps: the smallest id of each group."""
    gone = written(group(docs, doc_id, text, shingle, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    if 8 * gone.count() <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("__gone"), "left_anti")
