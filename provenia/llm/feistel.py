"""Sharding by a Feistel permutation over global row numbers, in DataFrame operations only.

Rows are numbered 0..n-1 in a fixed order (a hashed bucket, then id, size and checksum), the number is
permuted by a keyed Feistel network over Z_a x Z_b with a * b >= n, walking the cycle while the image
is n or more, and the image p gives shard p mod s and slot p div s. So shard sizes differ by one at
most, slots have no gaps, and ``locate`` computes the place of a row number, and ``row_at`` the row
number at a place, without any table.

a and b lie within a factor of two of each other, so that every round moves both halves; among up to
``SIDES`` such a, from sqrt(n) upwards, a * b - n is least. A walk meets each of those a * b - n images
at most once, which bounds its length exactly.

Cases: a null text has size 16 and checksum 0; null ids come first in their bucket; rows that agree in
id, size and checksum are interchangeable: they are counted, and dealt over the buckets in chunks, so
that a row repeated without end is no hot spot; an empty table gives an empty table. Only the id and
text columns are read.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A prime below 2**31, so that products of two residues fit a long.
PRIME = 2147483647
ROUNDS = 8
SIDES = 4096
#: Ranges of row numbers that are sorted apart.
BUCKETS = 4096
#: Equal rows that are numbered in one bucket.
CHUNK = 4096


def _key(seed: int, r: int) -> tuple[int, int, int]:
    """Round constants from the seed."""
    x = (seed * 1_000_003 + r * 7919 + 12345) % PRIME
    out = []
    for _ in range(3):
        x = (x * 48271 + 11) % PRIME
        out.append(x | 1)
    return out[0], out[1], out[2]


def sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n, at most a factor of two apart, and few images to walk over."""
    low = max(1, isqrt(max(n - 1, 0)) + 1)
    a = min(range(low, min(low + SIDES, max(low + 1, isqrt(2 * n) + 1))), key=lambda a: (-(-n // a) * a - n, a))
    return a, max(1, -(-n // a))


def _turn(x: int, k: tuple[int, int, int], side: int) -> int:
    y = (x % PRIME * k[0] + k[1]) % PRIME
    return (y * y + k[2]) % PRIME % side


def permute(x: int, n: int, seed: int = 0) -> int:
    """The image of row number x, in plain Python."""
    a, b = sides(n)
    while True:
        left, right = x // b, x % b
        for r in range(ROUNDS):
            if r % 2:
                right = (right + _turn(left, _key(seed, r), b)) % b
            else:
                left = (left + _turn(right, _key(seed, r), a)) % a
        x = left * b + right
        if x < n:
            return x


def invert(y: int, n: int, seed: int = 0) -> int:
    """The row number whose image is y."""
    a, b = sides(n)
    while True:
        left, right = y // b, y % b
        for r in reversed(range(ROUNDS)):
            if r % 2:
                right = (right - _turn(left, _key(seed, r), b)) % b
            else:
                left = (left - _turn(right, _key(seed, r), a)) % a
        y = left * b + right
        if y < n:
            return y


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = permute(row, n, seed)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number at a shard and slot."""
    return invert(slot * shards + shard, n, seed)


def _once(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network as a column expression; a struct chain keeps it linear in size."""
    state = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    return _rounds(state, a, b, seed)


def _rounds(state: Column, a: int, b: int, seed: int) -> Column:
    keys = F.array(*[F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(_key(seed, r), "ijk"))) for r in range(ROUNDS)])

    def turn(s: Column, i: Column) -> Column:
        k = F.get(keys, i)
        odd = i % 2 == 1
        y = (F.when(odd, s["l"]).otherwise(s["r"]) % F.lit(PRIME) * k["i"] + k["j"]) % F.lit(PRIME)
        f = (y * y + k["k"]) % F.lit(PRIME)
        return F.struct(
            F.when(odd, s["l"]).otherwise((s["l"] + f % F.lit(a)) % F.lit(a)).alias("l"),
            F.when(odd, (s["r"] + f % F.lit(b)) % F.lit(b)).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def _network(df: DataFrame, source: str, target: str, a: int, b: int, seed: int) -> DataFrame:
    """Add ``target``, one pass of the network over ``source``, as plain generated code."""
    left, right = f"{target}_l", f"{target}_r"
    df = df.withColumns({left: F.expr(f"{source} div {b}L"), right: F.expr(f"{source} % {b}L")})
    for r in range(ROUNDS):
        i, j, k = _key(seed, r)
        to, by, side = (right, left, b) if r % 2 else (left, right, a)
        df = df.withColumn(f"{target}_y", F.expr(f"({by} % {PRIME}L * {i}L + {j}L) % {PRIME}L"))
        df = df.withColumn(to, F.expr(f"({to} + ({target}_y * {target}_y + {k}L) % {PRIME}L % {side}L) % {side}L"))
    return df.withColumn(target, F.expr(f"{left} * {b}L + {right}")).drop(left, right, f"{target}_y")


def number(rows: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Add ``row``, 0..n-1, by a bucket hashed from all columns and then the columns in order; also n.

    Equal rows are counted first. The driver gets one count for each bucket, ``buckets`` at most; no
    task sees more than a bucket at a time, and windows sort with spilling.
    """
    order = rows.columns
    groups = written(rows.groupBy(*order).agg(F.count("*").alias("__copies")), "row-groups")
    chunks = groups.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__copies - 1) div {CHUNK}L"))))
    chunks = chunks.withColumn("__size", F.least(F.lit(CHUNK), F.col("__copies") - F.col("__chunk") * CHUNK))
    chunks = chunks.withColumn("__bucket", F.pmod(F.xxhash64(*order, "__chunk"), F.lit(buckets)).cast("int"))
    counts = {r[0]: r[1] for r in chunks.groupBy("__bucket").agg(F.sum("__size")).collect()}
    starts, n = [], 0
    for k in range(buckets):
        starts.append((k, n))
        n += counts.get(k, 0)
    offsets = rows.sparkSession.createDataFrame(starts, "__bucket int, __start long")
    earlier = Window.partitionBy("__bucket").orderBy(*(F.asc_nulls_first(c) for c in order), "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).join(F.broadcast(offsets), "__bucket")
    first = F.col("__start") + F.col("__before")
    return chunks.select(*order, F.explode(F.sequence(first, first + F.col("__size") - 1)).alias("row")), n


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """One row for each document: id, size (UTF-8 bytes + 16), text_crc32, row, shard, slot."""
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows, n = number(base)
    a, b = sides(n)
    walk = a * b - n
    rows = _network(rows, "row", "__p", a, b, seed)
    if walk:
        on = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), F.col("__p"), lambda p, _: F.when(p < F.lit(n), p).otherwise(_once(p, a, b, seed)))
        rows = rows.withColumn("__p", F.when(F.col("__p") < F.lit(n), F.col("__p")).otherwise(on))
    return rows.select(
        "doc_id", "size", "text_crc32", "row",
        (F.col("__p") % F.lit(shards)).cast("int").alias("shard"), F.expr(f"__p div {shards}L").alias("slot"),
    )
