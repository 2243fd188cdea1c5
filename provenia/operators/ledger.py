"""A hash-chained ledger: append, verify, fold; payload encryption; erasure certificates."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that replay applies; others are for audit.
WRITE_KINDS = ("ADD_NODE", "UPDATE_NODE", "ADD_ENTITY", "UPDATE_ENTITY", "ADD_RELATION")
REMOVAL_KINDS = ("ERASE", "PRUNE", "COMPRESS")
AUDIT_KINDS = ("CHECKPOINT", "ADD_SOURCE", "CREATE", "DEDUP", "REINFORCE", "MODIFY", "DISPUTE", "NOOP")
KINDS = (*WRITE_KINDS, *REMOVAL_KINDS, *AUDIT_KINDS)


def _body(tenant: Column, seq: Column, kind: Column, ts: Column, payload: Column, prev: Column) -> Column:
    return F.concat_ws("\x1f", tenant.cast("string"), seq.cast("string"), kind, ts.cast("string"), payload, prev)


_CHAINED = "tenant string, seq long, event_id string, kind string, ts string, payload string, prev_hash string, hash string"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link events sorted by tenant and seq: each hash covers the body and the hash before it."""
    tenant, last = None, ""
    for batch in batches:
        prev, own = [], []
        for t, tail, body in zip(*(batch.column(c).to_pylist() for c in (0, 6, 7))):
            if t != tenant:
                tenant, last = t, tail
            prev.append(last)
            last = hashlib.sha256(f"{body}\x1f{last}".encode()).hexdigest()
            own.append(last)
        columns = [*(batch.column(c) for c in range(6)), pa.array(prev, pa.string()), pa.array(own, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _CHAINED.split(", ")])


def append(events: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Chain new events (tenant, order columns ``ts``, ``event_id``; kind, payload) behind the tenants' tails.

    seq has no gaps in a tenant. Events are sorted by tenant and streamed through one digest each, so a
    tenant's batch is one task's time but never its memory: the chain has no other order. The result is
    a function of the input rows, so a retried batch writes the same rows. Unknown kinds are an error.
    """
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind "), F.coalesce("kind", F.lit("null")))))
    rows = events.withColumn("kind", known)
    if tails is None:
        rows = rows.withColumn("__next", F.lit(0).cast("long")).withColumn("__tail", F.lit(""))
    else:
        rows = rows.join(tails.select("tenant", F.col("next_seq").alias("__next"), F.col("tail_hash").alias("__tail")), "tenant", "left")
        rows = rows.withColumns({"__next": F.coalesce("__next", F.lit(0)), "__tail": F.coalesce("__tail", F.lit(""))})
    order = Window.partitionBy("tenant").orderBy("ts", "event_id")
    rows = rows.withColumn("seq", (F.col("__next") + F.row_number().over(order) - 1).cast("long"))
    body = F.concat_ws("\x1f", "tenant", F.col("seq").cast("string"), "kind", F.col("ts").cast("string"), "payload")
    rows = rows.select(F.col("tenant").cast("string"), "seq", "event_id", "kind", F.col("ts").cast("string"), "payload", "__tail", body.alias("__body"))
    return rows.mapInArrow(_chain, _CHAINED)


def tails(ledger: DataFrame) -> DataFrame:
    """tenant, next_seq, tail_hash, length."""
    return ledger.groupBy("tenant").agg((F.max("seq") + 1).alias("next_seq"), F.max_by("hash", "seq").alias("tail_hash"), F.count("*").alias("length"))


def verify_chain(ledger: DataFrame) -> DataFrame:
    """Every event with ``fault``: gap, broken_link, altered, or null."""
    w = Window.partitionBy("tenant").orderBy("seq")
    prev = F.coalesce(F.lag("hash").over(w), F.lit(""))
    body = _body(F.col("tenant"), F.col("seq"), F.col("kind"), F.col("ts"), F.col("payload"), F.col("prev_hash"))
    fault = F.when(F.col("seq") != F.row_number().over(w) - 1, "gap").when(F.col("prev_hash") != prev, "broken_link").when(F.col("hash") != F.sha2(body, 256), "altered")
    return ledger.withColumn("fault", fault)


def fold(ledger: DataFrame, upto: int | None = None) -> DataFrame:
    """State after replay: the last write of each object id that no later removal names. Parallel, no order needed.

    Events have object_id (null for audit kinds) and payload.
    """
    rows = ledger if upto is None else ledger.filter(F.col("seq") <= upto)
    writes = rows.filter(F.col("kind").isin(*WRITE_KINDS)).groupBy("tenant", "object_id").agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))
    gone = rows.filter(F.col("kind").isin(*REMOVAL_KINDS)).groupBy("tenant", "object_id").agg(F.max("seq").alias("gone"))
    return writes.join(gone, ["tenant", "object_id"], "left").filter(F.col("gone").isNull() | (F.col("gone") < F.col("seq"))).drop("gone")


def replay(ledger: DataFrame, checkpoint: DataFrame, at: int) -> DataFrame:
    """The same from a state at ``at`` and the events after it."""
    as_events = checkpoint.select("tenant", "object_id", "seq", "payload", F.lit("ADD_NODE").alias("kind"))
    return fold(as_events.unionByName(ledger.filter(F.col("seq") > at).select("tenant", "object_id", "seq", "payload", "kind")))


def state_hash(state: DataFrame) -> DataFrame:
    """One digest for each tenant of its rows, ordered by object id."""
    row = F.sha2(F.concat_ws("\x1f", "object_id", "payload"), 256)
    return state.groupBy("tenant").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("object_id", row.alias("h")))), lambda x: x["h"]), ""), 256).alias("state_hash"), F.count("*").alias("objects"))


def encrypt(rows: DataFrame, keyring: DataFrame, columns: list[str], subject: str = "subject") -> DataFrame:
    """AES-GCM under the subject's key (keyring: subject, key as 32 bytes). Ciphertexts are base64 with a version mark."""
    out = rows.join(keyring, subject, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("key").isNotNull(), F.concat(F.lit("enc2:"), F.base64(F.aes_encrypt(F.col(c), F.col("key"))))).otherwise(F.col(c)))
    return out.drop("key")


def decrypt(rows: DataFrame, keyring: DataFrame, columns: list[str], subject: str = "subject") -> DataFrame:
    """The inverse; a shredded or wrong key shows ``[erased]``."""
    out = rows.join(keyring, subject, "left")
    for c in columns:
        plain = F.try_aes_decrypt(F.unbase64(F.substring(F.col(c), 6, 1 << 30)), F.coalesce("key", F.unhex(F.lit("00" * 32)))).cast("string")
        out = out.withColumn(c, F.when(F.col(c).startswith("enc2:"), F.coalesce(plain, F.lit("[erased]"))).otherwise(F.col(c)))
    return out.drop("key")


class HmacSigner:
    """Signs canonical JSON with a key kept outside the store."""

    name = "hmac-sha256"

    def __init__(self, key: bytes):
        self.key = key

    def sign(self, certificate: dict) -> str:
        return hmac.new(self.key, canonical(certificate), hashlib.sha256).hexdigest()

    def verify(self, certificate: dict, signature: str) -> bool:
        return hmac.compare_digest(self.sign(certificate), signature)


def canonical(value: dict) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
