"""Append-only JSON logs (quarantine, read audit) and the ledger table; safe to retry by batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def append(rows: DataFrame, path: str, batch: str) -> None:
    """Write a batch as its own partition: a retried batch replaces itself, it never doubles."""
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch string").json(path)


def latest(log: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The last ``n`` entries: a top-k report."""
    return log.orderBy(F.desc(order)).limit(n)


def read_event(verdicts: DataFrame, keep_question: bool = False, salt: str = "") -> DataFrame:
    """Audit rows of gate verdicts (question, abstain, reason, head): a fingerprint of the question, its text only if asked for."""
    out = verdicts.select(T.salted_fingerprint(F.col("question"), salt).alias("fingerprint"), "abstain", "reason", "head", *(["question"] if keep_question else []))
    return out


def summarise(events: DataFrame, heads: int = 8) -> dict[str, DataFrame]:
    """Answered and abstained counts, reasons, and the most frequent refused heads."""
    totals = events.agg(F.count_if(~F.col("abstain")).alias("answered"), F.count_if("abstain").alias("abstained"))
    refused = events.filter("abstain and head is not null").groupBy("head").count().orderBy(F.desc("count"), "head").limit(heads)
    return {"totals": totals, "reasons": events.groupBy("reason").count(), "heads": refused}


class LedgerConflict(RuntimeError):
    """Another writer holds the place in the chain that this batch was made for."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether the batch was written to its end."""
    fs, p = _fs(spark, f"{path}/batch={batch}/_SUCCESS")
    return fs.exists(p)


def get_or_create(spark: SparkSession, path: str, value: str) -> str:
    """The text of a file; the first writer creates it with ``value``."""
    fs, p = _fs(spark, path)
    if fs.createNewFile(p):
        out = fs.create(p, True)
        out.write(bytearray(value.encode()))
        out.close()
        return value
    stream = fs.open(p)
    held = bytes(stream.readNBytes(fs.getFileStatus(p).getLen())).decode()
    stream.close()
    if not held:
        raise LedgerConflict(f"{path} is being written")
    return held


def claim_place(spark: SparkSession, path: str, tenant: str, seq: int, batch: str) -> None:
    """Take the chain's next place for a batch; only one batch ever gets it, a retry of that batch gets it again.

    The file that marks the place is created atomically by the store. A batch that a crash left half
    written is finished by a retry under its name.
    """
    held = get_or_create(spark, f"{path}/_places/{hashlib.sha256(tenant.encode()).hexdigest()[:16]}-{seq}", batch)
    if held != batch:
        raise LedgerConflict(f"place {seq} of {tenant} belongs to batch {held}")


def append_ledger(events: DataFrame, path: str, batch: str) -> None:
    """Write a batch of chained events; one that was written before is left as it is."""
    if not committed(events.sparkSession, path, batch):
        events.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ledger_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches that were written to their end."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [f"{path}/{n}" for n in sorted(names) if n.startswith("batch=") and committed(spark, path, n.removeprefix("batch="))]


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches that were written to their end; places are unique by ``claim_place``."""
    folders = ledger_folders(spark, path)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str) -> dict[str, list[int]]:
    fs, p = _fs(spark, path)
    out: dict[str, list[int]] = {}
    for batch in fs.listStatus(p) if fs.exists(p) else []:
        name = batch.getPath().getName()
        found = [int(v.getPath().getName().removeprefix("v=")) for v in fs.listStatus(batch.getPath()) if v.getPath().getName().startswith("v=")]
        out[name] = sorted(v for v in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/v={v}/_SUCCESS")))
    return {k: v for k, v in out.items() if v}


_KEYS = "object_id string, key binary"


def write_keys(keys: DataFrame, path: str, batch: str) -> None:
    """Keys (object_id, key) of a batch; a retry before its events are committed writes the next version, which counts from then on."""
    folder = f"{path}/batches"
    version = _versions(keys.sparkSession, folder).get(batch, [-1])[-1] + 1
    keys.write.mode("overwrite").parquet(f"{folder}/{batch}/v={version}")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(object_id, key, key_batch): the latest version of every batch's keys."""
    folders = [f"{path}/batches/{name}/v={v[-1]}" for name, v in sorted(_versions(spark, f"{path}/batches").items())]
    if not folders:
        return spark.createDataFrame([], f"{_KEYS}, key_batch string")
    batch = F.regexp_extract(F.col("_metadata.file_path"), "/batches/([^/]+)/v=", 1)
    return spark.read.schema(_KEYS).parquet(*folders).withColumn("key_batch", F.url_decode(batch))


def shred_keys(spark: SparkSession, path: str, objects: DataFrame) -> None:
    """Delete the keys of objects (object_id): affected batches are written anew without them, older versions deleted."""
    for name, versions in _versions(spark, f"{path}/batches").items():
        folder = f"{path}/batches/{name}"
        keys = spark.read.schema(_KEYS).parquet(f"{folder}/v={versions[-1]}")
        if not keys.join(objects.select("object_id"), "object_id", "left_semi").isEmpty():
            keys.join(objects.select("object_id"), "object_id", "left_anti").write.mode("overwrite").parquet(f"{folder}/v={versions[-1] + 1}")
            versions = [*versions, versions[-1] + 1]
        for old in versions[:-1]:
            fs, p = _fs(spark, f"{folder}/v={old}")
            fs.delete(p, True)
