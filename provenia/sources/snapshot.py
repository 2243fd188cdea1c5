"""The open snapshot format: one JSON object with version, nodes, entities and relations; its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
NODE_TYPES = ("fact", "event", "preference", "state", "constraint", "inference", "reflection", "summary")
STATES = ("active", "quarantined", "disputed", "superseded", "frozen")
EDGE_TYPES = ("co_occurs", "supports", "contradicts", "supersedes", "causes", "motivates", "before", "derived_from")
NODES = "array<struct<node_id:string,node_type:string,claim:string,normalized_claim:string,subject:string,domains:array<string>,memory_state:string,valid_to:string,source_id:string,doc_hash:string,byte_start:bigint,byte_end:bigint,evidence:string,r:double>>"
ENTITIES = "array<struct<entity_id:string,canonical_name:string,entity_type:string,aliases:array<string>>>"
RELATIONS = "array<struct<relation_id:string,source_id:string,target_id:string,relation_type:string>>"
SCHEMA = f"snapshot_version int, nodes {NODES}, entities {ENTITIES}, relations {RELATIONS}"


class FormatError(ValueError):
    """A snapshot that this reader must refuse."""


def write(nodes: DataFrame, entities: DataFrame, relations: DataFrame, path: str) -> None:
    """One JSON object as text. Sets are sorted, rows ordered by id: equal states give equal files.

    The format is one object, so the whole state meets in one row; the tables themselves are the
    form to exchange at scale.
    """

    def rows(df: DataFrame, schema: str, key: str):
        fields = [f.split(":")[0] for f in _fields(schema)]
        own = [F.col(f) if f in df.columns else F.lit(None).alias(f) for f in fields]
        own = [F.array_sort(F.array_distinct(c)).alias(f) if f in ("domains", "aliases") and f in df.columns else c for f, c in zip(fields, own)]
        return df.select(F.struct(F.col(key), F.struct(*own).alias("v")).alias("s")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("v"))

    n, e, r = rows(nodes, NODES, "node_id"), rows(entities, ENTITIES, "entity_id"), rows(relations, RELATIONS, "relation_id")
    one = n.select(F.col("v").alias("nodes")).crossJoin(e.select(F.col("v").alias("entities"))).crossJoin(r.select(F.col("v").alias("relations")))
    text = F.to_json(F.struct(F.lit(VERSION).alias("snapshot_version"), "nodes", "entities", "relations"), {"ignoreNullFields": "false"})
    one.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _fields(schema: str) -> list[str]:
    body, depth, out, start = schema[len("array<struct<") : -2], 0, [], 0
    for i, c in enumerate(body + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(body[start:i])
            start = i + 1
    return out


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, entities and relations of a snapshot; unknown fields are ignored.

    Raises ``FormatError`` for malformed JSON, another version (version 1 by name), missing lists
    and nodes without id or claim.
    """
    raw = spark.read.text(path, wholetext=True)
    one = raw.select("value", F.from_json("value", SCHEMA).alias("s"), F.from_json("value", "map<string,string>").alias("m")).select("s.*", F.map_keys("m").alias("keys")).first()
    if one is None or one["keys"] is None:
        raise FormatError("not a JSON object")
    if one["snapshot_version"] == 1:
        raise FormatError("snapshot version 1 must be migrated first")
    if one["snapshot_version"] != VERSION:
        raise FormatError(f"unknown snapshot version {one['snapshot_version']}")
    for name in ("nodes", "entities", "relations"):
        if name not in one["keys"] or one[name] is None:
            raise FormatError(f"no list of {name}")
    parsed = raw.select(F.from_json("value", SCHEMA).alias("s"))
    out = {name: parsed.select(F.explode(f"s.{name}").alias("x")).select("x.*") for name in ("nodes", "entities", "relations")}
    if not out["nodes"].filter("node_id is null or claim is null").isEmpty():
        raise FormatError("a node without id or claim")
    return out


def conformance(nodes: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(check, violations) of the format's rules: unique ids, legal values, referential integrity, whole receipts."""
    ids, names = nodes.select("node_id"), entities.select("entity_id")
    edge = F.col("relation_type") == "co_occurs"

    def dangling(end: str, entity: bool) -> DataFrame:
        own = relations.filter(edge if entity else ~edge)
        return own.join((names if entity else ids).toDF(end), end, "left_anti")

    def repeated(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).count().filter("count > 1")

    partial = F.array("doc_hash", F.col("byte_start").cast("string"), F.col("byte_end").cast("string"))
    missing = F.size(F.filter(partial, lambda x: x.isNull()))
    rules = {
        "node ids are unique": repeated(nodes, "node_id"), "entity ids are unique": repeated(entities, "entity_id"), "relation ids are unique": repeated(relations, "relation_id"),
        "nodes have an id and a claim": nodes.filter("node_id is null or claim is null or trim(claim) = ''"),
        "node types are known": nodes.filter(~F.col("node_type").isin(*NODE_TYPES)), "memory states are known": nodes.filter(~F.col("memory_state").isin(*STATES)),
        "edge types are known": relations.filter(~F.col("relation_type").isin(*EDGE_TYPES)), "receipts are whole or absent": nodes.filter((missing > 0) & (missing < 3)),
        "byte ranges are ordered": nodes.filter("byte_start < 0 or byte_end < byte_start"), "co-occurrence joins entities": dangling("source_id", True).unionByName(dangling("target_id", True)),
        "other edges join nodes": dangling("source_id", False).unionByName(dangling("target_id", False)), "superseded nodes are closed": nodes.filter("memory_state = 'superseded' and valid_to is null"),
    }
    out = None
    for name, bad in rules.items():
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
