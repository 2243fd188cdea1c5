"""Claims as a graph: edges, bounded expansion, similarity joins, transitive closure, erasure."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import collapse as C
from .ledger import canonical


def valid_at(ts: Column | str | None) -> Column:
    """Validity on ISO text: open or later than ``ts``."""
    return F.col("valid_to").isNull() if ts is None else F.col("valid_to").isNull() | (F.col("valid_to") > ts)


def readable(claims: DataFrame, ts: Column | str | None = None) -> DataFrame:
    """Valid claims that are active or disputed: what every reader sees."""
    return claims.filter(valid_at(ts) & F.col("memory_state").isin("active", "disputed"))


def touching(claims: DataFrame, claim_entity: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims whose entities meet ``ids`` (entity_id): semi-joins on the bridge table."""
    hit = claim_entity.join(ids, "entity_id", "left_semi").select("node_id").distinct()
    return claims.join(hit, "node_id", "left_semi")


def one_hop(claim_entity: DataFrame, seeds: DataFrame) -> DataFrame:
    """node_ids that share an entity with the seeds (node_id), without the seeds."""
    shared = claim_entity.join(seeds, "node_id", "left_semi").select("entity_id").distinct()
    return claim_entity.join(shared, "entity_id", "left_semi").select("node_id").distinct().join(seeds, "node_id", "left_anti")


def field_expand(relations: DataFrame, seeds: DataFrame, types: tuple[str, ...] = ("causes", "motivates", "before")) -> DataFrame:
    """Nodes one typed edge away in either direction; the best-ranked seed (rank) anchors each."""
    edges = relations.filter(F.col("relation_type").isin(*types))
    both = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other"), "relation_type").unionByName(edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("other"), "relation_type"))
    found = both.join(seeds, "node_id").groupBy("other").agg(F.min_by(F.struct(F.col("node_id").alias("anchor"), "relation_type"), F.struct("rank", "node_id", "relation_type")).alias("a"))
    return found.select(F.col("other").alias("node_id"), "a.anchor", "a.relation_type").join(seeds.select("node_id"), "node_id", "left_anti")


def co_occurs(claim_entity: DataFrame) -> DataFrame:
    """Unordered pairs of entities in one claim, source before target, with the number of claims."""
    a, b = claim_entity.select("node_id", F.col("entity_id").alias("source_id")), claim_entity.select("node_id", F.col("entity_id").alias("target_id"))
    return a.join(b, "node_id").filter("source_id < target_id").groupBy("source_id", "target_id").agg(F.countDistinct("node_id").alias("weight"))


def before_edges(claims: DataFrame, claim_entity: DataFrame) -> DataFrame:
    """Directly consecutive dated claims of one entity (claims of equal date are unordered): earlier to later.

    The relation ``before`` is transitive; consecutive pairs are its reduction, so a frequent entity
    costs as many edges as it has claims.
    """
    dated = claim_entity.join(claims.filter(F.col("event_time").isNotNull()).select("node_id", "event_time"), "node_id")
    w = Window.partitionBy("entity_id").orderBy("event_time", "node_id")
    out = dated.withColumn("prev", F.lag(F.struct("node_id", "event_time")).over(w)).filter(F.col("prev.event_time") < F.col("event_time"))
    return out.select(F.col("prev.node_id").alias("source_id"), F.col("node_id").alias("target_id")).distinct()


def all_before_edges(claims: DataFrame, claim_entity: DataFrame) -> DataFrame:
    """The full relation, as stored edges: an equi-join on the entity with the dates compared."""
    dated = claim_entity.join(claims.filter(F.col("event_time").isNotNull()).select("node_id", "event_time"), "node_id")
    a, b = dated.select("entity_id", F.col("node_id").alias("source_id"), F.col("event_time").alias("ta")), dated.select("entity_id", F.col("node_id").alias("target_id"), F.col("event_time").alias("tb"))
    return a.join(b, "entity_id").filter("ta < tb").select("source_id", "target_id").distinct()


def related(claims: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each query row (query_id, text, domains) the k active claims of a shared domain with the highest white-space Jaccard.

    Claims that share only words of many queries are met as groups, by kinds of queries (``collapse``).
    """
    q = queries.select(F.col("query_id").alias("question_id"), T.space_tokens(F.col("text")).alias("f"), F.col("domains").alias("qd")).withColumn("nq", F.size("f"))
    c = claims.filter("memory_state = 'active' and size(domains) > 0").select("node_id", F.lit(0.0).alias("r"), T.space_tokens(F.col("claim")).alias("f"), F.array_sort("domains").alias("cd")).withColumn("nc", F.size("f"))

    def scored(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("qf", "f"))
        return pairs.filter(F.arrays_overlap("qd", "cd")).withColumn("score", both / (F.col("nq") + F.col("nc") - both))

    common = C.common_features(q)
    pairs = scored(C.near(q, c, common)).select("question_id", "node_id", "r", "score")
    if common:
        kind, members = C.kinds(q, common), C.written(C.group(c, common, ["nc", "cd"], [], k), "members")
        pairs = pairs.unionByName(C.best_far(scored(C.far(kind, members)), members, kind, F.col("score"), k, "score"))
    return C.best(pairs, F.col("score"), k, "score").withColumnRenamed("question_id", "query_id")


def best_match(clauses: DataFrame, claims: DataFrame, least: float = 0.5) -> DataFrame:
    """For each clause (clause_id, text) the active claim with the highest content Jaccard; the earliest (seq) wins ties."""
    left = clauses.select("clause_id", T.content_set(F.col("text")).alias("qt"))
    right = claims.filter("memory_state = 'active'").select("node_id", "seq", T.content_set(F.col("claim")).alias("ct"))
    pairs = left.withColumn("token", F.explode("qt")).join(right.withColumn("token", F.explode("ct")), "token").groupBy("clause_id", "node_id", "seq").agg(F.first("qt").alias("qt"), F.first("ct").alias("ct"))
    scored = pairs.withColumn("score", T.jaccard(F.col("qt"), F.col("ct"))).filter(F.col("score") >= least)
    return scored.groupBy("clause_id").agg(F.max_by(F.struct("node_id", "score"), F.struct(F.col("score"), -F.col("seq"))).alias("b")).select("clause_id", "b.node_id", "b.score")


def supersede(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """Claims after MODIFY rows (old_id, new_id, ts): the old one is superseded and closed, never deleted."""
    out = claims.join(changes.withColumnRenamed("old_id", "node_id"), "node_id", "left")
    hit = F.col("new_id").isNotNull()
    return (
        out.withColumn("valid_to", F.when(hit, F.col("ts")).otherwise(F.col("valid_to")))
        .withColumn("memory_state", F.when(hit, "superseded").otherwise(F.col("memory_state")))
        .withColumn("superseded_by", F.col("new_id")).drop("new_id", "ts")
    )


def closure(seeds: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """All nodes reachable from the seeds (node_id) along edges (source_id to target_id), with the step that found them.

    A frontier is joined with the edges until it is empty; each round is cut from its lineage by a
    checkpoint in the session's shared folder.
    """
    spark = seeds.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="provenia-"))
    known = seeds.select("node_id").distinct().withColumn("step", F.lit(0)).checkpoint()
    frontier = known
    for step in range(1, most + 1):
        reach = edges.join(frontier.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("node_id")).distinct()
        frontier = reach.join(known, "node_id", "left_anti").withColumn("step", F.lit(step)).checkpoint()
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier).checkpoint()
    raise RuntimeError(f"closure did not end within {most} steps")


class ErasureIncomplete(Exception):
    """A probe still finds the subject after its erasure; no certificate is made."""


def erase(claims: DataFrame, claim_entity: DataFrame, relations: DataFrame, subject: str, signer=None) -> tuple[dict[str, DataFrame], dict]:
    """Remove a subject: claims that touch it, all derived from them, their relations and entities left without claims.

    Returns the surviving tables and a signed certificate. The removal is probed: no surviving row may
    refer to a removed one.
    """
    seeds = claim_entity.filter(F.col("entity_id") == subject).select("node_id").distinct()
    derived = relations.filter("relation_type = 'derived_from'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    gone = closure(seeds, derived).select("node_id")
    kept_claims = claims.join(gone, "node_id", "left_anti")
    kept_bridge = claim_entity.join(gone, "node_id", "left_anti").filter(F.col("entity_id") != subject)
    dead = gone.select(F.col("node_id").alias("x")).unionByName(claim_entity.join(gone, "node_id", "left_semi").select("entity_id").distinct().join(kept_bridge.select("entity_id").distinct(), "entity_id", "left_anti").select(F.col("entity_id").alias("x")))
    kept_relations = relations.join(dead.toDF("source_id"), "source_id", "left_anti").join(dead.toDF("target_id"), "target_id", "left_anti")
    left = kept_bridge.filter(F.col("entity_id") == subject).count() + kept_relations.filter((F.col("source_id") == subject) | (F.col("target_id") == subject)).count()
    if left:
        raise ErasureIncomplete(f"{left} rows still name the subject")
    certificate = {"subject": T_fingerprint(subject), "claims_removed": gone.join(claims, "node_id", "left_semi").count(), "claims_before": claims.count(), "claims_after": kept_claims.count(), "probes_answered": 0}
    if signer is not None:
        certificate["signature"] = signer.sign(dict(certificate))
    return {"claims": kept_claims, "claim_entity": kept_bridge, "relations": kept_relations}, certificate


def T_fingerprint(subject: str) -> str:
    import hashlib

    return hashlib.sha256(canonical({"subject": " ".join(subject.lower().split())})).hexdigest()


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def relations_of(relations: DataFrame, ids: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Edges with one of ``ids`` (node_id) at either end: two equi-joins, never an OR join."""
    edges = relations if types is None else relations.filter(F.col("relation_type").isin(*types))
    own = edges.join(ids.toDF("source_id"), "source_id", "left_semi").select(*edges.columns)
    return own.unionByName(edges.join(ids.toDF("target_id"), "target_id", "left_semi").select(*edges.columns)).distinct()


def causal_clauses(claims: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """(node_id, side, text): what stands after (cause) and before (effect) the first causal marker of the evidence."""
    pattern = "(?i) (?:" + "|".join(markers) + ") "
    parts = F.split(F.col("evidence"), pattern, 2)
    both = claims.filter(F.col("evidence").rlike(pattern)).select("node_id", F.posexplode(parts).alias("side", "text"))
    return both.select("node_id", F.when(F.col("side") == 0, "effect").otherwise("cause").alias("side"), "text")


def causal_edges(claims: DataFrame, existing: DataFrame, markers: tuple[str, ...], least: float = 0.5, kind: str = "causes") -> DataFrame:
    """Edges from the claim that best matches the cause clause to the one that best matches the effect clause.

    ``causes`` leaves out directed edges that exist; ``motivates`` those of any type in either direction.
    """
    clauses = causal_clauses(claims, markers).withColumn("clause_id", F.concat_ws("/", "node_id", "side"))
    hit = best_match(clauses, claims, least).withColumnRenamed("node_id", "match")
    sided = clauses.join(hit, "clause_id")
    cause, effect = sided.filter("side = 'cause'").select("node_id", F.col("match").alias("source_id")), sided.filter("side = 'effect'").select("node_id", F.col("match").alias("target_id"))
    new = cause.join(effect, "node_id").filter("source_id != target_id").select("source_id", "target_id").distinct()
    if kind == "causes":
        known = existing.filter("relation_type = 'causes'").select("source_id", "target_id")
    else:
        known = existing.select("source_id", "target_id").unionByName(existing.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    return new.join(known, ["source_id", "target_id"], "left_anti").withColumn("relation_type", F.lit(kind))


def relation_ids(edges: DataFrame) -> DataFrame:
    """Edges with an id that depends on their type and ends alone: retries agree."""
    return edges.withColumn("relation_id", F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("|", "relation_type", "source_id", "target_id"), 256), 1, 16)))


def dispute(claims: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims after DISPUTE pairs (old_id, new_id): both disputed; and their symmetric ``contradicts`` edges."""
    both = pairs.select(F.explode(F.array("old_id", "new_id")).alias("node_id")).distinct().withColumn("__d", F.lit(True))
    out = claims.join(both, "node_id", "left").withColumn("memory_state", F.when(F.col("__d"), "disputed").otherwise(F.col("memory_state"))).drop("__d")
    edges = pairs.select(F.col("new_id").alias("source_id"), F.col("old_id").alias("target_id")).unionByName(pairs.select(F.col("old_id").alias("source_id"), F.col("new_id").alias("target_id")))
    return out, edges.distinct().withColumn("relation_type", F.lit("contradicts"))


def backfill_derivation(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """derived_from edges of old reflections and summaries, from supports and supersedes; and those that cannot be recovered."""
    derived = nodes.filter(F.col("node_type").isin("reflection", "summary")).select("node_id", "node_type")
    supports = relations.filter("relation_type = 'supports'").select(F.col("target_id").alias("node_id"), F.col("source_id").alias("origin"))
    supersedes = relations.filter("relation_type = 'supersedes'").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("origin")).join(derived.filter("node_type = 'summary'").select("node_id"), "node_id", "left_semi")
    found = derived.select("node_id").join(supports.unionByName(supersedes), "node_id").distinct()
    known = relations.filter("relation_type = 'derived_from'").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("origin"))
    new = found.join(known, ["node_id", "origin"], "left_anti").select(F.col("node_id").alias("source_id"), F.col("origin").alias("target_id"), F.lit("derived_from").alias("relation_type"))
    lost = derived.select("node_id").join(found.unionByName(known).select("node_id"), "node_id", "left_anti")
    return new, lost
