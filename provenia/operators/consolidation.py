"""Batch consolidation of a turn: freeze, reflect, compress. Proposers are callables; the guards decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import gates as G
from . import memory as M

#: What a proposed observation or summary must reach.
REFLECT_GROUNDING, COMPRESS_GROUNDING, NOVELTY, LEAST_CONFIDENCE = 0.4, 0.5, 0.65, 0.60

Proposer = Callable[[DataFrame], DataFrame]


def members(claims: DataFrame, groups: DataFrame, most: int = 16) -> DataFrame:
    """The first ``most`` claims of each group's domain, for a proposer to read."""
    each = claims.withColumn("domain", F.explode("domains")).join(groups.select("domain"), "domain", "left_semi")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("node_id"))
    few = each.withColumn("__k", rank).filter(F.col("__k") <= most)
    return few.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("node_id", "claim"))).alias("members"))


def judge(proposed: DataFrame, grounding: float, earlier: DataFrame | None = None) -> DataFrame:
    """Proposals (domain, members, text, confidence) with ``rejected``: the first guard that fails, or null.

    Guards: empty, low_confidence, ungrounded (share of stems found in the members), invented_number,
    invented_causation, not_novel (against ``earlier`` texts of the domain).
    """
    texts = F.transform("members", lambda m: m["claim"])
    joined = F.array_join(texts, " ")
    out = proposed.withColumns({"__own": T.stems(T.content_set(F.col("text"))), "__all": T.stems(T.content_set(joined))})
    share = T.coverage(F.col("__own"), F.col("__all"))
    stale: Column = F.lit(False)
    if earlier is not None:
        seen = earlier.groupBy("domain").agg(F.collect_list(T.stems(T.content_set(F.col("claim")))).alias("__seen"))
        out = out.join(seen, "domain", "left")
        stale = F.coalesce(F.exists("__seen", lambda s: T.jaccard(F.col("__own"), s) > NOVELTY), F.lit(False))
    rejected = (
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(F.col("confidence") < LEAST_CONFIDENCE, "low_confidence").when(share < grounding, "ungrounded")
        .when(G.invents_numbers(F.col("text"), joined), "invented_number").when(G.invents_causation(F.col("text"), texts), "invented_causation").when(stale, "not_novel")
    )
    return out.withColumn("rejected", rejected).drop("__own", "__all", "__seen")


def derived(accepted: DataFrame, kind: str, csr: float) -> tuple[DataFrame, DataFrame]:
    """Nodes of accepted proposals and their derived_from edges."""
    ids = F.array_sort(F.transform("members", lambda m: m["node_id"]))
    nodes = accepted.withColumn("node_id", T.node_id(T.normalize(F.col("text")), ids, F.lit(kind)))
    edges = nodes.select(F.col("node_id").alias("source_id"), F.explode(ids).alias("target_id"), F.lit("derived_from").alias("relation_type"))
    made = nodes.select("node_id", F.col("text").alias("claim"), F.lit(kind).alias("node_type"), F.array("domain").alias("domains"), F.lit("active").alias("memory_state"), F.lit(M.W_SESSION * csr).alias("r"), F.array_join(ids, ",").alias("evidence"))
    return made, edges


def reflect(claims: DataFrame, proposer: Proposer, earlier: DataFrame | None = None, budget: int = 1) -> tuple[DataFrame, DataFrame]:
    """Reflections on the largest groups of readable claims, ``budget`` of them."""
    groups = M.reflect_groups(claims).orderBy(F.desc("members"), "domain").limit(budget)
    good = judge(proposer(members(claims, groups)), REFLECT_GROUNDING, earlier).filter("rejected is null")
    return derived(good, "reflection", 0.5)


def compress(claims: DataFrame, frozen: DataFrame, significant: DataFrame, proposer: Proposer, budget: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries of faded groups; their sources (node_id) are to be superseded."""
    groups = M.compress_groups(claims, frozen, significant).orderBy(F.desc("members"), "domain").limit(budget)
    good = judge(proposer(members(M.faded(claims, frozen, significant), groups)), COMPRESS_GROUNDING).filter("rejected is null")
    made, edges = derived(good, "summary", 0.6)
    return made, edges, edges.select(F.col("target_id").alias("node_id")).distinct()


#: How many claims a turn freezes, and how many reflections and summaries it makes.
FREEZE_BUDGET, REFLECT_BUDGET, COMPRESS_BUDGET = 8, 1, 1


def turn(claims: DataFrame, significant: DataFrame, proposer: Proposer, earlier: DataFrame | None = None) -> dict[str, DataFrame]:
    """One turn over the store, in this order: freeze, reflect, compress.

    ``claims`` have ``prior`` (significance) too. What is frozen now is spared by the compression of the
    same turn. Gives ``frozen`` (node_id), ``nodes`` and ``edges`` to add, and ``superseded`` (node_id).
    """
    frozen = M.freeze(claims, FREEZE_BUDGET).select("node_id")
    made, edges = reflect(claims, proposer, earlier, REFLECT_BUDGET)
    short, more, gone = compress(claims, frozen, significant, proposer, COMPRESS_BUDGET)
    return {"frozen": frozen, "nodes": made.unionByName(short), "edges": edges.unionByName(more), "superseded": gone}


def quoting_proposer(groups: DataFrame) -> DataFrame:
    """A proposer without a model: repeats the first member. A stand-in where none is configured."""
    return groups.select("domain", "members", F.get("members", F.lit(0))["claim"].alias("text"), F.lit(0.9).alias("confidence"))
