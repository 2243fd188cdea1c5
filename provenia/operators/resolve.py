"""What a new claim does to the store: CREATE, DEDUP, REINFORCE, MODIFY, DISPUTE or NOOP."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

#: Recorded with every stored claim.
VERSION = "set-2"
LEAST_CONFIDENCE, SAME, CANONICAL = 0.30, 0.80, 0.55
GAP_DAYS, SCOPE, CONTRADICTION = 30, 0.70, 0.65
REVISABLE = ("preference", "state", "constraint")


def dedup(claims: DataFrame) -> DataFrame:
    """Set-based mode: the first row (seq) of each normalised claim creates, the others of it are DEDUP; low confidence and empty claims are NOOP."""
    ok = (F.trim("claim") != "") & (F.col("confidence") >= LEAST_CONFIDENCE)
    rows = claims.withColumn("normalized", T.normalize(F.col("claim"))).withColumn("ok", F.coalesce(ok, F.lit(False)))
    first = rows.filter("ok").groupBy("normalized").agg(F.min_by("claim_id", "seq").alias("created_by"), F.min("seq").alias("first_seq"))
    out = rows.join(first, "normalized", "left")
    mutation = F.when(~F.col("ok"), "NOOP").when(F.col("seq") == F.col("first_seq"), "CREATE").otherwise("DEDUP")
    return out.withColumn("mutation", mutation).select("claim_id", "seq", "normalized", "mutation", F.when(F.col("ok"), F.col("created_by")).alias("target"))


def opposition(a: Column, b: Column) -> Column:
    """Of polarities: 1 for positive against negative, else 0."""
    return F.when(((a == "positive") & (b == "negative")) | ((a == "negative") & (b == "positive")), 1.0).otherwise(0.0)


def change_signal(x: Column) -> Column:
    return T.contains_any(F.concat(F.lit(" "), F.lower(x), F.lit(" ")), V.CHANGE_SIGNALS)


def contradictions(claims: DataFrame) -> DataFrame:
    """For each claim (node_id, subject, claim, polarity, node_type, day) the earlier claim of its subject that it contradicts best.

    Equi-join on subject; opposite polarity, at most ``GAP_DAYS`` apart, scope alike; MODIFY with a
    change signal on a revisable claim, else DISPUTE.
    """
    rows = claims.withColumn("tokens", T.content_set(F.col("claim"))).withColumn("scope", T.scoring_tokens(T.scope(F.col("claim"))))
    old = rows.select(*(F.col(c).alias(f"old_{c}") for c in ("node_id", "subject", "polarity", "node_type", "day", "tokens", "scope")))
    pairs = rows.join(old, (F.col("subject") == F.col("old_subject"))).filter((F.col("old_day") < F.col("day")) & (F.date_diff("day", "old_day") <= GAP_DAYS) & F.col("old_node_type").isin(*REVISABLE))
    pairs = pairs.withColumn("similarity", T.jaccard(F.col("tokens"), F.col("old_tokens"))).withColumn("scope_match", T.jaccard(F.col("scope"), F.col("old_scope"))).withColumn("opposed", opposition(F.col("polarity"), F.col("old_polarity")))
    pairs = pairs.withColumn("confidence", 0.4 * F.col("opposed") + 0.3 * F.col("scope_match") + 0.2 * F.col("similarity") + 0.1)
    pairs = pairs.filter((F.col("opposed") >= 0.95) & (F.col("scope_match") >= SCOPE) & F.col("similarity").between(0.3, 0.95) & (F.col("confidence") >= CONTRADICTION))
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("confidence"), "old_node_id"))
    best = pairs.withColumn("rank", rank).filter("rank = 1")
    return best.withColumn("mutation", F.when(change_signal(F.col("claim")), "MODIFY").otherwise("DISPUTE")).select("node_id", "old_node_id", "confidence", "mutation")


def subject_of(claim: Column) -> Column:
    """The first name of a claim, in lower case; null without one."""
    return F.lower(F.get(T.candidate_names(claim), F.lit(0)))


def outcomes(new: DataFrame, held: DataFrame) -> DataFrame:
    """Set mode against a store: new claims (node_id, claim, polarity, node_type) with ``mutation`` and ``target`` among held ones.

    ``held`` has the same columns and seq, of active claims. In this order: a held claim of the same
    subject, opposite polarity, alike scope and a Jaccard of 0.3 to 0.95 is contradicted (MODIFY with a
    change signal, if it is revisable, else DISPUTE); one with a Jaccard of ``SAME``, or of ``CANONICAL``
    with the same subject and polarity, is meant (REINFORCE); else CREATE. Claims of one batch do not
    see each other. Joins are on the subject and on content tokens.
    """
    form = lambda df, *more: df.select("node_id", "polarity", "node_type", *more, subject_of(F.col("claim")).alias("subject"), T.content_set(F.col("claim")).alias("t"), T.scoring_tokens(T.scope(F.col("claim"))).alias("scope"), "claim")
    a, b = form(new), form(held, "seq")
    old = b.select(*(F.col(c).alias(f"old_{c}") for c in ("node_id", "polarity", "node_type", "subject", "t", "scope", "seq")))
    near = a.join(old, F.col("subject") == F.col("old_subject")).filter((opposition(F.col("polarity"), F.col("old_polarity")) >= 0.95) & F.col("old_node_type").isin(*REVISABLE))
    near = near.withColumns({"similarity": T.jaccard(F.col("t"), F.col("old_t")), "match": T.jaccard(F.col("scope"), F.col("old_scope"))}).filter(F.col("similarity").between(0.3, 0.95) & (F.col("match") >= SCOPE))
    best = near.groupBy("node_id").agg(F.max_by("old_node_id", F.struct("similarity", -F.col("old_seq"))).alias("against"))
    words = b.select("node_id", F.size("t").alias("nb"), "subject", "polarity", "seq", F.explode("t").alias("token")).withColumnsRenamed({"node_id": "like_id", "subject": "like_subject", "polarity": "like_polarity"})
    pairs = a.select("node_id", "subject", "polarity", F.size("t").alias("na"), F.explode("t").alias("token")).join(words, "token")
    pairs = pairs.groupBy("node_id", "subject", "polarity", "na", "like_id", "like_subject", "like_polarity", "nb", "seq").agg(F.count("*").alias("both")).withColumn("j", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    same = F.coalesce((F.col("subject") == F.col("like_subject")) & (F.col("polarity") == F.col("like_polarity")), F.lit(False))
    meant = pairs.filter((F.col("polarity") == F.col("like_polarity")) & ((F.col("j") >= SAME) | (same & (F.col("j") >= CANONICAL)))).groupBy("node_id").agg(F.max_by("like_id", F.struct("j", -F.col("seq"))).alias("meant"))
    out = a.join(best, "node_id", "left").join(meant, "node_id", "left")
    mutation = F.when(F.col("against").isNotNull(), F.when(change_signal(F.col("claim")), "MODIFY").otherwise("DISPUTE")).when(F.col("meant").isNotNull(), "REINFORCE").otherwise("CREATE")
    return out.select("node_id", mutation.alias("mutation"), F.coalesce("against", "meant").alias("target"))


def _tokens(x: str) -> frozenset[str]:
    return frozenset(t for t in "".join(c if c.isalnum() or c == "_" else " " for c in x.lower()).split() if len(t) > 2)


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


ORDERED_SCHEMA = "tenant string, seq long, claim_id string, mutation string, target string"


def ordered(claims: DataFrame) -> DataFrame:
    """Exact mode: each claim sees the store left by the ones before it, within its tenant.

    ``claims``: tenant, seq, claim_id, claim, subject, polarity, node_type, day (ISO text),
    confidence. Order: NOOP, contradiction, exact repeat, similar (REINFORCE), CREATE. A tenant is one
    worker's task, by the nature of the fold; its index holds active claims by text and by token.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        active: dict[str, str] = {}
        nodes: dict[str, dict] = {}
        by_token: dict[str, set[str]] = {}
        by_subject: dict[str, list[str]] = {}
        out = []
        for r in rows.sort_values(["seq", "claim_id"]).itertuples():
            norm, tokens = " ".join(str(r.claim).lower().split()), _tokens(str(r.claim))
            kind, target = "CREATE", str(r.claim_id)
            if not norm or r.confidence < LEAST_CONFIDENCE:
                kind, target = "NOOP", None
            else:
                best = None
                for old in by_subject.get(r.subject, []):
                    n = nodes[old]
                    near = n["state"] == "active" and n["type"] in REVISABLE and {n["polarity"], r.polarity} == {"positive", "negative"}
                    gap = (pd.Timestamp(r.day) - pd.Timestamp(n["day"])).days
                    if near and 0 < gap <= GAP_DAYS and 0.3 <= _jaccard(tokens, n["tokens"]) <= 0.95 and (best is None or _jaccard(tokens, n["tokens"]) > best[0]):
                        best = (_jaccard(tokens, n["tokens"]), old)
                if best:
                    kind = "MODIFY" if any(s in f" {norm} " for s in V.CHANGE_SIGNALS) else "DISPUTE"
                    target = best[1]
                    nodes[target]["state"] = "superseded" if kind == "MODIFY" else "disputed"
                    active.pop(nodes[target]["norm"], None)
                elif norm in active:
                    kind, target = "DEDUP", active[norm]
                else:
                    near = {x for t in tokens for x in by_token.get(t, ()) if nodes[x]["state"] == "active"}
                    scored = max(((_jaccard(tokens, nodes[x]["tokens"]), -nodes[x]["seq"], x) for x in near), default=(0, 0, None))
                    same = scored[2] is not None and nodes[scored[2]]["subject"] == r.subject and nodes[scored[2]]["polarity"] == r.polarity
                    if scored[0] >= SAME or (same and scored[0] >= CANONICAL):
                        kind, target = "REINFORCE", scored[2]
            if kind in ("CREATE", "MODIFY", "DISPUTE"):
                own = str(r.claim_id)
                nodes[own] = {"norm": norm, "tokens": tokens, "subject": r.subject, "polarity": r.polarity, "type": r.node_type, "day": r.day, "seq": r.seq, "state": "disputed" if kind == "DISPUTE" else "active"}
                by_subject.setdefault(r.subject, []).append(own)
                for t in tokens:
                    by_token.setdefault(t, set()).add(own)
                if kind != "DISPUTE":
                    active[norm] = own
            out.append((str(r.tenant), int(r.seq), str(r.claim_id), kind, target))
        return pd.DataFrame(out, columns=["tenant", "seq", "claim_id", "mutation", "target"])

    return claims.groupBy("tenant").applyInPandas(run, ORDERED_SCHEMA)
