"""What happens to claims over time: reinforcement, decay, significance, predictions, consolidation candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds and weights of the data model.
HOT, CORE, WARM = 0.5, 0.87, 0.4
W_LOCAL, W_SESSION = 0.3, 0.7
NOVEL = 0.72
BASE_DECAY, FLOOR, FLOOR_TURNS, HOT_TURNS, HOT_FACTOR, DAMPING = 0.012, 0.25, 5, 3, 0.8, 0.6


def layer(r: Column) -> Column:
    return F.when(r >= CORE, "CORE").when(r >= HOT, "HOT").when(r >= WARM, "WARM").otherwise("COLD")


def reinforce(mentions: DataFrame) -> DataFrame:
    """Each mention (tenant, node_id, session, seq) that brings a node a new session, with the score it then has.

    csr is the node's distinct sessions over the tenant's sessions begun so far, frozen until its
    next new session; the first mention has csr 0. Windows are taken within a tenant.
    """
    first = mentions.groupBy("tenant", "node_id", "session").agg(F.min("seq").alias("seq"))
    starts = mentions.groupBy("tenant", "session").agg(F.min("seq").alias("seq")).withColumn("starts", F.lit(1))
    marked = first.join(starts, ["tenant", "session", "seq"], "left")
    begun = F.sum(F.coalesce("starts", F.lit(0))).over(Window.partitionBy("tenant").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0))
    # A session's first row is always the first mention of some node in it, so no start is missed.
    rows = marked.withColumn("begun", begun).withColumn("k", F.row_number().over(Window.partitionBy("tenant", "node_id").orderBy("seq")))
    rows = rows.withColumn("csr", F.when(F.col("k") == 1, 0.0).otherwise(F.col("k") / F.col("begun"))).withColumn("validated", F.col("k") >= 2)
    return rows.select("tenant", "node_id", "session", "seq", "k", "begun", "csr", "validated")


def overall(local: Column, csr: Column) -> Column:
    return W_LOCAL * local + W_SESSION * csr


def novelty(claims: DataFrame) -> DataFrame:
    """Created claims (node_id, seq, decision, domains): ``boosted`` if rescued or any domain is first seen here."""
    each = claims.select("node_id", "seq", F.explode_outer("domains").alias("domain"))
    first = each.groupBy("domain").agg(F.min("seq").alias("seq")).filter("domain is not null")
    new = each.join(first, ["domain", "seq"], "left_semi").select("node_id").distinct().withColumn("__new", F.lit(True))
    out = claims.join(new, "node_id", "left")
    return out.withColumn("boosted", (F.col("decision") == "RESCUE") | F.coalesce("__new", F.lit(False))).withColumn("csr", F.when(F.col("boosted"), NOVEL).otherwise(0.0)).drop("__new")


def decayed(r0: Column, created: Column, last: Column, turn: Column, polarity: Column, prior: Column, frozen: Column) -> Column:
    """Reinforcement after idling from ``last`` to ``turn``: linear, slower for meaning, polarity and fresh HOT claims."""
    idle = turn - last
    m = F.when(polarity == "positive", 0.8).when(polarity == "negative", 0.6).otherwise(1.0) * F.when(prior > 0, F.greatest(F.lit(0.0), 1 - DAMPING * prior)).otherwise(1.0)
    m = m * F.when((r0 >= HOT) & (r0 < CORE) & (idle <= HOT_TURNS + 1), HOT_FACTOR).otherwise(1.0)
    r = r0 - BASE_DECAY * idle * m
    floor = F.when(turn - created <= FLOOR_TURNS, FLOOR).otherwise(0.0)
    return F.when((r0 >= CORE) | frozen | (idle <= 0), r0).otherwise(F.greatest(floor, r))


def significance_weight(r: Column, prior: Column) -> Column:
    return r * (1 + prior)


def synthesis_candidates(claims: DataFrame) -> DataFrame:
    """Active claims other than inferences that are HOT or above, the strongest first, ties by id."""
    return claims.filter((F.col("memory_state") == "active") & (F.col("node_type") != "inference") & (F.col("r") >= HOT)).orderBy(F.desc("r"), "node_id")


def significance_prior(grounding: Column, causes: Column) -> Column:
    return 0.5 * grounding + 0.3 * F.least(causes, F.lit(3)) / 3


def merge_significance(records: DataFrame) -> DataFrame:
    """Per node: the rationale of the highest grounding (the latest of equals), its distinct causes, its prior."""
    out = records.groupBy("node_id").agg(
        F.max_by("rationale", F.struct("grounding", "seq")).alias("rationale"), F.max("grounding").alias("grounding"), F.countDistinct("cause").alias("causes")
    )
    return out.withColumn("prior", significance_prior(F.coalesce("grounding", F.lit(0.0)), F.col("causes")))


def calibration(predictions: DataFrame) -> DataFrame:
    """predictions (probability, outcome 0/1 or null): counts, Brier score, accuracy, mean confidence."""
    p, a = F.col("probability"), F.col("outcome").cast("double")
    out = predictions.agg(
        F.count("*").alias("n"), F.count("outcome").alias("resolved"), F.avg((p - a) * (p - a)).alias("brier"),
        F.avg(F.when(a.isNotNull(), ((p >= 0.5) == (a == 1)).cast("double"))).alias("accuracy"), F.avg(F.when(a.isNotNull(), p)).alias("mean_confidence"),
    )
    return out.withColumn("well_calibrated", F.col("brier") <= 0.25)


def resolve_predictions(predictions: DataFrame, observations: DataFrame, least: float = 0.4) -> DataFrame:
    """Open predictions with the first later observation of the subject that overlaps enough (share of its tokens)."""
    pairs = predictions.join(observations.withColumnRenamed("seq", "obs_seq"), "subject").filter("obs_seq > seq")
    pairs = pairs.filter(F.size(F.array_intersect("observed", "predicted")) >= least * F.size("observed"))
    return pairs.groupBy("prediction_id").agg(F.min("obs_seq").alias("resolved_at"))


def reflect_groups(claims: DataFrame, least: int = 3) -> DataFrame:
    """Domains with ``least`` or more readable claims that may be reflected on."""
    each = claims.filter(F.col("memory_state").isin("active", "disputed") & ~F.col("node_type").isin("inference", "reflection", "summary")).select("node_id", F.explode("domains").alias("domain"))
    return each.groupBy("domain").agg(F.count("*").alias("members"), F.min("node_id").alias("first_member")).filter(F.col("members") >= least)


def faded(claims: DataFrame, frozen: DataFrame, significant: DataFrame) -> DataFrame:
    """Active claims that have cooled down and are neither frozen, significant nor inferred."""
    out = claims.filter((F.col("memory_state") == "active") & ~F.col("node_type").isin("inference", "reflection") & (F.col("r") < WARM))
    return out.join(frozen, "node_id", "left_anti").join(significant, "node_id", "left_anti")


def compress_groups(claims: DataFrame, frozen: DataFrame, significant: DataFrame, least: int = 3) -> DataFrame:
    """Domains with ``least`` or more faded claims that are neither frozen nor significant."""
    each = faded(claims, frozen, significant).select("node_id", F.explode("domains").alias("domain"))
    return each.groupBy("domain").agg(F.count("*").alias("members"), F.min("node_id").alias("first_member")).filter(F.col("members") >= least)


def freeze(claims: DataFrame, most: int = 8, least: float = 0.4) -> DataFrame:
    """Readable claims below CORE with enough prior: the ``most`` highest, ties by id."""
    return claims.filter(F.col("memory_state").isin("active", "disputed") & (F.col("r") < CORE) & (F.col("prior") >= least)).orderBy(F.desc("prior"), "node_id").limit(most)


def retain(arrivals: DataFrame, capacity: int, partition: str) -> DataFrame:
    """What a buffer of ``capacity`` still holds: highest salience, the newest of equals."""
    w = Window.partitionBy(partition).orderBy(F.desc("salience"), F.desc("seq"))
    return arrivals.withColumn("keep_rank", F.row_number().over(w)).filter(F.col("keep_rank") <= capacity)


def drain(held: DataFrame, batch: int, partition: str) -> DataFrame:
    """The next batch: highest salience, the oldest of equals."""
    w = Window.partitionBy(partition).orderBy(F.desc("salience"), "seq")
    return held.withColumn("drain_rank", F.row_number().over(w)).filter(F.col("drain_rank") <= batch)
