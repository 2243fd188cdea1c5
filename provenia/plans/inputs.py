"""Tables that the registered queries derive from the driver's data, the same way as their SQL does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


#: Tables with texts, whose expressions cost far more than a shuffle of them, and their keys.
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer splits than there are cores (one small file) are dealt out by their key."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _TEXTS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, _TEXTS[name])
    return df


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, part: the sentences of all documents."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, variant, claim, evidence: sentences of 10 characters or more, four in five of them perturbed."""
    rows = parts(spark, sf_dir).filter(F.length("part") >= 10).withColumn("variant", F.col("pos") % 5)
    p = F.col("part")
    claim = (
        F.when(F.col("variant") == 1, F.array_join(F.reverse(F.split(p, " ")), " "))
        .when(F.col("variant") == 2, F.concat(p, F.lit(" 4,242.50")))
        .when(F.col("variant") == 3, F.concat(p, F.lit(" zyxwv")))
        .when(F.col("variant") == 4, F.concat(F.lit("Zorblat was "), p))
        .otherwise(p)
    )
    return rows.select("doc_id", "pos", "variant", claim.alias("claim"), p.alias("evidence"))


PROPOSALS = """proposals AS (SELECT doc_id, pos, pos % 5 AS variant, part AS evidence,
    CASE pos % 5 WHEN 1 THEN array_to_string(list_reverse(string_split(part, ' ')), ' ') WHEN 2 THEN part || ' 4,242.50'
    WHEN 3 THEN part || ' zyxwv' WHEN 4 THEN 'Zorblat was ' || part ELSE part END AS claim FROM parts WHERE length(part) >= 10)"""


def letters(key: str) -> str:
    """SQL of both dialects: a name of letters for a number (digits as letters a to j, first in capitals)."""
    return f"concat('Q', translate(cast({key} as string), '0123456789', 'abcdefghij'))"


#: Claims made from the star schema: one for each order. Both dialects read this text.
TEMPLATED = f"""
    SELECT o_orderkey AS seq, concat('n', cast(o_orderkey as string)) AS node_id, {letters('o_custkey')} AS subject, {letters('c_nationkey')} AS place,
        CASE o_orderkey % 4 WHEN 0 THEN concat({letters('o_custkey')}, ' likes tea from ', {letters('c_nationkey')}, '.')
            WHEN 1 THEN concat({letters('o_custkey')}, ' dislikes tea from ', {letters('c_nationkey')}, '.')
            WHEN 2 THEN concat({letters('o_custkey')}, ' works for ', {letters('c_nationkey')}, ' at the office.')
            ELSE concat({letters('o_custkey')}, ' owns a dog in ', {letters('c_nationkey')}, '.') END AS claim,
        CASE o_orderkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS polarity,
        CASE o_orderkey % 4 WHEN 2 THEN 'employer' WHEN 3 THEN 'pet' END AS slot,
        CASE WHEN o_orderkey % 4 < 2 THEN 'preference' ELSE 'state' END AS node_type,
        cast(o_orderdate as date) AS day, CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'P' THEN 'disputed' ELSE 'active' END AS memory_state,
        o_totalprice / 600000.0 AS r
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, node_id, subject, place, claim, polarity, slot, node_type, day, memory_state, r."""
    # Dates are shorter than times where orders are shuffled for the join.
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return spark.sql(TEMPLATED.replace("FROM orders JOIN customer", "FROM {o} JOIN {c}"), o=orders, c=table(spark, sf_dir, "customer"))


def templated_sql() -> str:
    return TEMPLATED.replace("as string", "as varchar")
