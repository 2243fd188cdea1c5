"""Entity linking: mentions, the entity table, roles, anchors and merging of name variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PLACE = r"\b(?:in|at|near) "


def mentions(claims: DataFrame) -> DataFrame:
    """(claim_id, seq, position, name, is_place): capitalised runs, but for a lone first word that is no name elsewhere.

    ``claims`` has claim_id, seq and claim. A run after in, at or near is a place.
    """
    found = claims.select("claim_id", "seq", "claim", F.posexplode(T.candidate_names(F.col("claim"))).alias("position", "name"))
    found = found.withColumn("is_place", F.rlike(F.col("claim"), F.concat(F.lit(f"(?i:{PLACE})"), F.col("name"), F.lit(r"\b"))))
    sentence_initial = F.col("claim").startswith(F.col("name")) & ~F.col("name").contains(" ")
    noise = F.lower("name").isin("the", "this", "that", "there", "it", "i", "he", "she", "they", "we", "you", "and", "but")
    return found.filter(~(sentence_initial & noise)).drop("claim")


def entity_table(found: DataFrame, salt: str | None = None) -> DataFrame:
    """One row for each name, case apart: id, first seq, type (place once it was ever one)."""
    out = found.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", F.struct("seq", "position")).alias("canonical_name"), F.min("seq").alias("first_seq"), F.bool_or("is_place").alias("place"), F.count("*").alias("mentions")
    )
    slug = F.row_number().over(Window.partitionBy(T.entity_id(F.col("canonical_name"), salt)).orderBy("first_seq", "key"))
    base = T.entity_id(F.col("canonical_name"), salt)
    out = out.withColumn("entity_id", F.when(slug == 1, base).otherwise(F.concat(base, F.lit("_"), slug.cast("string"))))
    return out.withColumn("entity_type", F.when(F.col("place"), "place").otherwise("person")).drop("place")


def link(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions with entity_id and role: places are locations, the first person of a claim is actor, the rest co_actors."""
    out = found.withColumn("key", F.lower("name")).join(entities.select("key", "entity_id", "entity_type"), "key")
    first = F.row_number().over(Window.partitionBy("claim_id", F.col("entity_type") == "place").orderBy("position"))
    role = F.when(F.col("entity_type") == "place", "location").when(first == 1, "actor").otherwise("co_actor")
    return out.withColumn("role", role).select("claim_id", "seq", "position", "entity_id", "role")


def resolve_names(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """name to entity_id: canonical name first, then an alias (entity_id, alias); case-insensitive, the last writer wins."""
    canonical = entities.groupBy(F.lower("canonical_name").alias("key")).agg(F.max_by("entity_id", "first_seq").alias("by_name"))
    alias = aliases.groupBy(F.lower("alias").alias("key")).agg(F.min("entity_id").alias("by_alias"))
    out = names.withColumn("key", F.lower("name")).join(canonical, "key", "left").join(alias, "key", "left")
    return out.select("name", F.coalesce("by_name", "by_alias").alias("entity_id"))


def merge_variants(entities: DataFrame) -> DataFrame:
    """(entity_id, merged_into): a one-word name of three letters or more that is a whole word of exactly one longer name."""
    words = entities.select(F.col("entity_id").alias("long_id"), "key", F.explode(F.split("key", " ")).alias("word")).filter(F.col("key").contains(" "))
    short = entities.filter(~F.col("key").contains(" ") & (F.length("key") >= 3)).select("entity_id", F.col("key").alias("word"))
    pairs = short.join(words, "word").groupBy("entity_id").agg(F.countDistinct("long_id").alias("n"), F.min("long_id").alias("merged_into"))
    return pairs.filter("n = 1").drop("n")


def anchors(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, name or null) with ``anchor``: the first name seen so far in the conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("anchor", F.first("name", ignorenulls=True).over(w))


def resolve_pronouns(turns: DataFrame) -> DataFrame:
    """Turns with ``linked``: own name, else the anchor where a third-person pronoun stands."""
    pronoun = F.col("text").rlike(r"(?i)\b(he|she|they|him|her|them|his|hers|their)\b")
    return anchors(turns).withColumn("linked", F.coalesce("name", F.when(pronoun, F.col("anchor"))))
