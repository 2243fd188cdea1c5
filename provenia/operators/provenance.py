"""Receipts over exact byte ranges, and redactable Merkle documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Levels of a Merkle tree that a fold goes up at most: more parts than an array can hold.
LEVELS = 31


def doc_hash(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def normalize_hash(x: Column) -> Column:
    """Hashes with and without the prefix meet."""
    return F.regexp_replace(F.lower(F.trim(x)), "^sha256:", "")


def byte_start(text: Column, quote: Column) -> Column:
    """UTF-8 offset of the first exact occurrence, else null."""
    at = F.instr(text, quote)
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1))).cast("long")


def bind(claims: DataFrame, sources: DataFrame, quote: str = "evidence") -> DataFrame:
    """Claims (source_id, quote) with doc_hash, byte_start, byte_end of the quote in their source; null where it is not found.

    An equi-join on source_id; sources have source_id and text.
    """
    out = claims.join(_hashed(sources), "source_id", "left")
    start = byte_start(F.col("__source"), F.col(quote))
    out = out.withColumn("byte_start", start).withColumn("byte_end", (F.col("byte_start") + F.octet_length(quote)).cast("long"))
    return out.withColumn("doc_hash", F.when(F.col("byte_start").isNotNull(), F.col("__hash"))).drop("__source", "__hash")


def _hashed(sources: DataFrame) -> DataFrame:
    """Sources with their hash: worked out once for each, before claims join them."""
    return sources.select("source_id", F.col("text").alias("__source"), doc_hash(F.col("text")).alias("__hash"))


def verify(receipts: DataFrame, sources: DataFrame, quote: str = "evidence") -> DataFrame:
    """Receipts with ``outcome``: verified, failed, turn_bound (no coordinates) or source_not_held."""
    out = receipts.join(_hashed(sources), "source_id", "left")
    span = F.substring(F.col("__source").cast("binary"), (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int"))
    good = (normalize_hash(F.col("doc_hash")) == normalize_hash(F.col("__hash"))) & (span == F.col(quote).cast("binary"))
    outcome = F.when(F.col("__source").isNull(), "source_not_held").when(F.col("byte_start").isNull(), "turn_bound").when(good, "verified").otherwise("failed")
    return out.withColumn("outcome", outcome).drop("__source", "__hash")


# Kinds of origin, what is computed from the bytes, and what a caller declares.
ORIGIN_KINDS = ("conversation", "file", "url", "api", "user_submitted", "unknown")
ATTESTED, DECLARED = ("source_id", "doc_hash", "byte_length"), ("origin", "origin_kind")


def disclosure(records: DataFrame) -> DataFrame:
    """Registrations with what of them is attested and what is only declared."""
    return records.withColumns({"attested": F.lit(", ".join(ATTESTED)), "declared": F.lit(", ".join(DECLARED))})


def register(documents: DataFrame, origin: str = "undeclared", kind: str = "unknown") -> DataFrame:
    """source_id, doc_hash, byte_length and declared origin fields of documents (source_id, text)."""
    return documents.select(
        "source_id", "text", doc_hash(F.col("text")).alias("doc_hash"), F.octet_length("text").cast("long").alias("byte_length"),
        F.coalesce(F.nullif(F.lit(origin), F.lit("")), F.lit("undeclared")).alias("origin"), F.lit(kind if kind in ORIGIN_KINDS else "unknown").alias("origin_kind"),
    )


def trace(claims: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """Claim to bytes to registration event: TRACED, AMBIGUOUS (several registrations), TURN-BOUND or NOT FOUND."""
    seen = events.filter("kind = 'ADD_SOURCE'").groupBy(normalize_hash(F.col("doc_hash")).alias("__h")).agg(F.count("*").alias("__n"))
    out = verify(claims, sources).withColumn("__h", normalize_hash(F.col("doc_hash"))).join(seen, "__h", "left")
    outcome = F.when(F.col("outcome") == "turn_bound", "TURN-BOUND").when(F.col("__n").isNull() | (F.col("outcome") != "verified"), "NOT FOUND").when(F.col("__n") > 1, "AMBIGUOUS")
    return out.withColumn("trace", outcome.otherwise("TRACED")).drop("__h", "__n")


def leaf_hash(part: Column, nonce: Column) -> Column:
    """sha256(0x00, length of the nonce in 4 bytes, nonce, part); the nonce is hexadecimal text."""
    size = F.lpad(F.hex((F.length(nonce) / 2).cast("int")), 8, "0")
    return F.sha2(F.concat(F.unhex(F.concat(F.lit("00"), size, nonce)), part.cast("binary")), 256)


def pair_hash(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(a), F.unhex(b)), 256)


def _up(level: Column) -> Column:
    """One level up: pairs are hashed, an odd last node is promoted."""
    half = F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1)
    return F.transform(half, lambda i: F.when(2 * i + 1 < F.size(level), pair_hash(F.get(level, 2 * i), F.get(level, 2 * i + 1))).otherwise(F.get(level, 2 * i)))


def merkle_root(leaves: Column, levels: int = LEVELS) -> Column:
    """Root of an array of leaf hashes, a fold over the levels; null for no leaves or more than 2**levels."""
    step = lambda acc, _: F.when(F.size(acc) > 1, _up(acc)).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), leaves, step, lambda top: F.when(F.size(top) == 1, F.get(top, F.lit(0))))


def inclusion_proof(leaves: Column, index: Column, levels: int = LEVELS) -> Column:
    """Siblings from leaf to root, each with L or R for its side."""
    start = F.struct(leaves.alias("level"), index.cast("int").alias("at"), F.array().cast("array<string>").alias("path"))

    def step(s: Column, _: Column) -> Column:
        other = F.when(s["at"] % 2 == 0, s["at"] + 1).otherwise(s["at"] - 1)
        mark = F.when(s["at"] % 2 == 0, F.lit("R")).otherwise(F.lit("L"))
        sibling = F.get(s["level"], other)
        path = F.when((F.size(s["level"]) > 1) & sibling.isNotNull(), F.concat(s["path"], F.array(F.concat(mark, sibling)))).otherwise(s["path"])
        level = F.when(F.size(s["level"]) > 1, _up(s["level"])).otherwise(s["level"])
        return F.struct(level.alias("level"), F.floor(s["at"] / 2).cast("int").alias("at"), path.alias("path"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, step, lambda s: s["path"])


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.when(s.startswith("L"), pair_hash(F.substring(s, 2, 64), acc)).otherwise(pair_hash(acc, F.substring(s, 2, 64))))


def whole_parts(x: Column) -> Column:
    """array<struct<text, start>>: the sentences of a text with the white space behind them, and the byte at which each starts; together they are the text."""
    pieces = F.filter(F.regexp_extract_all(x, F.lit(r"(?s)(.*?[.!?]\s+|.+$)"), F.lit(1)), lambda p: p != "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<text:string,start:bigint>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        return F.struct((s["at"] + F.octet_length(p)).cast("long").alias("at"), F.concat(s["out"], F.array(F.struct(p.alias("text"), s["at"].alias("start")))).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def redactable(documents: DataFrame, salt: str) -> DataFrame:
    """source_id, parts (array of text, nonce, hash) and root. Nonces derive from the salt, id and place, so they are minted once and retries agree."""
    parts = F.transform(T.sentences(F.col("text")), lambda p, i: F.struct(p.alias("text"), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.col("source_id").cast("string"), i.cast("string")), 256), 1, 32).alias("nonce")))
    out = documents.withColumn("__parts", parts)
    out = out.withColumn("parts", F.transform("__parts", lambda p: F.struct(p["text"].alias("text"), p["nonce"].alias("nonce"), leaf_hash(p["text"], p["nonce"]).alias("hash"))))
    return out.select("source_id", "parts", merkle_root(F.transform("parts", lambda p: p["hash"])).alias("root"))


def redact(docs: DataFrame, needle: str) -> DataFrame:
    """Parts that contain the needle keep their hash alone; the root must not change."""
    hidden = lambda p: F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("nonce"), p["hash"].alias("hash"))
    return docs.withColumn("parts", F.transform("parts", lambda p: F.when(F.lower(p["text"]).contains(needle.lower()), hidden(p)).otherwise(p)))


def surviving_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit("[redacted]"))), " ")


def rebuilt_root(parts: Column) -> Column:
    """Root from what a redacted document still shows: texts with nonces, else hashes."""
    return merkle_root(F.transform(parts, lambda p: F.when(p["text"].isNotNull(), leaf_hash(p["text"], p["nonce"])).otherwise(p["hash"])))


def best_part(claims: DataFrame, documents: DataFrame, least: float = 0.4) -> DataFrame:
    """For each claim the part of its source most alike (Jaccard of scoring tokens, ties to the first), at ``least`` or more."""
    parts = documents.select("source_id", F.posexplode(T.sentences(F.col("text"))).alias("part_index", "part"))
    scored = claims.join(parts, "source_id").withColumn("__j", T.jaccard(T.scoring_tokens(F.col("claim")), T.scoring_tokens(F.col("part")))).filter(F.col("__j") >= least)
    best = scored.groupBy("claim_id").agg(F.max_by(F.struct("part_index", "part", "__j"), F.struct("__j", -F.col("part_index"))).alias("__b"))
    return best.select("claim_id", "__b.part_index", "__b.part", F.col("__b.__j").alias("similarity"))
