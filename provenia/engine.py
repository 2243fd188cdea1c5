"""The engine: an event-sourced claim store in a folder, with the library's public operations.

All state is the fold of a hash-chained ledger; claims, entities and relations are views of it.
Every operation appends events in one batch: a batch that was written is left as it is when the call is
repeated under its name, and a batch takes its place in the chain before it is written, so that two
writers cannot both extend the same tail (``LedgerConflict``).

Texts lie in the ledger only as ciphertext, each object (a claim, a part of a source, a quarantined
proposal) under a key of its own in a folder apart from the store; so does the salt of the entity ids.
Erasure deletes the keys of every object that names the subject. What is left of a source are the salted
hashes of its parts, by which other receipts into it still verify.
"""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import entities as E
from .operators import gates as G
from .operators import graph as GR
from .operators import ledger as L
from .operators import memory as M
from .operators import provenance as P
from .operators import resolve as R
from .operators import retrieval as RT
from .sources import logs, snapshot

CLAIM = (
    "node_id string, claim string, normalized string, evidence string, source_id string, session string, node_type string, polarity string, lemma string, slot string, "
    "domains array<string>, memory_state string, valid_to string, r double, doc_hash string, byte_start long, byte_end long"
)
PART = "source_id string, part_index int, byte_start long, text string, nonce string"
SOURCE = "source_id string, doc_hash string, byte_length long, root string, hashes array<string>"
QUARANTINE = "claim string, evidence string, source_id string, reason string, ts string"
PERCEPT = "claim string, evidence string, source_id string, confidence double, salience double, seq long"
RELATION = "relation_id string, source_id string, target_id string, relation_type string"
LEDGER = "tenant string, seq long, event_id string, kind string, ts string, payload string, prev_hash string, hash string"
#: Stands for a text whose key is gone.
ERASED = "[erased]"
SCOPE = (
    "Erased from the live state and from the ledger of this store: the keys of all claims, source parts and quarantined proposals that name the subject are deleted, so their "
    "ciphertext cannot be read again. Copies of the keys or texts taken before, and other stores, are not covered."
)


class VersionConflict(RuntimeError):
    """A session was ingested before."""


def _random_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([os.urandom(32) for _ in range(batch.num_rows)], pa.binary())], names=["object_id", "key"])


def _sealed(text: Column, key: Column) -> Column:
    """AES-GCM, base64; the nonce is a digest of key and text, so a retried task writes the same bytes."""
    iv = F.substring(F.unhex(F.sha2(F.concat(key, text.cast("binary")), 256)), 1, 12)
    return F.base64(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), iv))


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """The rows held by the executors while a call reads them several times; what is lost is worked out anew."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


class Engine:
    """``Engine(spark, folder)``: remember, recall, verify, trace, forget, export and more, over DataFrames.

    ``keys``: folder of the object keys and the salt, by default beside the store; keep it out of the
    store's backups. ``audit_reads``: record every question's verdict by a fingerprint.
    """

    def __init__(
        self, spark: SparkSession, folder: str, tenant: str = "default", signer: L.HmacSigner | None = None, proposer: Callable[[DataFrame], DataFrame] | None = None,
        keys: str | None = None, audit_reads: bool = False,
    ):
        self.spark, self.folder, self.tenant, self.signer, self.proposer = spark, folder.rstrip("/"), tenant, signer, proposer
        self.keys, self.audit_reads = (keys or f"{self.folder}-keys").rstrip("/"), audit_reads
        self.salt = logs.get_or_create(spark, f"{self.keys}/id_salt", os.urandom(16).hex())

    # --- state ---------------------------------------------------------------------------------------------------------

    def ledger(self) -> DataFrame:
        return logs.read_ledger(self.spark, f"{self.folder}/ledger", LEDGER)

    def _append(self, events: DataFrame, batch: str) -> None:
        """events: event_id, kind, ts, payload. Nothing to append, or a batch written before, leaves the ledger as it is."""
        path = f"{self.folder}/ledger"
        if logs.committed(self.spark, path, batch):
            return
        with _kept(events) as events:
            if events.isEmpty():
                return
            last = L.tails(self.ledger().filter(F.col("tenant") == self.tenant)).first()
            logs.claim_place(self.spark, path, self.tenant, last["next_seq"] if last else 0, batch)
            tails = self.spark.createDataFrame([(self.tenant, *((last["next_seq"], last["tail_hash"]) if last else (0, "")))], "tenant string, next_seq long, tail_hash string")
            logs.append_ledger(L.append(events.withColumn("tenant", F.lit(self.tenant)), tails), path, batch)

    def _state(self, erased: bool = False) -> DataFrame:
        """Last write of each object; ``erased``: also of those that an event erased."""
        rows = self.ledger().filter(F.col("tenant") == self.tenant)
        rows = rows.filter(F.col("kind").isin(*L.WRITE_KINDS)) if erased else rows
        return L.fold(rows.withColumn("object_id", F.get_json_object("payload", "$.id")))

    def _objects(self, prefix: str, schema: str, erased: bool = False) -> DataFrame:
        """Objects whose id has the prefix, opened with their keys; without a key an object cannot be read."""
        rows = self._state(erased).filter(F.col("object_id").startswith(prefix))
        rows = rows.select("object_id", F.get_json_object("payload", "$.key_batch").alias("key_batch"), F.get_json_object("payload", "$.body").alias("body"))
        opened = rows.join(logs.read_keys(self.spark, self.keys), ["object_id", "key_batch"])
        plain = F.try_aes_decrypt(F.unbase64("body"), F.col("key")).cast("string")
        return opened.select("object_id", F.from_json(plain, schema).alias("o")).filter("o is not null").select("object_id", "o.*")

    def _plain(self, prefix: str, schema: str) -> DataFrame:
        return self._state().filter(F.col("object_id").startswith(prefix)).select(F.from_json("payload", schema).alias("o")).select("o.*")

    def claims(self) -> DataFrame:
        """All claims with their present state, and r from the sessions that brought them or repeated them."""
        own = self._objects("node_", CLAIM).drop("object_id")
        now = self._plain("state:", "node string, memory_state string, valid_to string").toDF("node_id", "now_state", "now_valid")
        r = self.reinforcement().groupBy("node_id").agg(F.max_by("csr", "seq").alias("csr"))
        out = own.join(now, "node_id", "left").join(r, "node_id", "left")
        state = {"memory_state": F.coalesce("now_state", "memory_state"), "valid_to": F.coalesce("now_valid", "valid_to"), "r": F.greatest(F.coalesce("r", F.lit(0.0)), M.overall(F.lit(0.0), F.coalesce("csr", F.lit(0.0))))}
        return out.withColumns(state).select(*(x.split()[0] for x in CLAIM.split(", ")))

    def reinforcement(self) -> DataFrame:
        """Each mention of a claim that brought it a new session, from the ledger: node_id, session, seq, k, begun, csr, validated."""
        path = {"ADD_NODE": "$.id", "REINFORCE": "$.node"}
        rows = self.ledger().filter((F.col("tenant") == self.tenant) & F.col("kind").isin(*path))
        node = F.coalesce(*[F.when(F.col("kind") == k, F.get_json_object("payload", p)) for k, p in path.items()])
        mentions = rows.select("tenant", node.alias("node_id"), F.get_json_object("payload", "$.session").alias("session"), "seq").filter("node_id like 'node\\_%' and session is not null")
        return M.reinforce(mentions)

    def parts(self) -> DataFrame:
        return self._objects("part:", PART).drop("object_id")

    def registered(self) -> DataFrame:
        """source_id, doc_hash, byte_length, Merkle root and leaf hashes of every source."""
        return self._plain("source:", SOURCE)

    def _held(self) -> DataFrame:
        """Parts (source_id, part_index, byte_start, byte_end, text) whose leaf hash is the registered one."""
        leaves = self.registered().select("source_id", F.posexplode("hashes").alias("part_index", "leaf"))
        own = self.parts().join(leaves, ["source_id", "part_index"]).filter(P.leaf_hash(F.col("text"), F.col("nonce")) == F.col("leaf"))
        return own.select("source_id", "part_index", "byte_start", (F.col("byte_start") + F.octet_length("text")).alias("byte_end"), "text")

    def sources(self) -> DataFrame:
        """source_id, text, doc_hash, whole: what is still held of every source, with a mark for each part that is not."""
        every = self.registered().select("source_id", "doc_hash", F.posexplode("hashes").alias("part_index", "leaf"))
        rows = every.join(self._held().select("source_id", "part_index", "text"), ["source_id", "part_index"], "left")
        out = rows.groupBy("source_id", "doc_hash").agg(F.array_sort(F.collect_list(F.struct("part_index", F.coalesce("text", F.lit(ERASED)).alias("t")))).alias("p"), F.bool_and(F.col("text").isNotNull()).alias("whole"))
        return out.select("source_id", F.array_join(F.transform("p", lambda p: p["t"]), "").alias("text"), "doc_hash", "whole")

    def relations(self) -> DataFrame:
        return self._plain("rel_", RELATION)

    def claim_entity(self) -> DataFrame:
        """node_id, entity_id of every claim's names."""
        found = E.mentions(self.claims().select(F.col("node_id").alias("claim_id"), F.lit(0).alias("seq"), "claim"))
        return found.select(F.col("claim_id").alias("node_id"), T.entity_id(F.col("name"), self.salt).alias("entity_id")).distinct()

    def entities(self) -> DataFrame:
        found = E.mentions(self.claims().select(F.col("node_id").alias("claim_id"), F.xxhash64("node_id").alias("seq"), "claim"))
        return E.entity_table(found, self.salt)

    # --- writes --------------------------------------------------------------------------------------------------------

    def _keyed(self, objects: DataFrame, batch: str) -> DataFrame:
        """Objects (object_id, ...) with a new random key each; keys are written first, so that retried tasks agree on them."""
        ids = objects.select("object_id").distinct().mapInArrow(_random_keys, "object_id string, key binary")
        logs.write_keys(ids, self.keys, batch)
        keys = logs.read_keys(self.spark, self.keys).filter(F.col("key_batch") == batch)
        return objects.join(keys, "object_id")

    @staticmethod
    def _write(objects: DataFrame, fields: dict[str, Column], **plain: Column) -> DataFrame:
        """ADD_NODE events of keyed objects, their fields sealed; ``plain`` ones stay readable."""
        body = _sealed(T.canonical_json(fields), F.col("key"))
        payload = T.canonical_json({"id": F.col("object_id"), "key_batch": F.col("key_batch"), "body": body, **plain})
        return objects.select(F.col("object_id").alias("event_id"), F.lit("ADD_NODE").alias("kind"), F.lit(_now()).alias("ts"), payload.alias("payload"))

    def add_source(self, documents: DataFrame, origin: str = "undeclared", kind: str = "unknown", batch: str | None = None) -> None:
        """Register documents (source_id, text): sealed parts, their leaf hashes and root, and an audit event with the hash."""
        batch = batch or f"source-{_stamp()}"
        if logs.committed(self.spark, f"{self.folder}/ledger", batch):
            return
        made = P.register(documents.withColumn("source_id", T.safe_source_id(F.col("source_id"))), origin, kind)
        parts = made.select("source_id", F.posexplode(P.whole_parts(F.col("text"))).alias("part_index", "part"))
        parts = parts.select(F.concat_ws(":", F.lit("part"), "source_id", "part_index").alias("object_id"), "source_id", "part_index", F.col("part.start").alias("byte_start"), F.col("part.text").alias("text"))
        parts = self._keyed(parts, batch).withColumn("nonce", F.substring(F.sha2(F.concat(F.lit("nonce").cast("binary"), F.col("key")), 256), 1, 32))
        leaves = parts.select("source_id", "part_index", P.leaf_hash(F.col("text"), F.col("nonce")).alias("leaf"))
        trees = leaves.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_index", "leaf"))), lambda x: x["leaf"]).alias("hashes"))
        heads = made.drop("text").join(trees, "source_id").withColumn("root", P.merkle_root(F.col("hashes")))
        fixed = {c: F.col(c) for c in ("source_id", "doc_hash", "byte_length", "root", "hashes")}
        event = lambda name, kind, payload: heads.select(F.concat(F.lit(name), "source_id").alias("event_id"), F.lit(kind).alias("kind"), F.lit(_now()).alias("ts"), payload.alias("payload"))
        write = event("source:", "ADD_NODE", T.canonical_json({"id": F.concat(F.lit("source:"), F.col("source_id")), **fixed}))
        audit = event("add:", "ADD_SOURCE", T.canonical_json({c: F.col(c) for c in ("source_id", "doc_hash", "byte_length", "origin", "origin_kind")}))
        own = self._write(parts, {x.split()[0]: F.col(x.split()[0]) for x in PART.split(", ")})
        self._append(own.unionByName(write).unionByName(audit), batch)

    def remember(self, proposals: DataFrame, session: str, batch: str | None = None, acknowledge_erasure: bool = False) -> DataFrame:
        """Admit proposals (claim, evidence, source_id) of a session; returns each with its decision and reason.

        Admitted claims are resolved against the active ones (``resolve.outcomes``): a repeat, or a claim
        that means the same, is recorded as REINFORCE; a contradiction supersedes the older claim (MODIFY)
        or puts both in dispute; others are stored with byte receipts. Quarantined proposals go to their
        log, the rest is refused with a reason. Claims that name an erased subject are refused as
        ``erased_subject`` unless the erasure is acknowledged.
        """
        name = batch or f"session-{session}"
        with ExitStack() as calls:
            keep = lambda df: calls.enter_context(_kept(df))
            claims = keep(self.claims())
            if not claims.filter(F.col("session") == session).isEmpty():
                raise VersionConflict(f"session {session} was ingested before")
            judged = G.admit(proposals).withColumn("normalized", T.normalize(F.col("claim")))
            if not acknowledge_erasure:
                erased = self.ledger().filter("kind = 'ERASE'").select(F.get_json_object("payload", "$.subject_fingerprint").alias("fp")).filter("fp is not null").distinct()
                named = judged.select("normalized", F.explode(T.candidate_names(F.col("claim"))).alias("n")).withColumn("fp", T.salted_fingerprint(F.col("n"), self.salt))
                named = named.join(erased, "fp", "left_semi").select("normalized").distinct().withColumn("__erased", F.lit("erased_subject"))
                judged = judged.join(named, "normalized", "left").withColumn("reason", F.coalesce("reason", "__erased")).drop("__erased")
            judged = keep(judged)
            good = judged.filter(F.col("reason").isNull() & F.col("decision").isin("ACCEPT", "RESCUE"))
            first = F.row_number().over(Window.partitionBy("normalized").orderBy("source_id", "claim"))
            once = good.withColumn("k", first).filter("k = 1").drop("k")
            held = claims.filter("memory_state = 'active'").groupBy("normalized").agg(F.min("node_id").alias("held_id"))
            new = once.join(held, "normalized", "left_anti")
            c = F.col("claim")
            node = T.node_id(F.concat(F.lit(self.salt), F.col("normalized")), T.candidate_names(c), F.lit(session))
            typed = new.select("claim", "normalized", "evidence", "source_id", node.alias("node_id"), T.node_type(c).alias("node_type"), T.polarity(c).alias("polarity"))
            active = claims.filter("memory_state = 'active'").withColumn("seq", F.xxhash64("node_id"))
            solved = keep(typed.join(R.outcomes(typed, active), "node_id").withColumn("object_id", F.col("node_id")))
            bound = keep(P.bind(solved.filter("mutation != 'REINFORCE'"), self.sources().filter("whole").select("source_id", "text")))
            fields = {
                "node_id": F.col("node_id"), "claim": c, "normalized": F.col("normalized"), "evidence": F.col("evidence"), "source_id": F.col("source_id"), "session": F.lit(session), "node_type": F.col("node_type"),
                "polarity": F.col("polarity"), "lemma": T.lemma(c), "slot": G.slot_of(c, F.col("evidence")), "domains": T.domains(c), "memory_state": F.when(F.col("mutation") == "DISPUTE", "disputed").otherwise("active"),
                "valid_to": F.lit(None).cast("string"), "r": F.lit(0.0), "doc_hash": F.col("doc_hash"), "byte_start": F.col("byte_start"), "byte_end": F.col("byte_end"),
            }
            doubtful = judged.filter(F.col("reason").isNull() & (F.col("decision") == "QUARANTINE")).withColumn("__q", F.concat_ws("|", F.lit(self.salt), "normalized", "evidence", "source_id", F.lit(name)))
            doubtful = doubtful.select(F.concat(F.lit("doubt_"), F.substring(F.sha2("__q", 256), 1, 20)).alias("object_id"), "claim", "evidence", "source_id", F.col("firewall_reason").alias("reason")).distinct()
            out = judged.select("claim", "evidence", "source_id", "decision", F.coalesce("reason", F.when(~F.col("decision").isin("ACCEPT", "RESCUE"), F.col("firewall_reason"))).alias("reason"))
            result = self.spark.createDataFrame(out.toArrow())
            if not logs.committed(self.spark, f"{self.folder}/ledger", name):
                event = lambda rows, event_id, kind, payload: rows.select(event_id.alias("event_id"), F.lit(kind).alias("kind"), F.lit(_now()).alias("ts"), T.canonical_json(payload).alias("payload"))
                met = once.join(held, "normalized").select(F.col("held_id").alias("target")).unionByName(solved.filter("mutation = 'REINFORCE'").select("target")).distinct()
                again = event(met, F.concat(F.lit("again:"), "target", F.lit(f":{session}")), "REINFORCE", {"node": F.col("target"), "session": F.lit(session)})
                write = self._write(self._keyed(bound, name), fields, session=F.lit(session), mutation=F.col("mutation"), resolver=F.lit(R.VERSION))
                against = solved.filter(F.col("mutation").isin("MODIFY", "DISPUTE"))
                closed = F.col("mutation") == "MODIFY"
                state = event(against, F.concat(F.lit("state:"), "target", F.lit(f":{session}")), "UPDATE_NODE", {"id": F.concat(F.lit("state:"), "target"), "node": F.col("target"), "memory_state": F.when(closed, "superseded").otherwise("disputed"), "valid_to": F.when(closed, F.lit(_now()))})
                ends = against.select(F.col("node_id").alias("source_id"), F.col("target").alias("target_id"), F.when(closed, "supersedes").otherwise("contradicts").alias("relation_type"))
                ends = ends.unionByName(ends.filter("relation_type = 'contradicts'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation_type"))
                names = E.mentions(bound.select(F.col("node_id").alias("claim_id"), F.lit(0).alias("seq"), "claim")).select(F.col("claim_id").alias("node_id"), T.entity_id(F.col("name"), self.salt).alias("entity_id")).distinct()
                ends = ends.unionByName(GR.co_occurs(names).select("source_id", "target_id", F.lit("co_occurs").alias("relation_type")))
                edge = {x.split()[0]: F.col(x.split()[0]) for x in RELATION.split(", ")}
                edges = event(GR.relation_ids(ends.distinct()), F.concat("relation_id", F.lit(f":{session}")), "ADD_RELATION", {"id": F.col("relation_id"), **edge})
                doubts = self._write(self._keyed(doubtful, f"{name}-doubts"), {x.split()[0]: F.lit(_now()) if x.startswith("ts ") else F.col(x.split()[0]) for x in QUARANTINE.split(", ")})
                self._append(GR.union_all(write, again, state, edges, doubts), name)
            return result

    def ingest(self, turns: DataFrame, session: str, speaker: str | None = None) -> DataFrame:
        """Turns (source_id, text) of a session: first person is rewritten to the speaker, sentences are the claims and their evidence."""
        text = F.col("text") if speaker is None else T.first_person_to(F.col("text"), F.lit(speaker))
        each = turns.select("source_id", F.explode(T.sentences(text)).alias("claim")).filter(F.length(F.trim("claim")) >= 10)
        return self.remember(each.withColumn("evidence", F.col("claim")), session)

    # --- intake --------------------------------------------------------------------------------------------------------

    def perceive(self, percepts: DataFrame, batch: str | None = None) -> None:
        """Put percepts (claim, evidence, source_id, seq; confidence and salience may be null) into the buffer, sealed like claims."""
        batch = batch or f"percepts-{_stamp()}"
        if logs.committed(self.spark, f"{self.folder}/ledger", batch):
            return
        rows = percepts.withColumns({c: F.col(c).cast("double") if c in percepts.columns else F.lit(None).cast("double") for c in ("confidence", "salience")})
        rows = rows.withColumn("confidence", T.clamp01(F.coalesce("confidence", F.lit(0.5)))).withColumn("salience", T.clamp01(F.coalesce("salience", "confidence"))).filter(F.trim("claim") != "")
        own = F.sha2(F.concat_ws("|", F.lit(self.salt), F.lit(batch), F.col("seq").cast("string"), "claim", "evidence", "source_id"), 256)
        rows = rows.withColumn("object_id", F.concat(F.lit("percept_"), F.substring(own, 1, 20))).dropDuplicates(["object_id"])
        self._append(self._write(self._keyed(rows, batch), {x.split()[0]: F.col(x.split()[0]) for x in PERCEPT.split(", ")}), batch)

    def pending(self) -> DataFrame:
        return self._objects("percept_", PERCEPT)

    def tick(self, batch: int = 32, capacity: int = 256, flush: bool = False) -> DataFrame | None:
        """One turn: of the buffer's ``capacity`` most salient percepts the ``batch`` first are remembered; the rest waits.

        With fewer than ``batch`` waiting nothing happens, unless ``flush``. What was taken, and what the
        capacity evicted, leaves the buffer: erased, its keys deleted. Returns the decisions, or None.
        """
        waiting = self.pending().withColumn("tenant", F.lit(self.tenant))
        n = waiting.count()
        if not n or (n < batch and not flush):
            return None
        kept = M.retain(waiting, capacity, "tenant")
        taken = M.drain(kept, batch, "tenant")
        # The turn is named by what it takes: repeated after a crash it is known, and only the clearing is done again.
        name = hashlib.sha256("|".join(sorted(r["object_id"] for r in taken.select("object_id").collect())).encode()).hexdigest()[:16]
        out = None if logs.committed(self.spark, f"{self.folder}/ledger", f"session-turn-{name}") else self.remember(taken.select("claim", "evidence", "source_id"), f"turn-{name}")
        gone = taken.select("object_id").unionByName(waiting.join(kept.select("object_id"), "object_id", "left_anti").select("object_id"))
        events = gone.select(F.concat(F.lit("erase:"), "object_id").alias("event_id"), F.lit("PRUNE").alias("kind"), F.lit(_now()).alias("ts"), T.canonical_json({"id": F.col("object_id")}).alias("payload"))
        self._append(events, f"turn-{name}-taken")
        pruned = self.ledger().filter(F.col("kind") == "PRUNE").select(F.get_json_object("payload", "$.id").alias("object_id"))
        logs.shred_keys(self.spark, self.keys, pruned)
        return out if out is not None else self.spark.createDataFrame([], "claim string, evidence string, source_id string, decision string, reason string")

    def flush(self, batch: int = 32) -> list[DataFrame]:
        """Turns until the buffer is empty."""
        turns = []
        while (out := self.tick(batch, flush=True)) is not None:
            turns.append(out)
        return turns

    def ingest_documents(self, documents: DataFrame, session: str) -> DataFrame:
        """Register documents (source_id, text), propose claims (by the proposer, else every sentence), admit them."""
        self.add_source(documents, batch=f"documents-{session}")
        safe = documents.withColumn("source_id", T.safe_source_id(F.col("source_id")))
        return self.remember(self.proposer(safe), session) if self.proposer else self.ingest(safe, session)

    # --- reads ---------------------------------------------------------------------------------------------------------

    def readable(self, ts: str | None = None) -> DataFrame:
        return GR.readable(self.claims(), ts)

    def query(self, questions: DataFrame, k: int = RT.LIMIT) -> DataFrame:
        """Questions (question_id, question) with abstain and reason, and for the answered ones their ranked claims."""
        live = self.readable().withColumn("object", F.lit(None).cast("string"))
        bridge = self.claim_entity()
        names = self.entities().select("entity_id", "canonical_name")
        named = RT.subjects(questions, names)
        verdict = RT.gate(questions, live, bridge, named, names)
        ranked = RT.retrieve(questions, live, bridge, named, k)
        return verdict.join(ranked, "question_id", "left").withColumn("answer_rank", F.when(~F.col("abstain"), F.col("rank")))

    def recall(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Answers with claim text and the state of their receipts; abstentions with their reason."""
        receipts = self.verify_receipts().select("node_id", "outcome").join(self.claims().select("node_id", "claim"), "node_id")
        found = self.query(questions, k)
        if self.audit_reads:
            verdicts = found.select("question_id", "abstain", "reason", "head").distinct().join(questions, "question_id")
            logs.append(logs.read_event(verdicts, salt=self.salt).withColumn("ts", F.lit(_now())), f"{self.folder}/reads", f"read-{_stamp()}")
        found = found.join(receipts, "node_id", "left")
        return found.select("question_id", "abstain", "reason", F.col("answer_rank").alias("rank"), *(F.when(~F.col("abstain"), F.col(c)).alias(c) for c in ("claim", "score", "outcome")))

    def review_reads(self) -> dict[str, DataFrame]:
        """Answered and abstained questions, reasons and the most frequent refused heads of the read audit."""
        return logs.summarise(logs.read(self.spark, f"{self.folder}/reads", "fingerprint string, abstain boolean, reason string, head string, ts string"))

    def verify_receipts(self) -> DataFrame:
        """node_id, source_id, outcome: verified, failed, turn_bound (no coordinates) or source_not_held.

        The parts that a receipt's bytes lie in must be held, hash to their registered leaves, whose root
        is the registered one, and read as the evidence; other parts of the source may be erased.
        """
        heads = self.registered().select("source_id", F.col("doc_hash").alias("held_hash"), (P.merkle_root(F.col("hashes")) == F.col("root")).alias("root_ok"))
        own = self.claims().select("node_id", "source_id", "evidence", "doc_hash", "byte_start", "byte_end")
        part = self._held().select("source_id", "part_index", F.col("byte_start").alias("part_start"), F.col("byte_end").alias("part_end"), "text")
        met = own.select("node_id", "source_id", "byte_start", "byte_end").join(part, "source_id").filter("byte_start < part_end and byte_end > part_start")
        read = met.groupBy("node_id").agg(F.min("part_start").alias("from"), F.array_sort(F.collect_list(F.struct("part_index", "text"))).alias("p"))
        read = read.select("node_id", "from", F.array_join(F.transform("p", lambda p: p["text"]), "").cast("binary").alias("bytes"))
        rows = own.join(heads, "source_id", "left").join(read, "node_id", "left")
        span = F.substring(F.col("bytes"), (F.col("byte_start") - F.col("from") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int"))
        good = F.col("root_ok") & (P.normalize_hash(F.col("doc_hash")) == P.normalize_hash(F.col("held_hash"))) & (span == F.col("evidence").cast("binary"))
        outcome = F.when(F.col("byte_start").isNull(), "turn_bound").when(F.col("held_hash").isNull(), "source_not_held").when(F.coalesce(good, F.lit(False)), "verified").otherwise("failed")
        return rows.select("node_id", "source_id", "doc_hash", outcome.alias("outcome"))

    def trace_evidence(self) -> DataFrame:
        """node_id, source_id, trace: from the claim over its bytes to the registration of the source."""
        events = self.ledger().filter("kind = 'ADD_SOURCE'").select(P.normalize_hash(F.get_json_object("payload", "$.doc_hash")).alias("__h")).groupBy("__h").agg(F.count("*").alias("__n"))
        out = self.verify_receipts().withColumn("__h", P.normalize_hash(F.col("doc_hash"))).join(events, "__h", "left")
        trace = F.when(F.col("outcome") == "turn_bound", "TURN-BOUND").when(F.col("__n").isNull() | (F.col("outcome") != "verified"), "NOT FOUND").when(F.col("__n") > 1, "AMBIGUOUS")
        return out.select("node_id", "source_id", trace.otherwise("TRACED").alias("trace"))

    def stats(self) -> DataFrame:
        return self.claims().groupBy("memory_state").agg(F.count("*").alias("claims"))

    def review_quarantine(self, n: int = 20) -> DataFrame:
        return logs.latest(self._objects("doubt_", QUARANTINE).drop("object_id"), n)

    def verify_ledger(self) -> DataFrame:
        return L.verify_chain(self.ledger()).filter("fault is not null")

    # --- erasure and exchange ------------------------------------------------------------------------------------------

    def _naming(self, subject: str) -> tuple[DataFrame, DataFrame]:
        """Readable objects (object_id) whose text has the subject's words, and the names (name) that hold them."""
        words = r"\s+".join(re.escape(w) for w in subject.split())
        if not words:
            raise ValueError("an empty subject names everything")
        pattern = rf"(?i)(?<![\p{{L}}\p{{N}}]){words}(?![\p{{L}}\p{{N}}])"
        texts = GR.union_all(
            self._objects("node_", CLAIM, True).select("object_id", F.concat_ws("\n", "claim", "evidence").alias("text")), self._objects("part:", PART, True).select("object_id", "text"),
            self._objects("doubt_", QUARANTINE, True).select("object_id", F.concat_ws("\n", "claim", "evidence").alias("text")),
        )
        found = texts.filter(F.col("text").rlike(pattern))
        return found.select("object_id").distinct(), found.select(F.explode(T.candidate_names(F.col("text"))).alias("name")).filter(F.col("name").rlike(pattern)).distinct()

    def forget(self, subject: str) -> dict:
        """Erase a subject: every object whose text names it, and claims derived from those; a signed certificate.

        ERASE events come first, then the keys are deleted, then it is probed that no text of the store
        names the subject and that questions about its names are refused; else ``ErasureIncomplete``.
        Repeated after a crash, it takes up what still has keys.
        """
        with ExitStack() as calls:
            keep = lambda df: calls.enter_context(_kept(df))
            claims = keep(self.claims())
            before, state_before = claims.count(), self.state_hash()
            own, names = self._naming(subject)
            own = keep(own)
            derived = self.relations().filter("relation_type = 'derived_from'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
            gone = keep(GR.closure(own.select(F.col("object_id").alias("node_id")), derived).select(F.col("node_id").alias("object_id")))
            asked = self.spark.createDataFrame(names.unionByName(self.spark.createDataFrame([(subject,)], "name string")).distinct().toArrow())
            names = asked.withColumn("fp", T.salted_fingerprint(F.col("name"), self.salt))
            event = lambda rows, payload: rows.select(F.concat(F.lit("erase:"), payload["id"]).alias("event_id"), F.lit("ERASE").alias("kind"), F.lit(_now()).alias("ts"), T.canonical_json(payload).alias("payload"))
            # Edges of what goes, and of entities that no other claim grounds.
            left = self.claim_entity().join(gone.withColumnRenamed("object_id", "node_id"), "node_id", "left_anti").select(F.col("entity_id").alias("end"))
            left = left.unionByName(claims.select(F.col("node_id").alias("end")).join(gone.withColumnRenamed("object_id", "end"), "end", "left_anti")).distinct()
            loose = self.relations().select("relation_id", F.explode(F.array("source_id", "target_id")).alias("end")).join(left, "end", "left_anti").select(F.col("relation_id").alias("object_id")).distinct()
            events = event(gone.unionByName(loose), {"id": F.col("object_id")}).unionByName(event(names, {"id": F.concat(F.lit("subject:"), "fp"), "subject_fingerprint": F.col("fp")}))
            self._append(events, f"erase-{_stamp()}")
            logs.shred_keys(self.spark, self.keys, gone)
            erased = gone.count()
            left = self._naming(subject)[0].count()
            questions = asked.select(F.monotonically_increasing_id().alias("question_id"), F.concat(F.lit("What about "), "name", F.lit("?")).alias("question"))
            answered = self.query(questions.filter(F.size(T.candidate_names(F.col("question"))) > 1)).filter(~F.col("abstain")).count()
            if left or answered:
                raise GR.ErasureIncomplete(f"{left} texts still name the subject, {answered} questions are still answered")
        certificate = {
            "subject_fingerprint": self.spark.range(1).select(T.salted_fingerprint(F.lit(subject), self.salt)).first()[0], "claims_before": before, "claims_after": self.claims().count(),
            "objects_erased": erased, "probes_answered": 0, "cipher": "AES-256-GCM", "key_destroyed": True, "scope": SCOPE, "state_hash_before": state_before, "state_hash": self.state_hash(),
        }
        return {**certificate, "scheme": self.signer.name, "signature": self.signer.sign(certificate)} if self.signer else certificate

    def state_hash(self) -> str | None:
        row = L.state_hash(self._state()).first()
        return row["state_hash"] if row else None

    def export(self, path: str) -> int:
        """Write a snapshot; returns the number of readable claims."""
        snapshot.write(self.claims().withColumnRenamed("normalized", "normalized_claim"), self.entities(), self.relations(), path)
        return self.readable().count()

    def restore(self, path: str, batch: str | None = None) -> None:
        """Load a snapshot's claims and relations as events; refuses other versions."""
        batch = batch or f"restore-{_stamp()}"
        if logs.committed(self.spark, f"{self.folder}/ledger", batch):
            return
        parts = snapshot.read(self.spark, path)
        node = parts["nodes"].withColumns({"normalized": F.col("normalized_claim"), "object_id": F.col("node_id")})
        fields = [x.split()[0] for x in CLAIM.split(", ")]
        nodes = self._write(self._keyed(node, batch), {f: F.col(f) if f in node.columns else F.lit(None).cast("string") for f in fields})
        rels = parts["relations"].select(F.col("relation_id").alias("event_id"), F.lit("ADD_RELATION").alias("kind"), F.lit(_now()).alias("ts"), T.canonical_json({"id": F.col("relation_id"), **{c: F.col(c) for c in parts["relations"].columns}}).alias("payload"))
        self._append(nodes.unionByName(rels), batch)


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def _stamp() -> str:
    return str(time.time_ns())
