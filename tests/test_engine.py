"""The engine from registration to erasure, the snapshot format, logs and the streaming buffer."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenia import engine as EN
from provenia.operators import ledger as L
from provenia.sources import logs, snapshot
from provenia.streaming import buffer

TEXT = "Maya Lin works for Acme and is at the office. Bob Ross lives in Oslo near the hotel. Été: Maya Lin owns a dog and cooks dinner."


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """On a handful of rows compiling code and planning anew cost more than they save."""
    names = {"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    e = EN.Engine(spark, str(tmp_path_factory.mktemp("store")), signer=L.HmacSigner(b"key"))
    docs = spark.createDataFrame([("a/notes.txt", TEXT)], "source_id string, text string")
    e.ingest_documents(docs, "s1")
    return e


def test_ingest_and_receipts(store):
    assert store.claims().count() == 3
    assert {r["outcome"] for r in store.verify_receipts().collect()} == {"verified"}
    assert {r["trace"] for r in store.trace_evidence().collect()} == {"TRACED"}
    assert store.verify_ledger().count() == 0 and store.stats().first()["claims"] == 3


def test_remember_refuses_and_dedups(spark, store):
    rows = [("Maya Lin works for Acme and is at the office.", "Maya Lin works for Acme and is at the office.", "notes.txt"), ("Maya Lin works for Acme and is at the office since 1999.", "Maya Lin works for Acme and is at the office.", "notes.txt"), ("it was quite unclear", "it was quite unclear", "notes.txt")]
    out = {r["claim"]: (r["decision"], r["reason"]) for r in store.remember(spark.createDataFrame(rows, "claim string, evidence string, source_id string"), "s2").collect()}
    assert out[rows[1][0]][1] == "numeral_invented" and out[rows[2][0]] == ("QUARANTINE", "too_unclear") and store.claims().count() == 3
    assert [r["claim"] for r in store.review_quarantine().collect()] == ["it was quite unclear"]
    with pytest.raises(EN.VersionConflict):
        store.remember(spark.createDataFrame(rows, "claim string, evidence string, source_id string"), "s1")


def test_questions(spark, store):
    q = spark.createDataFrame([(1, "What pet does Maya Lin own?"), (2, "What yacht does Maya Lin own?"), (3, "Where does Zed Quill live?"), (4, "Which office does Maya Lin use?")], "question_id long, question string")
    got = {}
    for r in store.recall(q).collect():
        got.setdefault(r["question_id"], []).append(r)
    assert not got[1][0]["abstain"] and any("dog" in (r["claim"] or "") for r in got[1])
    assert got[2][0]["reason"] == "unknown_predicate" and got[3][0]["reason"] == "entity_not_found" and all(r["claim"] is None for r in got[2] + got[3])
    assert {r["outcome"] for r in got[4]} == {"verified"}


def test_export_restore_and_refusals(spark, store, tmp_path):
    path = str(tmp_path / "snap")
    assert store.export(path) == 3
    again = EN.Engine(spark, str(tmp_path / "again"))
    again.restore(path)
    columns = ("node_id", "claim", "byte_start", "memory_state")
    assert sorted(map(tuple, again.claims().select(*columns).collect())) == sorted(map(tuple, store.claims().select(*columns).collect()))
    parts = snapshot.read(spark, path)
    bad = [tuple(r) for r in snapshot.conformance(parts["nodes"], parts["entities"], parts["relations"]).filter("violations > 0").collect()]
    assert bad == []
    for text in ('{"snapshot_version": 99, "nodes": [], "entities": [], "relations": []}', '{"snapshot_version": 1}', "not json", '{"snapshot_version": 2, "entities": [], "relations": []}', '{"snapshot_version": 2, "nodes": [{"node_id": "n"}], "entities": [], "relations": []}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(snapshot.FormatError):
            snapshot.read(spark, str(tmp_path / "bad.json"))


def _files_with(folder, word):
    return [str(p) for p in folder.rglob("*") if p.is_file() and word in p.read_bytes().lower()]


def test_texts_and_names_are_not_in_the_store(store):
    from pathlib import Path

    assert _files_with(Path(store.folder), b"acme") == [] and _files_with(Path(store.folder), b"ent_maya") == []
    assert not any("salt" in p.name or "key" in p.name for p in Path(store.folder).rglob("*"))


def test_forget(spark, store):
    from pathlib import Path

    certificate = store.forget("Ross")
    signature, _ = certificate.pop("signature"), certificate.pop("scheme")
    assert store.signer.verify(certificate, signature) and certificate["claims_after"] == certificate["claims_before"] - 1 and certificate["key_destroyed"]
    assert store.claims().filter(F.col("claim").contains("Bob")).count() == 0 and store.claims().filter(F.col("claim").contains("Maya")).count() == 2
    source = store.sources().first()
    assert "Bob" not in source["text"] and EN.ERASED in source["text"] and "Maya Lin owns a dog" in source["text"] and not source["whole"]
    assert {r["outcome"] for r in store.verify_receipts().collect()} == {"verified"} and {r["trace"] for r in store.trace_evidence().collect()} == {"TRACED"}
    assert store.verify_ledger().count() == 0 and _files_with(Path(store.folder), b"bob") == [] and _files_with(Path(store.keys), b"bob") == []
    # No version of the keys that opens an erased text is left.
    assert store._objects("part:", EN.PART, erased=True).filter(F.col("text").contains("Bob")).count() == 0
    again = spark.createDataFrame([("Bob Ross lives in Oslo near the hotel.", "Bob Ross lives in Oslo near the hotel.", "notes.txt")], "claim string, evidence string, source_id string")
    assert store.remember(again, "s9").first()["reason"] == "erased_subject"
    assert store.claims().filter(F.col("claim").contains("Bob")).count() == 0
    store.remember(again, "s10", acknowledge_erasure=True)
    assert store.claims().filter(F.col("claim").contains("Bob")).count() == 1


def test_tampering_is_found(spark, store):
    head = store.registered()
    bad = head.withColumn("hashes", F.transform("hashes", lambda h: F.when(h == F.element_at("hashes", 1), F.sha2(h, 256)).otherwise(h)))
    store_registered, store.registered = store.registered, lambda: bad
    assert "verified" not in {r["outcome"] for r in store.verify_receipts().collect()}
    store.registered = store_registered


def test_repeated_batches_change_nothing(spark, tmp_path):
    """Calls repeated under their batch name, also after a crash between keys, place and events."""
    e = EN.Engine(spark, str(tmp_path / "s"), audit_reads=True)
    docs = spark.createDataFrame([("n.txt", TEXT)], "source_id string, text string")
    for _ in range(2):
        e.add_source(docs, batch="b1")
    rows = e.ledger().count()
    claims = spark.createDataFrame([("Maya Lin works for Acme and is at the office.", "Maya Lin works for Acme and is at the office.", "n.txt")], "claim string, evidence string, source_id string")
    before = logs.append_ledger
    logs.append_ledger = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        e.remember(claims, "s1")
    logs.append_ledger = before
    assert e.ledger().count() == rows and e.verify_ledger().count() == 0
    e.remember(claims, "s1")
    assert e.ledger().count() == rows + 2 and e.verify_ledger().count() == 0 and {r["outcome"] for r in e.verify_receipts().collect()} == {"verified"}
    with pytest.raises(EN.VersionConflict):
        e.remember(claims, "s1")
    e.remember(claims, "s2")
    assert e.ledger().filter("kind = 'REINFORCE'").count() == 1 and e.claims().count() == 1
    e.recall(spark.createDataFrame([(1, "Which office does Maya Lin use?"), (2, "Where does Zed Quill live?")], "question_id long, question string")).collect()
    assert tuple(e.review_reads()["totals"].first()) == (1, 1) and "Zed" not in str(e.review_reads()["heads"].collect())


def test_claims_are_resolved_against_the_store(spark, tmp_path):
    """Repeat, same meaning, dispute and change; r grows with sessions, edges are events."""
    e = EN.Engine(spark, str(tmp_path / "s"))
    say = lambda session, *claims: e.remember(spark.createDataFrame([(c, c, "turn") for c in claims], "claim string, evidence string, source_id string"), session)
    say("s1", "Maya Lin likes green tea from Oslo.", "Bob Ross likes dinner at the hotel.", "Maya Lin works for Acme and is at the office.")
    say("s2", "Maya Lin works for Acme and is at the office.", "Maya Lin dislikes green tea from Oslo.", "Bob Ross no longer likes dinner at the hotel.")
    got = {r["claim"]: r for r in e.claims().collect()}
    assert got["Maya Lin likes green tea from Oslo."]["memory_state"] == got["Maya Lin dislikes green tea from Oslo."]["memory_state"] == "disputed"
    assert got["Bob Ross likes dinner at the hotel."]["memory_state"] == "superseded" and got["Bob Ross likes dinner at the hotel."]["valid_to"] and got["Bob Ross no longer likes dinner at the hotel."]["memory_state"] == "active"
    assert got["Maya Lin works for Acme and is at the office."]["r"] == pytest.approx(0.7) and got["Bob Ross no longer likes dinner at the hotel."]["r"] == 0.0
    kinds = {r["relation_type"]: r["count"] for r in e.relations().groupBy("relation_type").count().collect()}
    assert kinds["contradicts"] == 2 and kinds["supersedes"] == 1 and kinds["co_occurs"] >= 2
    say("s3", "Maya Lin works for Acme and is at the big office.")
    assert e.claims().count() == 5 and e.verify_ledger().count() == 0
    ends = e.entities().select("entity_id").unionByName(e.claims().select(F.col("node_id").alias("entity_id")))
    for end in ("source_id", "target_id"):
        assert e.relations().join(ends, F.col(end) == F.col("entity_id"), "left_anti").count() == 0
    e.forget("Bob Ross")
    ends = e.entities().select("entity_id").unionByName(e.claims().select(F.col("node_id").alias("entity_id")))
    assert e.relations().join(ends, F.col("source_id") == F.col("entity_id"), "left_anti").count() == 0 and e.relations().filter("relation_type = 'supersedes'").count() == 0


def test_percepts_wait_and_are_taken_by_salience(spark, tmp_path):
    e = EN.Engine(spark, str(tmp_path / "s"))
    claims = ["Maya Lin likes green tea from Oslo.", "Bob Ross owns a dog and cooks dinner.", "Zoe Park works for Acme and is at the office."]
    rows = [(c, c, "turn", i, [0.2, 0.9, 0.5][i]) for i, c in enumerate(claims)]
    for _ in range(2):
        e.perceive(spark.createDataFrame(rows, "claim string, evidence string, source_id string, seq long, salience double"), batch="p1")
    assert e.pending().count() == 3 and e.tick(batch=4) is None
    assert [r["claim"] for r in e.tick(batch=2).collect()] and {r["claim"] for r in e.claims().collect()} == set(claims[1:]) and e.pending().count() == 1
    assert len(e.flush()) == 1 and e.pending().count() == 0 and e.claims().count() == 3 and e.verify_ledger().count() == 0


def test_two_writers_of_one_place_fail_loudly(spark, tmp_path):
    e = EN.Engine(spark, str(tmp_path / "s"))
    logs.claim_place(spark, f"{e.folder}/ledger", e.tenant, 0, "someone-else")
    with pytest.raises(logs.LedgerConflict):
        e.add_source(spark.createDataFrame([("n.txt", TEXT)], "source_id string, text string"), batch="mine")
    assert e.ledger().count() == 0


def test_unknown_kinds_are_refused(spark):
    with pytest.raises(Exception, match="unknown event kind"):
        L.append(spark.createDataFrame([("t", "1", "e", "ADD_NOISE", "{}")], "tenant string, ts string, event_id string, kind string, payload string")).collect()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab .!?\n é", max_size=30), max_size=4))
def test_whole_parts_are_the_text(spark, texts):
    from provenia.operators import provenance as P

    rows = spark.createDataFrame([(t,) for t in texts] or [("",)], "t string").select("t", P.whole_parts(F.col("t")).alias("p")).collect()
    for r in rows:
        assert "".join(p["text"] for p in r["p"]) == r["t"] and all(r["t"].encode()[p["start"] :].startswith(p["text"].encode()) for p in r["p"])


def test_conformance_finds_faults(spark):
    nodes = spark.createDataFrame([("n", "odd", " ", "active", None, None, None, None), ("n", "fact", "c", "superseded", None, "h", 3, 1)], "node_id string, node_type string, claim string, memory_state string, valid_to string, doc_hash string, byte_start long, byte_end long")
    entities = spark.createDataFrame([("e",)], "entity_id string")
    relations = spark.createDataFrame([("r", "n", "missing", "supports"), ("q", "e", "f", "co_occurs")], "relation_id string, source_id string, target_id string, relation_type string")
    got = {r["check"]: r["violations"] for r in snapshot.conformance(nodes, entities, relations).collect()}
    assert got["node ids are unique"] == 1 and got["node types are known"] == 1 and got["byte ranges are ordered"] == 1 and got["superseded nodes are closed"] == 1
    assert got["other edges join nodes"] == 1 and got["co-occurrence joins entities"] == 1 and got["nodes have an id and a claim"] == 1


def test_logs_are_safe_to_retry(spark, tmp_path):
    rows = spark.createDataFrame([("what salary?", True, "unknown_predicate", "salary"), ("who?", False, "answerable", None)], "question string, abstain boolean, reason string, head string")
    for _ in range(2):
        logs.append(logs.read_event(rows), str(tmp_path / "log"), "b1")
    back = logs.read(spark, str(tmp_path / "log"), "fingerprint string, abstain boolean, reason string, head string")
    assert back.count() == 2 and "question" not in back.columns and tuple(logs.summarise(back)["totals"].first()) == (1, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.booleans()), max_size=40), st.integers(1, 6))
def test_buffer_never_drops_a_more_salient_percept(arrivals, capacity):
    held, seen = [], []
    for i, (salience, _) in enumerate(arrivals):
        row = ("t", i, "c", "e", 0.5, salience)
        seen.append(row)
        held, _ = buffer.step(held, [row], capacity)
    assert held == sorted(seen, key=lambda r: (-r[5], -r[1]))[:capacity]
    now, rest = buffer.take(held, 3)
    assert all(a[5] >= b[5] for a in now for b in rest) and len(now) + len(rest) == len(held)


def test_buffer_stream(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"t{i % 2}", i, f"claim {i}", "e", r.random(), None if i % 5 else r.random()) for i in range(60)]
    raw = spark.createDataFrame(rows, "tenant string, seq long, claim string, evidence string, confidence double, salience double")
    raw.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = buffer.coerce(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")))
    got = []

    def apply(batch, _):
        got.extend(map(tuple, batch.collect()))

    buffer.consolidate(buffer.drained(stream, capacity=16, batch=8), apply, str(tmp_path / "ck"), once=True).awaitTermination(120)
    for t in ("t0", "t1"):
        own = buffer.coerce(raw).filter(F.col("tenant") == t).collect()
        held, _ = buffer.step([], [tuple(x) for x in own], 16)
        first, held = buffer.take(held, 8)
        second, _ = buffer.take(held, 8)
        expected = [(x[1], 1, k + 1) for k, x in enumerate(first)] + [(x[1], 2, k + 1) for k, x in enumerate(second)]
        assert sorted((x[1], x[6], x[7]) for x in got if x[0] == t) == sorted(expected)
