"""Top-k searches against brute force where words and entities are rare, common and absent, and their work as questions grow."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provenia.operators import graph as GR
from provenia.operators import retrieval as RT

WORDS = ["tea", "office", "trip", "doctor", "likes", "with", "owns", "from", "the", *(f"rare{i}" for i in range(12))]


def most_rows(df):
    """The largest number of rows that any operator of the plan put out."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return max(found)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    pick = lambda n: [WORDS[min(int(rng.expovariate(0.25)), len(WORDS) - 1)] for _ in range(n)]
    claims = [
        (f"n{i}", " ".join(pick(rng.randint(1, 5))), rng.randint(0, 30) / 30, f"1997-0{rng.randint(1, 9)}-11", rng.choice(["positive", "negative", "neutral"]), sorted(rng.sample([f"e{j}" for j in range(40)], 2) if rng.random() < 0.7 else ["hot", f"e{rng.randint(0, 39)}"]))
        for i in range(400)
    ]
    asked = []
    for i in range(120):
        own = rng.choice([[], ["hot"], [f"e{rng.randint(0, 39)}"], ["hot", f"e{rng.randint(0, 39)}"]])
        window = rng.choice([None, ("1997-01-01", "1997-05-30"), ("1997-03-01", "1997-08-30")])
        asked.append((i, " ".join(pick(rng.randint(1, 4))), window, rng.random() < 0.4, sorted(rng.sample(["food", "work", "travel"], rng.randint(0, 1))), own))
    c = spark.createDataFrame(claims, "node_id string, normalized string, r double, event_time string, polarity string, e array<string>")
    c = c.withColumn("domains", F.expr("filter(array(if(normalized like '%tea%', 'food', null), if(normalized like '%trip%', 'travel', null), if(normalized like '%office%', 'work', null)), x -> x is not null)")).cache()
    q = spark.createDataFrame(asked, "question_id long, question string, window struct<from string, to string>, negative boolean, domains array<string>, e array<string>")
    return c, q, c.select("node_id", F.explode("e").alias("entity_id")), q.select("question_id", F.explode("e").alias("entity_id"))


def measures(q, c):
    t, x = set(q["question"].split()), set(c["normalized"].split())
    e = set(q["e"])
    j, cov, ep = len(t & x) / len(t | x), len(t & x) / len(t), min(1.0, len(e & set(c["e"])) / len(e)) if e else 0.0
    return j, ep, 0.55 * max(j, cov) + 0.4 * ep + 0.05 * c["r"]


def cut(rows, k):
    return [(n, round(s, 6)) for n, s in sorted(rows, key=lambda x: (-round(x[1], 9), x[0]))[:k]]


def negatives(q, rows):
    return [x for x in rows if x[0]["polarity"] == "negative"] if q["negative"] and any(x[0]["polarity"] == "negative" for x in rows) else rows


def brute_retrieve(q, claims, k):
    rows = []
    for c in claims:
        j, ep, s = measures(q, c)
        if (j > 0 or ep > 0) and (not q["e"] or ep > 0 or j >= 0.05) and (not q["window"] or q["window"]["from"] <= c["event_time"] <= q["window"]["to"]):
            rows.append((c, j, s))
    rows = [(c["node_id"], s) for c, j, s in negatives(q, rows) if not q["domains"] or not c["domains"] or set(q["domains"]) & set(c["domains"]) or j > 0.05]
    return cut(rows, k)


def brute_expand(q, found, claims, k):
    by = {c["node_id"]: c for c in claims}
    ranks = {n: i for i, (n, _) in enumerate(found)}
    matched = {d for n in ranks for d in by[n]["domains"]}
    rows, anchors = [], {}
    for c in claims:
        a = min((r, n) for n, r in ranks.items() if set(by[n]["e"]) & set(c["e"])) if c["node_id"] not in ranks and any(set(by[n]["e"]) & set(c["e"]) for n in ranks) else None
        if a and (not c["domains"] or set(c["domains"]) & matched) and (not q["window"] or q["window"]["from"] <= c["event_time"] <= q["window"]["to"]):
            rows.append((c, measures(q, c)[2]))
            anchors[c["node_id"]] = a[1]
    return [(n, s, anchors[n]) for n, s in cut([(c["node_id"], s) for c, s in negatives(q, rows)], k)]


def test_retrieve_and_expand_are_brute_force(data):
    c, q, bridge, named = data
    claims, asked = c.collect(), q.collect()
    out = RT.retrieve(q.drop("e"), c.drop("e"), bridge, named, 4)
    got, more = defaultdict(list), defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got[r["question_id"]].append((r["node_id"], round(r["score"], 6)))
    second = RT.expand(out, q.drop("e", "domains"), c.withColumnRenamed("e", "entities"), bridge, named, k=3)
    for r in sorted(second.collect(), key=lambda r: r["rank"]):
        more[r["question_id"]].append((r["node_id"], round(r["score"], 6), r["anchor"]))
    assert any(got.values()) and any(more.values())
    for x in asked:
        assert got[x["question_id"]] == brute_retrieve(x, claims, 4), x
        assert more[x["question_id"]] == brute_expand(x, got[x["question_id"]], claims, 3), x


@pytest.mark.parametrize("common, windows, screen", [(0, 1, 0), (10**9, 16, 0)])
def test_filters_do_not_depend_on_what_is_common(data, monkeypatch, common, windows, screen):
    c, q, bridge, named = data
    rows = lambda: {tuple(r) for r in RT.retrieve(q.drop("e"), c.drop("e"), bridge, named, 4).select("question_id", "rank", "node_id", F.round("score", 9)).collect()}
    expected = rows()
    monkeypatch.setattr(RT.C, "COMMON", common)
    monkeypatch.setattr(RT.C, "SCREEN", screen)
    monkeypatch.setattr(RT, "WINDOWS", windows)
    assert rows() == expected


def test_related_and_simple_are_brute_force(data):
    c, q, _, _ = data
    c = c.withColumns({"claim": F.col("normalized"), "memory_state": F.lit("active")})
    claims, asked = c.collect(), q.collect()
    related, simple = defaultdict(list), defaultdict(list)
    for r in sorted(GR.related(c, q.select(F.col("question_id").alias("query_id"), F.col("question").alias("text"), "domains"), 4).collect(), key=lambda r: r["rank"]):
        related[r["query_id"]].append((r["node_id"], round(r["score"], 6)))
    for r in sorted(RT.simple_score(q.select("question_id", "question"), c, 4, 0.2).collect(), key=lambda r: r["rank"]):
        simple[r["question_id"]].append((r["node_id"], round(r["score"], 6)))
    domains = lambda s: {d for d, ws in RT.V.DOMAINS.items() if any(w in s for w in ws)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    assert any(related.values()) and any(simple.values())
    for x in asked:
        t = set(x["question"].split())
        own = [(y["node_id"], jaccard(t, set(y["claim"].split()))) for y in claims if set(x["domains"]) & set(y["domains"])]
        assert related[x["question_id"]] == cut([y for y in own if y[1] > 0], 4), x
        own = [(y["node_id"], 0.4 * jaccard(t, set(y["claim"].split())) + 0.3 * jaccard(domains(x["question"]), domains(y["claim"])) + 0.3 * y["r"]) for y in claims if y["r"] >= 0.2 and t & set(y["claim"].split())]
        assert simple[x["question_id"]] == cut(own, 4), x


@pytest.fixture(scope="module")
def many(spark):
    """600 questions that share words with 1,200 claims, each of a subject of its own and one of two places."""
    q = spark.range(600).select(F.col("id").alias("question_id"), F.expr("concat('which tea does name', id, ' like')").alias("question"), F.expr("concat('name', id)").alias("entity_id"))
    c = spark.range(1200).select(F.expr("concat('n', id)").alias("node_id"), F.expr("concat('name', id div 2, ' likes tea from somewhere')").alias("normalized"), (F.col("id") / 1200).alias("r"), F.array(F.expr("concat('name', id div 2)"), F.expr("concat('place', id % 2)")).alias("entities"))
    c = c.withColumns({"claim": F.col("normalized"), "domains": F.array(F.lit("food")), "memory_state": F.lit("active")}).cache()
    return q.cache(), c, c.select("node_id", F.explode("entities").alias("entity_id"))


MOST = 20_000


def test_retrieve_grows_with_questions_alone(many):
    q, c, bridge = many
    assert most_rows(RT.retrieve(q.select("question_id", "question"), c, bridge, q.select("question_id", "entity_id"), 5)) <= MOST


def test_retrieve_reads_the_claims_in_one_job(many):
    """One job makes what both ways of meeting need of the claims: the result's plan does not come back to them."""
    q, c, bridge = many
    out = RT.retrieve(q.select("question_id", "question"), c, bridge, q.select("question_id", "entity_id"), 5)
    assert out.filter("rank = 1").count() == 600
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "InMemoryRelation" in x and "node_id" in x]


def test_expand_grows_with_questions_alone(many):
    q, c, bridge = many
    named = q.select("question_id", "entity_id")
    ranked = RT.retrieve(q.select("question_id", "question"), c, bridge, named, 2).cache()
    assert most_rows(RT.expand(ranked, q.select("question_id", "question"), c, bridge, named, k=2)) <= MOST


def test_related_grows_with_queries_alone(many):
    q, c, _ = many
    asked = q.select(F.col("question_id").alias("query_id"), F.expr("concat(entity_id, ' likes tea from somewhere else')").alias("text"), F.array(F.lit("food")).alias("domains"))
    assert most_rows(GR.related(c, asked, 5)) <= MOST


def test_simple_score_grows_with_questions_alone(many):
    q, c, _ = many
    assert most_rows(RT.simple_score(q.select("question_id", "question"), c, 5)) <= MOST
