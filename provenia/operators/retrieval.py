"""The read path for many questions at once: parse, candidates, filters, score, top-k, gate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from . import collapse as C

# Weights and thresholds.
W_LEXICAL, W_ENTITY, W_REINFORCE = 0.55, 0.40, 0.05
LIMIT, GUARD, DF_CAP = 10, 0.05, 0.5
ABSTAIN_JACCARD, ABSTAIN_RELAXED, ABSTAIN_COVERAGE = 0.12, 0.05, 0.6
_MARK = "\u0001"
WINDOWS = 16  # different windows that claims are told apart by; with more, each date is its own


def demand(question: Column) -> Column:
    """struct<wh, head, typed>: what the question asks the store to supply."""
    t = T.gate_tokens(question)
    content = F.filter(t, lambda x: ~x.isin(*V.FUNCTION_WORDS))
    first, second, last = F.get(t, F.lit(0)), F.get(t, F.lit(1)), F.try_element_at(content, F.lit(-1))
    degree = ("many", "much", "long", "old", "far", "often")
    rest = F.slice(t, 3, 10000)
    stop = F.array_position(F.transform(rest, lambda x: x.isin(*V.AUXILIARIES)), True).cast("int")
    noun = F.try_element_at(F.filter(F.when(stop > 0, F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rest), lambda x: ~x.isin(*V.FUNCTION_WORDS) & ~x.isin(*degree)), F.lit(-1))
    after = F.slice(t, 2, 2)
    phrase = F.when(F.get(after, F.lit(1)).isin(*V.FUNCTION_WORDS) | F.get(after, F.lit(1)).isNull(), second).otherwise(F.get(after, F.lit(1)))
    partitive = second.isin("kind", "type", "sort") & (F.get(t, F.lit(2)) == "of") & (F.size(t) > 3)
    of = F.get(F.filter(F.slice(t, 4, 10000), lambda x: ~x.isin(*V.FUNCTION_WORDS)), F.lit(0))
    typed = F.when(first == "who", "person").when(first == "where", "place").when(first == "when", "time")
    head = (
        F.when((first == "how") & second.isin(*degree), noun)
        .when(first.isin("what", "which", "whose") & partitive, of)
        .when(first.isin("what", "which", "whose") & second.isNotNull() & ~second.isin(*V.FUNCTION_WORDS), phrase)
        .otherwise(last)
    )
    wh = F.when(first.isin("what", "which", "whose", "who", "where", "when", "how", "why"), first).when(first.isin(*V.AUXILIARIES), "bool")
    kind = F.when((first == "how") & second.isin("many", "much"), "quantity").when((first == "how") & second.isin(*degree), "measure").otherwise(typed)
    return F.struct(wh.alias("wh"), head.alias("head"), kind.alias("typed"))


def slot_of_head(head: Column) -> Column:
    pairs = [F.lit(v) for s, heads in sorted(V.SLOTS.items()) for h in heads for v in (h, s)]
    return F.try_element_at(F.create_map(*pairs), head)


def subjects(questions: DataFrame, entities: DataFrame, most_words: int = 3) -> DataFrame:
    """(question_id, entity_id): name spans of one to three words that are an entity's name, longest first from the left.

    Spans are exploded and equi-joined; a span inside a longer matched one is dropped.
    """
    tokens = questions.select("question_id", T.gate_tokens(F.col("question")).alias("t"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1))), lambda i: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(F.col("t"), i, n), " ").alias("key")))))
    found = tokens.select("question_id", F.size("t").alias("size"), F.explode(spans).alias("s")).filter("s.at + s.n - 1 <= size")
    hits = found.select("question_id", "s.at", "s.n", "s.key").join(entities.select(F.lower("canonical_name").alias("key"), "entity_id"), "key")
    w = Window.partitionBy("question_id").orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.col("at") + F.col("n")).over(w)
    return hits.withColumn("c", covered).filter(F.col("c").isNull() | (F.col("at") >= F.col("c"))).select("question_id", "entity_id").distinct()


def vocabulary(claims: DataFrame) -> DataFrame:
    """Document frequency of every word, lemma and object word over readable claims (normalized, lemma, object)."""
    terms = F.array_union(T.gate_tokens(F.col("normalized")), F.array_union(F.array_compact(F.array(F.when(F.col("lemma") != "unknown", F.col("lemma")))), T.gate_tokens(F.coalesce("object", F.lit("")))))
    return claims.select(F.explode(F.array_distinct(terms)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def scoped_vocabulary(claims: DataFrame, claim_entity: DataFrame) -> DataFrame:
    """Document frequency of every word over the claims of each entity: entity_id, token, df."""
    words = claims.select("node_id", F.explode(F.array_distinct(T.gate_tokens(F.col("normalized")))).alias("token"))
    return claim_entity.select("node_id", "entity_id").distinct().join(words, "node_id").groupBy("entity_id", "token").agg(F.count("*").alias("df"))


def slot_counts(claims: DataFrame, claim_entity: DataFrame) -> DataFrame:
    """Typed claims by slot, in the whole store (entity_id null) and by entity."""
    typed = claims.filter("slot is not null").select("node_id", "slot")
    own = claim_entity.select("node_id", "entity_id").distinct().join(typed, "node_id").groupBy("entity_id", "slot").agg(F.count("*").alias("claims"))
    return own.unionByName(typed.groupBy("slot").agg(F.count("*").alias("claims")).withColumn("entity_id", F.lit(None).cast("string")))


def status(tokens: DataFrame, vocab: DataFrame, n_docs: int | Column, cap: float = DF_CAP) -> DataFrame:
    """tokens (key columns and ``token``) with grounded, non_discriminative or ungrounded, by the word or, failing it, a form of it."""
    keys = [c for c in tokens.columns]
    forms = tokens.select(*keys, F.posexplode(T.verb_forms(F.col("token"))).alias("place", "form"))
    found = forms.join(vocab.withColumnRenamed("token", "form"), "form", "left").groupBy(*keys).agg(F.min_by("df", F.when(F.col("df").isNotNull(), F.col("place"))).alias("df"))
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return found.withColumn("status", F.when(F.col("df").isNull(), "ungrounded").when(F.col("df") / n > cap, "non_discriminative").otherwise("grounded"))


def polarity_filter(matches: DataFrame, query_negative: str = "negative_question") -> DataFrame:
    """For negative questions the negative claims, unless there is none: then all stay."""
    flag = F.col("polarity") == "negative"
    any_ = F.max(flag.cast("int")).over(Window.partitionBy("question_id"))
    return matches.withColumn("__any", any_).filter(~F.col(query_negative) | (F.col("__any") == 0) | flag).drop("__any")


def in_window(event_time: Column, window: Column) -> Column:
    """No window or no date passes; a date of year or month is compared at its own precision."""
    cut = lambda end: F.substring(end, F.lit(1), F.length(event_time))
    return window.isNull() | event_time.isNull() | ((event_time >= cut(window["from"])) & (event_time <= cut(window["to"])))


def features(tokens: Column, entities: Column) -> Column:
    """Words, and entities by a mark that no word has."""
    return F.concat(tokens, F.transform(entities, lambda e: F.concat(F.lit(_MARK), e.cast("string"))))


def _none() -> Column:
    return F.array().cast("array<string>")


def _asked(questions: DataFrame, question_entity: DataFrame, given: list[str]) -> DataFrame:
    """question_id, ``given``, nq and ne (numbers of words and entities), f."""
    own = question_entity.groupBy("question_id").agg(F.collect_set("entity_id").alias("e"))
    q = questions.select("question_id", *given, F.coalesce(T.scoring_tokens(F.col("question")), _none()).alias("t")).join(own, "question_id", "left")
    return q.select("question_id", *given, F.size("t").alias("nq"), F.coalesce(F.size("e"), F.lit(0)).alias("ne"), features(F.col("t"), F.coalesce("e", F.array())).alias("f"))


def _with_entities(claims: DataFrame, claim_entity: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Claims with the array ``entities``: their own column of that name, or what the bridge has (of ``asked`` entities alone, where given)."""
    if "entities" in claims.columns:
        return claims
    bridge = claim_entity if asked is None else claim_entity.join(asked.select("entity_id").distinct(), "entity_id", "left_semi")
    return claims.join(bridge.groupBy("node_id").agg(F.collect_set("entity_id").alias("entities")), "node_id", "left").withColumn("entities", F.coalesce("entities", F.array()))


def _matched(pairs: DataFrame) -> DataFrame:
    """Pairs with ``qf`` and ``f``, nq, nc and ne, and how well they match: jaccard, coverage, entity_precision, base."""
    shared = F.array_intersect("qf", "f")
    hits = F.size(F.filter(shared, lambda x: x.startswith(_MARK)))
    pairs = pairs.withColumns({"hits": hits, "both": F.size(shared) - hits})
    jaccard = F.when((F.col("nq") == 0) | (F.col("nc") == 0), 0.0).otherwise(F.col("both") / (F.col("nq") + F.col("nc") - F.col("both")))
    coverage = F.when(F.col("nq") == 0, 0.0).otherwise(F.col("both") / F.col("nq"))
    precision = F.when(F.col("ne") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("hits") / F.col("ne")))
    pairs = pairs.withColumns({"jaccard": jaccard, "coverage": coverage, "entity_precision": precision})
    return pairs.withColumn("base", W_LEXICAL * F.greatest("jaccard", "coverage") + W_ENTITY * F.col("entity_precision"))


def _seen(claims: DataFrame, questions: DataFrame) -> Column:
    """What the windows of the questions tell of event_time: which of them it is in; itself, if there are more than ``WINDOWS`` of them."""
    windows = [r["window"] for r in questions.select("window").filter("window is not null").distinct().limit(WINDOWS + 1).collect()]
    if len(windows) > WINDOWS:
        return F.col("event_time")
    return F.array(F.lit(True), *(F.coalesce(in_window(F.col("event_time"), F.struct(F.lit(w["from"]).alias("from"), F.lit(w["to"]).alias("to"))), F.lit(False)) for w in windows))


def retrieve(questions: DataFrame, claims: DataFrame, claim_entity: DataFrame, question_entity: DataFrame, k: int = LIMIT) -> DataFrame:
    """Scored candidates of each question: question_id, rank, node_id, score, jaccard, coverage, entity_precision.

    Candidates share a scoring token or an entity with the question; those that share only what many
    questions ask for are met as groups, by kinds of questions (``collapse``). A question with entities
    needs an entity or a Jaccard of ``GUARD``. Optional columns of the questions filter the candidates
    before the ranking, in this order: ``window`` (struct of dates, against the claims' event_time),
    ``negative`` (boolean, against polarity: negative claims alone, unless there is none), ``domains``
    (against the claims' domains: a shared one, none at all, or a Jaccard over ``GUARD``). Claims with
    an array ``entities`` need no bridge.
    """
    filters = {"window": "event_time", "negative": "polarity", "domains": "claim_domains"}
    given = {f: c for f, c in filters.items() if f in questions.columns}
    q = _asked(questions, question_entity, list(given))
    own = [F.array_sort("domains").alias("claim_domains") if c == "claim_domains" else F.col(c) for c in given.values()]
    c = _with_entities(claims, claim_entity, question_entity).select("node_id", "r", *own, F.coalesce(T.scoring_tokens(F.col("normalized")), _none()).alias("t"), "entities")
    c = c.select("node_id", "r", *given.values(), F.size("t").alias("nc"), features(F.col("t"), F.col("entities")).alias("f"))
    measures = ("base", "jaccard", "coverage", "entity_precision", "flag")

    def passed(pairs: DataFrame) -> DataFrame:
        pairs = _matched(pairs).filter((F.col("ne") == 0) | (F.col("hits") > 0) | (F.col("jaccard") >= GUARD))
        if "window" in given:
            pairs = pairs.filter(in_window(F.col("event_time"), F.col("window")))
        flag = F.col("negative") & (F.col("polarity") == "negative") if "negative" in given else F.lit(False)
        fit = (F.size("domains") == 0) | (F.size("claim_domains") == 0) | F.arrays_overlap("claim_domains", "domains") | (F.col("jaccard") > GUARD) if "domains" in given else F.lit(True)
        return pairs.withColumns({"flag": F.coalesce(flag, F.lit(False)), "fit": F.coalesce(fit, F.lit(False)), "strict": F.col("negative") if "negative" in given else F.lit(False)})

    common, posted = C.common_features(q), None
    if common:
        by = {"nc": F.col("nc")} | {"seen" if x == "event_time" else x: _seen(c, q) if x == "event_time" else F.col(x) for x in given.values()}
        posted, members = C.divided(q, c, common, by, [F.desc("r")], k)
    pairs = passed(C.near(q, c, common, posted)).select("question_id", "node_id", "r", "strict", "fit", *measures)
    score = F.round(F.col("base") + W_REINFORCE * F.col("r"), 9)
    if common:
        kind = C.kinds(q, common)
        met = passed(C.far(kind, members))
        if "negative" in given:
            # A kind's negative claim counts for all of its questions, be it of their domains or not.
            any_ = met.groupBy("sid").agg(F.max("flag").alias("flag")).filter("flag")
            marks = kind.join(any_, "sid").select("question_id", F.lit(None).cast(c.schema["node_id"].dataType).alias("node_id"), F.lit(0.0).alias("r"), F.lit(True).alias("strict"), F.lit(False).alias("fit"), *(F.lit(0.0).alias(m) for m in measures[:-1]), "flag")
            pairs = pairs.unionByName(marks)
            met = met.join(any_.select("sid", F.lit(True).alias("__any")), "sid", "left").filter(F.col("__any").isNull() | F.col("flag"))
        met = C.best_far(met.filter("fit"), members, kind, score, k, "strict", *measures)
        pairs = pairs.unionByName(met.withColumn("fit", F.lit(True)))
    if "negative" in given:
        some = F.max("flag").over(Window.partitionBy("question_id"))
        pairs = pairs.withColumn("__some", some).filter(~F.col("strict") | ~F.col("__some") | F.col("flag"))
    rows = pairs.filter("fit").withColumn("score", F.col("base") + W_REINFORCE * F.col("r"))
    return C.best(rows, F.round("score", 9), k, "score", "jaccard", "coverage", "entity_precision")


def parsed(questions: DataFrame, anchor: Column) -> DataFrame:
    """Questions with the columns by which ``retrieve`` filters: window (relative to the date ``anchor``), negative, domains."""
    x = F.col("question")
    return questions.withColumns({"window": T.window_of(x, anchor), "negative": T.is_negated(x), "domains": T.domains(x)})


def relevant(ranked: DataFrame) -> DataFrame:
    """Results without those that share neither a word nor an entity with their question, unless that leaves none."""
    good = (F.col("jaccard") > 0) | (F.col("entity_precision") > 0)
    any_ = F.max(good.cast("int")).over(Window.partitionBy("question_id"))
    return ranked.withColumn("__any", any_).filter(good | (F.col("__any") == 0)).drop("__any")


def expand(ranked: DataFrame, questions: DataFrame, claims: DataFrame, claim_entity: DataFrame, question_entity: DataFrame, relations: DataFrame | None = None, k: int = LIMIT) -> DataFrame:
    """The second list of each question: neighbours of its results, ranked as results are: question_id, rank, node_id, score, via, anchor.

    Neighbours share an entity with a result (``via`` entity) and a domain with any of its results, or
    have none; ``relations`` adds those one typed edge away (``via`` the edge's type), whatever their
    domain. Windows and negative questions filter them too. The anchor is the best-ranked result that
    leads there. Neighbours that share something rare with their question are met as they are; of all
    others, kinds of questions meet the groups of an entity's claims (``collapse``), each with as many
    first members as a question can want besides its own results.
    """
    given = {f: c for f, c in {"window": "event_time", "negative": "polarity"}.items() if f in questions.columns}
    ranked = C.written(ranked.select("question_id", "node_id", "rank"), "ranked")
    most = ranked.groupBy("question_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    c = _with_entities(claims, claim_entity).select("node_id", "r", *given.values(), F.col("domains").alias("own"), F.coalesce(T.scoring_tokens(F.col("normalized")), _none()).alias("t"), "entities")
    c = c.select("node_id", "r", *given.values(), "own", "entities", F.size("t").alias("nc"), features(F.col("t"), F.col("entities")).alias("f"))
    if "window" in given:
        c = c.withColumn("seen", _seen(c, questions))
    # What leads from a question: its results, their domains, and for each of their entities the best result with it.
    held = C.screened(c, "node_id", ranked).join(ranked, "node_id").select("question_id", "node_id", "rank", "own", "entities")
    held = C.written(held, "held")
    reach = held.select("question_id", F.struct("rank", F.col("node_id").alias("anchor")).alias("a"), F.explode("entities").alias("entity_id")).groupBy("question_id", "entity_id").agg(F.min("a").alias("a"))
    leads = reach.groupBy("question_id").agg(F.collect_list(F.struct("entity_id", "a")).alias("reach"))
    results = held.groupBy("question_id").agg(F.collect_set("node_id").alias("results"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("matched"))
    q = _asked(questions, question_entity, list(given))
    every = q.join(results, "question_id").join(leads, "question_id", "left").withColumn("reach", F.coalesce("reach", F.array()))
    every = C.written(every, "asked")
    q = every.drop("results", "reach")
    alike = (F.size("own") == 0) | F.arrays_overlap("own", "matched")
    columns = ("question_id", "node_id", "base", "r", "via", "a", "strict", "flag")

    def passed(pairs: DataFrame) -> DataFrame:
        pairs = _matched(pairs)
        if "window" in given:
            pairs = pairs.filter(in_window(F.col("event_time"), F.col("window")))
        strict = F.col("negative") if "negative" in given else F.lit(False)
        return pairs.withColumns({"strict": strict, "flag": F.coalesce(F.col("polarity") == "negative", F.lit(False)) if "negative" in given else F.lit(False)})

    def led(pairs: DataFrame) -> DataFrame:
        at = F.array_min(F.transform(F.filter("reach", lambda x: F.array_contains("entities", x["entity_id"])), lambda x: x["a"]))
        return passed(pairs.filter(~F.array_contains("results", F.col("node_id"))).withColumn("a", F.when(alike, at)))

    common = C.common_features(q)
    pairs = led(C.near(every, c, common)).filter("a is not null").withColumn("via", F.lit("entity")).select(*columns)
    if relations is not None:
        seeds = ranked.select("question_id", F.col("node_id").alias("seed"), "rank")
        edges = relations.filter(F.col("relation_type").isin("causes", "motivates", "before"))
        both = edges.select(F.col("source_id").alias("seed"), F.col("target_id").alias("node_id"), "relation_type").unionByName(edges.select(F.col("target_id").alias("seed"), F.col("source_id").alias("node_id"), "relation_type"))
        typed = seeds.join(both, "seed").groupBy("question_id", "node_id").agg(F.min(F.struct(F.struct("rank", F.col("seed").alias("anchor")).alias("a"), "relation_type")).alias("b"))
        typed = led(typed.join(c, "node_id").join(every.withColumnRenamed("f", "qf"), "question_id"))
        pairs = pairs.unionByName(typed.withColumns({"via": F.when(F.col("a").isNull(), F.col("b.relation_type")).otherwise("entity"), "a": F.least("a", "b.a")}).select(*columns))
    # By common features alone: an entity's groups, and of each kind and entity as many neighbours as remain enough without any question's own results.
    kind = C.kinds(q, common)
    ways = kind.select("question_id", "sid").join(reach, "question_id")
    by = ["entity_id", "nc", "own", *("seen" if x == "event_time" else x for x in given.values())]
    members = C.screened(c.withColumn("entity_id", F.explode("entities")).drop("entities"), "entity_id", reach)
    members = C.written(C.group(members, common, by, [F.desc("r")], k + most, 0), "members")
    met = ways.select("sid", "entity_id").distinct().join(members.filter("place = 1").drop("place", "node_id"), "entity_id")
    met = passed(met.join(kind.drop("question_id").dropDuplicates(["sid"]).withColumnRenamed("f", "qf"), "sid").filter(alike))
    score = F.round(F.col("base") + W_REINFORCE * F.col("r"), 9)
    w = Window.partitionBy("sid", "entity_id", "flag")
    met = met.withColumn("__s", score).withColumn("__p", F.rank().over(w.orderBy(F.desc("__s")))).filter(F.col("__p") <= k + most).select("sid", "entity_id", "gid", "base", "strict", "flag")
    met = met.join(members.select("entity_id", "gid", "node_id", "r"), ["entity_id", "gid"]).withColumn("__s", score).withColumn("__p", F.row_number().over(w.orderBy(F.desc("__s"), "node_id"))).filter(F.col("__p") <= k + most)
    met = ways.join(met, ["sid", "entity_id"]).withColumn("via", F.lit("entity")).select(*columns)
    met = met.join(ranked.select("question_id", "node_id"), ["question_id", "node_id"], "left_anti")
    rows = pairs.unionByName(met)
    if "negative" in given:
        some = F.max("flag").over(Window.partitionBy("question_id"))
        rows = rows.withColumn("__some", some).filter(~F.col("strict") | ~F.col("__some") | F.col("flag"))
    rows = rows.groupBy("question_id", "node_id").agg(F.max(F.col("base") + W_REINFORCE * F.col("r")).alias("score"), F.min_by("via", F.col("via") != "entity").alias("via"), F.min("a").alias("a"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "node_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("question_id", "rank", "node_id", "score", "via", F.col("a.anchor").alias("anchor"))


def lexical_abstain(results: DataFrame) -> DataFrame:
    """Per question: abstain if its best Jaccard and coverage are both too low (lower bar with a strong entity match)."""
    best = results.groupBy("question_id").agg(F.max("jaccard").alias("jaccard"), F.max("coverage").alias("coverage"), F.max("entity_precision").alias("entity"))
    bar = F.when(F.col("entity") >= 1.0, ABSTAIN_RELAXED).otherwise(ABSTAIN_JACCARD)
    return best.withColumn("abstain", (F.col("jaccard") < bar) & (F.col("coverage") < ABSTAIN_COVERAGE))


def gate(questions: DataFrame, claims: DataFrame, claim_entity: DataFrame, question_entity: DataFrame, entities: DataFrame, typed_miss_refuses: bool = False) -> DataFrame:
    """Per question: abstain, reason (answerable, entity_not_found, no_evidence, unknown_predicate), head and its status.

    A head grounded anywhere in the store answers; else the claims of the named subject decide, by slot
    or by a concrete word for a general one in the subject's own words. Only questions without a known
    subject look for concrete words in the whole store. ``typed_miss_refuses``: where the subject has
    typed claims and none of the slot asked for, concrete words do not help.
    """
    n = claims.count()
    vocab = vocabulary(claims)
    d = questions.withColumn("d", demand(F.col("question"))).select("question_id", "question", F.col("d.wh").alias("wh"), F.col("d.head").alias("head"))
    stat = status(d.filter(F.col("head").isNotNull()).select("question_id", F.col("head").alias("token")), vocab, max(n, 1)).select("question_id", "status")
    bridge = claim_entity.select("node_id", "entity_id").distinct()
    slots = bridge.join(claims.select("node_id", "slot").filter("slot is not null"), "node_id").select("entity_id", "slot").distinct()
    asked_slots = question_entity.join(slots, "entity_id").select("question_id", "slot").distinct()
    typed, covered = asked_slots.withColumn("typed_hit", F.lit(True)), asked_slots.select("question_id").distinct().withColumn("has_typed", F.lit(True))
    pairs = questions.sparkSession.createDataFrame([(g, w) for g, ws in V.HYPONYMS.items() for w in ws], "head string, token string")
    anywhere = pairs.join(vocab, "token").groupBy("head").agg(F.min("token").alias("anywhere"))
    concrete = sorted({w for ws in V.HYPONYMS.values() for w in ws})
    said = claims.select("node_id", F.explode(F.array_distinct(T.gate_tokens(F.col("normalized")))).alias("token")).filter(F.col("token").isin(*concrete))
    about = said.join(bridge, "node_id").select("entity_id", "token").distinct().join(question_entity, "entity_id").select("question_id", "token").distinct()
    about = about.join(pairs, "token").groupBy("question_id", "head").agg(F.min("token").alias("own_word"))
    named = F.size(F.filter(T.candidate_names(F.regexp_replace(F.col("question"), r"^\S+\s*", "")), lambda x: x != "")) > 0
    known = question_entity.join(bridge.select("entity_id").distinct().withColumn("spoken", F.lit(True)), "entity_id", "left").groupBy("question_id").agg(F.lit(True).alias("has_subject"), F.max("spoken").alias("has_claims"))
    out = d.join(stat, "question_id", "left").join(known, "question_id", "left").withColumn("slot", slot_of_head(F.col("head")))
    out = out.join(typed, ["question_id", "slot"], "left").join(covered, "question_id", "left").join(anywhere, "head", "left").join(about, ["question_id", "head"], "left")
    word = F.when(F.col("has_claims"), F.col("own_word")).otherwise(F.col("anywhere"))
    if typed_miss_refuses:
        word = F.when(F.col("has_typed") & F.col("slot").isNotNull(), None).otherwise(word)
    reason = (
        F.when(named & F.col("has_subject").isNull(), "entity_not_found")
        .when(F.col("head").isNull(), "answerable")
        .when(F.lit(n == 0), "no_evidence")
        .when(F.col("status") != "ungrounded", "answerable")
        .when(F.col("typed_hit"), "answerable")
        .when(word.isNotNull(), "answerable")
        .otherwise("unknown_predicate")
    )
    return out.withColumn("reason", reason).withColumn("abstain", F.col("reason") != "answerable").select("question_id", "wh", "head", "status", "abstain", "reason")


def predicates_about(claims: DataFrame, claim_entity: DataFrame, names: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent content words of each entity's claims, its own name left out; ties by word."""
    words = claims.select("node_id", F.explode(F.array_distinct(T.gate_tokens(F.col("normalized")))).alias("token")).filter(~F.col("token").isin(*V.FUNCTION_WORDS) & (F.length("token") >= 3))
    own = names.select("entity_id", F.explode(F.array_distinct(T.gate_tokens(F.col("canonical_name")))).alias("token"))
    counted = claim_entity.select("node_id", "entity_id").distinct().join(words, "node_id").join(own, ["entity_id", "token"], "left_anti").groupBy("entity_id", "token").agg(F.count("*").alias("claims"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("claims"), "token"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k)


def some_entities(entities: DataFrame, n: int = 5) -> DataFrame:
    """A few known names, for the redirect of an unknown subject."""
    return entities.select("canonical_name").distinct().orderBy("canonical_name").limit(n)


def simple_score(questions: DataFrame, claims: DataFrame, k: int = 10, least_r: float = 0.0) -> DataFrame:
    """The plain scorer: 0.4 Jaccard of words + 0.3 Jaccard of domains + 0.3 reinforcement, over claims that share a word."""
    q = questions.select("question_id", T.scoring_tokens(F.col("question")).alias("f"), T.domains(F.col("question")).alias("qd")).withColumn("nq", F.size("f"))
    c = claims.filter(F.col("r") >= least_r).select("node_id", "r", T.scoring_tokens(F.col("claim")).alias("f"), T.domains(F.col("claim")).alias("cd")).withColumn("nc", F.size("f"))

    def based(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("qf", "f"))
        return pairs.withColumn("base", 0.4 * both / (F.col("nq") + F.col("nc") - both) + 0.3 * T.jaccard(F.col("qd"), F.col("cd")))

    common = C.common_features(q)
    pairs = based(C.near(q, c, common)).select("question_id", "node_id", "r", "base")
    score = F.col("base") + 0.3 * F.col("r")
    if common:
        kind, members = C.kinds(q, common), C.written(C.group(c, common, ["nc", "cd"], [F.desc("r")], k), "members")
        pairs = pairs.unionByName(C.best_far(based(C.far(kind, members)), members, kind, F.round(score, 9), k, "base"))
    return C.best(pairs.withColumn("score", score), F.round("score", 9), k, "score")


def top_cosine(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, vec_id, rank): the k vectors of highest cosine (rounded to nine places, ties by id) for every query row, itself left out.

    Queries are taken in blocks of ``block``: one block at a time is broadcast and meets all vectors in
    numpy; a task keeps k results for each query.
    """
    spark = vectors.sparkSession
    form = lambda df: df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows, asked = form(vectors), form(vectors.filter(is_query))
    blocks, found = max(1, -(-asked.count() // block)), []
    for b in range(blocks):
        table = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        own = spark.sparkContext.broadcast((table.column(0).to_numpy(), _unit(table.column(1))) if table.num_rows else None)

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            if own.value is None:
                return
            ids, q = own.value
            best, names = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                if batch.num_rows:
                    at = batch.column(0).to_numpy(zero_copy_only=False)
                    s = np.round(q @ _unit(batch.column(1)).T, 9)
                    s[ids[:, None] == at[None, :]] = -np.inf
                    both, every = np.column_stack([best, s]), np.column_stack([names, np.broadcast_to(at, s.shape)])
                    place = np.lexsort((every, -both), axis=1)[:, :k]
                    best, names = np.take_along_axis(both, place, 1), np.take_along_axis(every, place, 1)
            real = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[real]), pa.array(names[real]), pa.array(best[real])], names=["query_id", "vec_id", "s"])

        found.append(rows.mapInArrow(run, "query_id long, vec_id long, s double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank")


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length of a column of equally long vectors."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def bundle_hits(claims: DataFrame, bundles: DataFrame, least: int = 2, most: int = 10_000) -> DataFrame:
    """Claims that hit ``least`` or more bundles (target, bundle, phrase; target_order) of a target; the first target wins.

    Bundles are a vocabulary of at most ``most`` phrases (more is an error); they become one column
    expression, so claims are read once and nothing is joined.
    """
    rows = bundles.select("target", "target_order", "bundle", "phrase").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} phrases")
    targets: dict[tuple, dict[str, list[str]]] = {}
    for r in rows:
        targets.setdefault((r["target_order"], r["target"]), {}).setdefault(r["bundle"], []).append(r["phrase"])
    low = F.col("low")
    hits = lambda own: sum((T.contains_any(low, tuple(p)).cast("int") for p in own.values()), F.lit(0))
    target = F.coalesce(*[F.when(hits(own) >= least, F.lit(t)) for (_, t), own in sorted(targets.items())], F.lit(None).cast("string"))
    return claims.select("node_id", F.lower("claim").alias("low")).select("node_id", target.alias("target")).filter("target is not null")


def validate_answers(answers: DataFrame, given: DataFrame, most: int = 800) -> DataFrame:
    """Model answers (question_id, answer, cited) with ``violation``: empty, too_long, operator_syntax, hedged, unsupported_citation, or null.

    ``given``: the node ids each question was answered from.
    """
    cited = answers.select("question_id", F.explode("cited").alias("node_id")).join(given.select("question_id", "node_id"), ["question_id", "node_id"], "left_anti").select("question_id").distinct().withColumn("__bad", F.lit(True))
    hedge = T.contains_any(F.lower("answer"), ("i am not sure", "i don't know", "cannot determine", "not enough information"))
    violation = (
        F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", "empty").when(F.length("answer") > most, "too_long").when(F.col("answer").rlike(r"[{}<>]|\bnode_[0-9a-f]{12}\b"), "operator_syntax")
        .when(hedge, "hedged").when(F.col("__bad"), "unsupported_citation")
    )
    return answers.join(cited, "question_id", "left").withColumn("violation", violation).drop("__bad")


def semantic_rescue(refused: DataFrame, terms: DataFrame, embedding: str = "embedding", least: float = 0.60, block: int = 65536) -> DataFrame:
    """For refused heads (question_id, embedding) the most alike term (term, embedding) at ``least`` cosine: an optional encoder's vectors, off by default.

    Terms are taken in blocks, one broadcast at a time; ties go to the later term.
    """
    spark = refused.sparkSession
    form = lambda df, key: df.filter(F.col(embedding).isNotNull()).select(key, F.transform(embedding, lambda x: x.cast("double")).alias("v"))
    heads, words = form(refused, "question_id"), form(terms, "term")
    schema = f"question_id {refused.schema['question_id'].dataType.simpleString()}, term string, cosine double"
    blocks, found = max(1, -(-words.count() // block)), []
    for b in range(blocks):
        table = words.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).orderBy("term").toArrow()
        own = spark.sparkContext.broadcast((table.column(0).to_pylist(), _unit(table.column(1))) if table.num_rows else None)

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and own.value is not None:
                    names, t = own.value
                    cosine = _unit(batch.column(1)) @ t.T
                    at = cosine.shape[1] - 1 - cosine[:, ::-1].argmax(1)
                    best = cosine[np.arange(len(at)), at]
                    good = pa.array(best >= least)
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), pa.array([names[k] for k in at], pa.string()).filter(good), pa.array(best).filter(good)], names=["question_id", "term", "cosine"])

        found.append(heads.mapInArrow(run, schema))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("question_id").agg(F.max_by("term", F.struct("cosine", "term")).alias("term"), F.max("cosine").alias("cosine"))
