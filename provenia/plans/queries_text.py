"""Registered queries over text: tokenizers, classifiers, gates, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import gates as G
from ..operators import provenance as P
from ..operators import resolve as R
from . import sqltext as S
from .inputs import PROPOSALS, parts, proposals, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {S.PARTS} SELECT doc_id, pos, trim(part, ' ') AS part FROM parts WHERE length(trim(part, ' ')) >= 10")
def sentence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 10 characters or more."""
    return parts(spark, sf_dir).withColumn("part", F.trim("part")).filter(F.length("part") >= 10)


@query(
    f"""WITH {S.PARTS}, c AS (SELECT concat(doc_id, ':', pos) AS claim_id, doc_id * 100000 + pos AS seq, {S.normalize('part')} AS normalized,
            trim(part, ' ') <> '' AND CASE WHEN pos % 7 = 6 THEN 0.2 ELSE 0.9 END >= 0.3 AS ok FROM parts),
        f AS (SELECT normalized, min(seq) AS first_seq, arg_min(claim_id, seq) AS created_by FROM c WHERE ok GROUP BY ALL)
        SELECT claim_id, seq, normalized, CASE WHEN NOT ok THEN 'NOOP' WHEN seq = first_seq THEN 'CREATE' ELSE 'DEDUP' END AS mutation,
            CASE WHEN ok THEN created_by END AS target FROM c LEFT JOIN f USING (normalized)"""
)
def normalize_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("pos").cast("string")).alias("claim_id"), (F.col("doc_id") * 100000 + F.col("pos")).alias("seq"),
        F.col("part").alias("claim"), F.when(F.col("pos") % 7 == 6, 0.2).otherwise(0.9).alias("confidence"),
    )
    return R.dedup(rows)


def _tokens(name: str, expression, sql: str, ordered: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = expression(F.col("text"))
        joined = F.array_join(t if ordered else F.array_sort(t), " ")
        return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(joined.cast("binary")).alias("digest"))

    run.__name__ = name
    own = sql if ordered else f"list_sort({sql})"
    query(f"SELECT doc_id, len({sql}) AS n, md5(array_to_string({own}, ' ')) AS digest FROM documents WHERE text IS NOT NULL")(run)


_tokens("tokens_scoring", T.scoring_tokens, S.scoring("text"), False)
_tokens("tokens_content", T.content_tokens, S.content("text"), True)
_tokens("tokens_gate", T.gate_tokens, S.gate("text"), True)
_tokens("tokens_space", T.space_tokens, S.space("text"), False)
_tokens("tokens_plain", T.plain_tokens, S.plain("text"), False)
_tokens("numerals", T.numerals, S.numerals("text"), False)


@query(
    f"""WITH t AS (SELECT doc_id, unnest(list_distinct({S.content('text')})) AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, count(DISTINCT CASE WHEN ends_with(t, 'ing') AND length(t) >= 6 THEN left(t, length(t) - 3) WHEN ends_with(t, 'ed') AND length(t) >= 5 THEN left(t, length(t) - 2)
            WHEN ends_with(t, 'es') AND length(t) >= 5 THEN left(t, length(t) - 2) WHEN ends_with(t, 's') AND length(t) >= 4 THEN left(t, length(t) - 1) ELSE t END) AS stems FROM t GROUP BY doc_id"""
)
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(T.stems(T.content_set(F.col("text")))).cast("long").alias("stems")).filter("stems > 0")


_SIMILAR = f"""WITH d AS (SELECT doc_id, {S.scoring('text')} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {S.scoring('text')} AS t FROM benchmark),
    p AS (SELECT item_id, doc_id, len(list_intersect(d.t, b.t)) AS shared, len(d.t) AS nd, len(b.t) AS nb FROM d, b),
    s AS (SELECT *, shared::DOUBLE / (nd + nb - shared) AS jaccard, shared::DOUBLE / nb AS coverage FROM p WHERE shared > 0)"""


def _similar(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.scoring_tokens(F.col("text")).alias("t")).withColumn("nd", F.size("t"))
    b = table(spark, sf_dir, "benchmark").select("item_id", T.scoring_tokens(F.col("text")).alias("t")).withColumn("nb", F.size("t"))
    both = d.select("doc_id", "nd", F.explode("t").alias("token")).join(b.select("item_id", "nb", F.explode("t").alias("token")), "token").groupBy("item_id", "doc_id", "nd", "nb").agg(F.count("*").alias("both"))
    both = both.withColumn("jaccard", F.col("both") / (F.col("nd") + F.col("nb") - F.col("both"))).withColumn("coverage", F.col("both") / F.col("nb"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(by), "doc_id"))
    return both.withColumn("rank", rank.cast("long")).filter("rank <= 10").select("item_id", "rank", "doc_id", F.col(by).alias("score"))


@query(f"{_SIMILAR} SELECT item_id, rank, doc_id, jaccard AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jaccard DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, "jaccard")


@query(f"{_SIMILAR} SELECT item_id, rank, doc_id, coverage AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def coverage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, "coverage")


def _subject_sql() -> str:
    raw = r"list_filter(string_split(regexp_replace(claim, '\s+', ' ', 'g'), ' '), lambda t: t <> '')"
    low = f"list_transform({raw}, lambda t: regexp_replace(lower(t), '[.,!?;:]+$', ''))"
    verb = f"coalesce(list_position(list_transform({low}, lambda t: t IN {S.lst(*V.AUXILIARIES)} OR (regexp_matches(t, '(ed|ing)$') AND length(t) > 4)), true), 0)"
    before = f"array_to_string({raw}[1:{verb} - 1], ' ')"
    return f"CASE WHEN {verb} > 1 THEN list_filter({S.content(before)}, lambda t: t NOT IN {S.lst(*V.DETERMINERS, *V.EXPLETIVES)}) ELSE [] END"


_GATE = f"""WITH {S.PARTS}, {PROPOSALS},
    t AS (SELECT *, {S.content('claim')} AS ct, {S.content('evidence')} AS et, {_subject_sql()} AS subject, {S.numerals('claim')} AS cn, {S.numerals('evidence')} AS en FROM proposals),
    g AS (SELECT doc_id, pos, variant, claim, evidence, len(subject) = 0 OR list_has_any(subject, et) AS subject_ok,
        {S.subsequence('list_filter(ct, lambda y: list_contains(et, y))', 'et')} AS order_ok, list_has_all(en, cn) AS numerals_ok,
        len(list_filter(ct, lambda y: NOT list_contains(et, y) AND y NOT IN {S.lst(*V.FUNCTION_WORDS)})) = 0 AS predicate_ok FROM t),
    r AS (SELECT *, CASE WHEN trim(claim, ' ') = '' THEN 'empty' WHEN NOT subject_ok THEN 'unknown_subject' WHEN NOT order_ok THEN 'relation_transposed'
        WHEN NOT numerals_ok THEN 'numeral_invented' WHEN NOT predicate_ok THEN 'asserts_more_than_evidence' END AS reason FROM g)"""


@query(f"{_GATE} SELECT doc_id, pos, variant, subject_ok, order_ok, numerals_ok, predicate_ok, reason, CASE WHEN reason IS NULL THEN 'grounded_verbatim' END AS grounding FROM r")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.checks(proposals(spark, sf_dir)).withColumn("grounding", F.when(F.col("reason").isNull(), "grounded_verbatim"))
    return rows.select("doc_id", "pos", "variant", "subject_ok", "order_ok", "numerals_ok", "predicate_ok", "reason", "grounding")


@query(f"{_GATE} SELECT variant, coalesce(reason, 'admitted') AS reason, count(*) AS claims, count(DISTINCT doc_id) AS documents FROM r GROUP BY ALL")
def refusal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: which sentences are admissible claims, and why not the others."""
    rows = G.checks(proposals(spark, sf_dir))
    return rows.groupBy("variant", F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("claims"), F.countDistinct("doc_id").alias("documents"))


@query(f"{_GATE} SELECT quality, coalesce(reason, 'admitted') AS reason, count(*) AS claims FROM r JOIN labels USING (doc_id) GROUP BY ALL")
def quality_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.checks(proposals(spark, sf_dir)).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("quality", F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("claims"))


_KEYWORDS = S.lst(*(k.strip() for v in V.DOMAINS.values() for k in v))
_FIREWALL = f"""
    f AS (SELECT *, trim(part, ' ') AS s, lower(trim(part, ' ')) AS low FROM parts),
    w AS (SELECT *, list_transform(string_split(regexp_replace(low, '\\s+', ' ', 'g'), ' '), lambda x: regexp_replace(x, '^[.,;:!?''"]+|[.,;:!?''"]+$', '', 'g')) AS bare,
        {S.domains('part')} AS found, string_split(regexp_replace(s, '\\s+', ' ', 'g'), ' ') AS ws FROM f),
    x AS (SELECT *, CASE WHEN {' OR '.join(f"starts_with(low, '{g}')" for g in V.GREETINGS)} THEN 'greeting'
        WHEN starts_with(s, '<') AND ends_with(s, '>') THEN 'placeholder'
        WHEN low IN {S.lst(*V.BARE_IDENTITIES)} OR (NOT contains(s, ' ') AND regexp_matches(s, '^[A-Z]')) THEN 'bare_identity'
        WHEN low IN {_KEYWORDS} THEN 'no_durable_predicate' WHEN length(s) < 10 THEN 'too_short'
        WHEN NOT list_has_any(bare, {S.q(*V.COPULAS, *V.IRREGULAR_VERBS)}) AND NOT regexp_matches(low, '{V.DURABLE_VERBS}') THEN 'fragment'
        WHEN contains(low, 'the user said') OR contains(low, 'user mentioned') THEN 'parser_artifact'
        WHEN {S.pii('low')} THEN 'constitutional:pii' WHEN {S.injection('low')} THEN 'constitutional:injection'
        WHEN len(found) = 1 THEN 'known_domain' WHEN len(found) > 1 THEN 'multi_domain'
        WHEN len(list_filter(ws[2:], lambda t: regexp_matches(t, '^[A-Z]'))) > 0 THEN 'unknown_domain_rescued' ELSE 'too_unclear' END AS reason FROM w)"""


@query(
    f"""WITH {S.PARTS}, {_FIREWALL} SELECT doc_id, pos, CASE WHEN reason IN ('known_domain', 'multi_domain') THEN 'ACCEPT' WHEN reason = 'unknown_domain_rescued' THEN 'RESCUE'
        WHEN reason = 'too_unclear' THEN 'QUARANTINE' ELSE 'REJECT' END AS decision, reason FROM x"""
)
def firewall_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).withColumn("f", G.firewall(F.col("part"))).select("doc_id", "pos", "f.decision", "f.reason")


@query(f"SELECT doc_id, {S.pii('text')} AS pii, {S.injection('text')} AS injection FROM documents WHERE text IS NOT NULL")
def constitutional_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", G.pii(F.col("text")).alias("pii"), G.injection(F.col("text")).alias("injection"))


@query(
    f"""WITH {S.PARTS} SELECT doc_id, pos, array_to_string({S.domains('part')}, ',') AS domains, {S.domain('part')} AS domain, array_to_string({S.facets('part')}, ',') AS facets,
        {S.node_type('part')} AS node_type, {S.polarity('part')} AS polarity FROM parts"""
)
def domain_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part")
    return parts(spark, sf_dir).select("doc_id", "pos", F.array_join(T.domains(p), ",").alias("domains"), T.domain(p).alias("domain"), F.array_join(T.facets(p), ",").alias("facets"), T.node_type(p).alias("node_type"), T.polarity(p).alias("polarity"))


_BOUND = f"""WITH {S.PARTS}, c AS (SELECT DISTINCT p.doc_id, part AS evidence, text FROM parts p JOIN documents d ON p.doc_id = d.doc_id WHERE length(part) >= 10),
    b AS (SELECT doc_id, evidence, text, strlen(left(text, instr(text, evidence) - 1)) AS byte_start, strlen(evidence) AS n FROM c)"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("source_id"), "text")
    return parts(spark, sf_dir).filter(F.length("part") >= 10).select(F.col("doc_id").alias("source_id"), F.col("part").alias("evidence")).distinct(), sources


@query(f"{_BOUND} SELECT doc_id AS source_id, evidence, byte_start, byte_start + n AS byte_end, 'sha256:' || sha256(text) AS doc_hash FROM b")
def byte_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bind(*_claims(spark, sf_dir)).select("source_id", "evidence", "byte_start", "byte_end", "doc_hash")


@query(f"{_BOUND} SELECT 'verified' AS outcome, count(*) AS receipts FROM b HAVING count(*) > 0")
def receipt_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, sources = _claims(spark, sf_dir)
    return P.verify(P.bind(claims, sources), sources).groupBy("outcome").agg(F.count("*").alias("receipts"))


@query(
    f"""{_BOUND}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'source_not_held' WHEN doc_id % 3 = 1 THEN 'failed' ELSE 'verified' END AS outcome FROM b)
        SELECT outcome, count(*) AS receipts FROM t GROUP BY outcome"""
)
def receipt_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the sources is gone, a third was changed after binding."""
    claims, sources = _claims(spark, sf_dir)
    changed = sources.filter("source_id % 3 != 0").withColumn("text", F.when(F.col("source_id") % 3 == 1, F.concat(F.lit("x"), F.col("text"))).otherwise(F.col("text")))
    return P.verify(P.bind(claims, sources), changed).groupBy("outcome").agg(F.count("*").alias("receipts"))


@query("SELECT doc_id AS source_id, 'sha256:' || sha256(text) AS doc_hash, strlen(text) AS byte_length, 'crawl' AS origin, 'url' AS origin_kind, 'source_id, doc_hash, byte_length' AS attested, 'origin, origin_kind' AS declared FROM documents WHERE text IS NOT NULL")
def source_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("source_id"), "text")
    return P.disclosure(P.register(docs, "crawl", "url").drop("text"))


@query(
    r"""SELECT page_id, CASE WHEN s = '' THEN 'agent' ELSE s END AS safe_id FROM (SELECT page_id,
        left(regexp_replace(regexp_replace(regexp_extract(replace(url, '\', '/'), '[^/]*$'), '[^A-Za-z0-9._-]', '_', 'g'), '^\.+', ''), 120) AS s FROM pages)"""
)
def safe_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_source_id(F.col("url")).alias("safe_id"))


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    f"WITH documents AS (SELECT page_id AS doc_id, {_STRIP} AS text FROM pages), {S.PARTS} SELECT doc_id AS page_id, count(*) AS parts, count(*) FILTER (length(part) >= 10) AS claims FROM parts GROUP BY doc_id"
)
def page_text_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(T.sentences(F.trim(F.regexp_replace(html, r"\s+", " ")))).alias("part"))
    return pages.groupBy("page_id").agg(F.count("*").alias("parts"), F.count_if(F.length("part") >= 10).alias("claims"))


def _tree(leaf: str) -> str:
    """SQL of the Merkle roots (doc_id, root) over ``leaf`` of every part, level by level."""
    return f"""t(doc_id, pos, h, n) AS (SELECT doc_id, pos, {leaf}, count(*) OVER (PARTITION BY doc_id) FROM parts
        UNION ALL SELECT doc_id, pos // 2, CASE WHEN next IS NULL THEN h ELSE sha256(unhex('01' || h || next)) END, (n + 1) // 2
            FROM (SELECT *, lead(h) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM t WHERE n > 1) WHERE pos % 2 = 0),
        roots AS (SELECT doc_id, h AS root FROM t WHERE n = 1)"""


_BARE = "sha256(unhex('0000000000') || encode(part))"
_NONCED = "sha256(unhex('0000000010' || left(sha256(concat_ws('|', 'install', doc_id, pos)), 32)) || encode(part))"


@query(
    f"""WITH RECURSIVE {S.PARTS}, {_tree(_NONCED)}, hidden AS (SELECT doc_id, count(*) FILTER (contains(lower(part), ' the ')) AS hidden FROM parts GROUP BY doc_id)
        SELECT doc_id AS source_id, root, true AS root_kept, true AS proof_ok, CAST(hidden AS INTEGER) AS hidden FROM roots JOIN hidden USING (doc_id)"""
)
def merkle_redact_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: root, whether redaction of ``the`` keeps it, whether the first part's proof leads to it, hidden parts."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("source_id"), "text")
    made = P.redactable(docs, "install")
    after = P.redact(made, " the ")
    leaves = F.transform("parts", lambda p: p["hash"])
    return after.select(
        "source_id", "root", (P.rebuilt_root(F.col("parts")) == F.col("root")).alias("root_kept"),
        (P.fold_proof(F.get(leaves, F.lit(0)), P.inclusion_proof(leaves, F.lit(0))) == F.col("root")).alias("proof_ok"),
        F.size(F.filter("parts", lambda p: p["text"].isNull())).alias("hidden"),
    )


@query(f"WITH RECURSIVE {S.PARTS}, {_tree(_BARE)} SELECT doc_id, root FROM roots")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root over all parts of each document, without nonces."""
    leaves = F.transform(T.sentences(F.col("text")), lambda p: P.leaf_hash(p, F.lit("")))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", P.merkle_root(leaves).alias("root"))


@query(
    f"""WITH {S.PARTS} SELECT doc_id, pos, sha256({S.normalize('part')}) AS fingerprint, 'node_' || left(sha256({S.normalize('part')} || '|' || 'a,b' || '|' || '2024'), 12) AS node_id,
        left(sha256('salt' || chr(0) || {S.normalize('part')}), 32) AS salted FROM parts"""
)
def claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part")
    ids = F.array(F.lit("b"), F.lit("a"))
    return parts(spark, sf_dir).select("doc_id", "pos", T.name_fingerprint(p).alias("fingerprint"), T.node_id(T.normalize(p), ids, F.lit("2024")).alias("node_id"), T.salted_fingerprint(p, "salt").alias("salted"))
