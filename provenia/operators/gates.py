"""Write gates: is a claim supported by its evidence, and is it worth keeping? All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

REFUSALS = ("empty", "span_not_in_source", "unknown_subject", "relation_transposed", "numeral_invented", "asserts_more_than_evidence")


def is_subsequence(need: Column, hay: Column) -> Column:
    """Do all of ``need`` occur in ``hay`` in order (greedily)?"""

    def step(at: Column, x: Column) -> Column:
        rest = F.slice(hay, at + 1, F.greatest(F.size(hay) - at, F.lit(0)))
        p = F.array_position(rest, x).cast("int")
        return F.when((at < 0) | (p == 0), F.lit(-1)).otherwise(at + p)

    return F.aggregate(need, F.lit(0), step) >= 0


def order_preserved(claim: Column, evidence: Column) -> Column:
    """Claim tokens that the evidence has keep the evidence's order; none shared passes."""
    own, ev = T.content_tokens(claim), T.content_tokens(evidence)
    return is_subsequence(F.filter(own, lambda t: F.array_contains(ev, t)), ev)


def subject_tokens(claim: Column) -> Column:
    """Content words before the first verb, without determiners; empty if there is no verb, it comes first, or only expletives precede it."""
    raw = F.filter(F.split(claim, r"\s+"), lambda t: t != "")
    low = F.transform(raw, lambda t: F.regexp_replace(F.lower(t), r"[.,!?;:]+$", ""))
    verb = lambda t: t.isin(*V.AUXILIARIES) | (t.rlike("(ed|ing)$") & (F.length(t) > 4))
    at = F.array_position(F.transform(low, verb), True).cast("int")
    before = F.slice(raw, 1, F.greatest(at - 1, F.lit(0)))
    subject = F.array_except(T.content_set(F.array_join(before, " ")), T.words_of(*V.DETERMINERS))
    return F.when(at > 1, F.array_except(subject, T.words_of(*V.EXPLETIVES))).otherwise(F.array().cast("array<string>"))


def subject_grounded(claim: Column, evidence: Column) -> Column:
    subject = subject_tokens(claim)
    return (F.size(subject) == 0) | F.arrays_overlap(subject, T.content_tokens(evidence))


def numerals_grounded(claim: Column, evidence: Column) -> Column:
    return F.size(F.array_except(T.numerals(claim), T.numerals(evidence))) == 0


def predicate_grounded(claim: Column, evidence: Column) -> Column:
    """Every content word that is no function word is in the evidence (lexical mode)."""
    return F.size(F.array_except(T.content_set(claim), F.array_union(T.content_set(evidence), T.words_of(*V.FUNCTION_WORDS)))) == 0


def refusal(claim: Column, evidence: Column, source: Column | None = None) -> Column:
    """The first check that fails, null if the claim is admissible. ``source``: the evidence must be in it."""
    inside = F.lit(False) if source is None else ~source.contains(evidence)
    return (
        F.when(F.coalesce(F.trim(claim), F.lit("")) == "", "empty")
        .when(inside, "span_not_in_source")
        .when(~subject_grounded(claim, evidence), "unknown_subject")
        .when(~order_preserved(claim, evidence), "relation_transposed")
        .when(~numerals_grounded(claim, evidence), "numeral_invented")
        .when(~predicate_grounded(claim, evidence), "asserts_more_than_evidence")
    )


def grounding_class(claim: Column, evidence: Column, resolved: Column | None = None) -> Column:
    """grounded_verbatim, grounded_resolved (after its subject was resolved), or null."""
    out = F.when(refusal(claim, evidence).isNull(), "grounded_verbatim")
    return out if resolved is None else out.when(refusal(resolved, evidence).isNull(), "grounded_resolved")


def pii(x: Column) -> Column:
    """A personal-data pattern in the text or its upper case."""
    out = F.lit(False)
    for p in V.PII_PATTERNS:
        out = out | x.rlike(p) | F.upper(x).rlike(p)
    return out


def injection(x: Column) -> Column:
    """A hard marker, or an instruction word within eight words of a word with ``prompt``."""
    low = F.lower(x)
    tokens = F.split(low, r"\s+")
    at = lambda test: F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())
    prompts, words = at(lambda t: t.contains("prompt")), at(lambda t: T.contains_any(t, V.INJECTION_WORDS))
    near = F.exists(prompts, lambda p: F.exists(words, lambda w: F.abs(p - w) <= 8))
    return T.contains_any(low, V.INJECTION_MARKS) | (low.contains("prompt") & near)


def constitutional(x: Column) -> Column:
    return F.when(pii(x), "constitutional:pii").when(injection(x), "constitutional:injection")


def firewall(claim: Column) -> Column:
    """struct<decision, reason>: ordered rejections, then ACCEPT by domain, RESCUE by a name, else QUARANTINE."""
    stripped, low = F.trim(claim), F.lower(F.trim(claim))
    words = F.split(low, r"\s+")
    keywords = [k.strip() for v in V.DOMAINS.values() for k in v]
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:!?'\"]+|[.,;:!?'\"]+$", ""))
    verbless = ~F.arrays_overlap(bare, T.words_of(*V.COPULAS, *V.IRREGULAR_VERBS)) & ~low.rlike(V.DURABLE_VERBS)
    artifact = low.contains("the user said") | low.contains("user mentioned")
    flagged, found = constitutional(low), T.domains(claim)
    named = F.exists(F.slice(F.split(stripped, r"\s+"), 2, 10000), lambda w: w.rlike("^[A-Z]"))
    reason = (
        F.when(F.exists(T.words_of(*V.GREETINGS), lambda g: low.startswith(g)), "greeting")
        .when(stripped.startswith("<") & stripped.endswith(">"), "placeholder")
        .when(low.isin(*V.BARE_IDENTITIES) | (~stripped.contains(" ") & stripped.rlike("^[A-Z]")), "bare_identity")
        .when(low.isin(*keywords), "no_durable_predicate")
        .when(F.length(stripped) < 10, "too_short")
        .when(verbless, "fragment")
        .when(artifact, "parser_artifact")
        .when(flagged.isNotNull(), flagged)
        .when(F.size(found) == 1, "known_domain")
        .when(F.size(found) > 1, "multi_domain")
        .when(named, "unknown_domain_rescued")
        .otherwise("too_unclear")
    )
    decision = F.when(reason.isin("known_domain", "multi_domain"), "ACCEPT").when(reason == "unknown_domain_rescued", "RESCUE").when(reason == "too_unclear", "QUARANTINE").otherwise("REJECT")
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def invents_numbers(observation: Column, claims: Column) -> Column:
    return ~numerals_grounded(observation, claims)


def invents_causation(observation: Column, claims: Column, share: float = 0.7) -> Column:
    """With a causal marker in it, no single claim covers enough of the stems of both sides."""
    low = F.lower(observation)
    pattern = "|".join(V.CAUSAL_MARKERS)
    sides = F.split(low, f"(?:{pattern})", 2)
    part = lambda i: T.stems(T.content_set(F.coalesce(F.get(sides, F.lit(i)), F.lit(""))))
    covers = lambda c: (T.coverage(part(0), T.stems(T.content_set(c))) >= share) & (T.coverage(part(1), T.stems(T.content_set(c))) >= share)
    return low.rlike(pattern) & ~F.exists(claims, covers)


def ground_rationale(rationale: Column, source: Column, claim: Column) -> Column:
    """Share of the rationale's content that the source has; null below 0.6 or without anything new."""
    own = T.content_set(rationale)
    share = T.coverage(own, T.content_set(source))
    return F.when((share >= 0.6) & (F.size(F.array_except(own, T.content_set(claim))) > 0), share)


def ground_cause(cause: Column, source: Column, claim: Column) -> Column:
    own = T.content_set(cause)
    share = T.coverage(own, T.content_set(source))
    return F.when(T.contains_any(F.lower(source), V.CAUSAL_MARKERS) & (share >= 0.8) & (F.size(F.array_except(own, T.content_set(claim))) > 0), share)


def predicted_probability(x: Column) -> Column:
    """0.85 without a hedge, else that of the weakest hedge."""
    out = F.lit(0.85)
    for word, p in sorted(V.HEDGES, key=lambda h: -h[1]):
        out = F.when(F.array_contains(T.raw_tokens(x), word), p).otherwise(out)
    return out


def slot_of(claim: Column, evidence: Column) -> Column:
    """The slot whose longest cue stands in claim and evidence alike (ties by slot, cue); null without one."""
    cues = sorted(((c, s) for s, cs in V.SLOT_CUES.items() for c in cs), key=lambda x: (-len(x[0]), x[1], x[0]))
    both = lambda c: F.lower(claim).rlike(rf"\b{c}\b".replace(" ", r"\s+")) & F.lower(evidence).rlike(rf"\b{c}\b".replace(" ", r"\s+"))
    return F.coalesce(*[F.when(both(c), F.lit(s)) for c, s in cues])


def is_personality(claim: Column) -> Column:
    """A claim about character, which no conduct can ground."""
    return T.contains_any(F.lower(claim), V.PERSONALITY_MARKERS)


def evidence_grounded(evidence: Column, text: Column, least: float | None = None) -> Column:
    """The evidence stands in the text word for word; with ``least``, that share of its content words does (0.8 is usual)."""
    if least is None:
        return text.contains(evidence)
    own = T.content_set(evidence)
    return (F.size(own) > 0) & (T.coverage(own, T.content_set(text)) >= least)


def locate(span: Column, evidence: Column) -> Column:
    """struct<start, end, span> (code points, end exclusive) where a span stands in the evidence, case and white space apart, at word borders; null where it does not."""
    words = F.transform(F.filter(F.split(F.trim(span), r"\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}_])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), F.array_join(words, r"\s+"), F.lit(r"(?![\p{L}\p{N}_])"))
    found = F.regexp_substr(evidence, F.when(F.size(words) > 0, pattern))
    start = F.regexp_instr(evidence, F.when(F.size(words) > 0, pattern)) - 1
    return F.when(found.isNotNull(), F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("span")))


def admit_slot(slot: Column, span: Column, evidence: Column) -> Column:
    """struct<slot, span, start, end, reason>: a proposed slot and span, kept only if the slot is known and the span stands in the evidence.

    Reasons: no_proposal, slot_not_in_vocabulary, span_empty, span_not_contained, typed.
    """
    name, at = F.lower(F.trim(slot)), locate(span, evidence)
    reason = (
        F.when(F.coalesce(slot, F.lit("")) == "", "no_proposal").when(F.coalesce(span, F.lit("")) == "", "no_proposal").when(~name.isin(*V.SLOTS), "slot_not_in_vocabulary")
        .when(F.trim(span) == "", "span_empty").when(at.isNull(), "span_not_contained").otherwise("typed")
    )
    kept = lambda c: F.when(reason == "typed", c)
    return F.struct(kept(name).alias("slot"), kept(at["span"]).alias("span"), kept(at["start"]).alias("start"), kept(at["end"]).alias("end"), reason.alias("reason"))


def checks(proposals: DataFrame, claim: str = "claim", evidence: str = "evidence") -> DataFrame:
    """Proposals with subject_ok, order_ok, numerals_ok, predicate_ok and ``reason`` (null: admissible).

    Token arrays are columns of their own first, so that no lambda works them out again per element.
    """
    c, e = F.col(claim), F.col(evidence)
    tokens = {"__ct": T.content_tokens(c), "__et": T.content_tokens(e), "__subject": subject_tokens(c), "__cn": T.numerals(c), "__en": T.numerals(e)}
    out = proposals.withColumns(tokens)
    out = out.withColumn("__shared", F.filter("__ct", lambda t: F.array_contains(F.col("__et"), t)))
    known = F.array_union(F.col("__et"), T.words_of(*V.FUNCTION_WORDS))
    out = out.withColumns({
        "subject_ok": (F.size("__subject") == 0) | F.arrays_overlap("__subject", "__et"), "order_ok": is_subsequence(F.col("__shared"), F.col("__et")),
        "numerals_ok": F.size(F.array_except("__cn", "__en")) == 0, "predicate_ok": F.size(F.array_except(F.col("__ct"), known)) == 0,
    })
    reason = (
        F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty").when(~F.col("subject_ok"), "unknown_subject").when(~F.col("order_ok"), "relation_transposed")
        .when(~F.col("numerals_ok"), "numeral_invented").when(~F.col("predicate_ok"), "asserts_more_than_evidence")
    )
    return out.withColumn("reason", reason).drop(*tokens, "__shared")


def admit(proposals: DataFrame, claim: str = "claim", evidence: str = "evidence") -> DataFrame:
    """Proposals with the outcome of ``checks``, ``grounding`` and the firewall's ``decision`` and ``firewall_reason``."""
    out = checks(proposals, claim, evidence).withColumn("grounding", F.when(F.col("reason").isNull(), "grounded_verbatim"))
    return out.withColumn("__f", firewall(F.col(claim))).withColumns({"decision": F.col("__f.decision"), "firewall_reason": F.col("__f.reason")}).drop("__f")
