"""Tokenizers and text scalars as column expressions. Each takes and returns ``Column``; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

#: Everything but letters, digits and the underscore, in any script.
NON_WORD = r"[^\p{L}\p{N}_]+"
#: The same, keeping apostrophes.
NON_WORD_APOSTROPHE = r"[^\p{L}\p{N}_']+"


def words_of(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items])


def normalize(x: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def _split(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def raw_tokens(x: Column) -> Column:
    """Lower-case words of any length, in order."""
    return _split(F.regexp_replace(F.lower(x), NON_WORD, " "))


def scoring_tokens(x: Column) -> Column:
    """Distinct words of three characters or more, or with a digit."""
    return F.array_distinct(F.filter(raw_tokens(x), lambda t: (F.length(t) > 2) | t.rlike(r"\d")))


def content_tokens(x: Column) -> Column:
    """Words of three characters or more, in order, with repeats."""
    return F.filter(raw_tokens(x), lambda t: F.length(t) > 2)


def content_set(x: Column) -> Column:
    return F.array_distinct(content_tokens(x))


def gate_tokens(x: Column) -> Column:
    """Words with inner apostrophes; outer ones and a final possessive are cut off."""
    bare = F.transform(_split(F.regexp_replace(F.lower(x), NON_WORD_APOSTROPHE, " ")), lambda t: F.regexp_replace(F.regexp_replace(t, "^'+|'+$", ""), "'s$", ""))
    return F.filter(bare, lambda t: t != "")


def space_tokens(x: Column) -> Column:
    """Distinct pieces between white space, punctuation kept."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != ""))


def plain_tokens(x: Column) -> Column:
    """Distinct pieces between white space after full stops and commas are blanked; short negations stay."""
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(x), ".,", "  "), r"\s+"), lambda t: t != ""))


def is_negated(x: Column) -> Column:
    return F.arrays_overlap(plain_tokens(x), words_of(*V.NEGATIONS))


def numerals(x: Column) -> Column:
    """Distinct number literals without separators and without zeros that end a fraction."""
    found = F.regexp_extract_all(x, F.lit(r"(\d[\d,_]*(?:\.\d+)?)"), F.lit(1))
    plain = F.transform(found, lambda v: F.translate(v, ",_", ""))
    return F.array_distinct(F.transform(plain, lambda v: F.when(v.contains("."), F.regexp_replace(F.regexp_replace(v, "0+$", ""), r"\.$", "")).otherwise(v)))


def stem(t: Column) -> Column:
    """Strip the first of ing, ed, es, s that leaves three characters or more."""
    out = t
    for ending in reversed(("ing", "ed", "es", "s")):
        out = F.when(t.endswith(ending) & (F.length(t) >= 3 + len(ending)), F.substring(t, F.lit(1), F.length(t) - len(ending))).otherwise(out)
    return out


def stems(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, stem))


def sentences(x: Column) -> Column:
    """Parts of a text: cut after a full stop, exclamation or question mark followed by white space."""
    return F.split(x, r"(?<=[.!?])\s+")


def first_person_to(x: Column, speaker: Column) -> Column:
    """Rewrite first-person wording to the speaker's name, in a fixed order of patterns."""
    for pattern, suffix in V.FIRST_PERSON:
        x = F.regexp_replace(x, F.lit(f"(?i){pattern}"), F.concat(F.regexp_replace(speaker, r"([\\$])", r"\\$1"), F.lit(suffix)))
    return x


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def coverage(query: Column, target: Column) -> Column:
    """Share of the query's tokens that the target has; 0 for an empty query."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, target)) / F.size(query))


def contains_any(x: Column, items: tuple[str, ...]) -> Column:
    return F.exists(words_of(*items), lambda k: x.contains(k)) if items else F.lit(False)


def domains(x: Column) -> Column:
    """All domains with a keyword in the text, by name."""
    hits = [F.when(contains_any(F.lower(x), words), F.lit(d)) for d, words in sorted(V.DOMAINS.items())]
    return F.array_compact(F.array(*hits))


def domain(x: Column) -> Column:
    """The first domain in declared order with a keyword in the text, else unknown."""
    return F.coalesce(*[F.when(contains_any(F.lower(x), words), F.lit(d)) for d, words in V.DOMAINS.items()], F.lit("unknown"))


def facets(x: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(x).contains(k), F.lit(f)) for k, f in V.FACETS]))


def node_type(x: Column) -> Column:
    """preference, constraint, event (past verb with a time word), state, else fact."""
    tokens, low = raw_tokens(x), F.lower(x)
    past = F.exists(tokens, lambda t: t.endswith("ed") & (F.length(t) > 3))
    return (
        F.when(F.arrays_overlap(tokens, words_of(*V.PREFERENCE_WORDS)), "preference")
        .when(contains_any(low, V.CONSTRAINT_PHRASES), "constraint")
        .when(past & contains_any(low, V.TIME_MARKERS), "event")
        .when(F.arrays_overlap(tokens, words_of(*V.STATE_WORDS)), "state")
        .otherwise("fact")
    )


def polarity(x: Column) -> Column:
    tokens = plain_tokens(x)
    return (
        F.when(F.arrays_overlap(tokens, words_of(*V.NEGATIONS, *V.NEGATIVE_WORDS)), "negative")
        .when(F.arrays_overlap(tokens, words_of(*V.POSITIVE_WORDS)), "positive")
        .otherwise("neutral")
    )


def lemma(x: Column) -> Column:
    """Irregular verb's base, else the word after an auxiliary, else the first -ed/-ing/-s word's stem, else unknown."""
    tokens = raw_tokens(x)
    irregular = F.create_map(*[F.lit(v) for pair in V.IRREGULAR_VERBS.items() for v in pair])
    known = F.get(F.filter(F.transform(tokens, lambda t: irregular[t]), lambda t: t.isNotNull()), F.lit(0))
    at = F.get(F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(*V.AUXILIARIES), i)), lambda i: i.isNotNull()), F.lit(0))
    after = F.get(tokens, at + 1)
    ending = F.get(F.filter(tokens, lambda t: t.rlike("(ed|ing|s)$") & (F.length(t) > 4)), F.lit(0))
    return F.coalesce(known, F.when(after.isNotNull(), stem(after)), stem(ending), F.lit("unknown"))


def event_time(x: Column, anchor: Column) -> Column:
    """ISO date that a phrase names relative to ``anchor`` (a date); null without one."""
    low, day = F.lower(x), lambda d: F.date_format(d, "yyyy-MM-dd")
    month = F.regexp_extract(x, r"(?i)\bin (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})\b", 1)
    year = F.regexp_extract(x, r"(?i)\bin (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})\b", 2)
    number = F.create_map(*[F.lit(v) for i, m in enumerate(V.MONTHS, 1) for v in (m, f"{i:02d}")])
    weekday = F.regexp_extract(low, r"\bon (monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", 1)
    back = F.create_map(*[F.lit(v) for i, m in enumerate(V.WEEKDAYS) for v in (m, i)])
    gap = (F.weekday(anchor) - back[weekday] + 6) % 7 + 1
    return (
        F.when(low.contains("yesterday"), day(F.date_sub(anchor, 1)))
        .when(low.contains("last week"), day(F.date_sub(anchor, 7)))
        .when(low.contains("last month"), day(F.add_months(anchor, -1)))
        .when(low.contains("last year"), F.date_format(F.add_months(anchor, -12), "yyyy"))
        .when(F.arrays_overlap(raw_tokens(x), words_of("today", "now", "tonight")), day(anchor))
        .when(month != "", F.concat(year, F.lit("-"), F.try_element_at(number, F.lower(month))))
        .when(weekday != "", day(F.date_sub(anchor, gap.cast("int"))))
    )


def window_of(x: Column, anchor: Column) -> Column:
    """Window (from, to) of ISO dates that a question names; null without one."""
    low, day = F.lower(x), lambda n: F.date_format(F.date_sub(anchor, n), "yyyy-MM-dd")
    pair = lambda a, b: F.struct(day(a).alias("from"), day(b).alias("to"))
    return F.when(low.contains("yesterday"), pair(1, 1)).when(low.contains("last week"), pair(7, 1)).when(low.contains("last month"), pair(30, 1)).when(low.contains("today"), pair(0, 0))


def safe_source_id(x: Column) -> Column:
    """A name that is safe as a file name: last path part, odd characters replaced, 120 characters."""
    last = F.regexp_replace(F.substring_index(F.translate(x, "\\", "/"), "/", -1), r"[^A-Za-z0-9._-]", "_")
    short = F.substring(F.regexp_replace(last, r"^\.+", ""), 1, 120)
    return F.coalesce(F.when(short == "", None).otherwise(short), F.lit("agent"))


def name_fingerprint(x: Column) -> Column:
    return F.sha2(normalize(x), 256)


def salted_fingerprint(x: Column, salt: str) -> Column:
    """First half of a salted digest of the normalised text."""
    return F.substring(F.sha2(F.concat(F.lit(salt).cast("binary"), F.unhex(F.lit("00")), normalize(x).cast("binary")), 256), 1, 32)


def node_id(normalized: Column, entity_ids: Column, session: Column) -> Column:
    return F.concat(F.lit("node_"), F.substring(F.sha2(F.concat_ws("|", normalized, F.array_join(F.array_sort(entity_ids), ","), session), 256), 1, 12))


def entity_id(name: Column, salt: str | None = None) -> Column:
    """Opaque with a salt, else a slug of the name."""
    if salt is None:
        return F.concat(F.lit("ent_"), F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_"))
    return F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat(F.lit(salt).cast("binary"), F.unhex(F.lit("00")), F.lower(name).cast("binary")), 256), 1, 20))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with keys in alphabetical order and nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def scope(x: Column) -> Column:
    """What a claim is about: all of two words or fewer, the third of three, else the last two."""
    t = raw_tokens(x)
    return F.when(F.size(t) <= 2, F.array_join(t, " ")).when(F.size(t) == 3, F.get(t, F.lit(2))).otherwise(F.array_join(F.slice(t, -2, 2), " "))


def candidate_names(x: Column) -> Column:
    """Runs of capitalised words."""
    return F.regexp_extract_all(x, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1))


def json_array(x: Column, schema: str) -> Column:
    """The JSON array inside a model's output, markup and prose around it cut off; null if there is none."""
    bare = F.regexp_replace(x, r"(?s)^.*?(\[.*\]).*$", "$1")
    return F.from_json(F.when(bare.startswith("["), bare), schema)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def verb_forms(t: Column) -> Column:
    """The word, its irregular base, and its forms with and without a final s."""
    irregular = F.create_map(*[F.lit(v) for pair in V.IRREGULAR_VERBS.items() for v in pair])
    less = F.when(t.endswith("s") & (F.length(t) > 3), F.substring(t, F.lit(1), F.length(t) - 1))
    return F.array_distinct(F.array_compact(F.array(t, irregular[t], less, F.when(F.length(t) >= 3, F.concat(t, F.lit("s"))))))
