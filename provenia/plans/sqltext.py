"""The text expressions of ``provenia.functions.text`` in DuckDB's SQL, for the oracle side of the queries."""

from __future__ import annotations

from ..functions import vocabulary as V


def q(*items: str) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def lst(*items: str) -> str:
    return "(" + q(*items)[1:-1] + ")"


def raw(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda t: t <> '')"


def content(x: str) -> str:
    return f"list_filter({raw(x)}, lambda t: length(t) > 2)"


def scoring(x: str) -> str:
    return rf"list_distinct(list_filter({raw(x)}, lambda t: length(t) > 2 OR regexp_matches(t, '\d')))"


def gate(x: str) -> str:
    words = rf"string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_'']+', ' ', 'g'), ' ')"
    return f"list_filter(list_transform({words}, lambda t: regexp_replace(regexp_replace(t, '^''+|''+$', '', 'g'), '''s$', '')), lambda t: t <> '')"


def space(x: str) -> str:
    return rf"list_distinct(list_filter(string_split(regexp_replace(lower({x}), '\s+', ' ', 'g'), ' '), lambda t: t <> ''))"


def plain(x: str) -> str:
    return rf"list_distinct(list_filter(string_split(regexp_replace(translate(lower({x}), '.,', '  '), '\s+', ' ', 'g'), ' '), lambda t: t <> ''))"


def numerals(x: str) -> str:
    found = rf"regexp_extract_all({x}, '(\d[\d,_]*(?:\.\d+)?)', 1)"
    bare = f"list_transform({found}, lambda v: replace(replace(v, ',', ''), '_', ''))"
    return rf"list_distinct(list_transform({bare}, lambda v: CASE WHEN contains(v, '.') THEN regexp_replace(regexp_replace(v, '0+$', ''), '\.$', '') ELSE v END))"


def normalize(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def any_in(x: str, items) -> str:
    return "(" + " OR ".join(f"contains({x}, '{i}')" for i in items) + ")"


def domains(x: str) -> str:
    hits = ", ".join(f"CASE WHEN {any_in(f'lower({x})', ws)} THEN '{d}' END" for d, ws in sorted(V.DOMAINS.items()))
    return f"list_filter([{hits}], lambda d: d IS NOT NULL)"


def domain(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_in(f'lower({x})', ws)} THEN '{d}'" for d, ws in V.DOMAINS.items()) + " ELSE 'unknown' END"


def facets(x: str) -> str:
    hits = ", ".join(f"CASE WHEN contains(lower({x}), '{k}') THEN '{f}' END" for k, f in V.FACETS)
    return f"list_filter([{hits}], lambda d: d IS NOT NULL)"


def node_type(x: str) -> str:
    past = f"len(list_filter({raw(x)}, lambda t: ends_with(t, 'ed') AND length(t) > 3)) > 0"
    return (
        f"CASE WHEN list_has_any({raw(x)}, {q(*V.PREFERENCE_WORDS)}) THEN 'preference' WHEN {any_in(f'lower({x})', V.CONSTRAINT_PHRASES)} THEN 'constraint' "
        f"WHEN {past} AND {any_in(f'lower({x})', V.TIME_MARKERS)} THEN 'event' WHEN list_has_any({raw(x)}, {q(*V.STATE_WORDS)}) THEN 'state' ELSE 'fact' END"
    )


def polarity(x: str) -> str:
    return f"CASE WHEN list_has_any({plain(x)}, {q(*V.NEGATIONS, *V.NEGATIVE_WORDS)}) THEN 'negative' WHEN list_has_any({plain(x)}, {q(*V.POSITIVE_WORDS)}) THEN 'positive' ELSE 'neutral' END"


def subsequence(need: str, hay: str) -> str:
    """List fold with the place as text; -1 once it fails."""
    rest = f"{hay}[CAST(a AS INT) + 1:]"
    step = f"CASE WHEN a = '-1' OR coalesce(list_position({rest}, x), 0) = 0 THEN '-1' ELSE CAST(CAST(a AS INT) + list_position({rest}, x) AS VARCHAR) END"
    return f"list_reduce(list_prepend('0', {need}), lambda a, x: {step}) <> '-1'"


def pii(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}') OR regexp_matches(upper({x}), '{p}')" for p in V.PII_PATTERNS) + ")"


def injection(x: str) -> str:
    words = f"string_split(regexp_replace(lower({x}), '\\s+', ' ', 'g'), ' ')"
    index = f"range(1, len({words}) + 1)"
    near = f"len(list_filter({index}, lambda i: contains({words}[i], 'prompt') AND len(list_filter({index}, lambda j: {any_in(f'{words}[j]', V.INJECTION_WORDS)} AND abs(i - j) <= 8)) > 0)) > 0"
    return f"({any_in(f'lower({x})', V.INJECTION_MARKS)} OR CASE WHEN contains(lower({x}), 'prompt') THEN {near} ELSE false END)"


#: Sentences of documents: doc_id, pos, part.
PARTS = f"parts AS (SELECT doc_id, i - 1 AS pos, s[i] AS part FROM (SELECT doc_id, {sentences('text')} AS s, unnest(range(1, len({sentences('text')}) + 1)) AS i FROM documents WHERE text IS NOT NULL))"
