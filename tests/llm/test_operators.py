"""Edge cases, brute force, round trips and held-out accuracy of the text operators."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenia.llm import bpe, bytetext, components, ctw, feistel, gbdt, line_dedup, mtree, near_dups, ppm, registry, secrets, tiling
from provenia.llm.common import strings, written
from tests.llm.conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- words and hashes --------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_match_the_pattern(texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    w = bytetext.words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    expected = [(d, m) for d, x in enumerate(raw) for m in WORD.findall(lowered(x.decode()))]
    assert [(d, w.data[a:b].tobytes().decode()) for d, a, b in zip(w.doc, w.start, w.end)] == expected
    assert len(set(zip([m for _, m in expected], w.hash.tolist()))) == len({m for _, m in expected}) == len(set(w.hash.tolist()))


def test_hash_index_is_exact():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64))
    index = bytetext.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), np.searchsorted(keys, keys + np.uint64(1)), -1)).all()


# --- 1: context-tree weighting -----------------------------------------------------------------------------------------


def _naive_ctw(texts, depth):
    """Counts and weighting by plain recursion over all contexts."""
    counts = {}
    streams = [b"\n" * depth + b" ".join(x.encode() for x in WORD.findall(lowered(t))) + b"\n" for t in texts]
    for s in streams:
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for bit in range(8):
                    node = (s[i - d : i], (1 << bit) | (s[i] >> (8 - bit)))
                    counts.setdefault(node, [0, 0])[(s[i] >> (7 - bit)) & 1] += 1
    children = {}
    for context, prefix in counts:
        if context:
            children.setdefault((context[1:], prefix), []).append((context, prefix))

    def weighted(node):
        pe = float(ctw.kt_log(*map(np.float64, counts[node])))
        if len(node[0]) == depth:
            return pe, pe
        return pe, np.logaddexp(pe, sum(weighted(c)[1] for c in children[node])) + np.log(0.5)

    def zero(context, prefix):
        out, left = 0.0, 1.0
        for d in range(depth + 1):
            node = (context[depth - d :], prefix)
            if node not in counts:
                return out + left * 0.5
            n0, n1 = counts[node]
            pe, pw = weighted(node)
            w = 1.0 if d == depth else np.exp(np.log(0.5) + pe - pw)
            out, left = out + left * w * (n0 + 0.5) / (n0 + n1 + 1), left * (1 - w)
        return out

    def score(text):
        s, total = b"\n" * depth + b" ".join(x.encode() for x in WORD.findall(lowered(text))) + b"\n", 0.0
        for i in range(depth, len(s)):
            for bit in range(8):
                p = zero(s[i - depth : i], (1 << bit) | (s[i] >> (8 - bit)))
                total += log10(p if not (s[i] >> (7 - bit)) & 1 else 1 - p)
        return total

    return score


@pytest.mark.parametrize("depth,rows", [(1, 1 << 17), (2, 1 << 17), (5, 1 << 17), (5, 3)])
def test_ctw_equals_the_recursion(spark, monkeypatch, depth, rows):
    """Above, inside and below the branches, also where every batch holds a branch or two."""
    monkeypatch.setattr(ctw, "BRANCH_ROWS", rows)
    train = ["the cat sat", "the hat sat on the mat", "a cat", "the cat sat on the hat", "Ünder the mat"]
    fitted = ctw.fit(spark.createDataFrame([(t,) for t in train], "text string"), depth=depth)
    naive = _naive_ctw(train, depth)
    asked = ["the cat", "zebra the", "", "a mat sat", "xyz~~ü", "the cat sat on the hat sat"]
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), fitted).collect()}
    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(naive(t), rel=1e-6)


def _base(texts):
    train = Counter()
    for i, t in texts:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            train.update([*WORD.findall(lowered(t)), None])
    n, v = sum(train.values()), len(train)
    return n, [(i, sum(log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*WORD.findall(lowered(t)), None]), sum(train[w] > 0 for w in [*WORD.findall(lowered(t)), None])) for i, t in texts]


def test_ctw_base_score_by_brute_force(spark, sf):
    docs = registry.table(spark, sf, "documents").filter("doc_id < 60")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fitted = ctw.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0))
    n, expected = _base(texts)
    assert fitted.tokens == n
    got = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in ctw.score(docs, fitted).collect()}
    for i, base, known in expected:
        assert got[i][0] == pytest.approx(base, rel=1e-9) and got[i][1] == known


def test_ctw_odd_rows(odd, empty):
    rows = ctw.score_documents(odd).collect()
    assert len(rows) == len(TEXTS) and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in rows)
    assert ctw.score_documents(empty).count() == 0


def test_ctw_scores_a_block_in_little_memory():
    """A block of 4 MB of text, in two batches, takes less than 50 MB besides its texts; a block ends with the text that reaches 32 MB."""
    rng = random.Random(5)
    known = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(2000)]
    batches = [pa.record_batch([pa.array(range(i, i + 200)), pa.array([" ".join(rng.choices(known, k=2000)) for _ in range(200)])], names=["id", "text"]) for i in (0, 200)]
    keys, grams = np.array([ctw.END], np.uint64), np.zeros(0, np.uint64)
    for batch in batches:
        w = bytetext.words(*strings(batch.column("text")))
        keys, grams = np.union1d(keys, w.hash), np.union1d(grams, ctw._grams(w, 5)[0])
    answers = pa.table({"kind": pa.array([0, 1], pa.int32()), "keys": [keys.tobytes(), grams.tobytes()], "values": [np.ones(len(keys)).tobytes(), np.full(len(grams), -1, np.float32).tobytes()]})
    texts = pa.Table.from_batches(batches)
    tracemalloc.start()
    out = ctw._scorer(5, 100, 100)(texts, answers)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("score").to_pylist() == [-float(n) for n in out.column("bytes").to_pylist()] and out.column("id").to_pylist() == list(range(400))
    assert most < 50e6
    size = Counter()
    for x in ctw._blocks(iter(batches * 10)):
        for part, n in zip(x.column("part").to_pylist(), x.column("size").to_pylist()):
            size[part] += n
    assert len(size) > 1 and max(size.values()) < (32 << 20) + 10_000


def test_ctw_beats_the_word_model_on_held_out_texts(spark):
    out = registry.op1_ctw_score(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


# --- 2: BPE ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_padding(), library.no_truncation()
    with open(path, encoding="utf-8") as f:
        return bpe.Bpe(f.read()), library


def _same(both, texts):
    own, library = both
    for text, (n, ids, decoded) in zip(texts, own.encode(texts)):
        e = library.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(e), " ".join(map(str, e)), library.decode(e, skip_special_tokens=False)), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_bpe_equals_the_library(both, texts):
    _same(both, texts)


def test_bpe_special_cases(both):
    _same(both, ["", " ", "ΣΑΣ Σ", "İstanbul ﬁ ™ ½ Ⅷ", "a\x1cb\x85c　d it's we'll", "x<|startoftext|>Y <|endoftext|><|endoftext|>z", "日本語 \U0001f44d\U0001f3fd", "café", "thththth" * 50])


def test_bpe_on_every_code_point(both):
    """Alone between letters, behind a digit, and before a combining mark."""
    _same(both, [" ".join(f"a{chr(c)}b 1{chr(c)}\u0307" for c in range(k, k + 64) if c < 0xD800 or c > 0xDFFF) for k in range(0, 0x30000, 64)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdeinrst'é7", min_size=1, max_size=70), min_size=1, max_size=30))
def test_bpe_merges_in_step_as_one_by_one(both, words):
    assert both[0].merge_all(words) == [both[0].merge(w) for w in words]


def test_bpe_long_words(both):
    r = random.Random(5)
    text = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (47, 48, 49, 32_000, 200_000))
    _same(both, [text])


def test_bpe_on_documents(spark, sf, both):
    _same(both, [r["text"] for r in registry.table(spark, sf, "documents").collect()])


def test_bpe_odd_rows(odd, empty):
    rows = bpe.encode(odd, registry.tokenizer_path(), columns=tuple(bpe.COLUMNS)).collect()
    assert len(rows) == len(TEXTS)
    blank = next(r for r in rows if r["doc_id"] == 2)
    assert blank["n_tokens"] == 0 and blank["ids"] == [] and blank["decoded"] == "" and blank["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(empty, registry.tokenizer_path()).count() == 0


# --- 3: near duplicates ------------------------------------------------------------------------------------------------


def _groups(texts, k, percent=80):
    """Components by brute force over all pairs that share an element."""
    sets, index = {}, {}
    for i, t in texts:
        w = WORD.findall(lowered(t))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[i] = s
        for x in s:
            index.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in index[x] if j < i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dups_by_brute_force(spark, k):
    docs = registry.table(spark, "/root/testdata/sf0.01", "documents")
    expected = _groups([(r["doc_id"], r["text"]) for r in docs.collect()], k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.group(docs, shingle=k).collect()}
    assert got == expected


def test_near_dups_chains_and_large_groups(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [r.choice(vocabulary) for _ in range(200)]
    texts, words = [], list(base)
    for i in range(40):  # a chain: each differs from the one before by a few words
        texts.append((i, " ".join(words)))
        for _ in range(4):
            words[r.randrange(200)] = r.choice(vocabulary)
    for i in range(100, 400):  # a large group of near copies
        copy = list(base)
        copy[r.randrange(200)] = r.choice(vocabulary)
        texts.append((i, " ".join(copy)))
    texts += [(i, "the very same text again and again") for i in range(500, 700)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dups.group(docs, shingle=2).collect()}
    assert got == {i: c for i, (_, c) in _groups(texts, 2).items()}


def test_near_dups_odd_rows(odd, empty):
    rows = near_dups.group(odd, shingle=2).collect()
    assert len(rows) == len(TEXTS)
    got = {r["doc_id"]: r for r in rows}
    assert got[5]["component_id"] == 1 and not got[5]["kept"] and got[1]["kept"]
    assert got[2]["n_shingles"] == 0 and got[2]["component_id"] == 2 and got[3]["kept"] and got[4]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"] and got[8]["n_shingles"] == 1
    assert near_dups.group(empty).count() == 0
    kept = near_dups.one_per_group(odd, shingle=2)
    assert kept.columns == odd.columns and kept.filter("doc_id = 5").count() == 0 and kept.filter("doc_id is null").count() == 1


def test_components_by_union_find(spark):
    r = random.Random(7)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    parent = list(range(500))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    touched = {i for a, b in links if a != b for i in (a, b)}
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in touched}


# --- 4: M-tree ---------------------------------------------------------------------------------------------------------


def test_mtree_by_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 16)]) for i in range(700)]
    rows += [(700 + i, rows[i][1]) for i in range(50)]  # ties
    rows += [(1001, None), (1002, [1.0, float("nan")] + [0.0] * 14), (1003, [None] * 16), (1004, [float("inf")] * 16), (None, [0.5] * 16), (1100, [0.1, 0.2]), (1105, [0.3, 0.4]), (1120, [])]
    vectors = spark.createDataFrame([(*x, 0.5, 1) for x in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = mtree.top_k(vectors, F.col("vec_id") % 20 == 0, 7, block=16).collect()
    _same_top(rows, got, 7)
    assert mtree.top_k(vectors.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def _same_top(rows, got, k):
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in ints if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(expected)


@pytest.mark.parametrize("scale", [1e4, 2e5])
def test_mtree_scores_beyond_the_doubles(spark, scale):
    """Sums of products past 2**53 stay exact."""
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(0, scale, 64)]) for i in range(300)]
    _same_top(rows, mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 10).collect(), 10)


def test_mtree_prunes():
    r = np.random.default_rng(2)
    centres = r.normal(0, 1000, (20, 8))
    x = np.round(np.concatenate([c + r.normal(0, 10, (200, 8)) for c in centres]))
    x = x.astype(np.int64)
    top, ids = np.full((20, 5), mtree.NONE), np.zeros((20, 5), np.int64)
    scored = mtree.Tree(np.arange(len(x)), x, page=64).search(np.full(20, -1), x[::200], top, ids)
    assert scored < 0.25 * 20 * len(x)
    assert (top == np.sort(x[::200] @ x.T, axis=1)[:, ::-1][:, :5]).all()


# --- 5: Feistel --------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_feistel_is_a_permutation(n, seed):
    image = [feistel.permute(i, n, seed) for i in range(n)]
    assert sorted(image) == list(range(n)) and [feistel.invert(y, n, seed) for y in image] == list(range(n))


def test_feistel_large_domains():
    for n in (10**9 + 7, 3 * 10**10 + 1, 2**40 - 87):
        a, b = feistel.sides(n)
        assert a * b >= n and a * b - n < 2000 and max(a, b) <= 2 * min(a, b)
        for x in (0, 1, n // 2, n - 1):
            assert feistel.invert(feistel.permute(x, n), n) == x


@pytest.mark.parametrize("n", [101, 1009, 2003, 2 * 997, 4099])
def test_feistel_shuffles_and_walks_in_tables_as_in_python(spark, n):
    """Row counts that are primes, or twice one, have no exact sides: the walk is taken, and places are not shifted."""
    a, b = feistel.sides(n)
    assert a * b > n and max(a, b) <= 2 * min(a, b)
    rows = feistel.shard(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 7).collect()
    assert all((r["shard"], r["slot"]) == feistel.locate(r["row"], n, 7) for r in rows) and sorted(r["row"] for r in rows) == list(range(n))
    moves = Counter((feistel.permute(i, n) - i) % n for i in range(n))
    assert max(moves.values()) < 0.05 * n


def test_feistel_deals_out_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(feistel, "CHUNK", 50)
    docs = spark.createDataFrame([(None, "same")] * 500 + [(i, "own") for i in range(200)], "doc_id long, text string")
    rows = feistel.shard(docs, 9).collect()
    assert sorted(r["row"] for r in rows) == list(range(700)) and sum(r["doc_id"] is None for r in rows) == 500
    same = sorted(r["row"] for r in rows if r["doc_id"] is None)
    assert same[-1] - same[0] > 500  # not one run of rows


def test_feistel_shards(spark, sf):
    docs = registry.table(spark, sf, "documents")
    rows, n = registry.op5_feistel_shards(spark, sf).collect(), docs.count()
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert sorted(r["row"] for r in rows) == list(range(n))
    for r in rows:
        assert (r["shard"], r["slot"]) == feistel.locate(r["row"], n, 40) and feistel.row_at(r["shard"], r["slot"], n, 40) == r["row"]
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None
    counts = Counter(r["shard"] for r in rows)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    for s, c in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(c))


def test_feistel_odd_rows(odd, empty):
    rows = feistel.shard(odd, 5).collect()
    assert sorted(r["row"] for r in rows) == list(range(len(TEXTS)))
    assert next(r for r in rows if r["doc_id"] == 2)["size"] == 16 and feistel.shard(empty, 5).count() == 0


# --- 6: language -------------------------------------------------------------------------------------------------------


def test_ppm_held_out_accuracy(spark):
    docs = registry.table(spark, "/root/testdata/sf0.01", "documents")
    out = ppm.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and length(text) > 40")
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count()


def test_ppm_code_length_by_plain_escapes(spark):
    rows = [(1, "abab abba", "x"), (2, "cdcd dccd", "y")]
    model = ppm.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def bits(stream, text):
        counts = {}
        s = b"\n" * ppm.ORDER + stream + b"\n"
        for i in range(ppm.ORDER, len(s)):
            for d in range(ppm.ORDER + 1):
                counts.setdefault(s[i - d : i], Counter())[s[i]] += 1
        total, t = 0.0, b"\n" * ppm.ORDER + text + b"\n"
        for i in range(ppm.ORDER, len(t)):
            for d in range(ppm.ORDER, -1, -1):
                c = counts.get(t[i - d : i])
                if c and c[t[i]]:
                    total += np.log2((sum(c.values()) + len(c)) / c[t[i]])
                    break
                if c:
                    total += np.log2((sum(c.values()) + len(c)) / len(c))
            else:
                total += 8
        return total

    text = b"abc bad"
    length = model.lengths(*ppm._strings(np.frombuffer(text, np.uint8), np.array([0, len(text)])))[0]
    assert length == pytest.approx([bits(b"abab abba", text), bits(b"cdcd dccd", text)], rel=1e-5)


def test_ppm_samples_by_rows_and_bytes(spark):
    """With a bound below the table a part of the texts is learned from, copies and hot ids included; the languages stay apart."""
    rows = [(7 if i % 3 else i, ("abab abba " if i % 2 else "cdcd dccd ") * (1 + i % 5), "x" if i % 2 else "y") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, few, short = ppm.fit(docs), ppm.fit(docs, rows=60), ppm.fit(docs, size=2000)
    total = lambda m: sum(len(c[0]) for c in m.contexts[0])
    for model in (whole, few, short):
        assert model.languages == ["x", "y"] and total(model) > 0
        assert ppm.predict(docs, model).join(docs.select("doc_id", "text", "lang").distinct(), "doc_id").filter("doc_id != 7 and lang != lang_pred").count() == 0


def test_ppm_odd_rows(odd, empty):
    rows = ppm.identify(odd).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == len(TEXTS) and got[2] == got[3] == got[4] == got[10] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert ppm.identify(empty).count() == 0 and ppm.identify(odd.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred != 'und'").count() == 0


# --- 7: secrets --------------------------------------------------------------------------------------------------------


PLAIN = secrets.Guesser()
WORDY = secrets.Guesser(secrets.vocabulary_words(registry.tokenizer_path()))


def _base_spans(text):
    out = [("assign", *m.span()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "API_KEY", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef", "0123456789ab", "x", "ſecret", "hunter2!", "\n", "é"]), max_size=14).map("".join))
def test_secrets_keep_the_base_spans(text):
    assert [s[:3] for s in secrets.scan(text, PLAIN) if s[0] != "guess"] == _base_spans(text)


def test_secrets_on_documents(spark):
    docs = registry.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in registry.op7_secrets(spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in _base_spans(r["text"]))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_guess_bits_order():
    b = PLAIN.bits
    assert b("password") < b("password1") < b("Xq7#pLz9") and b("aaaaaaaaaa") < b("abacabadab") and b("qwertyuiop") < b("qzwmexrnty")
    assert b("20240131") < b("83920175") and b("") == 0 and b("ababababab") < b("abqxjzkwpv")
    assert b("zK8!vQ2#mT") >= secrets.GUESS_BITS > b("password123") and b("abcdefriend") < b("abcde") + b("friend") + 0.1 and b("aaaadmin") <= b("aaa") + b("admin")
    spans = lambda t: [s[0] for s in secrets.scan(t, WORDY)]
    assert spans("my passphrase: zK8!vQ2#mT9x ok") == ["guess"] and spans("my passphrase: welcome2024") == []
    assert spans("my_very_long_and_winding_name_of_the_password_4: zK8!vQ2#mT9x") == ["guess"] and spans("dbPassword => 'zK8!vQ2#mT9x'") == ["guess"]


PROSE = [
    "The key is understanding how it works", "login is straightforward", "spin is counterclockwise", "turkey: remarkable birds", "monkey = troublemaker", "the secret is perseverance",
    "token: understanding", "key: responsibilities, and so on", "The password is required.", "Pin: embroidered", "auth = authentication", "bearer: stretcher", "my key is international",
]


def test_no_guess_in_prose():
    assert [(t, s) for t in PROSE for s in secrets.scan(t, WORDY) if s[0] == "guess"] == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["password", "admin", "friend", "abc", "qwe", "aa", "ab", "1", "19", "2024", "0131", "x", "Z", "#", "é", "A"]), max_size=7).map("".join))
def test_guess_bits_are_the_least_over_all_cuts(value):
    """Against every segmentation by plain recursion."""
    from functools import lru_cache
    from math import log2

    low = value.lower()

    def options(i, j):
        piece, least = value[i:j], low[i:j]
        yield sum(secrets._char_bits(c) for c in piece)
        if j - i > 1 and least in PLAIN.bits_of:
            yield PLAIN._word(piece, least)
        for pattern, bits in secrets._DATES:
            if (m := pattern.match(value, i)) and m.end() == j:
                yield bits
        if j - i >= 3 and all(p in secrets._NEXT for p in zip(least, least[1:])):
            yield log2(47) + secrets._LENGTH
        for k in range(1, secrets._BLOCK + 1):
            if (j - i) % k == 0 and (j - i) >= max(2 * k, 3) and piece == piece[:k] * ((j - i) // k):
                yield sum(secrets._char_bits(c) for c in piece[:k]) + secrets._LENGTH

    @lru_cache(None)
    def least(i):
        return 0.0 if i == len(value) else min(x + secrets._SEGMENT + least(j) for j in range(i + 1, len(value) + 1) for x in options(i, j))

    assert PLAIN.bits(value) == pytest.approx(least(0))


def test_long_values_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "key => " + "z" * 100_000), (2, "key => " + "qX7#" * 10_000 + "".join(random.Random(1).choices("abcXYZ0189#!", k=20_000)))], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.find(docs).collect()}
    assert got[1] == [] and got[2] == ["guess"]


def test_secrets_odd_rows(odd, empty):
    assert secrets.find(odd).filter("size(spans) > 0").count() == 0 and secrets.find(odd).count() == len(TEXTS) and secrets.find(empty).count() == 0


# --- 8: tiling ---------------------------------------------------------------------------------------------------------


def _naive_tiles(text, item, least):
    """Greedy string tiling as published: the longest unmarked match, leftmost in the item, then in the text."""
    mt, mi, marked = [False] * len(text), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not mi[p + k] and not mt[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        if best[0] < least:
            return marked
        for k in range(best[0]):
            mi[best[1] + k] = mt[best[2] + k] = True
        marked += best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=16), st.sampled_from([1, 5, 1 << 20]))
def test_tiling_equals_the_naive_one(text, item, hits):
    """From seeds to tiles, also where hits are expanded a few at a time."""
    items = tiling.Items([7], [" ".join(map(str, item))], 3)
    raw = " ".join(map(str, text)).encode()
    tiling.HITS = hits
    _, found = tiling._covered(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), items, 1e-9)
    tiling.HITS = 1 << 18
    size = min(3, len(item))
    marked = _naive_tiles(text, item, size) if item else 0
    assert [round(c * len(item)) for c, _, _ in found.get(0, [])] == ([marked] if marked else [])


def test_tiling_of_repeated_tokens_stays_quick(spark):
    """An item of 2,000 equal tokens and a text of 200,000: hits collapse on diagonals, the item is full after one tile."""
    docs = spark.createDataFrame([(1, "tick " * 200_000), (None, "tick " * 3), (1, "tick " * 200_000)], "doc_id long, text string")
    got = tiling.contamination(docs, spark.createDataFrame([(1, "tick " * 2_000)], "item_id long, text string")).collect()
    assert [(r["n_items"], r["best_coverage"], r["best_tiles"]) for r in got if r["doc_id"] == 1] == [(1, 1.0, 1)] * 2
    assert [r["n_items"] for r in got if r["doc_id"] is None] == [0]


def test_tiling_finds_reordered_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    w = item.split()
    texts = [
        (1, f"intro words {item} closing words"), (2, "so " + " ".join(w[8:]) + " and then, " + " ".join(w[:8])), (3, "nothing of the kind"), (4, None), (5, ""), (6, " ".join(reversed(w))),
        (7, item.upper().replace(" ", ", ")), (8, " ".join(w[:5])), (9, ("pad " * 30000) + item),
    ]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, n_items int, best_item string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "orphan item"), (4, "tiny one")], "item_id long, text string")
    got = {r["doc_id"]: r for r in tiling.contamination(docs, bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {1, 2, 7, 9} and got[2]["best_tiles"] == 2 and got[1]["best_coverage"] == 1.0
    assert {r["doc_id"] for r in tiling.clean(docs, bench).collect()} == {3, 4, 5, 6, 8}
    assert tiling.contamination(docs, bench.filter("false")).filter("contaminated").count() == 0 and tiling.contamination(docs.filter("false"), bench).count() == 0


def test_tiling_in_blocks(spark, sf, monkeypatch):
    docs, bench = registry.table(spark, sf, "documents"), registry.table(spark, sf, "benchmark")
    whole = sorted(map(str, tiling.contamination(docs, bench).collect()))
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 2000)
    assert sorted(map(str, tiling.contamination(docs, bench).collect())) == whole


# --- 9: quality --------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    path = "/root/testdata/sf0.1"
    out = registry.op9_quality(spark, path).join(registry.table(spark, path, "labels"), "doc_id").filter("held_out").select("score", "quality", "predicted").collect()
    good, bad = [r["score"] for r in out if r["quality"] == 1], [r["score"] for r in out if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([r["predicted"] == 1 for r in out if r["quality"] == 1]) > 0.97


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (77, 1), (None, 1), (8, None)], "doc_id long, quality int")
    forest = gbdt.fit(odd, labels)
    rows = gbdt.score(odd, forest).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert gbdt.score(empty, forest).count() == 0 and gbdt.score(odd, gbdt.fit(odd, labels.filter("false"))).filter("score != 0.5").count() == 0
    assert gbdt.keep(odd, forest, 0.0).columns == odd.columns


def test_flattened_trees_split_cleanly():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = gbdt.grow(x, y, trees=40).probability(x)
    assert ((p > 0.5) == y).mean() > 0.97


def test_forest_by_row_and_by_level():
    """The vectorised walk against one row at a time."""
    r = np.random.default_rng(4)
    x = r.normal(size=(800, 5)).astype(np.float32)
    forest = gbdt.grow(x, ((x[:, 0] * x[:, 1] > 0) | (x[:, 4] > 1)).astype(float), trees=15)

    def margin(row):
        out = forest.start
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] + int(row[forest.feature[at]] > forest.threshold[at])
            out += forest.value[at]
        return out

    assert forest.margin(x) == pytest.approx([margin(row) for row in x])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab cA1.|!\n\t#é", max_size=60), min_size=1, max_size=4))
def test_statistics_by_plain_python(texts):
    raw = [t.encode() for t in texts]
    got = gbdt.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    for row, b in zip(got, raw):
        w = [x.lower() for x in re.split(rb"[\t-\r ]+", b) if x]
        some, size, lines = max(len(w), 1), max(len(b), 1), b.count(b"\n") + (len(b) > 0)
        mean = sum(map(len, w)) / some
        share = lambda chars: sum(b.count(bytes([c])) for c in chars) / size
        same = lambda k: sum(x == y for x, y in zip(w, w[k:])) / some
        expected = [
            np.log1p(len(b)), np.log1p(len(w)), np.log1p(lines), mean, max(sum(len(x) ** 2 for x in w) / some - mean**2, 0) ** 0.5, sum(len(x) >= 15 for x in w) / some, sum(len(x) <= 3 for x in w) / some,
            share(range(65, 91)), share(range(48, 58)), share(b".,;:?!'\"()-"), share(b"#$%&*|@^~<>=+/\\_{}[]`"), share(range(128, 256)), share([9, 11, 12, 13, 32]), share(b"\n"), share(b"|"), share(b"!"),
            len(set(w)) / some, len(set(zip(w, w[1:]))) / max(len(w) - 1, 1), len(set(b)), max(Counter(w).values(), default=0) / some, same(1), same(2), len(w) / max(lines, 1), sum(x[-1:] in b".,!?;" for x in w if x) / some,
        ]
        assert row == pytest.approx(expected, rel=1e-4, abs=1e-4)


def test_quality_counts_an_id_once(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 300 + [(2, "###")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert gbdt.fit(docs, labels).start == pytest.approx(0.0)


# --- 10: lines ---------------------------------------------------------------------------------------------------------


WHITE = " \t\x0b\x0c\r"


def test_line_dedup_by_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(120):
        lines = [f"own line {i} {j}" for j in range(3)] + (["menu"] * 2 if r.random() < 0.3 else []) + (["  footer\t" if i % 2 else "footer\r"] if r.random() < 0.06 else []) + ["", "shared"] * (i % 2)
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), ["a", "b", None][i % 3], 7))
    rows += [(200, None, "a", 1), (201, "", "a", 1), (202, "menu", "solo", 1), (203, " \t\r\nmenu\r\n\t", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_dropped int")
    pages = Counter(s for _, _, s, _ in rows)
    holds = Counter((s, k) for _, t, s, _ in rows for k in {x.strip(WHITE) for x in (t or "").split("\n")} if k)
    got = {x["doc_id"]: x["text"] for x in line_dedup.drop_lines(docs).collect()}
    for i, t, s, _ in rows:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(WHITE) or holds[s, x.strip(WHITE)] < 3 or holds[s, x.strip(WHITE)] <= 0.05 * pages[s])
        assert got[i] == kept


def test_line_dedup_odd_rows(odd, empty):
    assert line_dedup.drop_lines(odd).count() == len(TEXTS) and line_dedup.drop_lines(empty).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = registry.table(spark, sf, "documents")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "benchmark_decontamination", "bpe_encoding"]
    now = docs
    for _, stage in P.STAGES[:-1]:
        now = written(stage(spark, now, sf), "stage")
        assert now.columns == docs.columns
    expected = sorted(r["doc_id"] for r in now.collect())
    assert sorted(r["doc_id"] for r in P.run(spark, sf).collect()) == expected and 0 < len(expected) < docs.count()
