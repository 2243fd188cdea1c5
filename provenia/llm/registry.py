"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, feistel, gbdt, line_dedup, mtree, near_dups, ppm, secrets, tiling
from .common import crc_mod

#: Score from which a document counts as good.
QUALITY = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.group(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10).withColumn("rank", F.col("rank").cast("int"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feistel.shard(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"), vocabulary=tokenizer_path())
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "guess"), mark), ",")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in secrets.KINDS), F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", mark), ",").alias("spans"), F.array_max(F.transform("spans", lambda s: s["bits"])).alias("guess_bits"),
    )


def op8_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = gbdt.score(docs, gbdt.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ctw_score, op2_bpe, op3_near_dups, op4_mtree_topk, op5_feistel_shards, op6_language, op7_secrets, op8_tiling, op9_quality, op10_line_dedup)
}

#: Word for word the contract of each operator, in DuckDB's SQL.
ORACLES: dict[str, str] = {
    "op3_near_dups": """
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM t
        ), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c) UNION ALL SELECT y, x FROM p WHERE 100 * c >= 80 * (nx + ny - c)),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
        SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id
    """,
    "op10_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, source, i, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS k, line
            FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
        ), pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
        hot AS (
            SELECT l.source, k FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
            WHERE k <> '' GROUP BY l.source, k, pages
            HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_PAGES} AND count(DISTINCT doc_id) > {line_dedup.RATIO} * pages
        )
        SELECT d.doc_id, count(l.i) AS n_lines, count(l.i) FILTER (h.k IS NOT NULL) AS n_dropped,
               coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (h.k IS NULL), '') AS text
        FROM documents d JOIN lines l USING (doc_id)
        LEFT JOIN hot h ON l.source IS NOT DISTINCT FROM h.source AND l.k = h.k
        GROUP BY d.doc_id
    """,
    "op4_mtree_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
}
