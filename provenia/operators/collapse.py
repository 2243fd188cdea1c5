"""Top-k searches of many questions that tell neither most items nor most questions apart.

Questions and items have features (``f``, an array of different strings). A feature that more than
``COMMON`` questions ask for is common, the others are rare. A pair that shares a rare feature is met
as it is (``near``): there are at most ``COMMON`` times as many as items have features. By common
features alone, items are groups with their k first members, and questions are kinds: kinds meet groups
(``far``). A member's features are those of its group at least, so a score that grows with the shared
features is never lower than its group's, and the k first members of each group hold the best k of all
members that share no rare feature; the others are among the near pairs. Which features count as common
changes the work, never the result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Questions that may ask for a feature before it is common; common features at most (the others are met as rare ones).
COMMON, MOST_COMMON = 32, 1000
#: Different rare features up to which their hashes are broadcast, to drop what nothing asks for before it is shuffled.
SCREEN = 2_000_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that driver and executors share and read back: it is worked out once."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="provenia-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def common_features(questions: DataFrame) -> list[str]:
    """The features that most questions ask for."""
    asked = questions.select(F.explode("f").alias("x")).groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") > COMMON)
    return [r["x"] for r in asked.orderBy(F.desc("n"), "x").limit(MOST_COMMON).collect()]


def only(features: Column, common: list[str]) -> Column:
    return F.array_sort(F.filter(features, lambda x: x.isin(common)))


def screened(rows: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """``rows`` without most of those whose value no row of ``asked`` has: what is left still needs its join."""
    hashes = _hashes(column, asked)
    return rows if hashes is None else _screened(rows, column, hashes)


def _hashes(column: str, asked: DataFrame) -> DataFrame | None:
    """Different hashes of a column, none if there are more than ``SCREEN``."""
    hashes = asked.select(F.xxhash64(column).alias("__h")).distinct()
    return hashes if hashes.count() <= SCREEN else None


def _screened(rows: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(hashes), F.xxhash64(column) == F.col("__h"), "left_semi")


def _wanted(questions: DataFrame, common: list[str]) -> DataFrame:
    """Questions by each of their rare features ``__x``."""
    return questions.withColumn("__own", F.filter("f", lambda x: ~x.isin(common))).withColumnRenamed("f", "qf").withColumn("__x", F.explode("__own"))


def near(questions: DataFrame, items: DataFrame, common: list[str], posted: DataFrame | None = None) -> DataFrame:
    """Every pair of a question and an item that shares a rare feature, once: the columns of both, ``qf`` and ``f``.

    ``posted``: the items by feature, screened, from ``divided``.
    """
    asked = _wanted(questions, common)
    if posted is None:
        posted = screened(items.withColumn("__x", F.explode("f")), "__x", asked)
    return posted.join(asked, "__x").filter(F.col("__x") == F.get(F.array_intersect("__own", "f"), F.lit(0))).drop("__x", "__own")


def divided(questions: DataFrame, items: DataFrame, common: list[str], by: dict[str, Column], order: list[Column], k: int) -> tuple[DataFrame | None, DataFrame]:
    """What ``near`` and ``far`` need of the items, in one job: by rare features, screened, and ``group``.

    Both are columns of one table in the shared folder, so that what the items are made of is shuffled
    once for both. ``by``: columns of the groups, made of those of the items. Without a screen the first
    is none, as it would be larger than the items: ``near`` makes it on its way.
    """
    members = group(items.withColumns(by), common, [*by], order, k)
    hashes = _hashes("__x", _wanted(questions, common))
    if hashes is None:
        return None, written(members, "members")
    posted = _screened(items.withColumn("__x", F.explode("f")), "__x", hashes)
    both = written(posted.unionByName(members, allowMissingColumns=True), "divided")
    return both.filter("place is null").select(*posted.columns), both.filter("place is not null").select(*members.columns)


def group(items: DataFrame, common: list[str], by: list[str], order: list[Column], k: int, least: int = 1) -> DataFrame:
    """The k first members of each group of items with the same common features (``least`` or more) and ``by``: the columns of items, gid, place."""
    rows = items.withColumn("f", only(F.col("f"), common) if common else F.slice("f", 1, 0)).filter(F.size("f") >= least)
    w = Window.partitionBy("f", *by).orderBy(*order, "node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"place": F.row_number().over(w), "gid": F.first("node_id").over(w)}).filter(F.col("place") <= k)


def kinds(questions: DataFrame, common: list[str]) -> DataFrame:
    """Questions by their common features, and ``sid``: the same for those that only rare features tell apart."""
    q = questions.withColumn("f", only(F.col("f"), common) if common else F.slice("f", 1, 0))
    return q.withColumn("sid", F.md5(F.to_json(F.struct(*(c for c in q.columns if c != "question_id"))).cast("binary")))


def far(kind: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of a kind and a group that share a common feature, once: the columns of both, ``qf`` and ``f``."""
    asked = kind.drop("question_id").dropDuplicates(["sid"]).withColumnRenamed("f", "qf").withColumn("__x", F.explode("qf"))
    posted = members.filter("place = 1").drop("place", "node_id").withColumn("__x", F.explode("f"))
    return posted.join(asked, "__x").filter(F.col("__x") == F.get(F.array_intersect("qf", "f"), F.lit(0))).drop("__x")


def best_far(pairs: DataFrame, members: DataFrame, kind: DataFrame, score: Column, k: int, *columns: str) -> DataFrame:
    """For each question its kind's k best members by ``score`` (of the columns of ``pairs`` and a member's r), ties by node id.

    Groups are cut by their first member; all that tie with the k-th stay.
    """
    place = F.rank().over(Window.partitionBy("sid").orderBy(F.desc("__s")))
    rows = pairs.withColumn("__s", score).withColumn("__p", place).filter(F.col("__p") <= k).select("sid", "gid", *columns).join(members.select("gid", "node_id", "r"), "gid")
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("__s"), "node_id"))
    rows = rows.withColumn("__s", score).withColumn("__p", rank).filter(F.col("__p") <= k).select("sid", "node_id", "r", *columns)
    return kind.select("question_id", "sid").join(rows, "sid").drop("sid")


def best(pairs: DataFrame, score: Column, k: int, *columns: str) -> DataFrame:
    """question_id, rank, node_id, ``columns``: the k best items of each question by ``score``, ties by node id. Of a pair met twice the higher score is its own."""
    rows = pairs.withColumn("__s", score).groupBy("question_id", "node_id").agg(F.max(F.struct("__s", *columns)).alias("__m"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("__m.__s"), "node_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("question_id", "rank", "node_id", *(F.col(f"__m.{c}").alias(c) for c in columns))
