"""Views over the driver's tables, as DataFrames and as SQL for the other engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISLANDS = 5
THRESHOLDS = ((0, 10), (1, 20), (2, 30), (3, 40), (4, 45))
PART_SIZE_KINDS = ("QA", "EXEC", None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files for each task of a wide table: some 450,000 order lines.
TASK_BYTES = 8 * 2**20


def dealt(df: DataFrame, *keys: str, of: DataFrame) -> DataFrame:
    """df by its keys into as many partitions as the files of `of` are large, so that a task's share stays the same as tables grow."""
    size = int(str(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(of.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), *keys)


def programs(spark: SparkSession, sf_dir: str, code: bool = True) -> DataFrame:
    """Documents as programs: a binary tree of parents, five islands, metrics from sizes and labels; NaN noise on every 97th."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    d = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    score = (F.col("n_chars") % 1000) / 1000.0
    metrics = F.create_map(
        F.lit("score"), score, F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"),
        F.lit("combined_score"), F.when(F.col("quality") == 1, score / 2 + 0.25), F.lit("noise"), F.when(F.col("doc_id") % 97 == 0, F.lit(float("nan"))),
    )
    parent = F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 2).cast("long"))
    return d.select(
        F.col("doc_id").alias("id"), *([F.col("text").alias("code")] if code else []), F.col("lang").alias("language"), parent.alias("parent_id"),
        (F.length(F.bin(F.col("doc_id") + 1)) - 1).cast("long").alias("generation"), (F.col("doc_id") % ISLANDS).alias("island"), F.col("doc_id").alias("seq"),
        F.map_filter(metrics, lambda k, v: v.isNotNull()).alias("metrics"),
    )


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by instance once: what groups or ranks within an instance needs no other exchange."""
    rows = read(spark, sf_dir, "lineitem")
    line = rows.select(F.col("l_orderkey").alias("instance"), F.col("l_linenumber").cast("long").alias("solution"), "l_quantity")
    return dealt(line, "instance", of=rows).groupBy("instance", "solution").agg(F.max("l_quantity").alias("qty"))


def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as solutions, five quantity thresholds as tests."""
    tests = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("testing"), F.lit(t).alias("thr")) for i, t in THRESHOLDS])).alias("t")
    v = solutions(spark, sf_dir).select("instance", "solution", "qty", tests)
    return v.select(
        "instance", "solution", F.col("t.testing").alias("testing"), (F.col("qty") >= F.col("t.thr")).alias("result"),
        ((F.col("instance") + F.col("solution") + F.col("t.testing")) % 17 == 0).alias("unknown_error"), (F.col("qty") >= 25).alias("ground"),
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "QA").when(F.col("p_size") % 3 == 1, "EXEC")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("instance_id"), F.col("p_name").alias("description"), kind.alias("type"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_brand")).alias("get_agent_result")
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials of a search by each user."""
    e = read(spark, sf_dir, "events")
    x = (F.col("event_id") % 101) / 10.0 - 5
    y = (F.col("event_id") % 67) / 10.0 - 3
    value = F.when(F.col("event_id") % 29 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select(F.col("user_id").alias("grp"), F.col("event_id").alias("trial"), x.alias("x"), y.alias("y"), value.alias("value"), ((F.col("event_id") % 7) / 10.0).alias("seconds"))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    pred = F.when(F.col("l_orderkey") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity") * 1500.0)
    return li.select(F.col("l_suppkey").alias("grp"), F.col("l_extendedprice").alias("y"), pred.alias("y_hat"), F.col("l_quantity").alias("x"))


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("idx"), ((F.get("embedding", F.lit(0)).cast("double") + 1) / 2).alias("x"),
        ((F.get("embedding", F.lit(1)).cast("double") + 1) / 2).alias("y"), (F.lit(0.01) + F.col("label") * F.lit(0.001)).cast("double").alias("r"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("arrival"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), "source")


SQL = {
    "programs": f"""SELECT d.doc_id AS id, d.text AS code, d.lang AS language, CASE WHEN d.doc_id > 0 THEN (d.doc_id - 1) // 2 END AS parent_id,
  CAST(length(bin(d.doc_id + 1)) - 1 AS BIGINT) AS generation, d.doc_id % {ISLANDS} AS island, d.doc_id AS seq, CAST(d.n_chars % 1000 AS DOUBLE) / 1000.0 AS score,
  CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic, CASE WHEN l.quality = 1 THEN CAST(d.n_chars % 1000 AS DOUBLE) / 1000.0 / 2 + 0.25 END AS combined_score
  FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "fits": """SELECT *, round((score + coalesce(quality, 0) + coalesce(toxic, 0) + coalesce(combined_score, 0))
  / (1 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (combined_score IS NOT NULL)::INT), 9) AS fit FROM programs""",
    "bests": "SELECT *, round(coalesce(combined_score, fit), 9) AS best_fit FROM fits",
    "metric_rows": """SELECT id, parent_id, island, seq, 'score' AS key, score AS value FROM programs UNION ALL SELECT id, parent_id, island, seq, 'quality', quality FROM programs WHERE quality IS NOT NULL
  UNION ALL SELECT id, parent_id, island, seq, 'toxic', toxic FROM programs WHERE toxic IS NOT NULL
  UNION ALL SELECT id, parent_id, island, seq, 'combined_score', combined_score FROM programs WHERE combined_score IS NOT NULL""",
    "solutions": "SELECT l_orderkey AS instance, CAST(l_linenumber AS BIGINT) AS solution, max(l_quantity) AS qty FROM lineitem GROUP BY 1, 2",
    "verification": f"""SELECT s.instance, s.solution, CAST(t.testing AS BIGINT) AS testing, s.qty >= t.thr AS result, (s.instance + s.solution + t.testing) % 17 = 0 AS unknown_error, s.qty >= 25 AS ground,
  s.qty >= t.thr AND (s.instance + s.solution + t.testing) % 17 <> 0 AS pass FROM solutions s, (VALUES {", ".join(str(t) for t in THRESHOLDS)}) t(testing, thr)""",
    "pass_counts": "SELECT instance, solution, CAST(sum(pass::INT) AS BIGINT) AS weight FROM verification GROUP BY 1, 2",
    "accept_counts": "SELECT instance, testing, CAST(sum(pass::INT) AS BIGINT) AS weight FROM verification GROUP BY 1, 2",
    "solution_ranks": "SELECT *, row_number() OVER (PARTITION BY instance ORDER BY weight DESC, solution) AS rank, count(*) OVER (PARTITION BY instance) AS n FROM pass_counts",
    "testing_ranks": "SELECT *, row_number() OVER (PARTITION BY instance ORDER BY weight DESC, testing) AS rank FROM accept_counts",
    "with_accepts": """SELECT *, sum(pass::INT) OVER (PARTITION BY instance, testing) AS accepts, count(*) OVER (PARTITION BY instance, testing) AS n FROM verification""",
    "instances": """SELECT p_partkey AS instance_id, p_name AS description, CASE p_size % 3 WHEN 0 THEN 'QA' WHEN 1 THEN 'EXEC' END AS type,
  CASE WHEN p_partkey % 2 = 1 THEN p_brand END AS get_agent_result FROM part""",
    "trials": """SELECT user_id AS grp, event_id AS trial, CAST(event_id % 101 AS DOUBLE) / 10 - 5 AS x, CAST(event_id % 67 AS DOUBLE) / 10 - 3 AS y,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS value, CAST(event_id % 7 AS DOUBLE) / 10 AS seconds FROM events""",
    "regression": "SELECT l_suppkey AS grp, l_extendedprice AS y, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_quantity * 1500.0 END AS y_hat, l_quantity AS x FROM lineitem",
    "circles": """SELECT CAST(label AS BIGINT) AS grp, vec_id AS idx, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS x, (CAST(embedding[2] AS DOUBLE) + 1) / 2 AS y,
  CAST(0.01 AS DOUBLE) + label * CAST(0.001 AS DOUBLE) AS r FROM embeddings""",
    "questions": "SELECT doc_id AS arrival, string_split(text, chr(10))[1] AS title, source FROM documents",
}


def with_views(sql: str) -> str:
    """The query with the views it uses, and those that they use, in front."""
    used: set[str] = set()

    def find(text: str) -> None:
        for name, body in SQL.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                find(body)

    find(sql)
    ctes = [f"{name} AS ({body})" for name, body in SQL.items() if name in used]
    own = sql.strip()
    if not ctes:
        return own
    if own.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {own[15:]}"
    if own.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {own[5:]}"
    return f"WITH {', '.join(ctes)} {own}"
