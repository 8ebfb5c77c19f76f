"""Queries over the verification table, tasks and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from evoframe.operators import relational as R
from evoframe.operators import verification as V
from evoframe.plans import views
from evoframe.plans.catalogue import query

S = 2


def _v(spark, sf):
    return views.verification(spark, sf)


@query("SELECT instance, solution, testing, result, unknown_error, ground FROM verification")
def cross_exec_matrix(spark, sf):
    tests = spark.createDataFrame([(i, float(t)) for i, t in views.THRESHOLDS], "testing long, thr double")
    s = views.solutions(spark, sf)
    asks = s.select("instance").distinct().withColumn("testing", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")))
    asks = asks.join(F.broadcast(tests), "testing")  # five rows
    out = V.cross_execute(s, asks)
    return out.select(
        "instance", "solution", "testing", (F.col("qty") >= F.col("thr")).alias("result"), ((F.col("instance") + F.col("solution") + F.col("testing")) % 17 == 0).alias("unknown_error"), (F.col("qty") >= 25).alias("ground")
    )


@query("SELECT instance, solution, array_to_string(list_sort(list(testing) FILTER (WHERE pass)), ',') AS passed FROM verification GROUP BY 1, 2 HAVING sum(pass::INT) > 0 UNION ALL SELECT instance, solution, '' FROM verification GROUP BY 1, 2 HAVING sum(pass::INT) = 0")
def pass_lists(spark, sf):
    return V.pass_lists(_v(spark, sf)).withColumn("passed", F.array_join(F.col("passed").cast("array<string>"), ","))


@query("SELECT instance, testing, array_to_string(list_sort(list(solution) FILTER (WHERE pass)), ',') AS accepted FROM verification GROUP BY 1, 2 HAVING sum(pass::INT) > 0 UNION ALL SELECT instance, testing, '' FROM verification GROUP BY 1, 2 HAVING sum(pass::INT) = 0")
def accept_lists(spark, sf):
    return V.accept_lists(_v(spark, sf)).withColumn("accepted", F.array_join(F.col("accepted").cast("array<string>"), ","))


@query("SELECT * FROM pass_counts")
def pass_counts(spark, sf):
    return V.pass_counts(_v(spark, sf))


@query("SELECT * FROM accept_counts")
def accept_counts(spark, sf):
    return V.accept_counts(_v(spark, sf))


@query("SELECT instance, solution, weight, rank FROM solution_ranks")
def rank_baseline(spark, sf):
    return V.ranked(V.pass_counts(_v(spark, sf)), "solution")


@query("SELECT instance, testing, weight, rank FROM testing_ranks")
def rank_testings_baseline(spark, sf):
    return V.ranked(V.accept_counts(_v(spark, sf)), "testing")


@query("""WITH q AS (SELECT instance, solution, weight / 5.0 AS q FROM pass_counts),
w AS (SELECT v.instance, v.testing, coalesce(avg(q.q) FILTER (WHERE v.pass), 0) - coalesce(avg(q.q) FILTER (WHERE NOT v.pass), 0) AS w FROM verification v JOIN q USING (instance, solution) GROUP BY 1, 2)
SELECT instance, testing, round(w, 6) AS weight, row_number() OVER (PARTITION BY instance ORDER BY round(w, 6) DESC, testing) AS rank FROM w""")
def rank_discriminative(spark, sf):
    return V.ranked(V.discriminative_weights(_v(spark, sf)), "testing").withColumn("weight", F.round("weight", 6))


def _strategy(name):
    terms = {"tfidf": "ln(n / (1.0 + accepts))", "inverse": "1.0 / accepts", "hardness": "1 - accepts / CAST(n AS DOUBLE)", "coverage": "1.0"}
    sql = f"""WITH w AS (SELECT instance, solution, coalesce(sum(CASE WHEN pass THEN {terms[name]} END), 0.0) AS w FROM with_accepts GROUP BY 1, 2)
SELECT instance, solution, round(CAST(w AS DOUBLE), 6) AS weight, row_number() OVER (PARTITION BY instance ORDER BY round(CAST(w AS DOUBLE), 6) DESC, solution) AS rank FROM w"""

    def run(spark, sf):
        return V.ranked(V.solution_weights(_v(spark, sf), name), "solution").withColumn("weight", F.round("weight", 6))

    query(sql, f"rank_{name}")(run)


for _name in ("tfidf", "inverse", "hardness", "coverage"):
    _strategy(_name)


@query("""SELECT instance, bool_or(a.lo < a.hi) AS solutions_vary, bool_or(b.lo < b.hi) AS testings_vary, bool_or(a.lo < a.hi) AND bool_or(b.lo < b.hi) AS keep
FROM (SELECT instance, min(weight) AS lo, max(weight) AS hi FROM pass_counts GROUP BY 1) a JOIN (SELECT instance, min(weight) AS lo, max(weight) AS hi FROM accept_counts GROUP BY 1) b USING (instance) GROUP BY 1""")
def zero_variance_prune(spark, sf):
    return V.variance_report(_v(spark, sf))


def _ranks(spark, sf):
    v = _v(spark, sf)
    return v, *V.apply_strategy(v, "baseline")


_TOP = "SELECT v.*, r.rank, r.n, t.testing AS top FROM verification v JOIN testing_ranks t ON t.instance = v.instance AND t.rank = 1 AND t.testing = v.testing JOIN solution_ranks r ON r.instance = v.instance AND r.solution = v.solution"


@query(f"""WITH j AS ({_TOP}), k AS (SELECT * FROM j WHERE rank <= {S} OR rank > n - {S})
SELECT instance, arg_min(solution, rank) AS correct_solution, arg_max(solution, rank) AS wrong_solution, min(top) AS correct_testing, arg_min(ground, rank) AS ground_correct, arg_max(ground, rank) AS ground_wrong,
arg_min(ground, rank) AND bool_and(pass = ground) AS result FROM k GROUP BY instance""")
def agreement_code(spark, sf):
    return V.agreement_code(*_ranks(spark, sf), s=S)


@query(f"""WITH j AS ({_TOP}), k AS (SELECT * FROM j WHERE rank = 1 OR rank = n)
SELECT instance, arg_min(result, rank) AS positive, arg_max(result, rank) AS negative, arg_min(ground, rank) AS ground_positive, arg_max(ground, rank) AS ground_negative,
CASE WHEN NOT bool_or(unknown_error) THEN arg_min(ground, rank) AND arg_min(result, rank) AND arg_max(result, rank) = arg_max(ground, rank) END AS result FROM k GROUP BY instance""")
def agreement_os(spark, sf):
    return V.agreement_os(*_ranks(spark, sf))


@query(f"WITH j AS ({_TOP}) SELECT instance, solution, testing, unknown_error, CASE WHEN NOT unknown_error THEN result END AS kept FROM j WHERE rank = 1")
def retention(spark, sf):
    return V.retention(*_ranks(spark, sf))


@query("SELECT count(*) AS n, avg(result::INT) AS final_score, avg(ground::INT) AS answer_score FROM verification WHERE NOT unknown_error")
def final_score(spark, sf):
    return V.scores(_v(spark, sf))


@query("SELECT testing, count(*) AS n, avg(ground::INT) AS answer_score FROM verification WHERE NOT unknown_error GROUP BY testing")
def answer_score(spark, sf):
    return _v(spark, sf).where("not unknown_error").groupBy("testing").agg(F.count("*").alias("n"), F.avg(F.col("ground").cast("int")).alias("answer_score"))


@query("""SELECT testing, CAST(sum(pass::INT) AS BIGINT) AS succeeded, CAST(sum((NOT result AND NOT unknown_error)::INT) AS BIGINT) AS failed, CAST(sum(unknown_error::INT) AS BIGINT) AS errors,
sum(pass::INT) / CAST(nullif(sum((NOT unknown_error)::INT), 0) AS DOUBLE) AS rate FROM verification GROUP BY testing""")
def status_counts(spark, sf):
    return V.status_counts(_v(spark, sf), "testing")


@query("""SELECT instance, solution, testing, CAST(sum(pass::INT) OVER w AS BIGINT) AS succeeded, CAST(sum(unknown_error::INT) OVER w AS BIGINT) AS errors
FROM verification WINDOW w AS (PARTITION BY instance ORDER BY solution, testing ROWS UNBOUNDED PRECEDING)""")
def running_counts(spark, sf):
    return V.running_counts(_v(spark, sf), "instance", ["solution", "testing"]).select("instance", "solution", "testing", "succeeded", "errors")


@query("SELECT CAST(sum(CASE WHEN result IS TRUE THEN 1 ELSE 0 END) AS BIGINT) AS right_results, count(*) AS n FROM verification")
def inference_score(spark, sf):
    return _v(spark, sf).agg(F.count_if(F.col("result").eqNullSafe(F.lit(True))).alias("right_results"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT instance_id, type, CASE WHEN instance_id % 5 = 0 THEN NULL ELSE instance_id END AS solution, CASE WHEN instance_id % 7 = 0 THEN NULL WHEN instance_id % 3 = 0 THEN 'ground_truth' ELSE '0' END AS testing,
' ' || (instance_id % 4)::VARCHAR AS answer, CASE WHEN instance_id % 2 = 0 THEN 'true' ELSE (instance_id % 3)::VARCHAR END AS stdout, (instance_id % 5)::VARCHAR AS truth FROM instances)
SELECT instance_id, CASE WHEN solution IS NULL THEN 'NO_SOLUTION_FOUND' WHEN testing IS NULL THEN 'NO_TESTING_FOUND' END AS error_kind,
CASE WHEN solution IS NULL OR testing IS NULL THEN false WHEN testing = 'ground_truth' THEN trim(answer) = trim(truth)
WHEN type = 'QA' THEN trim(answer) = trim(stdout) ELSE stdout = 'true' END AS verdict FROM b""")
def os_verdict(spark, sf):
    i = F.col("instance_id")
    rows = views.instances(spark, sf).select(
        "instance_id", "type", F.when(i % 5 != 0, i).alias("solution"), F.when(i % 7 == 0, F.lit(None)).when(i % 3 == 0, "ground_truth").otherwise("0").alias("testing"),
        F.concat(F.lit(" "), (i % 4).cast("string")).alias("answer"), F.when(i % 2 == 0, "true").otherwise((i % 3).cast("string")).alias("stdout"), (i % 5).cast("string").alias("truth"),
        F.lit("check/string-match.py").alias("comparison_method"),
    )
    return V.os_verdicts(rows).select("instance_id", "error_kind", "verdict")


@query("""SELECT instance_id, coalesce((type = 'QA' AND get_agent_result IS NULL) OR (type = 'EXEC' AND get_agent_result IS NOT NULL), false) AS valid,
CASE WHEN (type = 'QA' AND get_agent_result IS NULL) OR (type = 'EXEC' AND get_agent_result IS NOT NULL) THEN type ELSE 'WRONG' END AS type FROM instances""")
def instance_validity(spark, sf):
    return V.valid_instances(views.instances(spark, sf)).select("instance_id", "valid", "type")


@query("SELECT instance_id, CAST(r.copy AS BIGINT) AS copy FROM instances, (SELECT unnest(range(0, 4)) AS copy) r")
def replicate_tasks(spark, sf):
    return R.replicated(views.instances(spark, sf).select("instance_id"), 4)


def _finished(spark, sf):
    return views.read(spark, sf, "documents").select("doc_id").where("doc_id % 3 = 0")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0")
def resume_anti(spark, sf):
    return R.unfinished(views.read(spark, sf, "documents").select("doc_id", "n_chars"), _finished(spark, sf), "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 = 0")
def eval_id_semi(spark, sf):
    return R.only(views.read(spark, sf, "documents").select("doc_id", "n_chars"), _finished(spark, sf), "doc_id")


@query("SELECT instance, testing, CASE WHEN instance % 2 = 0 THEN -1 ELSE rank END AS rank FROM testing_ranks")
def reuse_ranking(spark, sf):
    fresh = V.ranked(V.accept_counts(_v(spark, sf)), "testing").select("instance", "testing", "rank")
    cached = V.accept_counts(_v(spark, sf)).where("instance % 2 = 0").select("instance", "testing", F.lit(-1).cast("long").alias("rank"))
    return R.reused(cached, fresh, "instance")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey OFFSET 100")
def skip_rows(spark, sf):
    return R.skipped(views.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf):
    return R.point_lookup(views.read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 7)


@query("SELECT instance, solution, testing, qty >= 30 AS has_code, unknown_error FROM (SELECT s.instance, s.solution, t.t AS testing, s.qty, s.qty < 30 OR t.t = 2 AS unknown_error FROM solutions s, (SELECT unnest(CAST([0, 1, 2] AS BIGINT[])) AS t) t)")
def verify_inputs(spark, sf):
    s = views.solutions(spark, sf)
    asks = s.select("instance", "solution", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("testing"))
    codes = s.where("qty >= 30").select("instance", "solution", F.lit("code").alias("code"))
    tests = s.select("instance").distinct().withColumn("testing", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))).withColumn("cases", F.lit("[]"))
    return V.verify_inputs(asks, codes, tests).select("instance", "solution", "testing", F.col("code").isNotNull().alias("has_code"), "unknown_error")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY source, arrival) AS k FROM questions), f AS (SELECT arrival, title, source, row_number() OVER (PARTITION BY source ORDER BY arrival) AS place FROM d WHERE k = 1)
SELECT * FROM f WHERE place <= 10""")
def title_dedup_quota(spark, sf):
    return R.quota_by_source(views.questions(spark, sf), "title", "source", "arrival", 10).select("arrival", "title", "source", "place")


@query("SELECT doc_id FROM documents WHERE doc_id >= 500 AND text NOT IN (SELECT text FROM documents WHERE doc_id < 500)")
def content_dedup(spark, sf):
    d = views.read(spark, sf, "documents").select("doc_id", "text")
    return R.not_seen(d.where("doc_id >= 500"), d.where("doc_id < 500"), "text").select("doc_id")


@query("SELECT arrival, source, row_number() OVER (PARTITION BY source ORDER BY arrival) - 1 AS idx FROM questions")
def renumber(spark, sf):
    return R.numbered(views.questions(spark, sf).select("arrival", "source"), ["source"], ["arrival"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def renumber_all(spark, sf):
    return R.numbered_all(views.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND o_custkey <> 1")
def set_difference(spark, sf):
    o = views.read(spark, sf, "orders")
    ids = o.select(F.col("o_custkey").alias("id"))
    return R.set_difference(ids, o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")).distinct(), spark.createDataFrame([(1,)], "id long"))


@query("SELECT DISTINCT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf):
    return R.set_union(views.read(spark, sf, "customer").select(F.col("c_nationkey").alias("id")), views.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("id")))


@query("SELECT doc_id, CASE WHEN doc_id < 120 THEN 0 ELSE 1 END::BIGINT AS slice FROM documents WHERE doc_id < 120 OR (doc_id >= 150 AND doc_id < 180)")
def slice_concat(spark, sf):
    return R.slices(views.read(spark, sf, "documents").select("doc_id"), "doc_id", (0, 120), (150, 180))


@query("SELECT DISTINCT o_custkey AS id FROM orders")
def distinct_ids(spark, sf):
    return views.read(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()


@query("SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role, length(lead(text) OVER w) AS observed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def action_pairs(spark, sf):
    return R.action_pairs(views.read(spark, sf, "conversations")).select("conv_id", "turn", "role", "next_turn", "next_role", F.length("observation").cast("long").alias("observed"))


@query("SELECT conv_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_answer(spark, sf):
    return R.last_answer(views.read(spark, sf, "conversations"))


@query("""SELECT conv_id, CAST(sum((role = 'user')::INT) AS BIGINT) AS user_messages, CASE WHEN coalesce(arg_max(length(text) % 2 = 0, turn) FILTER (WHERE role = 'assistant'), false) THEN '/exit'
WHEN sum((role = 'user')::INT) >= 2 THEN 'continue, or give up' ELSE 'continue' END AS reply FROM conversations GROUP BY conv_id""")
def user_turn_rule(spark, sf):
    return R.continue_or_exit(views.read(spark, sf, "conversations"), F.length("text") % 2 == 0)


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations) SELECT * FROM r WHERE back <= 3""")
def recent_history(spark, sf):
    return R.recent(views.read(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3)


@query("SELECT doc_id FROM documents ORDER BY md5('seed42|' || doc_id::VARCHAR), doc_id LIMIT 50")
def sample_hash(spark, sf):
    return R.sampled(views.read(spark, sf, "documents").select("doc_id"), 50, "doc_id", "seed42")


@query("""WITH r AS (SELECT id, island, row_number() OVER (PARTITION BY island ORDER BY md5('pick|' || id::VARCHAR), id) AS k FROM programs) SELECT id, island FROM r WHERE k <= 3""")
def sample_per_group(spark, sf):
    return R.sampled_by(views.programs(spark, sf, code=False).select("id", "island"), "island", 3, "id", "pick")


@query("""WITH u AS (SELECT doc_id, CAST(('0x' || substr(md5('model|' || doc_id::VARCHAR), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.875 THEN 'b' ELSE 'c' END AS model FROM u""")
def weighted_choice(spark, sf):
    models = spark.createDataFrame([("a", 4.0), ("b", 3.0), ("c", 1.0)], "model string, weight double")
    return R.weighted_choice(views.read(spark, sf, "documents").select("doc_id"), models, "doc_id", "model").select("doc_id", "model")


@query("SELECT p_partkey AS ordinal, p_name, s_name FROM part JOIN supplier ON p_partkey = s_suppkey")
def positional_zip(spark, sf):
    a = views.read(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), "p_name")
    return R.positional_zip(a, views.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("ordinal"), "s_name"), "ordinal")


@query("SELECT n_name AS problem, c_custkey AS row, c_acctbal AS y FROM nation JOIN customer ON n_nationkey = c_nationkey")
def equation_join(spark, sf):
    n = views.read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("problem"))
    c = views.read(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("row"), F.col("c_acctbal").alias("y"))
    return c.join(n, "n_nationkey").select("problem", "row", "y")


@query("SELECT o_orderstatus, CAST(sum((o_totalprice > 150000)::INT) AS BIGINT) AS done, CAST(sum((o_totalprice <= 150000)::INT) AS BIGINT) AS pending FROM orders GROUP BY 1")
def done_pending(spark, sf):
    done = F.col("o_totalprice") > 150000
    return views.read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("pending"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND starts_with(c_name, 'Customer#00000001')")
def container_filter(spark, sf):
    c = views.read(spark, sf, "customer")
    return c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name")


@query("""WITH u AS (SELECT doc_id, CAST(('0x' || substr(md5('policy|' || doc_id::VARCHAR), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.2 THEN 'explore' WHEN u < 0.2 + 0.7 THEN 'exploit' ELSE 'random' END AS policy FROM u""")
def parent_policy(spark, sf):
    from evoframe.operators.population import parent_policy as policy

    return policy(views.read(spark, sf, "documents").select("doc_id"), "doc_id")


