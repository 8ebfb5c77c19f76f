"""Queries over the population, lineage, regression, trials and circles."""

from __future__ import annotations

from pyspark.sql import functions as F

from evoframe.functions import metrics as M
from evoframe.operators import geometry as G
from evoframe.operators import lineage as L
from evoframe.operators import population as P
from evoframe.operators import regression as E
from evoframe.operators.relational import ranked_within
from evoframe.plans import views
from evoframe.plans.catalogue import query

K = views.ISLANDS


def _p(spark, sf, code=False):
    return views.programs(spark, sf, code)


@query("SELECT id, fit AS average FROM fits")
def metric_average(spark, sf):
    return _p(spark, sf).select("id", F.round(M.safe_average(F.col("metrics")), 9).alias("average"))


@query("SELECT id, round(score + coalesce(quality, 0) + coalesce(toxic, 0) + coalesce(combined_score, 0), 9) AS total FROM programs")
def metric_sum(spark, sf):
    return _p(spark, sf).select("id", F.round(M.safe_sum(F.col("metrics")), 9).alias("total"))


@query("SELECT id, quality IS NOT NULL AS has_quality, 1 + (quality IS NOT NULL)::BIGINT + (toxic IS NOT NULL)::BIGINT + (combined_score IS NOT NULL)::BIGINT AS numbers FROM programs WHERE combined_score IS NOT NULL")
def metric_filter(spark, sf):
    m = F.col("metrics")
    return _p(spark, sf).where(F.map_contains_key(m, F.lit("combined_score"))).select("id", F.map_contains_key(m, F.lit("quality")).alias("has_quality"), F.size(M.numbers(m)).cast("long").alias("numbers"))


@query("SELECT key, CASE WHEN min(value) = max(value) THEN 0.0 ELSE min(value) END AS low, CASE WHEN min(value) = max(value) THEN 1.0 ELSE max(value) END AS high FROM metric_rows GROUP BY key")
def metric_minmax(spark, sf):
    return L.metric_range(_p(spark, sf))


@query("SELECT DISTINCT key FROM metric_rows UNION SELECT 'noise'")
def metric_keys(spark, sf):
    return L.metric_names(_p(spark, sf))


@query("""SELECT coalesce(max(score), 0) AS high, round(coalesce(avg(score), 0), 9) AS mean, count(*) AS programs, count(DISTINCT generation) AS generations, count(DISTINCT island) AS islands,
min(generation) AS first_generation, max(generation) AS last_generation FROM programs""")
def summary_bar(spark, sf):
    return L.summary(_p(spark, sf), "score").withColumn("mean", F.round("mean", 9))


@query("""SELECT c.id, c.key, round(c.value - p.value, 9) AS delta FROM metric_rows c JOIN metric_rows p ON p.id = c.parent_id AND p.key = c.key""")
def metric_delta(spark, sf):
    return L.metric_deltas(_p(spark, sf)).where("key <> 'noise'").select("id", "key", F.round("delta", 9).alias("delta"))


@query("""SELECT c.id, CASE WHEN bool_and(c.value > coalesce(p.value, 0)) THEN 'Improvement in all metrics' WHEN bool_and(c.value < coalesce(p.value, 0)) THEN 'Regression in all metrics' ELSE 'Mixed results' END AS outcome
FROM metric_rows c LEFT JOIN metric_rows p ON p.id = c.parent_id AND p.key = c.key WHERE c.parent_id IS NOT NULL GROUP BY c.id""")
def outcome_label(spark, sf):
    p = _p(spark, sf).withColumn("metrics", F.map_filter("metrics", lambda k, v: k != "noise"))
    parents = p.select(F.col("id").alias("parent_id"), F.col("metrics").alias("parent_metrics"))
    return p.join(parents, "parent_id").select("id", M.outcome(F.col("parent_metrics"), F.col("metrics")).alias("outcome"))


@query("""WITH t AS (SELECT id, lag(id, 1) OVER w AS one, lag(id, 2) OVER w AS two FROM programs WINDOW w AS (PARTITION BY island ORDER BY seq)),
r AS (SELECT t.id, m.key, m.value > coalesce(a.value, 0) AND m.value > coalesce(b.value, 0) AS up, m.value < coalesce(a.value, 0) AND m.value < coalesce(b.value, 0) AS down
FROM t JOIN metric_rows m ON m.id = t.id LEFT JOIN metric_rows a ON a.id = t.one AND a.key = m.key LEFT JOIN metric_rows b ON b.id = t.two AND b.key = m.key WHERE t.two IS NOT NULL)
SELECT id, coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE up), '') AS improved, coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE down), '') AS regressed FROM r GROUP BY id""")
def attempt_trend(spark, sf):
    return L.attempt_trends(_p(spark, sf).withColumn("metrics", F.map_filter("metrics", lambda k, v: k != "noise")))


@query("SELECT id, CASE WHEN id % 97 = 0 THEN false ELSE fit >= 0.5 END AS passes FROM fits")
def threshold_gate(spark, sf):
    return _p(spark, sf).select("id", M.passes(F.map_filter("metrics", lambda k, v: k != "error"), 0.5).alias("passes"))


@query("SELECT id, score AS a, coalesce(quality, -1) AS b, CAST(2 AS DOUBLE) AS stage FROM programs")
def cascade_merge(spark, sf):
    first = F.create_map(F.lit("b"), F.lit(-1.0), F.lit("error"), F.lit(1.0), F.lit("stage"), F.lit(1.0))
    score, quality = M.metric(F.col("metrics"), "score"), M.metric(F.col("metrics"), "quality")
    later = F.map_filter(F.create_map(F.lit("a"), score, F.lit("b"), quality, F.lit("stage"), F.lit(2.0)), lambda k, v: v.isNotNull())
    m = M.merged(first, later)
    return _p(spark, sf).select("id", M.metric(m, "a").alias("a"), M.metric(m, "b").alias("b"), M.metric(m, "stage").alias("stage"))


@query("SELECT id, score, score + 1 AS extra FROM programs")
def map_merge(spark, sf):
    score = M.metric(F.col("metrics"), "score")
    m = F.map_concat(F.create_map(F.lit("score"), F.lit(-1.0)), F.create_map(F.lit("score"), score, F.lit("extra"), score + 1))
    return _p(spark, sf).select("id", M.metric(m, "score").alias("score"), M.metric(m, "extra").alias("extra"))


@query("SELECT island, key AS metric, round(sum(value * 0.5), 6) AS value FROM metric_rows GROUP BY 1, 2")
def ensemble_feedback(spark, sf):
    rows = _p(spark, sf).select("island", F.explode(M.feedback(F.map_filter("metrics", lambda k, v: k != "noise"), "", 0.5)).alias("metric", "v"))
    return rows.groupBy("island", "metric").agg(F.round(F.sum("v"), 6).alias("value"))


@query("SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 9) AS weight FROM customer")
def weight_norm(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey")
    return views.read(spark, sf, "customer").select("c_custkey", F.round(F.col("c_acctbal") / F.sum("c_acctbal").over(w), 9).alias("weight"))


@query("SELECT arg_max(id, struct_pack(f := fit, s := -seq)) AS id, max(fit) AS value FROM fits")
def best_program(spark, sf):
    return P.best_program(_p(spark, sf))


@query("SELECT arg_max(id, struct_pack(f := score, s := -seq)) AS id, max(score) AS value FROM programs")
def best_program_by_metric(spark, sf):
    return P.best_program(_p(spark, sf), "score")


@query("SELECT id, fit AS value FROM fits ORDER BY fit DESC, seq LIMIT 20")
def top_programs(spark, sf):
    return P.top_programs(_p(spark, sf), 20).select("id", "value")


@query("SELECT id, fit FROM fits ORDER BY (id = 3) DESC, fit DESC, seq DESC LIMIT 100")
def population_limit(spark, sf):
    return P.limited(_p(spark, sf), 100, 3).select("id", "fit")


_CELLS = """cells AS (SELECT *, greatest(least(CAST(trunc(length(code) / 1000.0 * 10) AS BIGINT), 9), 0) AS b0, greatest(least(CAST(trunc(fit * 10) AS BIGINT), 9), 0) AS b1 FROM bests)"""
_CHAMPIONS = f"""{_CELLS}, champions AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b0, b1 ORDER BY best_fit DESC, seq) AS k FROM cells) WHERE k = 1)"""


@query(f"WITH {_CELLS} SELECT id, b0, b1, b0::VARCHAR || '-' || b1::VARCHAR AS cell FROM cells")
def feature_cells(spark, sf):
    return P.cells(_p(spark, sf, True)).select("id", "b0", "b1", "cell")


@query(f"WITH {_CHAMPIONS} SELECT b0::VARCHAR || '-' || b1::VARCHAR AS cell, id, best_fit FROM champions")
def cell_champion(spark, sf):
    return P.champions(_p(spark, sf, True)).select("cell", "id", "best_fit")


@query(f"WITH {_CHAMPIONS} SELECT a.id AS of_id, b.id AS id FROM champions a JOIN champions b ON abs(a.b0 - b.b0) <= 1 AND abs(a.b1 - b.b1) <= 1 AND (a.b0 <> b.b0 OR a.b1 <> b.b1)")
def neighbour_cells(spark, sf):
    return P.neighbour_cells(P.champions(_p(spark, sf, True))).select("of_id", "id")


@query("""WITH r AS (SELECT *, max(best_fit) OVER (PARTITION BY island ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM bests)
SELECT island, id, best_fit FROM r WHERE so_far IS NULL OR best_fit > so_far""")
def running_best(spark, sf):
    return P.running_best(_p(spark, sf)).select("island", "id", "best_fit")


@query("SELECT id, best_fit FROM bests ORDER BY best_fit DESC, seq LIMIT 50")
def archive_topk(spark, sf):
    return P.archive(_p(spark, sf), 50).select("id", "best_fit")


@query()
def archive_fold(spark, sf):
    return P.archive_fold(_p(spark, sf), 20)


@query("""SELECT i.island, coalesce(count(b.id), 0) AS size, coalesce(max(best_fit), 0) AS best, coalesce(round(avg(best_fit), 6), 0) AS mean, coalesce(max(generation), 0) AS last_generation
FROM (SELECT unnest(range(0, 7)) AS island) i LEFT JOIN bests b USING (island) GROUP BY 1""")
def island_stats(spark, sf):
    return P.island_stats(_p(spark, sf), 7).withColumn("mean", F.round("mean", 6))


@query()
def island_diversity(spark, sf):
    """Whole code of a sample from all programs; its distances count characters, which the other engine's don't, so it is held against brute force in tests/test_whole_job.py."""
    return P.island_diversity(_p(spark, sf, True)).withColumn("diversity", F.round("diversity", 6))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY best_fit DESC, seq) AS rank, count(*) OVER (PARTITION BY island) AS n FROM bests), c AS (SELECT * FROM r WHERE rank <= greatest(1, floor(n * 0.1)))
SELECT id, island, (island + d.d + {K}) % {K} AS target FROM c, (VALUES (1), (-1)) d(d)""")
def migrants(spark, sf):
    return P.migrants(_p(spark, sf), K, 0.1).select("id", "island", "target")


@query("SELECT max(generation) - 3 >= 5 AS due, max(generation) AS generation FROM programs")
def migration_due(spark, sf):
    state = _p(spark, sf).groupBy("island").agg(F.max("generation").alias("generation")).withColumn("last_migration", F.lit(3).cast("long"))
    return P.migration_due(state, 5)


@query("SELECT island, arg_min(id, md5('par|' || id::VARCHAR)) AS id FROM programs GROUP BY island")
def island_parent(spark, sf):
    return P.sampled_parent(_p(spark, sf), "par")


@query("""WITH a AS (SELECT * FROM bests ORDER BY best_fit DESC, seq LIMIT 50)
SELECT coalesce(arg_min(id, md5('arc|' || id::VARCHAR)) FILTER (WHERE island = 2), arg_min(id, md5('arc|' || id::VARCHAR))) AS id FROM a""")
def archive_parent(spark, sf):
    p = _p(spark, sf)
    return P.archive_parent(p, P.archive(p, 50), 2, "arc")


@query("""WITH r AS (SELECT * FROM bests WHERE id <> 5), best AS (SELECT id, 0 AS priority, '' AS place FROM r ORDER BY best_fit DESC, seq LIMIT 1),
top AS (SELECT id, 1 AS priority, printf('%020.9f', 1e9 - fit) AS place FROM r ORDER BY fit DESC, seq LIMIT 2), rest AS (SELECT id, 2 AS priority, md5('insp|' || id::VARCHAR) AS place FROM r),
pool AS (SELECT id, min(struct_pack(priority := priority, place := place)) AS p FROM (SELECT * FROM best UNION ALL SELECT * FROM top UNION ALL SELECT * FROM rest) GROUP BY id)
SELECT id, p.priority AS priority FROM pool ORDER BY p, id LIMIT 10""")
def inspirations(spark, sf):
    return P.inspirations(_p(spark, sf), 5, 10, 0.2, "insp")


@query(f"""WITH {_CHAMPIONS}, own AS (SELECT b0, b1 FROM cells WHERE id = 5), r AS (SELECT * FROM bests WHERE id <> 5), best AS (SELECT id, 0 AS priority, '' AS place FROM r ORDER BY best_fit DESC, seq LIMIT 1),
top AS (SELECT id, 1 AS priority, printf('%020.9f', 1e9 - fit) AS place FROM r ORDER BY fit DESC, seq LIMIT 1),
near AS (SELECT c.id, 2 AS priority, md5('insp|' || c.id::VARCHAR) AS place FROM champions c, own WHERE abs(c.b0 - own.b0) <= 1 AND abs(c.b1 - own.b1) <= 1 AND c.id <> 5 ORDER BY place LIMIT 12),
rest AS (SELECT id, 3 AS priority, md5('insp|' || id::VARCHAR) AS place FROM r),
pool AS (SELECT id, min(struct_pack(priority := priority, place := place)) AS p FROM (SELECT * FROM best UNION ALL SELECT * FROM top UNION ALL SELECT * FROM near UNION ALL SELECT * FROM rest) GROUP BY id)
SELECT id, p.priority AS priority FROM pool ORDER BY p, id LIMIT 12""")
def inspirations_near(spark, sf):
    """With the champions of cells next to the parent's."""
    p = P.cells(_p(spark, sf, True))
    grid = p.join(P.champions(_p(spark, sf, True)).select("id", F.lit(True).alias("champion")), "id", "left").withColumn("champion", F.coalesce("champion", F.lit(False)))
    return P.inspirations(p, 5, 12, 0.1, "insp", grid)


@query("""SELECT id, island, row_number() OVER (PARTITION BY island ORDER BY best_fit DESC, seq DESC) AS rank FROM bests""")
def comparator_rank(spark, sf):
    return P.compared(_p(spark, sf)).select("id", "island", "rank")


@query("SELECT id, CASE WHEN score > 0.5 + 0.02 THEN id ELSE -1 END AS chosen FROM programs")
def final_override(spark, sf):
    rows = _p(spark, sf).select("id", F.lit(-1).cast("long").alias("tracked_id"), F.lit(0.5).alias("tracked_score"), F.col("id").alias("best_id"), M.metric(F.col("metrics"), "score").alias("best_score"))
    return P.final_choice(rows).select("id", "chosen")


@query("SELECT id, coalesce(combined_score, round(fit, 9)) AS value FROM fits")
def default_lookup(spark, sf):
    m = F.col("metrics")
    return _p(spark, sf).select("id", F.coalesce(M.metric(m, "combined_score"), F.round(M.safe_average(m), 9)).alias("value"))


@query("SELECT p.id AS source, c.id AS target FROM programs c JOIN programs p ON p.id = c.parent_id")
def lineage_edges(spark, sf):
    return L.edges(_p(spark, sf))


@query("SELECT island, id, language FROM programs WHERE id % 5 <> 3 UNION ALL SELECT 7, id, language FROM programs WHERE id % 2 = 0")
def island_members(spark, sf):
    """A program can be a member of several islands; members without a program are left out."""
    p = _p(spark, sf)
    own, more = p.select("island", "id").where("id % 5 <> 3"), p.where("id % 2 = 0").select(F.lit(7).cast("long").alias("island"), "id")
    gone = p.select("island", (-F.col("id") - 1).alias("id"))
    return L.members(own.unionByName(more).unionByName(gone), p).select("island", "id", "language")


@query("SELECT parent_id, count(*) AS children, min(score) AS low, max(score) AS high FROM programs WHERE parent_id IS NOT NULL GROUP BY 1")
def children_stats(spark, sf):
    return L.children_stats(_p(spark, sf), "score")


@query("SELECT id FROM programs WHERE score = (SELECT max(score) FROM programs)")
def highlight_top(spark, sf):
    return L.highlighted(_p(spark, sf), "top").select("id")


@query("SELECT id FROM programs WHERE generation = 0")
def highlight_first(spark, sf):
    return L.highlighted(_p(spark, sf), "first").select("id")


@query("SELECT id FROM programs WHERE quality IS NULL")
def highlight_unset(spark, sf):
    return L.highlighted(_p(spark, sf), "unset", "quality").select("id")


@query("SELECT id FROM bests ORDER BY best_fit DESC, seq LIMIT 50")
def highlight_archive(spark, sf):
    p = _p(spark, sf)
    return L.highlighted(p, "archive", archive=P.archive(p, 50)).select("id")


@query("SELECT id FROM programs WHERE id % 11 = 0")
def highlight_failed(spark, sf):
    failed = F.when(F.col("id") % 11 == 0, F.map_concat("metrics", F.create_map(F.lit("error"), F.lit(1.0)))).otherwise(F.col("metrics"))
    return L.highlighted(_p(spark, sf).withColumn("metrics", failed), "failed").select("id")


@query("SELECT id, row_number() OVER (PARTITION BY island ORDER BY quality DESC NULLS LAST, seq) AS place FROM programs")
def list_sort(spark, sf):
    p = _p(spark, sf)
    return ranked_within(p, "island", *L.list_order(p, "score", "quality"), name="place").select("id", "place")


@query("""WITH s AS (SELECT min(score) AS lo, max(score) AS hi FROM programs) SELECT id, round(10 + (score - lo) / (hi - lo) * 22, 6) AS radius FROM programs, s""")
def node_radius(spark, sf):
    return L.node_radius(_p(spark, sf)).select("id", F.round("radius", 6).alias("radius"))


@query("""WITH s AS (SELECT min(score) AS lo, max(score) AS hi FROM programs) SELECT id, round(greatest(0, least(1, (score - lo) / (hi - lo))), 6) AS percent FROM programs, s""")
def metric_bar(spark, sf):
    return L.metric_bar(_p(spark, sf)).select("id", F.round("percent", 6).alias("percent"))


@query("SELECT generation, island, count(*) AS n FROM programs WHERE quality IS NULL GROUP BY 1, 2")
def nan_groups(spark, sf):
    return L.undefined_groups(_p(spark, sf), "quality")


@query("SELECT id FROM programs WHERE contains(id::VARCHAR, '12')")
def id_search(spark, sf):
    return L.id_search(_p(spark, sf), "12").select("id")


@query("SELECT min(generation) AS low, max(generation) AS high FROM programs")
def generation_extent(spark, sf):
    return _p(spark, sf).agg(F.min("generation").alias("low"), F.max("generation").alias("high"))


@query("WITH RECURSIVE up(id, parent_id, depth) AS (SELECT id, parent_id, 0 FROM programs WHERE id = 180 UNION ALL SELECT p.id, p.parent_id, up.depth + 1 FROM up JOIN programs p ON p.id = up.parent_id) SELECT id, depth FROM up")
def lineage_ancestors(spark, sf):
    return L.ancestors(_p(spark, sf), 180).select("id", "depth")


@query("""SELECT grp, CAST(count(y_hat) AS BIGINT) AS n, round(avg((y - y_hat) ** 2), 3) AS mse, round(avg((y - y_hat) ** 2) / var_pop(y) FILTER (WHERE y_hat IS NOT NULL), 6) AS nmse,
round(1 - sum((y - y_hat) ** 2) / (var_pop(y) FILTER (WHERE y_hat IS NOT NULL) * count(y_hat)), 6) AS r2, round(avg(abs((y - y_hat) / y)), 6) AS mape FROM regression GROUP BY grp""")
def regression_metrics(spark, sf):
    out = E.regression_metrics(views.regression(spark, sf), "grp")
    return out.select("grp", "n", F.round("mse", 3).alias("mse"), *[F.round(c, 6).alias(c) for c in ("nmse", "r2", "mape")])


@query("""WITH m AS (SELECT grp, avg(abs((y - y_hat) / y)) AS mape, count(y_hat) AS n FROM regression GROUP BY grp)
SELECT 'mape' AS metric, round(avg(mape), 6) AS mean, round(median(mape), 6) AS median, count(*) AS n FROM m UNION ALL SELECT 'n', round(avg(n), 6), round(median(n), 6), count(*) FROM m""")
def regression_rollup(spark, sf):
    m = E.regression_metrics(views.regression(spark, sf), "grp").withColumn("n", F.col("n").cast("double"))
    return E.rolled_up(m, "grp", ["mape", "n"]).select("metric", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "n")


@query("SELECT grp, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, count(*) AS n FROM regression GROUP BY grp")
def linear_fit(spark, sf):
    return E.linear_fit(views.regression(spark, sf), "grp", "x", "y").select("grp", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query("""WITH f AS (SELECT l_suppkey AS grp, l_extendedprice AS y, l_quantity AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem),
s AS (SELECT a.grp, sum(sign(a.y - b.y) * sign(a.p - b.p)) AS s, sum(abs(sign(a.y - b.y))) AS u, sum(abs(sign(a.p - b.p))) AS v FROM f a JOIN f b ON a.grp = b.grp AND a.k < b.k GROUP BY 1)
SELECT grp, round(s / (sqrt(u) * sqrt(v)), 6) AS tau FROM s""")
def kendall_tau(spark, sf):
    line = views.read(spark, sf, "lineitem")
    rows = line.select(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("k"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("y_hat"))
    return E.kendall_tau(rows, "grp", "k").select("grp", F.round("tau", 6).alias("tau"))


@query("""WITH t AS (SELECT grp, count(value) AS ok, count(*) AS n, avg(value) AS v, avg(sqrt((x + 1.704) ** 2 + (y - 0.678) ** 2)) FILTER (WHERE value IS NOT NULL) AS d, avg(seconds) FILTER (WHERE value IS NOT NULL) AS s,
stddev_pop(x) FILTER (WHERE value IS NOT NULL) AS sd, arg_max(sqrt((x + 1.704) ** 2 + (y - 0.678) ** 2), trial) FILTER (WHERE value IS NOT NULL) AS last FROM trials GROUP BY grp),
c AS (SELECT grp, last, 1 / (1 + abs(v + 1.519)) AS vs, 1 / (1 + d) AS ds, 1 / (1 + sd) AS ss, least(CASE WHEN s > 0 THEN 1 / s ELSE 0 END, 10) / 10 AS sp, ok / CAST(n AS DOUBLE) AS rel FROM t WHERE ok > 0),
k AS (SELECT *, 0.35 * vs + 0.35 * ds + 0.20 * ss + 0.05 * sp + 0.05 * rel AS comb FROM c)
SELECT grp, round(vs, 6) AS value_score, round(ds, 6) AS distance_score, round(ss, 6) AS standard_deviation_score, round(sp, 6) AS speed_score, round(rel, 6) AS reliability_score, round(comb, 6) AS combined_score,
round(0.8 * CASE WHEN last < 1 THEN 1.0 WHEN last < 3 THEN 0.5 ELSE 0.1 END + 0.2 * comb, 6) AS overall_score FROM k""")
def trial_scorecard(spark, sf):
    out = E.trial_scorecard(views.trials(spark, sf), "grp", -1.519, -1.704, 0.678)
    return out.select("grp", *[F.round(c, 6).alias(c) for c in out.columns if c != "grp"])


@query("SELECT trial, round(sin(x) * cos(y) + sin(x * y) + (x * x + y * y) / 20, 9) AS value FROM trials")
def trial_objective(spark, sf):
    return views.trials(spark, sf).select("trial", F.round(E.objective(F.col("x"), F.col("y")), 9).alias("value"))


@query("SELECT grp, min(v) AS value FROM (SELECT grp, round(sin(x) * cos(y) + sin(x * y) + (x * x + y * y) / 20, 9) AS v FROM trials) GROUP BY grp")
def random_search_min(spark, sf):
    return views.trials(spark, sf).groupBy("grp").agg(F.min(F.round(E.objective(F.col("x"), F.col("y")), 9)).alias("value"))


@query()
def multi_restart_fit(spark, sf):
    rows = views.regression(spark, sf).select("grp", F.array(F.col("x") / 50).alias("x"), (F.col("y") / 1e5).alias("y"))
    return E.multi_restart_fit(rows, "grp", 1)


@query("SELECT grp, idx FROM circles WHERE x - r < -1e-6 OR x + r > 1 + 1e-6 OR y - r < -1e-6 OR y + r > 1 + 1e-6")
def packing_violations(spark, sf):
    return G.boundary_violations(views.circles(spark, sf)).select("grp", "idx")


_OVER = "SELECT a.grp, a.idx AS i, b.idx AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.r + b.r AS rr FROM circles a JOIN circles b ON a.grp = b.grp AND a.idx < b.idx AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < a.r + b.r - 1e-6"


@query(f"WITH o AS ({_OVER}) SELECT grp, i, j, round(d, 9) AS distance FROM o")
def packing_overlaps(spark, sf):
    return G.overlaps(views.circles(spark, sf), cell=0.05).select("grp", "i", "j", F.round("distance", 9).alias("distance"))


@query(f"""WITH o AS ({_OVER}), h AS (SELECT grp, count(*) AS overlaps FROM o GROUP BY 1), s AS (SELECT grp, count(*) AS n, round(sum(r), 6) AS sum_radii, CAST(sum((x - r < -1e-6 OR x + r > 1 + 1e-6 OR y - r < -1e-6 OR y + r > 1 + 1e-6)::INT) AS BIGINT) AS boundary FROM circles GROUP BY grp)
SELECT s.grp, n, sum_radii, boundary, coalesce(h.overlaps, 0) AS overlaps, (boundary = 0 AND coalesce(h.overlaps, 0) = 0) AS valid, CASE WHEN boundary = 0 AND coalesce(h.overlaps, 0) = 0 THEN round(sum_radii / 2.635, 6) ELSE 0 END AS target_ratio FROM s LEFT JOIN h USING (grp)""")
def packing_score(spark, sf):
    out = G.packing_scores(views.circles(spark, sf), cell=0.05)
    return out.select("grp", "n", F.round("sum_radii", 6).alias("sum_radii"), "boundary", "overlaps", "valid", F.round("target_ratio", 6).alias("target_ratio"))


@query(f"""WITH o AS ({_OVER}), hits AS (SELECT grp, count(*) AS overlaps, string_agg('Circles ' || i || ' and ' || j || ' overlap: dist=' || printf('%.6f', d) || ', r1+r2=' || printf('%.6f', rr), chr(10) ORDER BY i, j) AS text FROM o GROUP BY 1),
s AS (SELECT grp, sum(r) AS total, count(*) FILTER (WHERE x - r < -1e-6 OR x + r > 1 + 1e-6 OR y - r < -1e-6 OR y + r > 1 + 1e-6) AS boundary, min(r) AS low, max(r) AS high, avg(r) AS mean,
string_agg('Circle ' || idx || ' at (' || printf('%.6f', x) || ', ' || printf('%.6f', y) || ') with radius ' || printf('%.6f', r) || ' is outside unit square', chr(10) ORDER BY idx) FILTER (WHERE x - r < -1e-6 OR x + r > 1 + 1e-6 OR y - r < -1e-6 OR y + r > 1 + 1e-6) AS text FROM circles GROUP BY grp)
SELECT s.grp, 'Valid: ' || CASE WHEN boundary = 0 AND coalesce(hits.overlaps, 0) = 0 THEN 'True' ELSE 'False' END || ', Violations: ' || boundary || ' boundary, ' || coalesce(hits.overlaps, 0) || ' overlaps' AS report,
coalesce(s.text, '') AS boundary_report, coalesce(hits.text, '') AS overlap_report, 'Min: ' || printf('%.6f', low) || ', Max: ' || printf('%.6f', high) || ', Avg: ' || printf('%.6f', mean) AS radius_stats FROM s LEFT JOIN hits USING (grp)""")
def packing_report(spark, sf):
    return G.packing_reports(views.circles(spark, sf), cell=0.05, columns=["grp", "report", "boundary_report", "overlap_report", "radius_stats"])


@query("SELECT idx, round(least(x, y, 1 - x, 1 - y), 9) AS radius FROM circles")
def border_radius(spark, sf):
    return views.circles(spark, sf).select("idx", F.round(G.border_radius(F.col("x"), F.col("y")), 9).alias("radius"))


@query()
def repaired_radii(spark, sf):
    return G.repaired_radii(views.circles(spark, sf))


@query("SELECT id, CAST(greatest(1, 100 // (5 * 10)) AS BIGINT) AS budget, (island + 1) % 5 AS next_island FROM programs")
def island_budget(spark, sf):
    return _p(spark, sf).select("id", F.greatest(F.lit(1), F.floor(F.lit(100) / (5 * 10))).cast("long").alias("budget"), F.pmod(F.col("island") + 1, F.lit(5)).alias("next_island"))


@query("SELECT 'kept' AS state, id FROM programs UNION ALL SELECT 'seeded', -1 UNION ALL SELECT 'resumed', id FROM programs WHERE generation = 0")
def seed_gate(spark, sf):
    """The seed joins an empty table at iteration 0 only."""
    from evoframe.plans.evolve import seeded

    p = _p(spark, sf).select("id", "generation")
    seed = spark.createDataFrame([(-1, 0)], "id long, generation long")
    cases = {"kept": seeded(p, seed, 0), "seeded": seeded(p.where("id < 0"), seed, 0), "resumed": seeded(p.where("generation = 0"), seed, 7)}
    out = None
    for name, rows in cases.items():
        rows = rows.select(F.lit(name).alias("state"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out
