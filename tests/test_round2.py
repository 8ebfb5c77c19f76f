"""Findings of the second round, on tables of the size or shape that showed them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from evoframe.plans import catalogue

QUERIES, ORACLES = catalogue.load()


def against_sql(spark, sf, name, *tables):
    """Rows of the query and of its SQL that the other doesn't have."""
    got = QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    con.register("mine", got)
    con.execute(f"CREATE TABLE theirs AS {ORACLES[name]}")
    cols, count = ", ".join(got.columns), lambda a, b: f"(SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}))"
    return con.execute(f"SELECT {count('mine', 'theirs')}, {count('theirs', 'mine')}, (SELECT count(*) FROM theirs)").fetchone()


@pytest.fixture(scope="module")
def many_programs(spark, tmp_path_factory):
    """More documents than a range partitioner samples."""
    sf = str(tmp_path_factory.mktemp("programs"))
    d = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), (F.floor(F.col("id") / 40) + F.pmod(F.xxhash64("id"), F.lit(9))).alias("n_chars"))
    d.coalesce(2).write.parquet(f"{sf}/documents.parquet")
    labels = spark.range(0, 30000, 7).select(F.col("id").alias("doc_id"), (F.col("id") % 3 % 2).cast("int").alias("quality"), (F.col("id") % 5 % 2).cast("int").alias("toxic"))
    labels.coalesce(1).write.parquet(f"{sf}/labels.parquet")
    return sf


@pytest.mark.parametrize("name", ["comparator_rank", "list_sort", "migrants", "running_best"])
def test_ranges_are_the_same_for_both_plans(spark, many_programs, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        mine, theirs, n = against_sql(spark, many_programs, name, "documents", "labels")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n and (mine, theirs) == (0, 0)


def test_stream_running_best_of_many_rows(spark, many_programs):
    """A batch of a key comes in several pieces."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 100)
    try:
        mine, theirs, n = against_sql(spark, many_programs, "stream_running_best", "documents", "labels")
    finally:
        spark.conf.set(key, before)
    assert n and (mine, theirs) == (0, 0)


def test_running_best_stream_over_batches(spark, tmp_path):
    """Rows without a value go out until one has a value; a later batch goes on from the best so far."""
    from evoframe.streaming import counts as C

    schema = "key long, seq long, value double"
    for k, values in enumerate([[None, 3.0, None, 2.0], [3.0, None, 4.0, 4.0]]):
        spark.createDataFrame([(1, 10 * k + i, v) for i, v in enumerate(values)][::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        C.running_best(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.seq, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, None), (1, 3.0), (12, 4.0)]


def test_packing_reports_hold_texts_not_pairs(spark):
    """Lines are put together circle by circle, and those of a packing without a name aren't lost."""
    from evoframe.operators import geometry as G

    rows = [(None, 1, 2.0, 0.5, 0.1)] + [(1, i, 0.5, 0.5 + i / 1000, 0.01) for i in range(40)]
    df = G.packing_reports(spark.createDataFrame(rows, "grp long, idx long, x double, y double, r double"), cell=0.05)
    got = {r.grp: r for r in df.collect()}
    assert got[None].boundary_report == "Circle 1 at (2.000000, 0.500000) with radius 0.100000 is outside unit square" and got[None].boundary == 1
    pairs = [(i, j) for i in range(40) for j in range(i + 1, 40) if (j - i) / 1000 < 0.02 - 1e-6 - 1e-12]
    assert got[1].overlap_report.split("\n") == [f"Circles {i} and {j} overlap: dist={(j - i) / 1000:.6f}, r1+r2=0.020000" for i, j in pairs]
    assert (got[1].overlaps, got[1].valid, got[1].boundary_report, got[1].n) == (len(pairs), False, "", 40)


@pytest.mark.parametrize("n", [0, 1, 5, 37, 99, 100, 150])
def test_skipped_without_one_task(spark, n):
    from evoframe.operators import relational as R

    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("id")).repartition(7)
    out = R.skipped(rows, n, F.desc("id"))
    assert [r.id for r in out.collect()] == list(range(99, -1, -1))[n:]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rank_discriminative", "rank_coverage", "rank_baseline", "accept_counts", "pass_counts", "zero_variance_prune"])
def test_verification_is_dealt_out_once(spark, name):
    """What is counted and ranked within an instance needs one exchange by instance (and that once for each side)."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert shuffles and all("REPARTITION_BY_NUM" in x for x in shuffles)


def test_partitions_follow_the_files(spark, monkeypatch):
    from evoframe.plans import views

    sf = "/root/testdata/sf0.01"
    few = views.solutions(spark, sf).rdd.getNumPartitions()
    monkeypatch.setattr(views, "TASK_BYTES", views.TASK_BYTES // 100)
    assert views.solutions(spark, sf).rdd.getNumPartitions() > few


def test_repaired_radii_of_many_circles(spark):
    """A packing of 4,000 circles took half a minute pair by pair."""
    import time

    import numpy as np
    from evoframe.operators import geometry as G

    rng = np.random.default_rng(5)
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(0.5 + rng.normal(0, 0.06, (4000, 2)))]
    df = spark.createDataFrame(rows, "grp long, idx long, x double, y double")
    began = time.perf_counter()
    assert G.repaired_radii(df).agg(F.count_if(F.col("r") >= 0)).first()[0] == 4000
    assert time.perf_counter() - began < 12


@pytest.mark.parametrize("size", [None, 1])
def test_stream_appends_of_many_files(spark, monkeypatch, size):
    """Batches follow the bytes that arrive, not the files; small batches give the same rows."""
    from pathlib import Path

    from evoframe.plans import query_storage as Q
    from evoframe.plans import views

    sf, made, scratch = "/root/testdata/sf0.001", [], Q.scratch
    monkeypatch.setattr(Q, "scratch", lambda s: made.append(scratch(s)) or made[-1])
    monkeypatch.setattr(views, "TASK_BYTES", 10_000)
    if size:
        monkeypatch.setattr(Q, "BATCH_BYTES", size)
        monkeypatch.setattr(views, "TASK_BYTES", 2**20)
    got = QUERIES["stream_appends"](spark, sf)
    want = views.verification(spark, sf).where("testing < 2").select("instance", "solution", "testing")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    path, _, state = (Path(p.removeprefix("file:")) for p in made)
    files, batches = len(list(path.glob("*.parquet"))), len(list((state / "commits").glob("[0-9]*")))
    assert batches == files if size else files > 10 and batches == 2


def test_results_are_written_small(spark, monkeypatch):
    from pathlib import Path

    from evoframe.plans import query_storage as Q
    from evoframe.plans import views

    made, scratch = [], Q.scratch
    monkeypatch.setattr(Q, "scratch", lambda s: made.append(scratch(s)) or made[-1])
    sf = "/root/testdata/sf0.001"
    got, want = QUERIES["results_write"](spark, sf), views.verification(spark, sf)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()
    files = list(Path(made[0].removeprefix("file:")).rglob("part-*"))
    assert files and sum(f.stat().st_size for f in files) < 20 * got.count()


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    """Spark's own shares are 32 small files each; every file is read all the same."""
    import gzip

    from evoframe.sources import storage as S

    rows = spark.range(4000).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(".json")).alias("name"), F.when(F.col("id") == 7, "{broken").otherwise(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit("café").alias("code")))).cast("binary").alias("content"))
    path = str(tmp_path / "programs")
    S.write_files(rows, path)
    programs, artifacts = S.read_json_dir(spark, path), S.read_artifacts(spark, path)
    assert programs.rdd.getNumPartitions() <= 8 and artifacts.rdd.getNumPartitions() <= 8
    assert {(r.id, r.code) for r in programs.collect()} == {(str(i), "café") for i in range(4000) if i != 7}
    assert artifacts.select("name").distinct().count() == artifacts.where("text is not null and bytes is null").count() == 4000
    logs = spark.range(4000).select(F.concat(F.col("id") % 9, F.lit("/"), F.col("id"), F.lit(".json")).alias("name"), F.to_json(F.struct("id")).cast("binary").alias("content"))
    S.write_files(logs, str(tmp_path / "logs"))
    events = S.read_event_logs(spark, str(tmp_path / "logs"), "id LONG")
    assert events.rdd.getNumPartitions() <= 8 and events.where("id = seq AND log = id % 9").count() == 4000
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "a.json.gz").write_bytes(gzip.compress(b'{"id": "a"}'))
    (tmp_path / "packed" / "b.json").write_bytes(b'{"id": "b"}')
    assert {r.id for r in S.read_json_dir(spark, str(tmp_path / "packed"), compressed=True).collect()} == {"a", "b"}


def test_edit_distances_side_by_side(monkeypatch):
    """Pairs of all lengths at once, next to pairs that go alone; far fewer steps than characters."""
    import random

    from evoframe.functions import text as T
    from tests.test_whole_job import brute_distance

    rng, seen, wave = random.Random(8), [], T._wave_distances
    monkeypatch.setattr(T, "FEW_WORDS", 1)
    monkeypatch.setattr(T, "_wave_distances", lambda pairs: seen.append(len(pairs)) or wave(pairs))
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    a = [word("abcé\U0001f600", rng.randint(0, 300)) for _ in range(60)] + [None, "x", "", "a" * 200, "b" * 64, "c" * 128]
    b = [word("abcd", rng.randint(0, 300)) for _ in range(60)] + ["x", None, "", "b" * 190, "a" * 64, "c" * 127 + "d"]
    assert T._distances(a, b) == [None if x is None or y is None else brute_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert sum(seen) > 40 and max(seen) > 20


@pytest.mark.parametrize("labels", [3, 20])
def test_language_scores_by_steps_in_place(labels):
    """Against the steps that the network is trained by, for fewer and for more labels than hidden units."""
    import numpy as np
    from evoframe.llm import language as L

    model, rng = L.BiGru(labels), np.random.default_rng(4)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (1, 2, 40, 900, 0, 1024)]
    x, mask = L.padded(texts)
    both = np.concatenate([model._run(d, x, mask)[0] for d in "fb"], 2)
    p = L._softmax(both @ model.p["out"] + model.p["bias"]) * mask[:, :, None]
    want = p.sum(0) / np.maximum(mask.sum(0), 1)[:, None]
    assert np.abs(model.score(texts) - want).max() < 1e-5
    assert callable(model._stepper("f", 5))
