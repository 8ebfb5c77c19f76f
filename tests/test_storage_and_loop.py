"""Round trips, the evolution loop and streams."""

import pytest
from pyspark.sql import functions as F

from evoframe.plans import catalogue, evolve, prompts
from evoframe.plans.query_storage import scratch
from evoframe.sources import storage as S
from evoframe.streaming import counts as C

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.load()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 1


def test_checkpoint(spark, tmp_path):
    c = S.Checkpoint(str(tmp_path), 7)
    p = spark.createDataFrame([("1", "x", {"s": 0.5})], "id string, code string, metrics map<string,double>")
    state = spark.createDataFrame([([["1"], []], 7, [1])], "islands array<array<string>>, last_iteration int, island_generations array<int>")
    c.write(p, state, p.select("id"))
    programs, back = c.read(spark)
    row = back.first()
    assert programs.first().metrics == {"s": 0.5} and row.last_iteration == 7
    assert row.island_generations == [0, 0] and row.archive == []
    paths = spark.createDataFrame([("b/checkpoint_9",), ("b/checkpoint_10",), ("b/other",)], "path string")
    assert S.latest_by_number(paths).first().path == "b/checkpoint_10"
    assert S.latest_by_time(spark, str(tmp_path), "*.json").first().path.rstrip("/").split("/")[-1] in ("best", "state")


def test_json_directory_skips_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "generation": 1}')
    (tmp_path / "b.json").write_text('{"id": ')
    (tmp_path / "c.json").write_text('{\n  "id": "c",\n  "generation": 2\n}')
    assert sorted(r.id for r in S.read_json_dir(spark, str(tmp_path)).collect()) == ["a", "c"]
    assert S.read_event_log(spark, str(tmp_path / "none"), "role STRING").count() == 0


def test_templates_override(spark, tmp_path):
    (tmp_path / "a.txt").write_text("own\nlines")
    rows = {r.name: r.text for r in S.read_templates(spark, str(tmp_path), {"a": "default", "b": "kept"}).collect()}
    assert rows == {"a": "own\nlines", "b": "kept"}


def test_artifacts(spark):
    rows = [(1, "text", bytearray(b"hello world")), (1, "bin", bytearray(b"\xff\xfehello worl")), (2, "big", bytearray(b"x" * 51200))]
    a = spark.createDataFrame(rows, "program_id long, key string, content binary")
    assert {r.program_id: r.total for r in S.artifact_sizes(a).collect()} == {1: 11 + 12, 2: 51200}
    assert {r.key: r.route for r in S.routed(a).collect()} == {"text": "inline", "bin": "inline", "big": "file"}
    assert '"text":"hello world"' in S.inline_json(a).where("program_id = 1").first().artifacts_json


def test_cascade_stops_early(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad code")], "id long, code string")
    out = evolve.cascade(rows, [(_compiles, 0.5), (_full, 0.0)])
    got = {r.id: (r.stages, r.metrics) for r in out.collect()}
    assert got[2] == (1, {"stage1": 0.0}) and got[1] == (2, {"stage1": 1.0, "score": 4.0})


def _compiles(code):
    return {"stage1": 0.0 if " " in code else 1.0, "note": "text"}


def _full(code):
    return {"score": float(len(code))}


def _fails(code):
    raise ValueError("no")


def test_errors_become_metrics(spark):
    rows = spark.createDataFrame([(1, "x")], "id long, code string")
    assert evolve.evaluated(rows, _fails, retries=1).first().metrics == {"error": 1.0}


def _grow(code, k):
    return code + "ab"[k]


def test_evolution(spark):
    scratch(spark)
    seed = spark.createDataFrame([(-1, "s", None, 0, 0, 0, {"score": 1.0})], evolve.SCHEMA)
    saved = []
    out = evolve.evolve(seed, _grow, _full, 3, evolve.Settings(population=4, islands=1, checkpoint_interval=2), on_checkpoint=lambda i, p: saved.append((i, p.count())))
    assert out.count() == 4 and saved == [(2, 4)]
    assert evolve.evolve(seed, _grow, _full, 0).count() == 1
    assert evolve.seeded(out, seed, 5).count() == 4 and evolve.seeded(out.where("false"), seed, 0).count() == 1


def test_prompt(spark):
    p = spark.createDataFrame([(1, "def f(): pass", "python", {"score": 0.5}, "log")], "id long, code string, language string, metrics map<string,double>, artifacts string")
    h = spark.createDataFrame([(1, 0, {"score": 0.4})], "id long, seq long, metrics map<string,double>")
    text = prompts.prompts(p, h).first().prompt
    assert "def f(): pass" in text and "score: 0.5" in text and "Attempt 1: score=0.4000" in text


def test_streams(spark, tmp_path):
    rows = [(1, s, t, (s + t) % 2 == 0, False, True) for s in range(3) for t in range(2)]
    v = spark.createDataFrame(rows, C.VERIFICATION)
    v.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = C.running_counts(C.arriving(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("c1").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("c1").collect()] == [(1, 3, 6, 0)]
    for _ in range(2):  # the second run finds nothing new
        C.append_results(C.without_repeats(C.arriving(spark, str(tmp_path / "in")), ["instance", "solution"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_running_best_stream(spark, tmp_path):
    spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5])], "key long, seq long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("key long, seq long, value double").parquet(str(tmp_path / "in"))
    q = C.running_best(s).writeStream.format("memory").queryName("best1").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in spark.table("best1").orderBy("seq").collect()] == [3.0, 4.0, 5.0]


def test_lineage_recursion(spark):
    from evoframe.operators.lineage import ancestors

    p = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1)], "id long, parent_id long")
    assert {(r.id, r.depth) for r in ancestors(p, 3).collect()} == {(3, 0), (1, 1), (0, 2)}
    assert p.select(F.max("id")).first()[0] == 3
