"""The evolution loop, its steps against a plain simulation, resume, and user callables."""

import hashlib
import json
import re
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoframe.operators import population as P
from evoframe.operators import regression as E2
from evoframe.plans import evolution as E
from evoframe.plans import experiments as X
from evoframe.plans import prompts, user_code
from evoframe.plans.query_storage import scratch
from evoframe.sources import config
from evoframe.sources import storage as S


def respond(system, prompt):
    """Adds a letter, fixed by the prompt, to the program's first line."""
    code = re.search(r"# Program\n```python\n(.*?)\n```", prompt, re.S).group(1)
    first = code.split("\n")[0]
    return f"x\n<<<<<<< SEARCH\n{first}\n=======\n{first}{hashlib.md5(prompt.encode()).hexdigest()[0]}\n>>>>>>> REPLACE\n"


def evaluate(code):
    return {"score": len(code) / 50, "note": "text"}, {"log": f"ran {len(code)}"}


def program(i, code, island=0, metrics=None, parent=None):
    return (str(i), code, "python", parent, 0, island, i, i, metrics if metrics is not None else {"score": len(code) / 50}, None, "", {})


def settings(**kw):
    return E.Settings(**({"timeout": 20.0, "delay": 0.0, "retries": 0, "iterations": 4, "islands": 2, "archive": 3, "checkpoint_interval": 2, "migration_interval": 2} | kw))


def test_adding_follows_the_rules(spark):
    scratch(spark)
    s = settings(population=4, archive=2, islands=1)
    rows = [program(i, "x" * n) for i, n in enumerate((10, 40, 20, 40, 5, 30))]
    state, programs, archive, cells, best = E.empty(spark, s), [], [], {}, None
    for r in rows:
        state = E.added(state, spark.createDataFrame([r], E.PROGRAMS), s)
        fit = round(len(r[1]) / 50, 9)
        programs.append((r[0], fit, r[6]))
        if len(programs) > s.population:
            keep = [p for p in programs if best and p[0] == best[0]]
            rest = sorted((p for p in programs if p not in keep), key=lambda p: (-p[1], -p[2]))
            programs = [p for p in programs if p in [*keep, *rest][: s.population]]
        alive = {p[0] for p in programs}
        archive, cells = [a for a in archive if a[0] in alive], {k: v for k, v in cells.items() if v[0] in alive}
        if r[0] in alive:
            cell = f"{min(int(fit * 10), 9)}-{min(int(len(r[1]) / 1000 * 10), 9)}"
            if cell not in cells or fit > cells[cell][1]:
                cells[cell] = (r[0], fit)
            if len(archive) < s.archive:
                archive.append((r[0], fit))
            else:
                worst = min(archive, key=lambda a: a[1])
                if fit > worst[1]:
                    archive[archive.index(worst)] = (r[0], fit)
            if best is None or fit > best[1]:
                best = (r[0], fit)
        assert {x.id for x in state.programs.collect()} == alive
        assert {x.id for x in state.archive.collect()} == {a[0] for a in archive}
        assert {x.cell: x.id for x in state.cells.collect()} == {k: v[0] for k, v in cells.items()}
        assert state.best_id == best[0]


def test_loop_checkpoints_and_resumes(spark):
    base = scratch(spark)
    whole = E.evolved(spark, "start\nrest", respond, evaluate, settings(), f"{base}/whole")
    got = {r.id: r for r in whole.programs.collect()}
    born = [r for r in got.values() if r.iteration_found > 0 and "_migrant_" not in r.id]
    assert len(born) == 4 and all(r.metrics == {"score": pytest.approx(len(r.code) / 50)} and r.artifacts["log"] == f"ran {len(r.code)}" for r in born)
    assert all(r.changes.startswith("Change 1: 'start") and r.parent_metrics for r in born)
    assert any("_migrant_" in i for i in got) and whole.last_migration >= 2 and whole.iteration == 4
    assert S.latest_checkpoint(spark, f"{base}/whole") == 4
    info = spark.read.json(f"{base}/whole/checkpoint_4/best").first()
    assert info.id == whole.best_id and info.current_iteration == 4
    assert spark.read.text(f"{base}/whole/checkpoint_4/best_code", wholetext=True).first().value == got[whole.best_id].code
    # Half of it, then the rest from its checkpoint: the same programs.
    E.evolved(spark, "start\nrest", respond, evaluate, settings(iterations=2), f"{base}/parts")
    state = E.resumed(spark, f"{base}/parts", settings())
    assert state.iteration == 2 and sum(state.generations) == 2
    rest = E.evolved(spark, "unused", respond, evaluate, settings(), f"{base}/parts")
    assert rest.iteration == 4 and "unused" not in {r.code for r in rest.programs.collect()}
    assert E.best_program(whole)["id"] == whole.best_id
    assert E.resumed(spark, f"{base}/none", settings()) is None


def test_target_ends_the_run(spark):
    scratch(spark)
    assert E.evolved(spark, "start", respond, evaluate, settings(iterations=5, target=0.1)).iteration == 1


def test_islands_turn(spark):
    s = E.empty(spark, settings(islands=3))
    assert E.next_island(E.set_island(s, 2)).island == 0 and E.set_island(s, 7).island == 1
    s = E.grown(E.grown(E.set_island(s, 1)))
    assert s.generations == (0, 2, 0) and E.migration_due(s, settings(islands=3)) and E.Settings(iterations=100, islands=5).budget == 2


def test_empty_island_takes_the_best(spark):
    scratch(spark)
    s = settings(exploration=1.0, exploitation=0.0)
    state = E.set_island(E.added(E.empty(spark, s), spark.createDataFrame([program(0, "a"), program(1, "abc")], E.PROGRAMS), s), 1)
    assert E.sampled_parents(state, s, 0) == ["1"]


def test_diversity_bins(spark):
    codes = ["a" * 300, "b" * 300, "a" * 150 + "b" * 150, "ab" * 150, ""]
    p = spark.createDataFrame([program(i, c) for i, c in enumerate(codes)], E.PROGRAMS)
    got = {r.id: r.bin for r in P.diversity_bins(p, p).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert got == {str(i): min(9, int(sum(distance(c, d) for d in codes) / 5 / 1000 * 10)) for i, c in enumerate(codes)}
    assert {r.bin for r in P.diversity_bins(p.limit(3), p.limit(3)).collect()} == {0}
    cells = {r.id: r.cell for r in P.grid(p, ("complexity", "diversity", "score", "other")).collect()}
    assert cells["0"].split("-")[1] == str(got["0"]) and all(len(c.split("-")) == 4 and c.endswith("-5") for c in cells.values())


def test_neighbours_inspire(spark):
    rows = [program(i, "x" * n, metrics={"score": m}) for i, (n, m) in enumerate([(100, 0.5), (150, 0.55), (900, 0.05), (220, 0.42), (100, 0.99)])]
    p = spark.createDataFrame(rows, E.PROGRAMS)
    grid = P.grid(p).withColumn("champion", F.lit(True))
    got = {r.id: r.priority for r in P.inspirations(p, "0", 4, 0.1, "s", grid).collect()}
    assert got == {"4": 0, "1": 2, "3": 2, "2": 3}


def test_prompt_has_every_section(spark):
    p = spark.createDataFrame([("1", "l\n" * 300, "python", {"a": 0.5, "b": 0.1}, {"log": "y" * 30})], "id string, code string, language string, metrics map<string,double>, artifacts map<string,string>")
    tries = [("1", k, {"a": 0.1 * k, "b": 0.5}, {"a": 0.0, "b": 0.9}, f"c{k}") for k in range(1, 5)]
    h = spark.createDataFrame(tries, "id string, seq long, metrics map<string,double>, parent_metrics map<string,double>, changes string")
    tops = spark.createDataFrame([("1", k, "\n".join(f"t{k}_{i}" for i in range(12)), "python", {"a": 0.9, "b": 0.2}) for k in range(1, 7)], "id string, place int, code string, language string, metrics map<string,double>")
    sampler = prompts.Sampler(artifact_chars=10, variations={"code": ["never"], "x": ["v1", "v2"]}, templates={"diff": prompts.TEMPLATES["diff"] + "{x}"})
    row = prompts.sampled_prompts(p, h, tops, sampler).first()
    t = row.prompt
    assert "- a: 0.5000\n- b: 0.1000" in t and "The code is long" in t and "Better than before: a" in t and "Worse than before: b" in t
    assert "### Attempt 4\n- Changes: c4\n- Measures: a: 0.4000, b: 0.5000\n- Outcome: Mixed results" in t and "Attempt 1\n" not in t and t.index("Attempt 4") < t.index("Attempt 2")
    assert "### Program 3 (score 0.5500)" in t and "t3_9\n# ... (cut)" in t and "t3_10" not in t and "### Program D2" in t and "### Program D3" not in t and "another way to a, another way to b" in t
    assert "yyyyyyyyyy\n... (truncated)" in t and t[-2:] in ("v1", "v2") and row.system == prompts.TEMPLATES["system"]
    rewrite = prompts.sampled_prompts(p, h.where("false"), tops.where("false"), prompts.Sampler(rewrite=True, templates={"system": "own"})).first()
    assert rewrite.system == "own" and "whole program in one fence" in rewrite.prompt


# --- user callables


def _check(row):
    if row["code"] == "loop":
        time.sleep(60)
    if row["code"] == "crash":
        import os

        os._exit(3)
    if row["code"] == "raise":
        raise ValueError("no")
    return row["code"] == row["cases"]


def test_verify_over_pairs(spark):
    rows = [(1, 0, 0, "a", "a", False), (1, 1, 0, "b", "a", False), (1, 2, 0, "raise", "a", False), (1, 3, 0, "crash", "a", False), (1, 4, 0, "loop", "a", False), (1, 5, 0, None, "a", True)]
    pairs = spark.createDataFrame(rows, "instance long, solution long, testing long, code string, cases string, unknown_error boolean")
    got = {r.solution: (r.result, r.unknown_error) for r in user_code.verified(pairs, _check, timeout=3.0).collect()}
    assert got == {0: (True, False), 1: (False, False), 2: (False, True), 3: (False, True), 4: (False, True), 5: (False, True)}


class _Result:
    metrics, artifacts = {"score": 1.0}, {"log": b"x"}


def test_evaluation_by_path(spark):
    scratch(spark)

    def by_file(path):
        assert path.endswith(".py")
        text = open(path).read()
        if text == "object":
            return _Result()
        return {"n": len(text), "name": "text"}

    rows = spark.createDataFrame([(1, "abc"), (2, "object"), (3, "")], "id long, code string")
    got = {r.id: (r.metrics, r.artifacts) for r in E.evaluated(rows, user_code.by_path(by_file), settings()).collect()}
    assert got == {1: ({"n": 3.0}, {}), 2: ({"score": 1.0}, {"log": "b'x'" if False else "x"}), 3: ({"n": 0.0}, {})}

    def bad(code):
        raise ValueError("broken")

    row = E.evaluated(rows.limit(1), bad, settings()).first()
    assert row.metrics == {"error": 0.0} and "broken" in row.artifacts["stderr"]


def test_delays_between_tries():
    waits, calls = [], []

    def fails(x):
        calls.append(x)
        raise KeyError(x)

    out = user_code.with_retries(fails, 3, 1.0, 2.0, waits.append)("k")
    assert out.value is None and "KeyError" in out.error and calls == ["k"] * 4 and waits == [1.0, 2.0, 4.0]
    user_code.with_retries(fails, 2, 1.0, sleep=waits.append)("k")
    assert waits[3:] == [1.0, 1.0]


def test_processing_batches_and_packings(spark):
    import numpy as np

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "id long, prompt string").coalesce(1)

    def work(row):
        if row["id"] == 3:
            raise ValueError("three")
        return {"n": np.int64(row["id"]), "a": np.arange(2), "f": np.float64(0.5)}

    got = {r.id: (r.output, r.error) for r in user_code.processed(rows, work, "id", retries=1).collect()}
    assert got[2] == ('{"a": [0, 1], "f": 0.5, "n": 2}', None) and got[3][0] is None and "three" in got[3][1]
    replies = user_code.batched(rows, lambda texts: [f"{t}/{len(texts)}" for t in texts], "id", size=3, delay=0.0).collect()
    assert {r.id: r.reply for r in replies} == {i: f"p{i}/{3 if i < 6 else 1}" for i in range(7)}
    programs = spark.createDataFrame([("a", "2"), ("b", "x")], "id string, code string")
    circles = user_code.packings(programs, lambda code: (np.full((int(code), 2), 0.5), np.full(int(code), 0.1), 0.2), timeout=10).collect()
    assert [(r.grp, r.idx, r.x, r.r, r.reported_sum) for r in sorted(circles, key=lambda r: r.idx)] == [("a", 0, 0.5, 0.1, 0.2), ("a", 1, 0.5, 0.1, 0.2)]


def _curve(x, p):
    return p[0] * np.sin(x[:, 0] * p[1]) + p[2]


def _broken(x, p):
    raise ValueError("no function")


def test_function_fits(spark):
    rng = np.random.default_rng(4)
    truth = {1: (2.0, 0.7, -1.0), 2: (0.5, 0.9, 3.0)}
    rows = [(g, [float(v)], float(a * np.sin(v * b) + c)) for g, (a, b, c) in truth.items() for v in rng.uniform(-2, 2, 80)]
    d = spark.createDataFrame(rows, "grp long, x array<double>, y double")
    for r in E2.function_fit(d, "grp", _curve, 3).collect():
        assert r.mse < 1e-8 and r.converged and r.error is None
        assert [abs(v) for v in r.params] == pytest.approx([abs(v) for v in truth[r.grp]], abs=1e-3)
    assert {(r.params, r.error) for r in E2.function_fit(d, "grp", _broken, 3).collect()} == {(None, "ValueError: no function")}
    p, loss, ok = E2.bfgs(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, np.array([-1.2, 1.0]), steps=500)
    assert loss < 1e-6 and p == pytest.approx([1, 1], abs=5e-3)


def test_experiments(spark, tmp_path):
    scratch(spark)
    inputs = "array<struct<symbol:string,description:string>>"
    problems = spark.createDataFrame([("a", "P0", [("t", "time"), ("v", "speed")], "s"), ("b", "P1", [], "c")], f"split string, name string, inputs {inputs}, output string")
    files = X.generated(problems)
    S.write_files(files, f"file://{tmp_path}")
    space = {}
    exec((tmp_path / "a/P0/initial_program.py").read_text(), space)  # noqa: S102  what was just made
    assert space["func"](np.array([[2.0, 3.0]]), np.arange(10)).tolist() == [3.0] and space["func"].num_params == 10
    assert "x[:, 1]: v (speed)" in (tmp_path / "a/P0/initial_program.py").read_text() and '"iterations":200' in (tmp_path / "a/P0/config.json").read_text()
    exec((tmp_path / "b/P1/initial_program.py").read_text(), space)  # noqa: S102
    assert space["func"](np.zeros((3, 0)), np.arange(1, 11)).tolist() == [1.0] * 3
    ended = []

    def run(row):
        if row["problem"] == "bad":
            raise ValueError("bad")
        return {"of": row["problem"]}

    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "bad"), ("c", "never")], "split string, problem string")
    done = X.fan_out(rows, run, ["a", "b"], after=lambda split, part: ended.append((split, part.count())))
    assert ended == [("a", 1), ("b", 2)]
    assert sorted((r.split, r.output, r.error) for r in done.collect() if r.output) == [("a", '{"of": "x"}', None), ("b", '{"of": "y"}', None)]


def test_configuration(tmp_path):
    values = {"iterations": 7, "unknown": 1, "dimensions": ["score", "diversity"], "sampler": {"top": 9, "other": 2}}
    (tmp_path / "c.json").write_text(json.dumps(values))
    c = config.load(E.Settings, str(tmp_path / "c.json"))
    assert (c.iterations, c.dimensions, c.sampler.top, c.islands) == (7, ("score", "diversity"), 9, 5)
    config.dump(c, str(tmp_path / "d.json"))
    assert config.load(E.Settings, str(tmp_path / "d.json")) == c
    assert config.load(E.Settings, str(tmp_path / "none"), {"SEED": "9"}, {"seed": "SEED", "target": "TARGET"}).seed == "9"
    pytest.importorskip("yaml")
    config.dump(c, str(tmp_path / "d.yaml"))
    assert config.load(E.Settings, str(tmp_path / "d.yaml")) == c
    assert config.switch("ENABLE_ARTIFACTS", {}) and not config.switch("ENABLE_ARTIFACTS", {"ENABLE_ARTIFACTS": "False"}) and not config.switch("OTHER", {})


def test_external_judge(spark):
    script = "import sys; t = sys.stdin.read(); sys.exit(3) if t == 'bad' else print(f'Score: {len(t)}\\nTest cases done: 3\\nTest cases correct: 2\\nTest cases total: 4' if t else 'nothing')"
    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "")], "id long, code string")
    got = {r.id: (r.score, r.total, r.error is not None) for r in user_code.judged(rows, [sys.executable, "-c", script], timeout=30).collect()}
    assert got == {1: (3, 4, False), 2: (None, None, True), 3: (None, None, False)}
