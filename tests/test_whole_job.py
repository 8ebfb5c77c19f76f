"""Queries and operators over all rows and whole texts, against brute force."""

import random
import math
import numpy as np
import re

import pytest
from pyspark.sql import functions as F

from evoframe.functions import text as T
from collections import Counter
from evoframe.plans import catalogue, views

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.load()


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def brute_redacted(x):
    x = re.sub(r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "", x)
    for pattern, instead in (("[A-Za-z0-9]{32,}", "<REDACTED_TOKEN>"), ("sk-[A-Za-z0-9]{48}", "<REDACTED_API_KEY>"), (r"password[=:]\s*[^\s]+", "password=<REDACTED>"), (r"token[=:]\s*[^\s]+", "token=<REDACTED>")):
        x = re.sub(pattern, instead, x, flags=re.IGNORECASE)
    return x


def test_redact_all(spark, tmp_path):
    texts = ["plain", "caf\u00e9 password= geheim\u00a0mehr", "\u201cToken:\u3000s\u00e9cret\u201d x", "pa\u017fsword: a", "to\u212aen=b", "\u0130\u0131\u017f\u212a" * 8, "\u00e9" * 40, "a" * 31 + "\u00e9", "PASSWORD:\x1cx y\x85z"]
    sf = table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in QUERIES["redact"](spark, sf).collect()}
    assert got == {i: brute_redacted(f"{t}\x1b[31m Password= abc\x1b[0m{i} token:x") for i, t in enumerate(texts)}
    assert spark.read.parquet(f"{SF}/documents.parquet").count() == QUERIES["redact"](spark, SF).count()


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_all(spark, tmp_path):
    rng = random.Random(3)
    texts = ["", "", "kitten", "sitting", "a" * 300 + "x", "a" * 300 + "yz", "caf\u00e9 \U0001f600", "cafe", None, "b"]
    texts += ["".join(rng.choice("ab\u00e9c") for _ in range(rng.randint(0, 400))) for _ in range(25)]
    texts += [texts[-1][:100] + "\u4e2d" + texts[-1][90:]]
    sf = table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.distance for r in QUERIES["edit_distance"](spark, sf).collect()}
    assert got == {i: None if a is None or b is None else brute_distance(a, b) for i, (a, b) in enumerate(zip(texts, texts[1:]))}


def brute_tau(rows):
    sign = lambda x: (x > 0) - (x < 0)
    d = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(rows) for b in rows[:i]]
    return sum(x * y for x, y in d) / (math.sqrt(sum(x * x for x, _ in d)) * math.sqrt(sum(y * y for _, y in d)))


def test_kendall_tau_all(spark, tmp_path):
    rng = random.Random(5)
    rows = [(g, i, 1, i, float(rng.randrange(1, 90)) + i % 70, float(rng.randrange(1, 9 + 20 * g))) for g in (1, 2) for i in range(150 * g)]
    sf = table(spark, tmp_path, "lineitem", rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double")
    got = {r.grp: r.tau for r in QUERIES["kendall_tau"](spark, sf).collect()}
    assert got == {g: pytest.approx(brute_tau([r[4:] for r in rows if r[0] == g]), abs=2e-6) for g in (1, 2)}


def test_island_diversity_all(spark, tmp_path):
    rng = random.Random(7)
    docs = [(i, "a" * 250 + "".join(rng.choice("xy\u00e9") for _ in range(rng.randint(0, 60))), ("en", "de")[i % 2], 9) for i in range(23)]
    table(spark, tmp_path, "labels", [(0, 1, 0)], "doc_id long, quality int, toxic int")
    sf = table(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, n_chars long")
    got = {r.island: r.diversity for r in QUERIES["island_diversity"](spark, sf).collect()}
    members = {k: [t for i, t, *_ in docs if i % 5 == k] for k in range(5)}
    mean = lambda x: sum(x) / len(x)
    assert got == {k: pytest.approx(mean([brute_distance(a, b) for i, a in enumerate(m) for b in m[:i]]), abs=1e-6) for k, m in members.items()}


def test_multi_restart_fit_of_every_group(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(g, i, float(x), float(x * 900 + rng.normal() * 1e4)) for g in range(1, 25) for i, x in enumerate(rng.integers(1, 51, 40))]
    sf = table(spark, tmp_path, "lineitem", rows, "l_suppkey long, l_orderkey long, l_quantity double, l_extendedprice double")
    got = {r.grp: (r.params, r.mse) for r in QUERIES["multi_restart_fit"](spark, sf).collect()}
    assert sorted(got) == list(range(1, 25))
    for g, (params, mse) in got.items():
        x = np.array([[r[2] / 50, 1.0] for r in rows if r[0] == g])
        y = np.array([r[3] / 1e5 for r in rows if r[0] == g])
        draw, best = np.random.default_rng(0), (np.inf, None)
        rate = 1.0 / np.linalg.eigvalsh(x.T @ x / len(x))[-1]
        for _ in range(10):
            p = draw.standard_normal(2)
            for _ in range(200):
                p -= rate * (x.T @ (x @ p - y) / len(x))
            best = min(best, (float(np.mean((x @ p - y) ** 2)), p.tolist()))
        assert mse == pytest.approx(best[0], rel=1e-6) and params == pytest.approx(best[1], rel=1e-6)


def test_storage_queries_take_whole_tables(spark):
    docs, turns = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/conversations.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    programs = {int(r.id) for r in QUERIES["dir_of_json"](spark, SF).collect()}
    assert programs == set(texts) - {3}
    log = Counter((r.log, r.seq, r.role, r.text) for r in QUERIES["event_log"](spark, SF).collect())
    assert log == Counter((r.conv_id, r.turn, r.role, r.text) for r in turns.collect())
    files = {r.name: (r.text, r.bytes) for r in QUERIES["artifact_dir"](spark, SF).collect()}
    assert files == {f"a{i}": (None, "FFFE") if i % 2 == 0 else (t, None) for i, t in texts.items()}
    assert QUERIES["latest_checkpoint"](spark, SF).first().path == f"base/checkpoint_{max(texts)}"
    v = views.verification(spark, SF)
    names = ["instance", "solution", "result", "testing"]
    assert QUERIES["results_write"](spark, SF).select(names).exceptAll(v.select(names)).count() == 0
    assert QUERIES["results_write"](spark, SF).count() == v.count() > 1000
    counts = QUERIES["stream_counts"](spark, SF)
    assert counts.select("instance").distinct().count() == v.select("instance").distinct().count()


def test_members_formats_and_bytes_of_every_row(spark):
    p = {r.id: r for r in views.programs(spark, SF).collect()}
    shown = {r.id: r.text for r in QUERIES["metric_format"](spark, SF).collect()}
    assert shown == {i: ", ".join(f"{k}={v:.4f}" for k, v in sorted(r.metrics.items())) for i, r in p.items()}
    assert "noise=nan" in shown[97] and any("quality=" in t for t in shown.values())
    assert {r.doc_id: r.text for r in QUERIES["byte_decode"](spark, SF).collect()} == {i: (b"\xff\xfe" + r.code.encode()).decode(errors="replace") for i, r in p.items()}


def test_archives_after_single_arrivals(spark, tmp_path):
    """The fold of each island, and a batch's, against plain loops."""
    from evoframe.operators import population as P

    rng = random.Random(11)
    rows = [(i, i % 2, i, {"score": rng.randrange(8) / 8} | ({"combined_score": rng.randrange(8) / 8} if i % 3 else {})) for i in range(60)]
    p = spark.createDataFrame(rows, "id long, island long, seq long, metrics map<string,double>")

    def fold(held, arrivals, n):
        average = lambda r: round(sum(r[3].values()) / len(r[3]), 9)
        value = lambda r: r[3].get("combined_score", average(r))
        for r in arrivals:
            if len(held) < n:
                held.append(r)
                continue
            worst = min(held, key=average)
            if value(r) > value(worst):
                held[held.index(worst)] = r
        return held

    got = Counter((r.island, r.id) for r in P.archive_fold(p, 7).collect())
    assert got == Counter((k, r[0]) for k in (0, 1) for r in fold([], [r for r in rows if r[1] == k], 7))
    s = P.scored(p)
    first = P.archive_added(s.where("false"), s.where("id < 20"), 5)
    both = {r.id for r in P.archive_added(first, s.where("id >= 20"), 5).collect()}
    assert {r.id for r in first.collect()} == {r[0] for r in fold([], rows[:20], 5)} and both == {r[0] for r in fold(fold([], rows[:20], 5), rows[20:], 5)}


def test_repaired_radii(spark):
    from evoframe.operators import geometry as G

    rng = random.Random(12)
    rows = [(g, i, rng.random(), rng.random()) for g in range(3) for i in range(12)]
    got = {(r.grp, r.idx): r.r for r in G.repaired_radii(spark.createDataFrame(rows, "grp long, idx long, x double, y double")).collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        radii = [min(x, y, 1 - x, 1 - y) for _, _, x, y in own]
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                far = math.dist(own[i][2:], own[j][2:])
                if radii[i] + radii[j] > far:
                    share = far / (radii[i] + radii[j])
                    radii[i], radii[j] = radii[i] * share, radii[j] * share
        assert [got[(g, i)] for i in range(12)] == pytest.approx(radii)
