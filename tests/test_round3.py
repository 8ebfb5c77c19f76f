"""Findings of round 3."""

from pathlib import Path

import duckdb

from evoframe.plans import catalogue

QUERIES, ORACLES = catalogue.load()


def test_artifacts_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds folders, not files; a folder has so many files at most, and a repeated name isn't lost."""
    from evoframe.sources import storage as S

    plan = QUERIES["artifact_dir"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan
    monkeypatch.setattr(S, "FOLDER_FILES", 50)
    rows = [(f"a{i}", bytes([65 + i % 26]) * i) for i in range(399)] + [("b.gz", b"\xff\x00"), ("_c", b"x"), ("a5", b"again"), ("a5", b"again")]
    folders = S.write_artifacts(spark.createDataFrame(rows, "name string, content binary").coalesce(1), str(tmp_path / "out"))
    sizes = [len(list(Path(f).iterdir())) for f in folders]
    assert len(folders) >= 8 and max(sizes) <= 50 and sum(sizes) == len(rows)
    got = [(r.name, r.text, r.bytes, r.size) for r in S.read_artifacts(spark, *folders).collect()]
    want = [(n, None if n == "b.gz" else c.decode(), bytearray(c) if n == "b.gz" else None, len(c)) for n, c in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert S.read_artifacts(spark).collect() == []


def test_artifacts_of_odd_documents(spark, tmp_path):
    """Empty and missing texts, missing, repeated and negative ids have their rows, as in the SQL."""
    docs = [(1, "one"), (3, ""), (5, None), (2, None), (4, ""), (None, "no id"), (None, None), (7, "caf\u00e9"), (7, "again"), (7, "again"), (-1, "minus"), (-2, "x"), (-3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    documents = duckdb.sql(f"SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")  # noqa: F841
    want = duckdb.sql(f"SELECT name, text, bytes, size FROM ({ORACLES['artifact_dir']})").fetchall()
    got = [tuple(r) for r in QUERIES["artifact_dir"](spark, str(tmp_path)).select("name", "text", "bytes", "size").collect()]
    assert len(want) == len(docs) and sorted(got, key=str) == sorted(want, key=str)


def test_each_large_packing_report_has_a_task(spark, monkeypatch):
    """Reports are put together as their circles pass; a task holds one large report, and no list of a packing's texts is made."""
    from pyspark.sql import functions as F

    from evoframe.operators import geometry as G

    monkeypatch.setattr(G, "LARGE", 20)
    rows = [(g, i, 0.5 + (g or 0) / 50, 0.5 + i / 1000, 0.01) for g in (None, 1, 2, 3, 4, 5) for i in range(12 if g == 5 else 40)] + [(1, 99, 2.0, 0.5, 0.1), (1, 7, 3.0, 0.5, 0.1)]
    circles = spark.createDataFrame(rows, "grp long, idx long, x double, y double, r double").repartition(5, "idx")
    out = G.packing_reports(circles, cell=0.25, columns=["grp", "report", "boundary_report", "overlap_report"])
    assert "collect_list(named_struct(i" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.grp: r for r in out.withColumn("task", F.spark_partition_id()).collect()}
    assert len(got) == 6 and len({got[g].task for g in (1, 2, 3, 4)}) == 4
    for g, r in got.items():
        n = {None: 0, 5: 12}.get(g, 40)  # circles without a packing don't meet
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if (j - i) / 1000 < 0.02 - 1e-6 - 1e-12]
        assert r.overlap_report == "\n".join(f"Circles {i} and {j} overlap: dist={(j - i) / 1000:.6f}, r1+r2=0.020000" for i, j in pairs)
        edge = [f"Circle {i} at ({x:.6f}, 0.500000) with radius 0.100000 is outside unit square" for i, x in ((7, 3.0), (99, 2.0))] if g == 1 else []
        assert r.boundary_report == "\n".join(edge) and r.report == f"Valid: {not pairs}, Violations: {len(edge)} boundary, {len(pairs)} overlaps"
