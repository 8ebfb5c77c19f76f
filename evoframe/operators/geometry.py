"""Circles in the unit square: grp, idx, x, y, r."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.session import whole_executor

TOLERANCE = 1e-6


def outside(x: Column, y: Column, r: Column) -> Column:
    low, high = -TOLERANCE, 1 + TOLERANCE
    return (x - r < low) | (x + r > high) | (y - r < low) | (y + r > high)


def boundary_violations(circles: DataFrame) -> DataFrame:
    return circles.where(outside(F.col("x"), F.col("y"), F.col("r")))


def overlaps(circles: DataFrame, cell: float | None = None) -> DataFrame:
    """Unordered pairs of a group that overlap. With a cell at least twice the largest radius, only neighbouring cells of a grid are joined."""
    far = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    close = (F.col("a.idx") < F.col("b.idx")) & (far < F.col("a.r") + F.col("b.r") - TOLERANCE)
    if cell is None:
        pairs = circles.alias("a").join(circles.alias("b"), (F.col("a.grp") == F.col("b.grp")) & close)
    else:
        grid = circles.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
        shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        probes = grid.withColumn("s", F.explode(shifts)).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")})
        same = (F.col("a.grp") == F.col("b.grp")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
        pairs = probes.alias("a").join(grid.alias("b"), same & close)
    return pairs.select(F.col("a.grp").alias("grp"), F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), far.alias("distance"), (F.col("a.r") + F.col("b.r")).alias("radii"))


def _statistics(circles: DataFrame) -> DataFrame:
    return circles.groupBy("grp").agg(
        F.count("*").alias("n"), F.sum("r").alias("sum_radii"), F.min("r").alias("min_radius"), F.max("r").alias("max_radius"), F.avg("r").alias("mean_radius"),
        F.count_if(outside(F.col("x"), F.col("y"), F.col("r"))).alias("boundary"), F.count_if((F.col("r") < 0) | F.isnan("r")).alias("negative"),
    )


VALID = "boundary = 0 and negative = 0 and overlaps = 0"


def packing_scores(circles: DataFrame, target: float = 2.635, cell: float | None = None) -> DataFrame:
    """Radius statistics, violations, validity, and the share of the target, which only a valid packing scores."""
    hits = overlaps(circles, cell).groupBy("grp").agg(F.count("*").alias("overlaps"))
    out = _statistics(circles).join(hits, "grp", "left").na.fill(0, ["overlaps"])
    return out.withColumn("valid", F.expr(VALID)).withColumn("target_ratio", F.when(F.col("valid"), F.col("sum_radii") / target).otherwise(0.0))


#: The lines of a packing's report.
BOUNDARY_LINE = "Circle %d at (%.6f, %.6f) with radius %.6f is outside unit square"
OVERLAP_LINE = "Circles %d and %d overlap: dist=%.6f, r1+r2=%.6f"
VERDICT_LINE = "Valid: %s, Violations: %d boundary, %d overlaps"
RADII_LINE = "Min: %.6f, Max: %.6f, Avg: %.6f"


#: A packing of more circles can have a report of some 100 MB; such a report has a task for itself.
LARGE = 2000
#: Columns of packing_reports.
REPORT = (
    "grp LONG, n LONG, sum_radii DOUBLE, min_radius DOUBLE, max_radius DOUBLE, mean_radius DOUBLE, boundary LONG, negative LONG, overlaps LONG, valid BOOLEAN, "
    "report STRING, boundary_report STRING, overlap_report STRING, radius_stats STRING"
)


def _reports(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a packing follow each other, its circles in order: a row for each packing, whose texts are held once."""

    def row(s: dict, texts: dict[str, bytearray], overlaps: int) -> pa.RecordBatch:
        valid = s["boundary"] == 0 and s["negative"] == 0 and overlaps == 0
        small = s | {"overlaps": overlaps, "valid": valid, "report": VERDICT_LINE % (valid, s["boundary"], overlaps)}
        out = []
        for name, kind in zip(columns, kinds, strict=True):
            if name in texts:
                offsets = pa.py_buffer(np.array([0, len(texts[name])], np.int32).tobytes())
                out.append(pa.Array.from_buffers(pa.string(), 1, [None, offsets, pa.py_buffer(texts[name])]))
            else:
                out.append(pa.array([small[name]], kind))
        return pa.RecordBatch.from_arrays(out, names=columns)

    of = {"LONG": pa.int64(), "DOUBLE": pa.float64(), "BOOLEAN": pa.bool_(), "STRING": pa.string()}
    kinds = [of[c.split()[1]] for n in columns for c in REPORT.split(", ") if c.split()[0] == n]

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, overlaps = None, {}, 0
        for batch in batches:
            for k in range(batch.num_rows):
                s = batch.column("s")[k].as_py()
                if s:  # a packing's first row
                    if now:
                        yield row(now, texts, overlaps)
                    now, texts, overlaps = s, {"boundary_report": bytearray(), "overlap_report": bytearray()}, 0
                overlaps += batch.column("overlaps")[k].as_py() or 0
                for name, line in (("boundary_report", "edge"), ("overlap_report", "overlap")):
                    line = batch.column(line)[k]
                    if line.is_valid:
                        texts[name] += b"\n" if texts[name] else b""
                        texts[name] += line.as_buffer()
                        if len(texts[name]) > 2**31 - 2**20:
                            raise ValueError(f"the report of packing {now['grp']} is longer than a text can be")
        if now:
            yield row(now, texts, overlaps)

    return put_together


def _none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return iter(())


def packing_reports(circles: DataFrame, cell: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """Each packing's verdict, a line for each violation, and its radii, as texts; all columns of REPORT or some. A report is as long as its violations are many, so
    the lines of each circle are put together first, these are sorted on disk if need be, and a report is put together as they pass. Each large one has a task for
    itself, as who writes the rows holds all of a task, and an executor for itself where its cores are known, as it takes several times its bytes there."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("j", F.format_string(OVERLAP_LINE, "i", "j", "distance", "radii").alias("line")))), lambda x: x["line"])
    pairs = overlaps(circles, cell).groupBy("grp", "i").agg(F.concat_ws("\n", told).alias("overlap"), F.count("*").alias("overlaps"))
    edge = boundary_violations(circles).select("grp", F.col("idx").alias("i"), F.format_string(BOUNDARY_LINE, "idx", "x", "y", "r").alias("edge"))
    stats = _statistics(circles)
    large = sorted(r.grp for r in stats.where((F.col("n") > LARGE) & F.col("grp").isNotNull()).select("grp").collect())
    n = int(circles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.hash("grp"), F.lit(n))
    if large:
        at = F.array_position(F.lit(large).cast("array<long>"), F.col("grp").cast("long")).cast("int")
        place = F.when(at > 0, n - 1 + at).otherwise(place)
    stats = stats.select("grp", F.struct(*stats.columns, F.format_string(RADII_LINE, "min_radius", "max_radius", "mean_radius").alias("radius_stats")).alias("s"))
    rows = pairs.unionByName(edge, allowMissingColumns=True).unionByName(stats, allowMissingColumns=True)
    # The row with the statistics comes first, and a circle without an index before the others.
    rows = rows.repartitionById(n + len(large), place).sortWithinPartitions("grp", F.col("s").isNull(), "i", "edge")
    columns = columns or [c.split()[0] for c in REPORT.split(", ")]
    schema = ", ".join(c for name in columns for c in REPORT.split(", ") if c.split()[0] == name)
    profile = whole_executor(circles.sparkSession) if large else None
    out = rows.mapInArrow(_reports(columns), schema, profile=profile)
    if large:
        # What made a report is gone when it is written. The empty table's profile is that of the tasks which read the reports.
        out = out.repartitionById(n + len(large), place)
        if profile:
            out = out.union(circles.sparkSession.range(0, 0, 1, 1).mapInArrow(_none, schema, profile=profile))
    return out


def border_radius(x: Column, y: Column) -> Column:
    return F.least(x, y, 1 - x, 1 - y)


def repaired_radii(centers: DataFrame) -> DataFrame:
    """Largest radii by distance to the border, then pairs in order shrunk in proportion where they overlap; one packing is one group."""

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        r = np.minimum.reduce([x, y, 1 - x, 1 - y])
        for i in range(len(r)):
            gaps = np.hypot(x[i] - x[i + 1 :], y[i] - y[i + 1 :])
            # Radii only shrink, so pairs that don't overlap as i begins won't later on.
            for k in np.flatnonzero(r[i] + r[i + 1 :] > gaps):
                j, gap = i + 1 + k, float(gaps[k])
                if r[i] + r[j] > gap:
                    r[i], r[j] = r[i] * gap / (r[i] + r[j]), r[j] * gap / (r[i] + r[j])
        return pdf.assign(r=r)[["grp", "idx", "x", "y", "r"]]

    return centers.select("grp", "idx", "x", "y").groupBy("grp").applyInPandas(repair, "grp long, idx long, x double, y double, r double")
