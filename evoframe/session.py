"""Session settings, and this package's code on the executors."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("evoframe")
    if master:
        builder = builder.master(master)
    spark = builder.config(map=CONF | conf).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_evoframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="evoframe-")) / "evoframe.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._evoframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder in the shared place that the cluster names; a temporary one only where it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="evoframe-"))
    return sc.getCheckpointDir()


def whole_executor(spark: SparkSession) -> ResourceProfile | None:
    """A profile whose tasks take all cores of an executor; None where these aren't known, or tasks can't have profiles."""
    conf = spark.sparkContext.getConf()
    few = re.fullmatch(r"local-cluster\[\s*\d+\s*,\s*(\d+)\s*,.*", spark.sparkContext.master)
    cores = int(few[1]) if few else int(conf.get("spark.executor.cores", "0"))
    if cores < 2 or not few and spark.sparkContext.master.startswith("local"):
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build


def kept(df: DataFrame) -> DataFrame:
    """The rows as they are now, written once: what two plans would compute in two ways is the same for both."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
