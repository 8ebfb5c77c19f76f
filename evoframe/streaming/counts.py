"""Incremental forms: running counts, appended results, resume without repeats, running best."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from evoframe.operators.verification import PASS

VERIFICATION = "instance LONG, solution LONG, testing LONG, result BOOLEAN, unknown_error BOOLEAN, ground BOOLEAN"


def arriving(spark: SparkSession, path: str, schema: str = VERIFICATION, files_per_trigger: int | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """A batch is bounded by files or by bytes. By files, the batches are as many as the writer had tasks, and each one goes through every partition of the state."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(path)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, in bounded memory; otherwise it is in the executors' heaps, and copied for each batch."""
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # counting looks every key up once more
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def running_counts(stream: DataFrame) -> DataFrame:
    """Passes, rows and errors of each instance as they arrive."""
    return stream.groupBy("instance").agg(F.count_if(F.expr(PASS)).alias("passed"), F.count("*").alias("n"), F.count_if("unknown_error").alias("errors"))


def without_repeats(stream: DataFrame, key: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once, also after a restart: the state is in the query's checkpoint. With an event time it is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key) if time else stream.dropDuplicates(key)


def append_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, appended to a folder of JSON; exactly once over restarts."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class RunningBest(StatefulProcessor):
    """Per key the best value so far; a row goes out when it is strictly better."""

    def init(self, handle) -> None:
        self.best = handle.getValueState("best", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        # A batch's rows come in pieces, in no order. Only those better than all before them in their piece can be better than all before them.
        kept = [self._rising(pdf[["seq", "value"]]) for pdf in rows]
        if not kept:
            return
        out = pd.concat(kept) if len(kept) > 1 else kept[0]
        best = self.best.get()[0] if self.best.exists() else None
        out = self._rising(out, best)
        if len(out):
            yield pd.DataFrame({"key": key[0], "seq": out["seq"], "value": out["value"]})
            if out["value"].notna().any():
                self.best.update((float(out["value"].max()),))

    @staticmethod
    def _rising(rows: pd.DataFrame, best: float | None = None) -> pd.DataFrame:
        """Rows greater than all in front by seq, and than best; those without a value only as long as none has one."""
        rows = rows.sort_values("seq")
        so_far = rows["value"].cummax().ffill().shift()
        if best is not None:
            so_far = so_far.fillna(best).clip(lower=best)
        return rows[so_far.isna() | (rows["value"] > so_far)]

    def close(self) -> None:
        pass


def running_best(stream: DataFrame) -> DataFrame:
    """key, seq, value: the arrivals that improve on all before them. Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(RunningBest(), "key long, seq long, value double", "Append", "None")
