"""Readers and writers: JSON directories, event logs, artifacts, checkpoints, results."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from evoframe.functions.text import safe_file_name

PROGRAMS = (
    "id STRING, code STRING, language STRING, parent_id STRING, generation INT, ts DOUBLE, iteration_found INT, metrics MAP<STRING,DOUBLE>, "
    "metrics_text MAP<STRING,STRING>, metadata MAP<STRING,STRING>, artifacts_json STRING, artifact_dir STRING"
)
STATE = (
    "feature_map MAP<STRING,STRING>, islands ARRAY<ARRAY<STRING>>, archive ARRAY<STRING>, best_program_id STRING, last_iteration INT, "
    "current_island INT, island_generations ARRAY<INT>, last_migration_generation INT"
)


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    """value as JSON; what doesn't parse is left out."""
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select(parsed.alias("j")).where("j is not null and j._bad is null").select("j.*").drop("_bad")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that don't parse are left out."""
    return _parsed(spark.read.text(path), schema)


#: Files of a folder are read by tasks of at most so many bytes, or of so many of Spark's own shares of small files.
TASK_BYTES, SHARES = 64 * 2**20, 16


def _few_tasks(files: DataFrame, out: DataFrame) -> DataFrame:
    """out, made of a folder's files row by row, in larger tasks: Spark counts a file as 4 MB at least, so a task has 32 small files, which take less time than its start."""
    plan = files._jdf.queryExecution()
    shares, size = plan.toRdd().getNumPartitions(), int(str(plan.optimizedPlan().stats().sizeInBytes()))
    n = max(files.sparkSession.sparkContext.defaultParallelism, -(-shares // SHARES), -(-size // TASK_BYTES))
    return out.coalesce(n) if n < shares else out


def read_json_dir(spark: SparkSession, path: str, schema: str = PROGRAMS, compressed: bool = False) -> DataFrame:
    """One JSON document a file; files that don't parse are left out. compressed: some of them are, which their ending tells; that reader is slow to open a file."""
    files = spark.read.text(path, wholetext=True) if compressed else spark.read.format("binaryFile").load(path)
    text = files if compressed else files.select(F.col("content").cast("string").alias("value"))
    return _few_tasks(files, _parsed(text, schema))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A checkpoint's state with defaults; island generations that don't match the islands start again at zero."""
    s = spark.read.schema(STATE).option("multiLine", True).json(path)
    islands = F.coalesce("islands", F.array().cast("array<array<string>>"))
    generations = F.coalesce("island_generations", F.array().cast("array<int>"))
    return s.select(
        F.coalesce("feature_map", F.create_map().cast("map<string,string>")).alias("feature_map"), islands.alias("islands"),
        F.coalesce("archive", F.array().cast("array<string>")).alias("archive"), "best_program_id",
        F.coalesce("last_iteration", F.lit(0)).alias("last_iteration"), F.coalesce("current_island", F.lit(0)).alias("current_island"),
        F.when(F.size(generations) == F.size(islands), generations).otherwise(F.array_repeat(F.lit(0), F.size(islands))).alias("island_generations"),
        F.coalesce("last_migration_generation", F.lit(0)).alias("last_migration_generation"),
    )


def read_event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files 0.json, 1.json, ... with their number as seq; a missing folder is an empty log."""
    with_name = f"{schema}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{with_name}, seq LONG")
    rows = spark.read.schema(with_name).option("multiLine", True).json(path)
    return rows.withColumn("seq", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).try_cast("long")).where("seq is not null")


def read_event_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Folders of event logs, with the folder's name as log."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    seq = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).try_cast("long")
    return _few_tasks(rows, rows.withColumns({"seq": seq, "log": F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)}).where("seq is not null"))


def write_files(rows: DataFrame, path: str, mode: int | None = None) -> None:
    """name, content (binary): a file under the path for each row with both, written by the executors into a folder that all of them share. mode: for file systems that have modes."""

    def write(part: Iterator[Row]) -> None:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path)
        made = set()
        for name, content in part:
            at = f"{root}/{name}"
            folder = at.rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(at) as out:
                out.write(content)
            if mode is not None and fs.type_name == "local":
                os.chmod(at, mode)

    rows.select("name", "content").where("name is not null and content is not null").foreachPartition(write)


def read_templates(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """(name, text): *.txt files override the defaults."""
    base = spark.createDataFrame(list(defaults.items()), "name STRING, text STRING")
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"), F.col("value").alias("own"))
    return base.join(files, "name", "full").select("name", F.coalesce("own", "text").alias("text"))


def latest_by_number(paths: DataFrame) -> DataFrame:
    """path: the one with the greatest number at its end."""
    number = F.regexp_extract("path", r"_(\d+)/?$", 1).try_cast("long")
    return paths.where(number.isNotNull()).agg(F.max_by("path", number).alias("path"))


def latest_by_time(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The folder whose file of that name was written last, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.agg(F.max_by(F.regexp_replace("path", r"/[^/]+$", ""), F.struct("modificationTime", "path")).alias("path"))


#: Files of a folder of artifacts, names that are dealt out together, and bytes of artifacts in a batch.
FOLDER_FILES, NAMES, BATCH_BYTES = 10_000, 200, 4 * 2**20


def write_artifacts(rows: DataFrame, path: str) -> list[str]:
    """name, content (binary): a file for each row with both, as it is, in folders under the path; gives the folders. A task writes folders of its own, of so many files
    at most, and a repeated name goes into the next one. Folders of tasks that were run again aren't among those given."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(path)
        own, made, names = TaskContext.get().taskAttemptId(), 0, set()
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                name = name.as_py()
                if not made or len(names) == FOLDER_FILES or name in names:
                    fs.create_dir(f"{root}/{own}/{made}", recursive=True)
                    yield pa.RecordBatch.from_pydict({"folder": [f"{path}/{own}/{made}"]})
                    made, names = made + 1, set()
                names.add(name)
                with fs.open_output_stream(f"{root}/{own}/{made - 1}/{name}", compression=None) as out:
                    out.write(content.as_buffer())

    there = rows.select("name", "content").where("name is not null and content is not null")
    return sorted(r.folder for r in there.mapInArrow(write, "folder string").collect())


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of folders' files, some to a row."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            fs, root = FileSystem.from_uri(folder)
            names = [f.base_name for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File]
            for at in range(0, len(names), NAMES):
                yield pa.RecordBatch.from_pydict({"folder": [folder], "names": pa.array([names[at : at + NAMES]], pa.list_(pa.string()))})


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSystem

    names, contents, size = [], [], 0
    packed = lambda: pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "content": pa.array(contents, pa.binary())})
    for batch in batches:
        for row in batch.to_pylist():
            fs, root = FileSystem.from_uri(row["folder"])
            for name in row["names"]:
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    content = f.read()
                if names and size + len(content) > BATCH_BYTES:
                    yield packed()
                    names, contents, size = [], [], 0
                names.append(name)
                contents.append(content)
                size += len(content)
    if names:
        yield packed()


def read_artifacts(spark: SparkSession, *folders: str) -> DataFrame:
    """(name, text, bytes, size) of each file: text where the content is UTF-8, else bytes. Tasks list the folders, each of which is one task's, and read the files."""
    n = max(spark.sparkContext.defaultParallelism, len(folders))
    listed = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(n).mapInArrow(_listed, "folder string, names array<string>")
    files = listed.repartition(n).mapInArrow(_contents, "name string, content binary")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("name", text.alias("text"), F.when(text.isNull(), F.col("content")).alias("bytes"), F.octet_length("content").cast("long").alias("size"))


def routed(artifacts: DataFrame, threshold: int = 32 * 1024) -> DataFrame:
    """artifacts: program_id, key, content (binary). route is inline up to the threshold in bytes, else file; file_name is safe to write."""
    size = F.octet_length("content")
    return artifacts.withColumns({"size": size.cast("long"), "route": F.when(size <= threshold, "inline").otherwise("file"), "file_name": safe_file_name(F.col("key"))})


def artifact_sizes(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("program_id").agg(F.sum(F.octet_length("content").cast("long")).alias("total"), F.count("*").alias("n"))


def inline_json(artifacts: DataFrame) -> DataFrame:
    """One JSON map a program: text as it is, bytes as base64 under a marker."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    value = F.coalesce(text, F.to_json(F.struct(F.base64("content").alias("__bytes__"))))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", value.alias("value")))))
    return artifacts.groupBy("program_id").agg(F.to_json(entries).alias("artifacts_json"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_results(df: DataFrame, path: str, by: str) -> None:
    """A folder of JSON for each value, compressed: names and flags repeat in every line, and take many times their input. Readers see it by the files' ending."""
    df.write.mode("overwrite").partitionBy(by).option("compression", "gzip").json(path)


@dataclass(frozen=True)
class Checkpoint:
    """Programs, state and best program of one iteration under base/checkpoint_<iteration>/."""

    base: str
    iteration: int
    options: dict[str, str] = field(default_factory=dict)

    @property
    def path(self) -> str:
        return f"{self.base}/checkpoint_{self.iteration}"

    def write(self, programs: DataFrame, state: DataFrame, best: DataFrame) -> None:
        programs.write.mode("overwrite").options(**self.options).parquet(f"{self.path}/programs")
        state.write.mode("overwrite").json(f"{self.path}/state")
        best.write.mode("overwrite").json(f"{self.path}/best")

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.read.parquet(f"{self.path}/programs"), read_state(spark, f"{self.path}/state")


def latest_checkpoint(spark: SparkSession, base: str) -> int | None:
    """The greatest number among base/checkpoint_<number>; None without one. Folders are listed by name only, through Spark's file systems."""
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbers = [int(n.rpartition("_")[2]) for n in names if n.startswith("checkpoint_") and n.rpartition("_")[2].isdigit()]
    return max(numbers, default=None)


def write_programs(programs: DataFrame, path: str) -> None:
    """One JSON file for each program, named by its id."""
    name = F.concat(safe_file_name(F.col("id").cast("string")), F.lit(".json"))
    write_files(programs.select(name.alias("name"), F.to_json(F.struct(*programs.columns)).cast("binary").alias("content")), path)


def write_json_document(rows: DataFrame, path: str, name: str) -> None:
    """All rows as one JSON array in one file, in the order of their columns; for summaries, which are few rows."""
    document = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).cast("binary").alias("content"))
    write_files(document.select(F.lit(name).alias("name"), "content"), path)


def write_matrix(rows: DataFrame, path: str) -> None:
    """Dense rows, as arrays in Parquet: read by column, and by part, where a dump of numbers would be read whole."""
    rows.write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_scripts(rows: DataFrame, path: str) -> None:
    """name, text: script files with plain line ends, which their owner may run where the file system keeps modes."""
    write_files(rows.select("name", F.replace("text", F.lit("\r\n"), F.lit("\n")).cast("binary").alias("content")), path, mode=0o755)
