"""What a submission of several files is: its language, main file and main class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.functions.text import MAIN_CALL, MAIN_CLASS, MAIN_FILE, language_of, old_python


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def languages(files: DataFrame, by: str) -> DataFrame:
    """files: by, pos (order), name, content. (by, language) by the first file's extension; a header needs to know of C files, Python of old statements."""
    extension = F.regexp_extract(F.element_at(F.split("name", "/"), -1), r".(\.[^.]*)\z", 1)
    told = old_python(F.col("content"))
    out = files.groupBy(by).agg(
        F.min_by(extension, "pos").alias("extension"), F.coalesce(F.bool_or(F.col("name").endswith(".c")), F.lit(False)).alias("has_c"),
        F.coalesce(F.min_by(told, F.when(told.isNotNull(), F.col("pos"))), F.lit(False)).alias("is_old"),
    )
    return out.select(by, language_of(F.col("extension"), F.col("has_c"), F.col("is_old")).alias("language"))


def main_files(files: DataFrame, by: str) -> DataFrame:
    """files: by, pos, name, content, language. (by, language, main_file, main): the file named main, else the first whose text starts a program, else the first.

    main is what is asked for: a file's name where there are several and the language wants one, or a class's name.
    """
    named = _stem(F.col("name")).isin("main", "Main")
    starts = F.col("language").isin(*MAIN_CALL) & F.col("content").rlike(r" main\s*\(") | (F.col("language") == "Pascal") & F.col("content").rlike(r"\A\s*[Pp]rogram\b")
    order = F.struct(F.when(named, 0).when(F.coalesce(starts, F.lit(False)), 1).otherwise(2), "pos")
    out = files.groupBy(by).agg(F.min("language").alias("language"), F.min_by("name", order).alias("main_file"), F.count("*").alias("n"))
    base, stem = F.element_at(F.split("main_file", "/"), -1), _stem(F.col("main_file"))
    kotlin = F.concat(F.upper(F.left(stem, F.lit(1))), F.substring(stem, F.lit(2), F.length(stem)), F.lit("Kt"))
    main = F.when(F.col("language").isin(*MAIN_FILE) & (F.col("n") > 1), base).when(F.col("language") == "Kotlin", kotlin).when(F.col("language").isin(*MAIN_CLASS), stem)
    return out.select(by, "language", "main_file", main.alias("main"))
