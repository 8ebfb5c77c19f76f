"""The corpus pipeline: quality, repeated lines, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.llm import lines, ngrams, packing, passages, quality
from evoframe.llm.common import checkpointed, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document, or above, go; so does a document of which nothing is left."""
    return _counted(docs, lines.drop_lines(docs))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngrams.drop_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document go."""
    return _counted(docs, passages.drop_passages(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in windows of tokens."""
    return packing.pack(docs)


def _counted(docs: DataFrame, out: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars")).select(*docs.columns)


STAGES = [
    ("quality", quality_classifier),
    ("lines", line_dedup),
    ("ngrams", ngram_join),
    ("passages", passage_dedup),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the join's components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
