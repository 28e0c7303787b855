"""The corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before has kept. All but
the last return the columns of ``docs``; the last one returns the packed segments with their texts. ``run``
writes each stage's rows as Parquet in the shared folder and reads them again for the next.

Defined results: those of the operators. A text whose lines are all boilerplate held elsewhere becomes
empty and stays a row until near dedup, where equal texts are one class; empty texts give no segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import decontaminate, line_dedup, near_dedup, packing, quality
from lineweave.llm.queries import labels, table
from lineweave.session import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of ``quality.KEEP_SCORE`` or more."""
    return quality.keep_good(docs, labels(spark, sf_dir, "quality", 5, 0))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of other documents; ``n_chars``, where there, follows the text."""
    cut = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in windows of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Segments with their texts, length buckets, batches and slots."""
    return packing.pack(packing.segments(docs.select("doc_id", "text")))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

# A fitted network and hashed signatures can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
