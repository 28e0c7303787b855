"""Reading the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.sources.corpus import table_as_files


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; the path keeps the order of the ids, and the time is an hour after that of the id before."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    files = table_as_files(docs.select("*", F.format_string("doc/%012d", "doc_id").alias("_path")),
                           F.col("_path"), "text", F.timestamp_seconds(F.lit(FIRST_DAY) + F.col("doc_id") * 3600))
    return files


FIRST_DAY = 1704067200  # seconds since 1970
DOC_TIME = f"make_timestamp(({FIRST_DAY} + doc_id * 3600) * 1000000)"
DOC_PATH = "'doc/' || lpad(CAST(doc_id AS VARCHAR), 12, '0')"
