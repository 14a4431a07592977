"""Markdown files and HTML files, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import native


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: doc_id (a hash of its path), path and text with line breaks as LF."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("path"), native.normalize("value").alias("text"))


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and normalised text of a table; the scan reads those two columns only."""
    return spark.read.parquet(path).select(F.col(id_col).cast("long").alias("doc_id"), native.normalize(text_col).alias("text"))


def write_relations(blocks: DataFrame, path: str, partitions: int | None = None) -> None:
    """Blocks as Parquet, clustered by document so that later joins on it prune files."""
    out = blocks.repartitionByRange(partitions, "doc_id") if partitions else blocks
    out.sortWithinPartitions("doc_id", "node_id").write.mode("overwrite").parquet(path)


def write_html(html: DataFrame, path: str) -> None:
    html.write.mode("overwrite").parquet(path)
