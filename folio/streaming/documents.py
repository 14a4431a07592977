"""Structured Streaming over document folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.relations import parse_blocks, parse_inlines, render_html

PARSERS = {"blocks": parse_blocks, "inlines": parse_inlines, "html": render_html}


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parsed_stream(documents: DataFrame, relation: str = "blocks", dialect: str = "gfm") -> DataFrame:
    """The rows of a relation as documents arrive; append mode, no state, no shuffle."""
    return PARSERS[relation](documents, dialect)


def kind_counts(blocks: DataFrame, time_col: str | None = None, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Running counts of block kinds, per window of event time if the stream carries one."""
    if time_col is None:
        return blocks.groupBy("kind").agg(F.count("*").alias("n"))
    return blocks.withWatermark(time_col, late).groupBy(F.window(time_col, window), "kind").agg(F.count("*").alias("n"))


def write_stream(parsed: DataFrame, path: str, checkpoint: str):
    """Append a parsed stream to a Parquet folder, exactly once by the checkpoint."""
    return parsed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
