"""Sharding: proportional stratified interleaving.

Rows of each source are put into a seeded random order, each gets the fraction of its source that
lies before it, and the whole table is ordered by that fraction. Any stretch of that order holds the
sources in the mixture of the table, so cutting it into equal stretches gives shards that match it.

Positions come from counts of small ordered buckets and from ranks within a bucket: no window spans
a source, so a source with a third of all rows is dealt to many tasks. The text itself is never
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import written

#: Rows that a bucket of an order should hold, and the most buckets (a power of two) of one order.
BUCKET_ROWS, MOST_BUCKET_BITS = 512, 24


def _bits(rows: int) -> int:
    """Bits of the bucket number for an order of so many rows."""
    return min(MOST_BUCKET_BITS, max(0, (max(rows, 1) // BUCKET_ROWS).bit_length()))


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list[str | Column], out: str) -> DataFrame:
    """``df`` with ``out``: the row's rank from 0 in its group, by bucket and then by ``order``."""
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order)
    return (
        df.withColumn("__inner", F.row_number().over(inner) - 1)
        .join(starts, [*group, bucket])
        .withColumn(out, F.col("__start") + F.col("__inner"))
        .drop("__start", "__inner")
    )


def interleave(docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, source.

    Shards hold single rows, so equal texts may lie in several: a group of copies may have a third of
    all rows, and whole in one shard it would break both the law and the mixture. ``text_crc32`` with
    ``size`` names the group of equal texts.

    size is the UTF-8 bytes of the text plus 16; law is ``rows``: shard counts differ by one at most.
    A null text counts as no bytes (crc 0), a null source is a source of its own, a null id sorts
    first. Rows that agree in id, source, size and checksum are interchangeable; each has its own
    slot. An empty table gives an empty result. Other columns of the input are not read.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("__source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"))
    # The texts are read once; what is sorted from here on is some 60 bytes a row.
    base = written(base, "shard-rows")
    sizes = base.groupBy("__source").agg(F.count("*").alias("__rows"))
    total, largest = sizes.agg(F.coalesce(F.sum("__rows"), F.lit(0)), F.coalesce(F.max("__rows"), F.lit(0))).first()
    ties = ["__h", "doc_id", "size", "text_crc32"]

    # The shuffled order of each source: the top bits of the seeded hash are its buckets.
    bits = _bits(largest)
    top = F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("long")
    ranked = _ranked(base.withColumn("__bucket", top), ["__source"], "__bucket", ties, "__rank")

    # The order of all: the fraction (rank + 1/2) / rows of the source; its leading bits are the buckets.
    bits = _bits(total)
    mixed = (
        ranked.drop("__bucket")
        .join(sizes, "__source")
        .withColumn("__fraction", (F.col("__rank") + 0.5) / F.col("__rows"))
        .withColumn("__bucket", F.floor(F.col("__fraction") * (1 << bits)).cast("long"))
        .withColumn("__all", F.lit(0))
    )
    placed = _ranked(mixed, ["__all"], "__bucket", ["__fraction", "__source", *ties], "__at")
    rows = max(total, 1)
    shard = F.expr(f"(__at * {shards}L) div {rows}L")
    return (
        placed.withColumn("shard", shard)
        .withColumn("__first", F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("__at") - F.col("__first")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "source",
        )
    )
