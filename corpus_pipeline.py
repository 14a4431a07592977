"""The corpus pipeline: documents through five stages, each written and read again.

Stages take (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, jaccard_join, language, line_dedup, packing
from folio.llm.common import row_key, scratch, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: no text, no letter, or too far from every language.

    Each row is judged by its own text, also where ids repeat or are null. Null texts, empty ones and
    those without a letter go; if no row has a language to learn from, so do all. An empty table stays empty.
    """
    keyed = docs.withColumn("__row", row_key())
    return without(keyed, language.identify(keyed, key_col="__row").where("rejected").select("__row"), "__row").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows. Documents stay, even if empty.

    The first occurrence is that of the least id (null first), then of the text's digest. Rows equal in
    id and text are one document and kept alike; null texts stay null, with n_chars 0.
    """
    done = line_dedup.line_dedup(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that the Jaccard join connects (five-word shingles, 0.8 or more), one row stays, of the least id.

    A null id comes first, ties fall by a key of id and text, rows equal in both by all columns. Null
    and empty texts and those without words connect with nothing: all their rows stay. An empty table stays empty.
    """
    return jaccard_join.one_of_each(docs, percent=80, k=5).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each judged by its own text, also where ids repeat or are null.

    Null and empty texts hold no item and stay; of an empty table nothing is left.
    """
    keyed = docs.withColumn("__row", row_key())
    return decontaminate.without_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__row").select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of 2048 tokens: a row per piece, not per document.

    A null or empty text is one piece of the end id; rows that repeat an id or a text are packed each
    by itself; which of equal lengths stands where is settled by a hash. An empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


#: Tokens, trained centroids and the search for a packing have no SQL form; the stages are tested one by one.
ORACLE_SQL = None
