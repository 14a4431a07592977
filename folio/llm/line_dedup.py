"""Line deduplication with overlapping windows of three lines, in DataFrame functions only.

Every three consecutive non-blank lines of a document are hashed. A window that occurs more than
once, anywhere in the corpus, stays where it occurs first; the lines that its later occurrences
cover are removed, overlapping occurrences merged. "First" is the order of (doc_id, digest of the
text, position), nulls first.

Windows are hashed inside the row by array functions, so the only shuffles are of hashes and
positions: one aggregate that combines before it shuffles, one join that Spark may split where a
window is common, and one join on the document. The positions gathered of a document are bounded by
its own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3

#: The non-blank lines of a text as (i: index among all lines, l: the line).
_LINES = "filter(transform(split(__text, '\\n', -1), (l, i) -> struct(i as i, l as l)), x -> length(trim(BOTH ' \\t\\r' FROM x.l)) > 0)"


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """A row per window: doc_id, __row (digest of the text), k (index of its first non-blank line), h1, h2."""
    args = ", ".join(f"__nb[k + {j}].l" for j in range(width))
    hashed = f"transform(sequence(0, size(__nb) - {width}), k -> struct(k as k, xxhash64({args}) as h1, hash({args}) as h2))"
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
        .where(F.col("__text").isNotNull())
        .select("doc_id", F.xxhash64("__text").alias("__row"), F.expr(_LINES).alias("__nb"))
        .where(F.size("__nb") >= width)
        .select("doc_id", "__row", F.explode(F.expr(hashed)).alias("w"))
        .select("doc_id", "__row", "w.k", "w.h1", "w.h2")
    )


def later_occurrences(found: DataFrame) -> DataFrame:
    """The windows that occurred before, as (doc_id, __row, __later: their first lines in order)."""
    place = F.struct("doc_id", "__row", "k")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    later = found.join(repeated, ["h1", "h2"]).where(place > F.col("__first"))
    return later.groupBy("doc_id", "__row").agg(F.array_sort(F.collect_set("k")).alias("__later"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` with the text rewritten, plus n_lines and n_removed (non-blank lines).

    Blank lines count for no window; those between two removed lines go with them. A null text stays
    null, an empty one empty, and a document of fewer than three non-blank lines stays as it is; a
    document of which every line was seen before keeps its row with an empty text. Rows equal in id
    and text are one document: all are kept alike. A null id is a value like any other. Other columns
    pass through.
    """
    covered = later_occurrences(windows(docs, id_col, text_col, width)).select(F.col("doc_id").alias("__cid"), F.col("__row").alias("__crow"), "__later")
    base = docs.withColumn("__text", F.col(text_col)).withColumn("__row", F.xxhash64("__text"))
    joined = base.join(covered, F.col(id_col).eqNullSafe(F.col("__cid")) & (F.col("__row") == F.col("__crow")), "left").drop("__cid", "__crow", "__row")
    # Merge: a run of later windows ends where the next begins beyond what it covers.
    starts = f"filter(__later, (k, j) -> j = 0 or k - __later[j - 1] > {width})"
    ends = f"transform(filter(__later, (k, j) -> j = size(__later) - 1 or __later[j + 1] - k > {width}), k -> k + {width - 1})"
    gone = "aggregate(zip_with(__from, __to, (a, b) -> b - a + 1), 0, (s, n) -> s + n)"
    # Kept lines are the gaps between runs, each a slice of all lines.
    begin = "if(g = 0, 0, __nb[__to[g - 1]].i + 1)"
    end = "if(g = size(__from), size(__all), __nb[__from[g]].i)"
    kept = f"array_join(flatten(transform(sequence(0, size(__from)), g -> slice(__all, {begin} + 1, greatest(0, {end} - ({begin}))))), '\\n')"
    touched = joined.withColumn("__nb", F.expr(_LINES)).withColumn("__all", F.expr("if(__later is null, null, split(__text, '\\n', -1))"))
    touched = touched.withColumn("__from", F.expr(starts)).withColumn("__to", F.expr(ends))
    out = touched.withColumn("n_lines", F.when(F.col("__text").isNull(), F.lit(0)).otherwise(F.size("__nb")))
    out = out.withColumn("n_removed", F.when(F.col("__later").isNull(), F.lit(0)).otherwise(F.expr(gone)))
    out = out.withColumn(text_col, F.when(F.col("__later").isNull(), F.col("__text")).otherwise(F.expr(kept)))
    return out.drop("__text", "__later", "__nb", "__all", "__from", "__to")
