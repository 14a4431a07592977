"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, jaccard_join, language, line_dedup, minhash, packing, pii, sharding, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(_table(spark, sf_dir, "documents"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the operator: near-duplicate classes from the signatures' bands."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), percent=90, k=3)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "text")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"), fold=2, folds=4)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_table(spark, sf_dir, "documents"), shards=40)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold=0, folds=5)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_roundtrip(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op1_near_duplicates": op1_near_duplicates,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_language": op5_language,
    "op6_sharding": op6_sharding,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
}

#: op4: windows are compared as the lines themselves; the order of occurrences is (doc_id, position), ids being unique.
_OP4_SQL = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), nb AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k
  FROM l WHERE length(trim(line, ' ' || chr(9) || chr(13))) > 0
), w AS (
  SELECT * FROM (SELECT doc_id, k, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM nb WINDOW d AS (PARTITION BY doc_id ORDER BY k))
  WHERE c IS NOT NULL
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS n FROM w) WHERE n > 1
), gone AS (
  SELECT DISTINCT later.doc_id, later.k + j AS k FROM later CROSS JOIN (SELECT unnest([0, 1, 2]) AS j)
), marked AS (
  SELECT l.doc_id, l.i, l.line, nb.k, gone.k IS NOT NULL AS out,
         coalesce(max(CASE WHEN nb.k IS NOT NULL THEN nb.k END) OVER (PARTITION BY l.doc_id ORDER BY l.i), -1) AS before
  FROM l LEFT JOIN nb USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = nb.k
), kept AS (
  SELECT m.doc_id, m.i, m.line FROM marked m
  LEFT JOIN gone g1 ON g1.doc_id = m.doc_id AND g1.k = m.before
  LEFT JOIN gone g2 ON g2.doc_id = m.doc_id AND g2.k = m.before + 1
  WHERE NOT m.out AND NOT (m.k IS NULL AND g1.k IS NOT NULL AND g2.k IS NOT NULL)
), done AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce((SELECT count(*) FROM nb WHERE nb.doc_id = d.doc_id), 0)::BIGINT AS n_lines,
       coalesce((SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id), 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(done.text, '') END AS text
FROM documents d LEFT JOIN done ON done.doc_id = d.doc_id
"""

#: op2: shingles as strings; components by a recursive walk over the links.
_OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	

]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b, i = x.n AND i = y.n AS same FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), d.doc_id)) AS component_id,
       least(d.doc_id, coalesce((SELECT min(a) FROM links WHERE links.b = d.doc_id AND same), d.doc_id)) AS class_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: op10: base32 from the hexadecimal digest, five bits a letter.
_OP10_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda j: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', hex[j])]), '') AS bits FROM d),
e AS (SELECT page_id, size, hex, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT + 4 * bits[5*i+3]::INT + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT]), '') AS digest,
  min(page_id) OVER (PARTITION BY hex) AS first FROM b)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM e
"""

ORACLES: dict[str, str] = {"op2_jaccard_join": _OP2_SQL, "op4_line_dedup": _OP4_SQL, "op10_warc": _OP10_SQL}
