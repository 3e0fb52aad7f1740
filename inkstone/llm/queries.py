"""The queries of the training-data operators, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import bestfit, encoding, langid, lines, middle, neighbours, packing, quality, runs, secrets, sharding, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc() % 4 == 2, F.lit(False))
    net = langid.trained(docs.filter(~held_out & F.col("lang").isNotNull()).select("text", "lang"))
    return langid.predicted(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest_columns(packing.packed(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest_columns(lines.deduplicated(table(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest_columns(sharding.sharded(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc() % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic")
    field = toxicity.trained(toxicity.sample(docs, labels))
    return toxicity.scored(docs, field).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.to_json("spans").alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scanned(table(spark, sf_dir, "documents")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest_columns(middle.transformed(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest_columns(runs.repeated(runs.planted(table(spark, sf_dir, "documents"))))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.digest_columns(bestfit.packed(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_simhash, op3_packing, op4_line_dedup, op5_bpe, op6_neighbours, op7_sharding, op8_quality, op9_toxicity, op10_secrets,
        op11_fill_middle, op12_periodic_runs, op13_best_fit,
    )}


#: Line dedup: windows of two lines and lines of 50 words, the earliest place of each kept.
LINE_DEDUP = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM split),
line AS (
  SELECT doc_id, pos, part, trim(part, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS body FROM raw),
full_line AS (
  SELECT doc_id, pos, body, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM line WHERE body <> ''),
run AS (
  SELECT doc_id, k, 2 AS n, body || chr(10) || lead(body) OVER (PARTITION BY doc_id ORDER BY k) AS body FROM full_line
  UNION ALL
  SELECT doc_id, k, 1 AS n, body FROM full_line
  WHERE len(regexp_split_to_array(body, '[ \t\r\x0b\x0c]+')) >= 50),
placed AS (
  SELECT doc_id, k, n, row_number() OVER (PARTITION BY n, body ORDER BY doc_id, k) AS place FROM run WHERE body IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM placed WHERE place > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.part, chr(10) ORDER BY l.pos) AS text
  FROM line l LEFT JOIN full_line f ON f.doc_id = l.doc_id AND f.pos = l.pos
  LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.k = f.k
  WHERE g.k IS NULL GROUP BY l.doc_id),
counts AS (
  SELECT f.doc_id, count(*) AS n_lines, count(g.k) AS n_removed
  FROM full_line f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.k = f.k GROUP BY f.doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
       sha256(coalesce(t.text, '')) AS text_sha256
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN kept t ON t.doc_id = d.doc_id
"""


#: Fill-in-middle: two cuts drawn from the id's hash, and the parts in the order of the form.
FILL_MIDDLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
number AS (
  SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn),
formed AS (
  SELECT doc_id, text, n, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM number),
part AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM part
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": LINE_DEDUP, "op11_fill_middle": FILL_MIDDLE}
