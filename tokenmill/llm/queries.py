"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.session import table


def label_weights(labels: DataFrame) -> DataFrame:
    """Sampling weights from quality labels: 2 for good, 0.5 for poor; unlabelled documents have 1 (see mix)."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.automaton import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.vectors import search

    return search(table(spark, sf_dir, "embeddings"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.suffix_dedup import suffix_dedup

    d = suffix_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.runlog import substring_dedup

    d = substring_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenmill.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    found = (op1_mix, op2_simhash, op3_automaton, op4_vectors, op5_suffix, op6_language, op7_html, op8_toxicity, op9_runlog, op10_warc)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END)::DOUBLE AS w FROM labels GROUP BY doc_id),
d AS (
  SELECT documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(w, 1.0)::DOUBLE AS w
  FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((rank - 1) % 3 + 1)::INT] AS ratio, source_size * 2.0::DOUBLE AS most FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0)) / (sum(ratio) OVER () - coalesce(sum(ratio) OVER w, 0)) AS level
  FROM r WINDOW w AS (ORDER BY most / ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS reached FROM l WHERE most / ratio >= level ORDER BY most / ratio, rank LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT reached FROM f), most / ratio) * ratio)::DOUBLE AS target FROM l),
k AS (
  SELECT doc_id, size, source_size, target, d.source,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS epochs FROM k)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(size, greatest(0, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken, epochs
FROM p
"""


OP3_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM l)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
o AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT r, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM l) s)),
m AS (SELECT r, p, o.n, item_id FROM o JOIN g ON o.n = g.n AND o.gram = g.gram),
h AS (SELECT r, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
k AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN k ON d.r = k.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op3_automaton": OP3_SQL}
