"""The queries opN_* and their SQL, for the entry point."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, exact_dedup, html_extract, line_templates, lm_scoring, mixing, ngram_join, packing, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.fit(docs)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.text_audio(_table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op10_every_recurring_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs, line_templates.every_recurring_line)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_secrets": op3_secrets,
    "op4_mixing": op4_mixing,
    "op5_html_extract": op5_html_extract,
    "op6_audio": op6_audio,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_line_templates": op10_line_templates,
    "op10_every_recurring_line": op10_every_recurring_line,
}

_OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id, t ORDER BY doc_id) AS i FROM d)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  coalesce(doc_id = max(doc_id) OVER (PARTITION BY t) AND i = 1, false) AS kept, sha256(t) AS text_sha256
FROM r
"""

_OP4_SQL = r"""
WITH RECURSIVE b AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS no FROM b),
d AS (SELECT *, CAST(floor(sqrt(CAST(size AS DOUBLE)) * 1024) AS BIGINT) AS root,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17:' || CAST(no AS VARCHAR)), 1, 13) AS UBIGINT) + 0.5) / 4503599627370496.0 AS u FROM o),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM s),
l AS (SELECT *, cap / w AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS everything FROM w),
m AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM l),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(lv) FROM m WHERE lv <= ratio), 0) * w) AS target FROM m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0.0, target - whole * source_size) AS rest FROM p),
h AS (SELECT source, size, root, count(*) * size AS words, CAST(root AS DECIMAL(18,0)) * CAST(count(*) * size AS DECIMAL(18,0)) AS steep FROM d WHERE size > 0 GROUP BY source, size, root),
i AS (SELECT h.*, coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_it,
    CAST(sum(steep) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS under_it FROM h),
j AS (SELECT i.source, i.size, i.root, greatest(0.0, q.rest - CAST(i.over_it AS DOUBLE)) * 1024.0 / under_it AS level FROM i JOIN q ON i.source IS NOT DISTINCT FROM q.source),
k AS (SELECT source, max_by(level, size) AS slope FROM j WHERE level * root <= 1024.0 GROUP BY source),
e AS (SELECT d.doc_id, d.no, d.size, q.source, q.source_size, q.target, q.whole, q.rest, u / (1 - u) AS odds,
    least(1.0, coalesce(k.slope, 0.0) * sqrt(CAST(size AS DOUBLE))) AS chance
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
f AS (SELECT *, CASE WHEN size > 0 AND rest > 0 THEN odds * (1 - chance) / (odds * (1 - chance) + chance) END AS rk FROM e),
g AS (SELECT *, CASE WHEN rk IS NOT NULL THEN coalesce(sum(size) OVER (PARTITION BY source, rk IS NULL ORDER BY rk, doc_id, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS reach FROM f)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN size * (whole + CASE WHEN reach + size / 2.0 <= rest THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM g
"""

_OP10_SQL = r"""
WITH RECURSIVE e AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM e),
m AS (SELECT doc_id, pos, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l),
c AS (SELECT * FROM m WHERE len(string_split(masked, ' ')) >= 4),
f AS (SELECT masked, string_split(masked, ' ') AS t, count(DISTINCT doc_id) AS docs FROM c GROUP BY masked),
v(masked, t, docs, turn, template) AS (
  SELECT masked, t, docs, 1, CASE WHEN len(list_filter(list_zip(t, string_split(head, ' ')), lambda x: x[1] = x[2])) / len(t) >= 0.6 THEN head END
  FROM (SELECT *, first_value(masked) OVER (PARTITION BY len(t), t[1:3] ORDER BY docs DESC, masked DESC) AS head FROM f)
  UNION ALL
  SELECT masked, t, docs, turn + 1, CASE WHEN len(list_filter(list_zip(t, string_split(head, ' ')), lambda x: x[1] = x[2])) / len(t) >= 0.6 THEN head END
  FROM (SELECT *, first_value(masked) OVER (PARTITION BY len(t), t[1:3 * CAST(2 ** (turn // 8) AS BIGINT)] ORDER BY docs DESC, masked DESC) AS head FROM v WHERE template IS NULL)),
j AS (SELECT c.doc_id, c.pos, v.template FROM c JOIN v ON c.masked = v.masked WHERE v.template IS NOT NULL),
o AS (SELECT template FROM j GROUP BY template HAVING count(DISTINCT doc_id) >= 4),
g AS (SELECT DISTINCT j.doc_id, j.pos FROM j JOIN o ON j.template = o.template),
d AS (SELECT doc_id, count(*) AS n_dropped FROM g GROUP BY doc_id),
r AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id)
SELECT e.doc_id, coalesce(r.text, '') AS text, CAST(len(e.parts) AS BIGINT) AS n_lines, CAST(coalesce(d.n_dropped, 0) AS BIGINT) AS n_dropped
FROM e LEFT JOIN r ON e.doc_id = r.doc_id LEFT JOIN d ON e.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op4_mixing": _OP4_SQL, "op8_exact_dedup": _OP8_SQL, "op10_line_templates": _OP10_SQL}
