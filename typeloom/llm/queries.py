"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, language_id, line_dedup, lm_scoring, media, mixing, near_dedup, packing, substring_dedup, url_filter

TOKENIZER = "word_bpe_49k.json"
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_spans(_table(spark, sf_dir, "documents"), passage=substring_dedup.PASSAGE)
    return found.withColumn("changed", F.col("n_removed") > 0)


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    samples = language_id.learn(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), samples).drop("text")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, numerator=80).drop("rk")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page of its own: a paragraph a line, and after the first its payload as a captioned figure."""
    docs = _table(spark, sf_dir, "documents")
    payload = media.padded(F.col("text"))
    digest = F.sha2(payload, 256)
    store = media.media_table(docs.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload"))
    escaped = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    shown = F.transform(F.split(escaped(F.col("text")), "\n", -1), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    figure = F.concat(F.lit(f'<figure><img src="{media.SCHEME}'), digest, F.lit('"><figcaption>'), F.format_string("%d characters in %d lines", F.coalesce(F.length("text"), F.lit(0)), F.size(shown)), F.lit("</figcaption></figure>"))
    html = F.concat(F.lit("<article>"), F.array_join(F.concat(F.slice(shown, 1, 1), F.array(figure), F.slice(shown, 2, 2**31 - 1)), ""), F.lit("</article>"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    items = media.interleaved(docs.select("doc_id", html.alias("html"), size.alias("n_bytes")), store, "doc_id", "n_bytes", kinds=("media",))
    return items.select("doc_id", "n_bytes", F.col("n_samples").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.score_words(_table(spark, sf_dir, "documents"), good)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_substring_dedup, op3_lsh_forest, op4_line_dedup, op5_language_id, op6_near_dedup, op7_url_filter, op8_media_columns, op9_packing, op10_lm_scoring)}


# One segment: plain earliest deadline first over all slots, as long as there are no more of them than mixing.SEGMENT.
_OP1 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT source, count(*) AS n_rows, sqrt(count(*)) AS weight FROM d GROUP BY 1),
f AS (SELECT *, CAST(floor(weight / max(weight) OVER () * power(2, 50)) AS HUGEINT) AS f,
  bool_and(weight = floor(weight)) OVER () AND sum(weight) OVER () <= 2147483648 AND min(weight) OVER () * 1048576 >= sum(weight) OVER () AS exact FROM w),
g AS (SELECT source, (n_rows + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} AS n, CASE WHEN exact THEN CAST(weight AS BIGINT) ELSE CAST(greatest(f * 2147483648 // sum(f) OVER (), 2048) AS BIGINT) END AS q FROM f),
plan AS (SELECT *, CAST(sum(q) OVER () AS BIGINT) AS whole FROM g),
ordered AS (SELECT list(source ORDER BY source) AS names, list(q ORDER BY source) AS qs, max(whole) AS whole, least(4 * sum(n), max(n * whole // q + 1)) AS until FROM plan),
sim AS (
  SELECT CAST(0 AS BIGINT) AS slot, names, qs, whole, until, list_transform(qs, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM ordered WHERE len(names) > 0
  UNION ALL
  SELECT slot + 1, names, qs, whole, until, list_transform(done, lambda x, i: x + CASE WHEN i = best THEN 1 ELSE 0 END), best
  FROM (SELECT *, list_position(due, list_min(due)) AS best
        FROM (SELECT *, list_transform(qs, lambda x, i: CASE WHEN done[i] * whole // x <= slot THEN ((done[i] + 1) * whole + x - 1) // x ELSE 4611686018427387904 END) AS due
              FROM sim WHERE slot < until))),
times AS (SELECT names[pick] AS source, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM sim WHERE slot > 0),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS i FROM d),
blocks AS (SELECT ranked.*, i // {mixing.BLOCK_ROWS} AS block, q, whole FROM ranked JOIN plan USING (source))
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(block * whole // q AS BIGINT) AS release,
  CAST(((block + 1) * whole + q - 1) // q AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot,
  CAST(slot * {mixing.BLOCK_ROWS} + i % {mixing.BLOCK_ROWS} AS BIGINT) AS place
FROM blocks JOIN times USING (source, block)
"""

_OP4 = f"""
WITH x AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l AS (SELECT doc_id, source, raw, pos, lower(trim(regexp_replace(raw, '[ \\t\\r\\f\\x0B]+', ' ', 'g'))) AS line FROM x),
s AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE length(line) >= {line_dedup.LEAST_CHARS} OR regexp_matches(line, '[\\p{{L}}\\p{{N}}]') GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.SITES}),
g AS (SELECT l.doc_id, l.raw, l.pos, s.first IS NOT NULL AND s.first <> (l.doc_id, l.pos) AS gone FROM l LEFT JOIN s ON l.line = s.line),
t AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed FROM g GROUP BY 1)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE t.text END AS text, coalesce(t.n_removed, 0) AS n_removed FROM documents d LEFT JOIN t USING (doc_id)
"""

_OP7 = """
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.*, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS r
      FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE r = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1, "op4_line_dedup": _OP4, "op7_url_filter": _OP7}
