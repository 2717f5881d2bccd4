"""Cross-site boilerplate lines, by HyperLogLog sketches of each line's sites. DataFrame functions only.

Sketches of the sites of each line hash merge by aggregation, first on the map side. A line whose
estimate is surely under the threshold stays. The occurrences of the others, near or over it, are
kept, and their sites counted exactly, so the result is exact wherever the sketch's error is within MARGIN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, row_key, stored

SITES, LEAST_CHARS, LG_K, MARGIN = 10, 20, 10, 0.2
#: Runs of these count as one blank.
BLANKS = r"[ \t\r\f\x0B]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _clean(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, BLANKS, " ")))


def near_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """rk, doc_id, site, at, h1, h2, first for the lines of docs (rk, doc_id, site, text) whose hash has about
    `sites` distinct sites or more; first is the hash's first occurrence (doc_id, rk, at)."""
    exploded = docs.select("rk", "doc_id", "site", F.posexplode(F.transform(_lines(F.col("text")), _clean)).alias("at", "line")).where((F.length("line") >= LEAST_CHARS) | F.col("line").rlike(r"[\p{L}\p{N}]"))
    lines = exploded.select("rk", "doc_id", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2"))
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc_id", "rk", "at")).alias("first"))
    near = stored(sketched.where(F.hll_sketch_estimate("sketch") >= sites * (1 - MARGIN)).select("h1", "h2", "first"))
    return stored(lines.join(near, ["h1", "h2"]))


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES, keep_first: bool = True) -> DataFrame:
    """docs with text cleaned and n_removed (lines gone) added; other columns and rows stay.

    A line goes if it stands in `sites` distinct sites or more. Lines compare lower-cased, trimmed, with
    runs of white space as one blank; those of under LEAST_CHARS characters without a letter or digit
    take no part. keep_first leaves a line's first occurrence (by doc_id, row key, position) in place,
    so no content is lost altogether. A null site counts as no site; null text stays null, n_removed 0;
    an empty text or table stays empty. Repeated rows (same doc_id and text) are one document. An
    existing column n_removed, in any case, is replaced. Other lines stay byte for byte.
    """
    require(docs, "doc_id", "text", site)
    docs = docs.drop(*(c for c in docs.columns if c.lower() == "n_removed"))
    base = docs.select(row_key("doc_id", "text").alias("_typeloom_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_typeloom_row"))
    found = near_lines(base.select(F.col("_typeloom_key").alias("rk"), "_typeloom_row.doc_id", F.col(f"_typeloom_row.`{site}`").cast("string").alias("site"), "_typeloom_row.text"), sites)
    spread = stored(found.groupBy("h1", "h2").agg(F.countDistinct("site").alias("n_sites")).where(F.col("n_sites") >= sites).select("h1", "h2"))
    hits = found.join(spread, ["h1", "h2"])
    if keep_first:
        hits = hits.where("rk <> first.rk or at <> first.at")
    gone = hits.groupBy(F.col("rk").alias("_typeloom_key")).agg(F.collect_set("at").alias("gone"))
    left = F.transform(F.array(_lines(F.col("_typeloom_row.text"))), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "gone"), lambda i: F.get(x, i)))
    cleaned = F.when(F.col("gone").isNull(), F.col("_typeloom_row.text")).otherwise(F.array_join(F.get(left, F.lit(0)), "\n"))
    return base.join(gone.hint("merge"), "_typeloom_key", "left").select(*(cleaned.alias("text") if c == "text" else F.col(f"_typeloom_row.`{c}`").alias(c) for c in docs.columns), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
