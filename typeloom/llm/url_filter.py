"""URL rules by host-suffix and path-prefix expressions.

Every URL expands into expressions of each suffix of its host (at label borders) with each prefix
of its path that is as long as some rule's path. Expressions are equi-joined with the rules on a
32-bit prefix of their SHA-256 and confirmed on the full digest; the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, stored

MOST_BROADCAST, MOST_LENGTHS = 50_000, 4_096


def host_and_path(url):
    """Columns (host, path): after the first `://` up to `/?#`, A-Z lower-cased; then up to `?#`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (any columns, among them url) with host, path, rule, verdict; existing ones, in any case, are replaced.

    rules: host, path, verdict. A rule fits its host and all subdomains where the path starts with the
    rule's. The longest host + path wins, then the longer host, then `block`. No rule: rule null and
    the default. A null url or one without `://` has an empty host and path, which only a rule with an empty
    host and path would fit. Repeated rows stay; null fields of rules make a rule void. Rules are
    broadcast if there are at most MOST_BROADCAST of them, else shuffled. Paths are cut at the lengths
    that rules' paths have; if those are more than MOST_LENGTHS, at every length.
    """
    require(pages, "url")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("url"))
    rules = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct()
    table = stored(rules.select(F.concat("host", "path").alias("rule"), (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.length("path").alias("cut"), "verdict", _digest(F.col("host"), F.col("path")).alias("digest")).withColumn("short", F.substring("digest", 1, 8)))
    lengths = [r.cut for r in table.select("cut").distinct().limit(MOST_LENGTHS + 1).collect()]
    few = table.count() <= MOST_BROADCAST
    # The page's own columns stay in one struct, so no name of theirs meets one of the join's.
    pages = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("page"), host.alias("host"), path.alias("path"))
    places = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if len(lengths) > MOST_LENGTHS:
        wanted = F.sequence(F.lit(0), F.length("path"))  # every prefix
    else:
        wanted = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    expanded = places.select("host", "path", F.explode(suffixes).alias("suffix"), wanted.alias("cuts")).select("host", "path", "suffix", F.explode("cuts").alias("cut")).select("host", "path", _digest(F.col("suffix"), F.expr("substring(path, 1, cut)")).alias("full")).withColumn("short", F.substring("full", 1, 8))
    matched = expanded.join(F.broadcast(table) if few else table, "short").where("full = digest")
    best = matched.groupBy("host", "path").agg(F.max(F.struct("size", "host_size", (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    return pages.join(best, ["host", "path"], "left").select(*(F.col(f"page.`{c}`").alias(c) for c in kept), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
