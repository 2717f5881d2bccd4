"""Constant-length packing: documents and end tokens in one stream, cut every L tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def stream_offsets(df: DataFrame, size: str, key: str, seed: int | None = None) -> DataFrame:
    """start: tokens before each row in the stream, in the order of the key's hash.

    Rows are ranked within hash buckets and buckets by their totals (at most BUCKETS rows in the one
    task), so no task sees the whole stream.
    """
    h = F.md5(F.concat_ws(":", F.lit("" if seed is None else str(seed)), F.col(key).cast("string")))
    rows = df.withColumn("_h", h).withColumn("_bucket", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    totals = rows.groupBy("_bucket").agg(F.sum(size).alias("_n"))
    before = totals.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_bucket").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(before, "_bucket")
    return placed.withColumn("start", (F.col("_before") + F.col("_inside")).cast("long")).drop("_h", "_bucket", "_before", "_inside")


def constant_length(df: DataFrame, ids: str, key: str, length: int, end: int, seed: int | None = None, pad: bool = False) -> DataFrame:
    """chunk, input_ids, labels, attention_mask: the stream of every row's ids and `end`, `length` at a time.

    Null or empty rows are left out. The last, shorter chunk is padded with `end`, masked 0, if pad
    is given, else dropped.
    """
    rows = df.where(F.col(ids).isNotNull() & (F.size(ids) > 0)).select(key, F.concat(F.col(ids), F.array(F.lit(end))).alias("_ids"))
    placed = stream_offsets(rows.withColumn("_size", F.size("_ids").cast("long")), "_size", key, seed)
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("_size") - 1) / length)
    parts = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("chunk") * length - F.col("start"), F.lit(0))
    high = F.least((F.col("chunk") + 1) * length - F.col("start"), F.col("_size"))
    parts = parts.select("chunk", (F.col("start") + low).alias("at"), F.slice("_ids", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    chunks = parts.groupBy("chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("_own"))
    short = (F.lit(length) - F.size("_own")).cast("int")
    if not pad:
        chunks = chunks.where(F.size("_own") == length)
    return chunks.select("chunk", F.concat("_own", F.array_repeat(F.lit(end), short)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size("_own")), F.array_repeat(F.lit(0), short)).alias("attention_mask")).withColumn("labels", F.col("input_ids"))
