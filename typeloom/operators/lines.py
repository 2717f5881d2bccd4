"""Line-shaped operators: marked sections, log records, type errors by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines

# The marker of a file in a bundle, and the head of a type error.
FILE_MARK = r"^// FILE: (\S+)$"
ERROR_HEAD = r"^(.*\.ts)\((\d+),\d+\):"


def numbered(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, pos (from 1), line for every line of the text."""
    return df.select(*keys, F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def fill_forward(df: DataFrame, value: Column, keys: list[str], order: str, default: Column, name: str) -> DataFrame:
    """name: the latest known value so far within the keys, or the default."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(window), default))


def sessions(df: DataFrame, header: Column, keys: list[str], order: str, name: str = "record") -> DataFrame:
    """name: how many headers have come so far; 0 before the first one."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.when(header, 1).otherwise(0)).over(window).cast("long"))


def _mark(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, FILE_MARK, 1), F.lit(""))


def split_files(df: DataFrame, keys: list[str], text: str = "content", default: str = "name") -> DataFrame:
    """keys, file, content: the files of a bundle; a marker line belongs to its file, a repeated marker
    goes on with it, lines before the first belong to the default. Empty text has no files."""
    rows = numbered(df.select(*keys, text, F.col(default).alias("_default")), text, [*keys, "_default"])
    filled = fill_forward(rows, _mark(F.col("line")), keys, "pos", F.col("_default"), "file")
    return filled.groupBy(*keys, "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))


def lines_to_file(df: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """keys, line_no, file: the file of every line, '' where no marker has come.

    Line 0 has ''; one past the last line has the last file, as errors may point there.
    """
    padded = F.concat(F.array(F.lit("")), lines(F.col(text)), F.array(F.lit("")))
    rows = df.select(*keys, F.posexplode(padded).alias("line_no", "line"))
    return fill_forward(rows, _mark(F.col("line")), keys, "line_no", F.lit(""), "file").select(*keys, "line_no", "file")


def split_log(df: DataFrame, keys: list[str], text: str = "tsc_logs") -> DataFrame:
    """keys, record, error, orphan: a header and the lines after it; lines before the first header are one
    orphan record."""
    rows = sessions(numbered(df, text, keys), F.col("line").rlike(ERROR_HEAD), keys, "pos")
    grouped = rows.groupBy(*keys, "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("error"))
    return grouped.withColumn("orphan", F.col("record") == 0)


def split_errors(df: DataFrame, keys: list[str], name: str = "name", output: str = "output", log: str = "tsc_logs") -> DataFrame:
    """keys, file, errors, all_errors: the errors of each file of a bundled output, [] for files without any.

    Errors are whole records, a header and its continuation lines. Without markers all of them belong to the name. With
    markers, records that mention node_modules and lines before the first header are dropped, and each
    error goes to the file its line number lies in; one that no file owns goes to the
    name, where a later one replaces an earlier (all_errors has them all).
    """
    base = df.select(*keys, F.col(name).alias("_name"), F.col(output).alias("_output"), F.col(log).alias("_log"))
    base = base.withColumn("_marked", F.exists(lines(F.col("_output")), lambda x: x.rlike(FILE_MARK)))
    owners = lines_to_file(base.where("_marked"), keys, "_output")
    records = split_log(base, keys, "_log").join(base.select(*keys, "_name", "_marked"), keys)
    counted = records.where(~F.col("_marked") | ~(F.col("orphan") | F.contains("error", F.lit("node_modules"))))
    placed = counted.withColumn("line_no", F.when(F.col("_marked"), F.regexp_extract("error", ERROR_HEAD, 2).try_cast("int"))).join(owners, [*keys, "line_no"], "left")
    known = F.when(F.col("_marked"), F.coalesce(F.col("file") != "", F.lit(False))).otherwise(True)
    placed = placed.withColumn("known", known).withColumn("file", F.when(F.col("_marked") & F.col("known"), F.col("file")).otherwise(F.col("_name")))
    grouped = placed.groupBy(*keys, "file").agg(F.array_sort(F.collect_list(F.struct("record", "error", "known"))).alias("r"))
    every = F.transform("r", lambda x: x["error"])
    left = F.when(F.element_at("r", -1)["known"], F.transform(F.filter("r", lambda x: x["known"]), lambda x: x["error"])).otherwise(F.slice(every, -1, 1))
    found = grouped.select(*keys, "file", left.alias("errors"), every.alias("all_errors"))
    files = owners.where("file <> ''").select(*keys, "file").union(base.where("not _marked").select(*keys, "_name")).distinct()
    none = F.array().cast("array<string>")
    return files.join(found, [*keys, "file"], "full_outer").select(*keys, "file", F.coalesce("errors", none).alias("errors"), F.coalesce("all_errors", none).alias("all_errors"))


def merge_files(files: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """Output files and error files over the union of their names; no content is '', no errors []."""
    return files.join(errors, [*keys, "file"], "full_outer").withColumn("content", F.coalesce("content", F.lit(""))).withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
