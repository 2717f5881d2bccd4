"""Corpus filters, sampling, shuffles and splits over source files, as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, parse_date

# Text that marks .ts files in other formats; lines that need other files; thresholds.
NOT_TYPESCRIPT = ("<!DOCTYPE TS>", "GOCAD TSurf", "@problemName")
IMPORTS = r"^\s*import(\*|\{|\s)"
REQUIRES = r"^.*\s+require\s*\(.+\)"
EXPORTS = r"^export[^\w_$]"
EXPORTS_OWN = r"^export[^\w_$]\s*(function|class|interface|type|enum|const|declare|default|async)"
THRESHOLDS = {
    "annotation_sites": "annotation_sites > 0",
    "type_definitions": "type_definitions > 0",
    "loc": "loc >= 50",
    "functions": "functions > 0",
    "loc_per_function": "loc_per_function >= 5",
    "estimated_tokens": "estimated_tokens <= 4096",
}
DATES = ("max_stars_repo_stars_event_min_datetime", "max_forks_repo_forks_event_min_datetime", "max_issues_repo_issues_event_min_datetime")
CUTOFF = "2021-12-31"


def lacks(content: Column, marks: Iterable[str]) -> Column:
    """None of the substrings occurs."""
    out = F.lit(True)
    for mark in marks:
        out &= ~F.contains(content, F.lit(mark))
    return out


def is_typescript(ext: Column, content: Column) -> Column:
    return (ext == "ts") & lacks(content, NOT_TYPESCRIPT)


def needs_other_files(line: Column) -> Column:
    """Whether a line imports, requires or exports what it doesn't define itself (Unicode white space and word characters)."""
    like = lambda pattern: line.rlike("(?U)" + pattern)
    return like(IMPORTS) | like(REQUIRES) | (like(EXPORTS) & ~like(EXPORTS_OWN))


def self_contained(content: Column, rejected: Callable[[Column], Column] = needs_other_files) -> Column:
    """No line is rejected."""
    return ~F.exists(lines(content), rejected)


def threshold_filters(df: DataFrame, names: Iterable[str], known: dict[str, str] = THRESHOLDS) -> DataFrame:
    for name in names:
        if name not in known:
            raise ValueError(f"no filter is named {name}; there are {', '.join(known)}")
        df = df.filter(known[name])
    return df


def sizes_after(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """(step, name, size): rows left after each filter in turn, counted in one pass."""
    kept, sums = F.lit(True), [F.count("*").alias("n0")]
    for i, condition in enumerate(filters.values(), 1):
        kept = kept & F.expr(condition)
        sums.append(F.count_if(kept).alias(f"n{i}"))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"n{i}").alias("size")) for i, name in enumerate(["all", *filters])]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def after_cutoff(dates: Iterable[Column], cutoff: Column) -> Column:
    """Every known date is later than the cutoff, and one is known."""
    return F.coalesce(F.least(*dates) > cutoff, F.lit(False))


def created_after(df: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    return df.filter(after_cutoff([parse_date(F.col(d)) for d in DATES], F.lit(cutoff).cast("timestamp")))


def hash_order(key: str, seed: int) -> Column:
    """An order that depends on the seed and the key alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement: those with the smallest hashes, so partitioning changes nothing."""
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def sample_percent(df: DataFrame, percent: float, key: str, seed: int = 0) -> DataFrame:
    """round(percent / 100 of the rows) rows, halves to even."""
    return sample_exact(df, round(df.count() * (percent / 100)), key, seed)


def sample(df: DataFrame, size: str, key: str, seed: int = 0) -> DataFrame:
    """A sample of a size as one writes it: `250` rows or `2.5%` of them."""
    return sample_percent(df, float(size.rstrip("%")), key, seed) if size.endswith("%") else sample_exact(df, int(size), key, seed)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).drop("_h")


def take_and_skip(df: DataFrame, n: int, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first n rows of the shuffled table and the others."""
    first = sample_exact(df, n, key, seed)
    return first, df.join(first.select(key), key, "left_anti")


def predefined_split(df: DataFrame, column: str = "split") -> dict[str, DataFrame]:
    return {name: df.filter(F.col(column) == name) for name in ("train", "test")}


def partition_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy it, the others); unknown counts as no."""
    yes = F.coalesce(predicate, F.lit(False))
    return df.filter(yes), df.filter(~yes)


def with_name(df: DataFrame) -> DataFrame:
    """name = repo/path where the table has these columns; else as it is."""
    if {"max_stars_repo_name", "max_stars_repo_path"} <= set(df.columns):
        return df.withColumn("name", F.concat_ws("/", "max_stars_repo_name", "max_stars_repo_path"))
    return df


def replace_by_key(df: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """column taken from new by keys; rows without a new value keep a NULL."""
    return df.drop(column).join(new.select(*keys, column), keys, "left")


def exploded(df: DataFrame, keys: list[str], column: str, index: str, value: str) -> DataFrame:
    """keys, index (from 0), value, and how many there are as num_<value>s: the entries of an array column."""
    return df.select(*keys, F.size(column).cast("long").alias(f"num_{value}s"), F.posexplode(column).alias(index, value)).withColumn(index, F.col(index).cast("long"))


def gathered(df: DataFrame, keys: list[str], index: str, value: str, column: str) -> DataFrame:
    """keys, column: the values of each key as an array in the order of the index, however the rows came."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda x: x[value]).alias(column))
