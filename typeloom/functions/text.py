"""Text functions on columns: lines, clipping, slices, prompts, dates and number formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a line besides \\r\\n, and the prompts' markers.
LINE_ENDS = "\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029"
COMMIT_BEFORE, COMMIT_MSG, COMMIT_AFTER = "<commit_before>", "<commit_msg>", "<commit_after>"
FIM_PREFIX, FIM_MIDDLE, FIM_SUFFIX = "<fim_prefix>", "<fim_middle>", "<fim_suffix>"
DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def lines(text: Column) -> Column:
    """Lines without their ends, by every Unicode line end; no empty line after the last end, none for ''."""
    parts = F.split(text, f"\\r\\n|[{LINE_ENDS}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines_with_ends(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{LINE_ENDS}]*(?:\\r\\n|[{LINE_ENDS}])|[^{LINE_ENDS}]+)"), 1)


def blank(line: Column) -> Column:
    return line.rlike("(?U)^\\s*\\z")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+\\z", "")


def count_lines_of_code(text: Column) -> Column:
    """Lines (by \\n) that aren't blank."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: ~blank(x))).cast("long")


def prefix_of_lines(text: Column, most: Column | int) -> Column:
    """At most `most` characters from the start, without the last, partial line (if there's a line end)."""
    return F.regexp_replace(F.substr(text, F.lit(1), _column(most)), "\\n[^\\n]*\\z", "")


def suffix_of_lines(text: Column, most: Column | int) -> Column:
    """At most `most` characters from the end, without the first, partial line; 0 means the whole text."""
    most = _column(most)
    tail = F.when(most == 0, text).when(most >= F.length(text), text).otherwise(F.substr(text, F.length(text) - most + 1, most))
    return F.regexp_replace(tail, "\\A[^\\n]*\\n", "")


def clip(one: Column, two: Column, most: int) -> tuple[Column, Column]:
    """one's end and two's start, together about `most` characters: a side under half stays whole."""
    half = most // 2
    short_one, short_two = F.length(one) < half, F.length(two) < half
    first = F.when(short_one, one).when(short_two, suffix_of_lines(one, F.lit(most) - F.length(two))).otherwise(suffix_of_lines(one, half))
    second = F.when(short_one, prefix_of_lines(two, F.lit(most) - F.length(one))).when(short_two, two).otherwise(prefix_of_lines(two, half))
    return first, second


def slices(text: Column, most: int) -> Column:
    """Runs of whole lines of at most `most` characters; a longer line stays whole, after an empty slice if it is first."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state: Column, line: Column) -> Column:
        fits = F.length(state["now"]) + F.length(line) <= most
        done = F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["now"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(state["now"], line)).otherwise(line).alias("now"))

    return F.aggregate(lines_with_ends(text), start, add, lambda s: F.concat(s["done"], F.array(s["now"])))


def commit_format(before: Column, message: Column, after: Column, empty: Callable[[Column], Column] | None = None) -> Column:
    """Training text of an edit; NULL if a side is empty or nothing changes.

    empty: which texts count as empty; by default those of white space alone. operators.programs.is_empty looks past comments as well.
    """
    empty = empty or (lambda x: strip(x) == "")
    text = F.concat(F.lit(COMMIT_BEFORE), before, F.lit(COMMIT_MSG), message, F.lit(COMMIT_AFTER), after)
    return F.when(~empty(before) & ~empty(after) & (before != after), text)


def edit_prompt(code: Column, instruction: Column, prefix: Column | None = None) -> Column:
    return strip(F.concat(F.lit(COMMIT_BEFORE), code, F.lit(COMMIT_MSG), instruction, F.lit(COMMIT_AFTER), prefix if prefix is not None else F.lit("")))


def infill_prompt(before: Column, after: Column) -> Column:
    return strip(F.concat(F.lit(FIM_PREFIX), before, F.lit(FIM_SUFFIX), after, F.lit(FIM_MIDDLE)))


def parse_date(text: Column) -> Column:
    """Timestamps of DATE_FORMAT (1 to 6 fraction digits); NULL for empty and malformed ones."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(DATE_FORMAT))


def decimal_text(x: Column) -> Column:
    return F.format_number(x, 1)


def whole_text(x: Column) -> Column:
    return F.format_number(x.cast("long"), 0)


def duration_text(seconds: Column) -> Column:
    """H:MM:SS of whole seconds."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def _column(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x
