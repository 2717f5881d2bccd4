"""Looking into results: index specifications, moves among completions, one row's code and difference."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")
INDEX = re.compile(r"^(?:(\d+)(?:(\.)(\d*))?|\.(\d+))$")


def parse_index(text: str, problem: int = 0, completion: int = 0) -> tuple[int, int]:
    """`P.C`, `P` and `P.` (the first completion), `.C` (of the problem at hand)."""
    m = INDEX.match(text.strip())
    if not m:
        raise ValueError(f"{text!r} is no index; write P.C, P, P. or .C")
    if m[4] is not None:
        return problem, int(m[4])
    return int(m[1]), int(m[3]) if m[3] else 0


def step(at: tuple[int, int], move: str, sizes: Sequence[int]) -> tuple[int, int]:
    """Where a move leads from (problem, completion); sizes: completions of each problem.

    next and previous go to the first completion of the neighbouring problem; forward and backward go by
    completions and cross into the next problem's first or the previous one's last. IndexError at the ends.
    """
    problem, completion = at
    if move == "forward" and completion + 1 < sizes[problem]:
        return problem, completion + 1
    if move == "backward" and completion > 0:
        return problem, completion - 1
    if move not in ("next", "previous", "forward", "backward"):
        raise ValueError(f"{move!r} is no move")
    to = problem + (1 if move in ("next", "forward") else -1)
    if not 0 <= to < len(sizes):
        raise IndexError(f"there is nothing {'after' if to else 'before'} problem {problem}")
    return to, sizes[to] - 1 if move == "backward" else 0


def goto(at: tuple[int, int], text: str, sizes: Sequence[int]) -> tuple[int, int]:
    """The place that an index names, seen from `at`; IndexError where there's none such."""
    problem, completion = parse_index(text, *at)
    if not 0 <= problem < len(sizes) or not 0 <= completion < sizes[problem]:
        raise IndexError(f"there is no completion {problem}.{completion}")
    return problem, completion


def selected(items: Sequence[T], places: Sequence[int]) -> list[T]:
    """The items at these places, all where none is given; IndexError names every place out of range."""
    wrong = [p for p in places if not 0 <= p < len(items)]
    if wrong:
        raise IndexError(f"{', '.join(map(str, wrong))} out of range; places go from 0 to {len(items) - 1}")
    return [items[p] for p in places] if places else list(items)


def shown(summaries: DataFrame) -> DataFrame:
    """Numbers as a reader sees them: shares (pct_*, pass@*, and both similarities) in percent with one decimal, other doubles with one."""
    share = lambda c: c.startswith(("pct_", "pass@")) or c.endswith("levenshtein")
    told = lambda c, t: F.format_string("%.1f%%", F.col(f"`{c}`") * 100) if share(c) else F.format_string("%.1f", F.col(f"`{c}`")) if t == "double" else F.col(f"`{c}`")
    return summaries.select(*(told(c, t).alias(c) for c, t in summaries.dtypes))


def summary_of(summaries: DataFrame, config: str) -> DataFrame:
    return summaries.filter(F.col("model") == config)


def completion_at(runs: DataFrame, problem: int, completion: int) -> DataFrame:
    return runs.filter((F.col("problem_id") == problem) & (F.col("completion_id") == completion))


def difference(before: str, after: str, names: tuple[str, str] = ("before", "after"), colour: bool = False) -> str:
    """A unified difference of two texts."""
    lines = difflib.unified_diff(before.splitlines(), after.splitlines(), *names, lineterm="")
    paint = {"+": "\033[32m", "-": "\033[31m", "@": "\033[36m"}
    return "\n".join(f"{paint[x[0]]}{x}\033[0m" if colour and x[:1] in paint else x for x in lines)
