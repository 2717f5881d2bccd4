"""Files to completions to problems to configurations: three aggregations from one file-grain table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import long_sum, nan_mean, pass_at_k, ratio, truthy, weighted_mean

# The counters of a file, and those that are also summed over files that parse.
COUNTERS = ["annotation_sites", "annotations_added", "annotations_trivial", "annotations_trivial_original", "definitions", "definitions_added", "definitions_used", "errors", "types_undefined"]
PARSED = ["annotations_added", "annotation_sites", "definitions", "definitions_added", "definitions_used", "types_undefined"]
ERRORFREE = ["annotations_trivial", "annotations_trivial_original", "annotations_added"]
SETS = ["type_annotations", "type_definitions", "type_definitions_used", "types_undefined"]
FLAGS = ["pkg_parses", "type_checks", "correct", "pkg_unchanged"]
MEASURES = ["accuracy", "levenshtein", "untyped_levenshtein", "token_count"]
SUMS = ["annotation_sites", "annotations_trivial", "annotations_trivial_original", "annotations_added", "definitions", "definitions_added", "definitions_used"]
AVERAGES = ["annotation_sites", "annotations_added", "annotations_trivial", "annotations_trivial_original", "definitions_added", "definitions_used", "types_undefined", "errors", "accuracy", "levenshtein", "untyped_levenshtein", "token_count"]
COMPLETION, PROBLEM = ["config", "problem_id", "completion_id"], ["config", "problem_id"]
#: (name, numerator, denominator) after the level's prefix.
RATIOS = [
    ("annotations_trivial", "annotations_trivial", "annotations_added"),
    ("annotations_trivial_errorfree_files", "annotations_trivial_errorfree_files", "annotations_added_errorfree_files"),
    ("annotation_sites_filled_files_parse", "annotations_added_files_parse", "annotation_sites_files_parse"),
]
DATASET_RATIOS = [
    *RATIOS,
    ("annotation_sites_filled", "annotations_added", "annotation_sites"),
    ("definitions_added", "definitions_added", "definitions"),
    ("definitions_added_files_parse", "definitions_added_files_parse", "definitions_files_parse"),
    ("definitions_used", "definitions_used", "definitions"),
    ("definitions_used_files_parse", "definitions_used_files_parse", "definitions_files_parse"),
]
FILE_COUNTS = ["files", "files_parse", "correct_files", "errorfree_files", "files_unchanged", "errors"]


def _carried() -> list[str]:
    """Counters that go up from completions to problems and configurations."""
    return [*SUMS, *(f"{c}_files_parse" for c in PARSED), *(f"{c}_errorfree_files" for c in ERRORFREE)]


def completions(files: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (a row for each completion: keys, `untyped_equal`, type_checks, MEASURES, ...) with its files' totals.

    A completion without files, such as one that failed, keeps zero counts; NULL flags count as false.
    """
    sums = [F.sum(f"num_{c}").cast("long").alias(f"num_{c}") for c in COUNTERS]
    sums += [F.coalesce(F.sum(F.when(F.col("parses"), F.col(f"num_{c}"))), F.lit(0)).cast("long").alias(f"num_{c}_files_parse") for c in PARSED]
    sums += [F.coalesce(F.sum(F.when(F.col("num_errors") == 0, F.col(f"num_{c}"))), F.lit(0)).cast("long").alias(f"num_{c}_errorfree_files") for c in ERRORFREE]
    sums += [F.count("*").alias("num_files"), truthy("parses").alias("num_files_parse"), truthy("correct").alias("num_correct_files"), truthy(F.col("num_errors") == 0).alias("num_errorfree_files"), truthy("unchanged").alias("num_files_unchanged")]
    sums += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in SETS if c in files.columns]
    totals = files.groupBy(*COMPLETION).agg(*sums)
    numbers = [c for c in totals.columns if c.startswith("num_")]
    out = runs.join(totals, COMPLETION, "left").fillna(0, numbers)
    out = out.withColumns({f"pct_{n}": ratio(F.col(f"num_{a}"), F.col(f"num_{b}")) for n, a, b in RATIOS})
    changed = F.col("num_annotations_added") + F.col("num_definitions_added") > 0
    return out.withColumn("errors_per_file", ratio(F.col("num_errors"), F.col("num_files"))).withColumn("correct", F.coalesce(F.col("type_checks") & F.col("untyped_equal") & changed, F.lit(False)))


def problems(done: DataFrame) -> DataFrame:
    """A row for each problem."""
    sums = [F.count("*").alias("num_completions"), *(truthy(f).alias(f"num_{f}") for f in FLAGS)]
    sums += [long_sum(f"num_{c}").alias(f"tot_{c}") for c in FILE_COUNTS]
    sums += [nan_mean(m).alias(f"avg_{m}") for m in MEASURES]
    sums += [nan_mean(f"num_{c}").alias(f"avg_{c}") for c in COUNTERS]
    sums += [long_sum(f"num_{c}").alias(f"num_{c}") for c in _carried()]
    out = done.groupBy(*PROBLEM).agg(*sums)
    return out.withColumns(
        {f"pct_{f}": ratio(F.col(f"num_{f}"), F.col("num_completions")) for f in FLAGS}
        | {f"pct_{n}": ratio(F.col(f"num_{a}"), F.col(f"num_{b}")) for n, a, b in RATIOS}
        | {"errors_per_file": ratio(F.col("tot_errors"), F.col("tot_files")), "pct_errorfree_files": ratio(F.col("tot_errorfree_files"), F.col("tot_files")), "pass@1_project": pass_at_k(F.col("num_completions"), F.col("num_correct"), 1), "pass@1_files": pass_at_k(F.col("tot_files"), F.col("tot_correct_files"), 1)}
    )


def configurations(solved: DataFrame) -> DataFrame:
    """A row for each configuration: the 58 columns of a dataset summary, the configuration's name as `model`."""
    sums = [F.count("*").alias("num_problems"), F.sum("num_completions").alias("tot_completions"), *(F.sum(f"num_{f}").alias(f"tot_{f}") for f in FLAGS)]
    sums += [F.sum(f"tot_{c}").alias(f"tot_{c}") for c in FILE_COUNTS]
    sums += [weighted_mean(f"avg_{a}", "num_completions").alias(f"avg_{a}") for a in AVERAGES]
    sums += [F.sum(f"num_{c}").alias(f"tot_{c}") for c in _carried()]
    out = solved.groupBy(F.col("config").alias("model")).agg(*sums)
    files = F.col("tot_files")
    return out.withColumns(
        {f"pct_{f}": F.col(f"tot_{f}") / F.col("tot_completions") for f in FLAGS}
        | {f"pct_{n}": ratio(F.col(f"tot_{a}"), F.col(f"tot_{b}")) for n, a, b in DATASET_RATIOS}
        | {"pct_files_parse": ratio(F.col("tot_files_parse"), files), "pct_errorfree_files": ratio(F.col("tot_errorfree_files"), files), "pct_files_unchanged": ratio(F.col("tot_files_unchanged"), files), "errors_per_file": ratio(F.col("tot_errors"), files)}
        | {"pass@1_project": pass_at_k(F.col("tot_completions"), F.col("tot_correct"), 1), "pass@1_files": pass_at_k(files, F.col("tot_correct_files"), 1)}
    ).drop("tot_correct_files")


def summarise(files: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(completions, problems, configurations), each from the one before."""
    one = completions(files, runs)
    two = problems(one)
    return one, two, configurations(two)


def correct_groups(done: DataFrame) -> DataFrame:
    """config, problem_id, output, completion_ids, n: distinct correct outputs and the completions that gave them."""
    return done.where("correct").groupBy(*PROBLEM, "output").agg(F.sort_array(F.collect_list("completion_id")).alias("completion_ids"), F.count("*").alias("n"))
