"""SQL of the three rollup levels, written column by column from their definitions, not from the operator's lists.

`share(a, b)` stands for a / b with NaN for a zero denominator, `mean(x)` for a mean without NaN, `one(n, c)` for pass@1.
"""

from __future__ import annotations

import re

LEVELS = """
sums AS (
  SELECT config, problem_id, completion_id,
    CAST(sum(num_annotation_sites) AS BIGINT) AS num_annotation_sites, CAST(sum(num_annotations_added) AS BIGINT) AS num_annotations_added,
    CAST(sum(num_annotations_trivial) AS BIGINT) AS num_annotations_trivial, CAST(sum(num_annotations_trivial_original) AS BIGINT) AS num_annotations_trivial_original,
    CAST(sum(num_definitions) AS BIGINT) AS num_definitions, CAST(sum(num_definitions_added) AS BIGINT) AS num_definitions_added, CAST(sum(num_definitions_used) AS BIGINT) AS num_definitions_used,
    CAST(sum(num_errors) AS BIGINT) AS num_errors, CAST(sum(num_types_undefined) AS BIGINT) AS num_types_undefined,
    CAST(sum(CASE WHEN parses THEN num_annotations_added ELSE 0 END) AS BIGINT) AS num_annotations_added_files_parse,
    CAST(sum(CASE WHEN parses THEN num_annotation_sites ELSE 0 END) AS BIGINT) AS num_annotation_sites_files_parse,
    CAST(sum(CASE WHEN parses THEN num_definitions ELSE 0 END) AS BIGINT) AS num_definitions_files_parse,
    CAST(sum(CASE WHEN parses THEN num_definitions_added ELSE 0 END) AS BIGINT) AS num_definitions_added_files_parse,
    CAST(sum(CASE WHEN parses THEN num_definitions_used ELSE 0 END) AS BIGINT) AS num_definitions_used_files_parse,
    CAST(sum(CASE WHEN parses THEN num_types_undefined ELSE 0 END) AS BIGINT) AS num_types_undefined_files_parse,
    CAST(sum(CASE WHEN num_errors = 0 THEN num_annotations_trivial ELSE 0 END) AS BIGINT) AS num_annotations_trivial_errorfree_files,
    CAST(sum(CASE WHEN num_errors = 0 THEN num_annotations_trivial_original ELSE 0 END) AS BIGINT) AS num_annotations_trivial_original_errorfree_files,
    CAST(sum(CASE WHEN num_errors = 0 THEN num_annotations_added ELSE 0 END) AS BIGINT) AS num_annotations_added_errorfree_files,
    count(*) AS num_files, count(*) FILTER (WHERE parses) AS num_files_parse, count(*) FILTER (WHERE correct) AS num_correct_files,
    count(*) FILTER (WHERE num_errors = 0) AS num_errorfree_files, count(*) FILTER (WHERE unchanged) AS num_files_unchanged,
    list_sort(list_distinct(flatten(list(type_annotations)))) AS type_annotations
  FROM files GROUP BY ALL),
completions AS (
  SELECT s.*, r.* EXCLUDE (config, problem_id, completion_id), share(num_annotations_trivial, num_annotations_added) AS pct_annotations_trivial,
    share(num_annotations_trivial_errorfree_files, num_annotations_added_errorfree_files) AS pct_annotations_trivial_errorfree_files,
    share(num_annotations_added_files_parse, num_annotation_sites_files_parse) AS pct_annotation_sites_filled_files_parse,
    share(num_errors, num_files) AS errors_per_file,
    type_checks AND untyped_equal AND num_annotations_added + num_definitions_added > 0 AS correct
  FROM sums s JOIN runs r USING (config, problem_id, completion_id)),
counted AS (
  SELECT config, problem_id, count(*) AS num_completions, count(*) FILTER (WHERE pkg_parses) AS num_pkg_parses, count(*) FILTER (WHERE type_checks) AS num_type_checks,
    count(*) FILTER (WHERE correct) AS num_correct, count(*) FILTER (WHERE pkg_unchanged) AS num_pkg_unchanged,
    CAST(sum(num_files) AS BIGINT) AS tot_files, CAST(sum(num_files_parse) AS BIGINT) AS tot_files_parse, CAST(sum(num_correct_files) AS BIGINT) AS tot_correct_files,
    CAST(sum(num_errorfree_files) AS BIGINT) AS tot_errorfree_files, CAST(sum(num_files_unchanged) AS BIGINT) AS tot_files_unchanged, CAST(sum(num_errors) AS BIGINT) AS tot_errors,
    mean(accuracy) AS avg_accuracy, mean(levenshtein) AS avg_levenshtein, mean(untyped_levenshtein) AS avg_untyped_levenshtein, mean(token_count) AS avg_token_count,
    mean(num_errors) AS avg_errors, mean(num_annotation_sites) AS avg_annotation_sites, mean(num_annotations_added) AS avg_annotations_added, mean(num_annotations_trivial) AS avg_annotations_trivial,
    mean(num_annotations_trivial_original) AS avg_annotations_trivial_original, mean(num_definitions) AS avg_definitions, mean(num_definitions_added) AS avg_definitions_added,
    mean(num_definitions_used) AS avg_definitions_used, mean(num_types_undefined) AS avg_types_undefined,
    CAST(sum(num_annotation_sites) AS BIGINT) AS num_annotation_sites, CAST(sum(num_annotations_trivial) AS BIGINT) AS num_annotations_trivial, CAST(sum(num_annotations_trivial_original) AS BIGINT) AS num_annotations_trivial_original,
    CAST(sum(num_annotations_added) AS BIGINT) AS num_annotations_added, CAST(sum(num_annotations_trivial_errorfree_files) AS BIGINT) AS num_annotations_trivial_errorfree_files,
    CAST(sum(num_annotations_trivial_original_errorfree_files) AS BIGINT) AS num_annotations_trivial_original_errorfree_files, CAST(sum(num_annotations_added_errorfree_files) AS BIGINT) AS num_annotations_added_errorfree_files,
    CAST(sum(num_annotations_added_files_parse) AS BIGINT) AS num_annotations_added_files_parse, CAST(sum(num_annotation_sites_files_parse) AS BIGINT) AS num_annotation_sites_files_parse,
    CAST(sum(num_definitions) AS BIGINT) AS num_definitions, CAST(sum(num_definitions_added) AS BIGINT) AS num_definitions_added, CAST(sum(num_definitions_used) AS BIGINT) AS num_definitions_used,
    CAST(sum(num_definitions_files_parse) AS BIGINT) AS num_definitions_files_parse, CAST(sum(num_definitions_added_files_parse) AS BIGINT) AS num_definitions_added_files_parse,
    CAST(sum(num_definitions_used_files_parse) AS BIGINT) AS num_definitions_used_files_parse, CAST(sum(num_types_undefined_files_parse) AS BIGINT) AS num_types_undefined_files_parse
  FROM completions GROUP BY ALL),
problems AS (
  SELECT *, share(num_pkg_parses, num_completions) AS pct_pkg_parses, share(num_type_checks, num_completions) AS pct_type_checks, share(num_correct, num_completions) AS pct_correct,
    share(num_pkg_unchanged, num_completions) AS pct_pkg_unchanged, share(num_annotations_trivial, num_annotations_added) AS pct_annotations_trivial,
    share(num_annotations_trivial_errorfree_files, num_annotations_added_errorfree_files) AS pct_annotations_trivial_errorfree_files,
    share(num_annotations_added_files_parse, num_annotation_sites_files_parse) AS pct_annotation_sites_filled_files_parse,
    share(tot_errors, tot_files) AS errors_per_file, share(tot_errorfree_files, tot_files) AS pct_errorfree_files, one(num_completions, num_correct) AS "pass@1_project", one(tot_files, tot_correct_files) AS "pass@1_files"
  FROM counted),
totals AS (
  SELECT config AS model, count(*) AS num_problems, CAST(sum(num_completions) AS BIGINT) AS tot_completions, CAST(sum(num_correct) AS BIGINT) AS tot_correct, CAST(sum(num_pkg_parses) AS BIGINT) AS tot_pkg_parses,
    CAST(sum(num_type_checks) AS BIGINT) AS tot_type_checks, CAST(sum(num_pkg_unchanged) AS BIGINT) AS tot_pkg_unchanged, CAST(sum(tot_files) AS BIGINT) AS tot_files, CAST(sum(tot_errorfree_files) AS BIGINT) AS tot_errorfree_files,
    CAST(sum(tot_errors) AS BIGINT) AS tot_errors, CAST(sum(tot_files_parse) AS BIGINT) AS tot_files_parse, CAST(sum(tot_files_unchanged) AS BIGINT) AS tot_files_unchanged, CAST(sum(tot_correct_files) AS BIGINT) AS tot_correct_files,
    sum(avg_annotation_sites * num_completions) / sum(num_completions) AS avg_annotation_sites, sum(avg_annotations_added * num_completions) / sum(num_completions) AS avg_annotations_added,
    sum(avg_annotations_trivial * num_completions) / sum(num_completions) AS avg_annotations_trivial, sum(avg_annotations_trivial_original * num_completions) / sum(num_completions) AS avg_annotations_trivial_original,
    sum(avg_definitions_added * num_completions) / sum(num_completions) AS avg_definitions_added, sum(avg_definitions_used * num_completions) / sum(num_completions) AS avg_definitions_used,
    sum(avg_types_undefined * num_completions) / sum(num_completions) AS avg_types_undefined, sum(avg_errors * num_completions) / sum(num_completions) AS avg_errors,
    sum(avg_accuracy * num_completions) / sum(num_completions) AS avg_accuracy, sum(avg_levenshtein * num_completions) / sum(num_completions) AS avg_levenshtein,
    sum(avg_untyped_levenshtein * num_completions) / sum(num_completions) AS avg_untyped_levenshtein, sum(avg_token_count * num_completions) / sum(num_completions) AS avg_token_count,
    CAST(sum(num_annotation_sites) AS BIGINT) AS tot_annotation_sites, CAST(sum(num_annotations_trivial) AS BIGINT) AS tot_annotations_trivial, CAST(sum(num_annotations_added) AS BIGINT) AS tot_annotations_added,
    CAST(sum(num_annotations_trivial_original) AS BIGINT) AS tot_annotations_trivial_original, CAST(sum(num_annotations_trivial_errorfree_files) AS BIGINT) AS tot_annotations_trivial_errorfree_files,
    CAST(sum(num_annotations_trivial_original_errorfree_files) AS BIGINT) AS tot_annotations_trivial_original_errorfree_files, CAST(sum(num_annotations_added_errorfree_files) AS BIGINT) AS tot_annotations_added_errorfree_files,
    CAST(sum(num_annotations_added_files_parse) AS BIGINT) AS tot_annotations_added_files_parse, CAST(sum(num_annotation_sites_files_parse) AS BIGINT) AS tot_annotation_sites_files_parse,
    CAST(sum(num_definitions) AS BIGINT) AS tot_definitions, CAST(sum(num_definitions_added) AS BIGINT) AS tot_definitions_added, CAST(sum(num_definitions_used) AS BIGINT) AS tot_definitions_used,
    CAST(sum(num_definitions_files_parse) AS BIGINT) AS tot_definitions_files_parse, CAST(sum(num_definitions_added_files_parse) AS BIGINT) AS tot_definitions_added_files_parse,
    CAST(sum(num_definitions_used_files_parse) AS BIGINT) AS tot_definitions_used_files_parse, CAST(sum(num_types_undefined_files_parse) AS BIGINT) AS tot_types_undefined_files_parse
  FROM problems GROUP BY ALL),
configurations AS (
  SELECT * EXCLUDE (tot_correct_files), share(tot_correct, tot_completions) AS pct_correct, share(tot_pkg_parses, tot_completions) AS pct_pkg_parses, share(tot_type_checks, tot_completions) AS pct_type_checks,
    share(tot_pkg_unchanged, tot_completions) AS pct_pkg_unchanged, one(tot_completions, tot_correct) AS "pass@1_project", one(tot_files, tot_correct_files) AS "pass@1_files", share(tot_files_parse, tot_files) AS pct_files_parse,
    share(tot_errors, tot_files) AS errors_per_file, share(tot_errorfree_files, tot_files) AS pct_errorfree_files, share(tot_files_unchanged, tot_files) AS pct_files_unchanged,
    share(tot_annotations_trivial, tot_annotations_added) AS pct_annotations_trivial, share(tot_annotations_trivial_errorfree_files, tot_annotations_added_errorfree_files) AS pct_annotations_trivial_errorfree_files,
    share(tot_annotations_added, tot_annotation_sites) AS pct_annotation_sites_filled, share(tot_annotations_added_files_parse, tot_annotation_sites_files_parse) AS pct_annotation_sites_filled_files_parse,
    share(tot_definitions_added, tot_definitions) AS pct_definitions_added, share(tot_definitions_added_files_parse, tot_definitions_files_parse) AS pct_definitions_added_files_parse,
    share(tot_definitions_used, tot_definitions) AS pct_definitions_used, share(tot_definitions_used_files_parse, tot_definitions_files_parse) AS pct_definitions_used_files_parse
  FROM totals)
"""


def written_out(sql: str) -> str:
    """The SQL with share, mean and one as expressions."""
    sql = re.sub(r"share\((\w+), (\w+)\)", r"CASE WHEN \2 = 0 THEN CAST('NaN' AS DOUBLE) ELSE \1 / CAST(\2 AS DOUBLE) END", sql)
    sql = re.sub(r"mean\((\w+)\)", r"coalesce(avg(CASE WHEN NOT isnan(CAST(\1 AS DOUBLE)) THEN \1 END), CAST('NaN' AS DOUBLE))", sql)
    return re.sub(r"one\((\w+), (\w+)\)", r"CASE WHEN \1 - \2 < 1 THEN 1.0 ELSE \2 / CAST(\1 AS DOUBLE) END", sql)


def rounded(table: str) -> str:
    """SELECT all columns of a level, doubles to nine places, lists as text."""
    return f"SELECT COLUMNS(lambda c: NOT {_DOUBLES} AND c <> 'type_annotations'), round(COLUMNS(lambda c: {_DOUBLES}), 9) FROM {table}"


_DOUBLES = "(regexp_matches(c, '^(pct_|avg_|pass@)') OR c IN ('errors_per_file', 'accuracy', 'levenshtein', 'untyped_levenshtein', 'token_count'))"
