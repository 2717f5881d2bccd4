"""Report tables from dataset summaries: percent tables, number formats, LaTeX rows, plot-ready long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decimal_text, whole_text

# Names shown for datasets, the tables' columns, the header line.
DATASETS = {"ts": "TS-Sourced", "js": "JS-Sourced"}
PACKAGE_AND_FILE = {
    "parses": ("tot_pkg_parses", "tot_completions", "tot_files_parse", "tot_files"),
    "typechecks": ("tot_type_checks", "tot_completions", "tot_errorfree_files", "tot_files"),
    "unchanged": ("tot_pkg_unchanged", "tot_completions", "tot_files_unchanged", "tot_files"),
}
FILE_ONLY = {
    "trivial_annotations": ("tot_errorfree_files", "tot_annotations_trivial_errorfree_files", "tot_annotations_added_errorfree_files"),
    "filled_annotations": ("tot_files_parse", "tot_annotations_added_files_parse", "tot_annotation_sites_files_parse"),
    "type_defs_added": ("tot_files_parse", "tot_definitions_added_files_parse", "tot_definitions_files_parse"),
    "type_defs_used": ("tot_files_parse", "tot_definitions_used_files_parse", "tot_definitions_files_parse"),
    "correct": (None, "tot_correct", "tot_files"),
}
HEADER = "% DO NOT MODIFY: this file is generated by an R script"


def named(summary: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """Dataset and Model from the configuration's name, which ends in _ts or _js; other columns stay.

    models: names to show, by the start of a configuration's name, the first that fits.
    """
    model, dataset = F.regexp_extract("model", "^(.*)_(ts|js)$", 1), F.regexp_extract("model", "^(.*)_(ts|js)$", 2)
    shown = F.coalesce(*(F.when(model.startswith(k), v) for k, v in (models or {}).items()), model)
    which = F.coalesce(*(F.when(dataset == k, v) for k, v in DATASETS.items()))
    return summary.select(which.alias("Dataset"), shown.alias("Model"), *(c for c in (f"`{x}`" for x in summary.columns) if c != "`model`"))


def _percent(n, tot):
    return F.try_divide(n.cast("double"), tot.cast("double")) * 100


def percent_table(summary: DataFrame, table: str, models: dict[str, str] | None = None) -> DataFrame:
    """Dataset, Model, counts and percentages of one report table, unformatted, in the summary's row order."""
    rows = named(summary, models)
    if table in PACKAGE_AND_FILE:
        a, b, c, d = (F.col(x) for x in PACKAGE_AND_FILE[table])
        return rows.select("Dataset", "Model", a.cast("long").alias("pkg_n"), b.cast("long").alias("pkg_tot"), _percent(a, b).alias("pkg_percent"), c.cast("long").alias("file_n"), d.cast("long").alias("file_tot"), _percent(c, d).alias("file_percent"))
    files, n, tot = FILE_ONLY[table]
    lead = [F.col(files).cast("long").alias("files")] if files else []
    return rows.select("Dataset", "Model", *lead, F.col(n).cast("long").alias("n"), F.col(tot).cast("long").alias("tot"), _percent(F.col(n), F.col(tot)).alias("percent"))


def formatted(table: DataFrame) -> DataFrame:
    """Doubles with one decimal, whole numbers with commas."""
    show = {"double": decimal_text, "bigint": whole_text, "int": whole_text}
    return table.select(*(show[t](F.col(c)).alias(c) if t in show else F.col(c) for c, t in table.dtypes))


def latex_rows(table: DataFrame) -> DataFrame:
    """line: the columns joined by ` & `, closed by ` \\\\`."""
    return formatted(table).select(F.concat(F.concat_ws(" & ", *(f"`{c}`" for c in table.columns)), F.lit(" \\\\")).alias("line"))


def write_latex(table: DataFrame, path: str, most: int = 1000) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("".join(f"{x}\n" for x in [HEADER, *(r.line for r in latex_rows(table).limit(most).collect())]))


def by_scope(table: DataFrame) -> DataFrame:
    """The plot's long form: a row for Packages and one for Files, with n, tot and percent."""
    return table.select("Dataset", "Model", F.expr("stack(2, 'Packages', pkg_n, pkg_tot, pkg_percent, 'Files', file_n, file_tot, file_percent) as (scope, n, tot, percent)"))
