"""Reducers, text functions, line operators, sources, summaries and reports."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from typeloom.functions import measures, text
from typeloom.operators import curate, lines, lookup, report
from typeloom.sources import io


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_reducers(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,), (3.0,)], "x double")
    got = df.agg(measures.nan_sum("x").alias("s"), measures.nan_mean("x").alias("m")).first()
    assert (got.s, got.m) == (4.0, 2.0)
    none = df.where("false").agg(measures.nan_sum("x").alias("s"), measures.nan_mean("x").alias("m")).first()
    assert none.s == 0.0 and math.isnan(none.m)
    assert math.isnan(one(spark, measures.ratio(F.lit(1), F.lit(0))))
    assert math.isnan(df.where("x is not null").withColumn("w", F.lit(1)).agg(measures.weighted_mean("x", "w").alias("m")).first().m)


@pytest.mark.parametrize(("n", "c", "k"), [(10, 0, 1), (10, 3, 1), (10, 3, 5), (10, 8, 3), (0, 0, 1), (1, 1, 1)])
def test_pass_at_k(spark, n, c, k):
    want = 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
    assert one(spark, measures.pass_at_k(F.col("n"), F.col("c"), k), n=n, c=c) == pytest.approx(want)


def test_indel_similarity():
    assert measures.indel_similarity("kitten", "sitting") == pytest.approx(8 / 13)
    assert measures.indel_similarity("", "") == 1.0
    draw = random.Random(1)
    for _ in range(200):
        a, b = ("".join(draw.choice("abcé") for _ in range(draw.randrange(12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert measures.lcs_length(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


ODD = ["", "a", "a\n", "\n", "a\r\nb", "a\rb\x0bc\x0cd", "a\x1cb\x85c d ", "x" * 30 + "\ny\nz", "é\nü\n"]


@pytest.mark.parametrize("s", ODD)
def test_lines(spark, s):
    assert one(spark, text.lines(F.col("s")), s=s) == s.splitlines()
    for n in (0, 1, 3, 100):
        assert one(spark, text.prefix_of_lines(F.col("s"), n), s=s) == s[:n].rsplit("\n", 1)[0]
        assert one(spark, text.suffix_of_lines(F.col("s"), n), s=s) == s[-n:].split("\n", 1)[-1]
    want, now = [], ""
    for line in s.splitlines(keepends=True):
        if len(now) + len(line) > 5:
            want.append(now)
            now = ""
        now += line
    assert one(spark, text.slices(F.col("s"), 5), s=s) == [*want, now]


def test_formats(spark):
    assert one(spark, text.commit_format(F.lit("a"), F.lit("m"), F.lit("b"))) == "<commit_before>a<commit_msg>m<commit_after>b"
    assert one(spark, text.commit_format(F.lit("a"), F.lit("m"), F.lit("a"))) is None
    assert one(spark, text.commit_format(F.lit(" \n"), F.lit("m"), F.lit("a"))) is None
    assert one(spark, text.commit_format(F.lit("// c"), F.lit("m"), F.lit("a"))) is not None
    assert one(spark, text.infill_prompt(F.lit(" a"), F.lit("b "))) == "<fim_prefix> a<fim_suffix>b <fim_middle>"
    assert one(spark, text.duration_text(F.lit(3725.9))) == "1:02:05"
    assert one(spark, text.parse_date(F.lit("2022-01-02T03:04:05.6Z"))).year == 2022
    assert one(spark, text.parse_date(F.lit(""))) is None


def test_curation(spark):
    rows = [("a", "ts", "let x", "2022-01-02T00:00:00.000Z", None, None), ("b", "ts", "import y from 'z'", "2021-01-02T00:00:00.000Z", "2023-01-02T00:00:00.000Z", None), ("c", "ts", "<!DOCTYPE TS>", None, None, None), ("d", "js", " import a", "2023-01-02T00:00:00.000Z", "", None)]
    df = spark.createDataFrame(rows, "hexsha string, ext string, content string, " + ", ".join(f"{d} string" for d in curate.DATES))
    names = lambda x: [r.hexsha for r in x.orderBy("hexsha").collect()]
    assert names(df.where(curate.is_typescript(F.col("ext"), F.col("content")))) == ["a", "b"]
    assert names(df.where(curate.self_contained(F.col("content")))) == ["a", "c"]
    assert names(df.where(curate.self_contained(F.col("content"), lambda x: x.contains("x")))) == ["b", "c", "d"]
    assert names(curate.created_after(df)) == ["a", "d"]
    assert curate.sample_percent(df, 50, "hexsha").count() == curate.sample(df, "50%", "hexsha").count() == curate.sample(df, "2", "hexsha").count() == 2
    with pytest.raises(ValueError):
        curate.threshold_filters(df, ["nothing"])
    made = curate.gathered(df.select(F.lit(1).alias("k"), "hexsha", "ext"), ["k"], "hexsha", "ext", "all")
    assert [(r["at"], r.x, r.num_xs) for r in curate.exploded(made, ["k"], "all", "at", "x").orderBy("at").collect()] == [(0, "ts", 4), (1, "ts", 4), (2, "ts", 4), (3, "js", 4)]


def test_bundles(spark):
    df = spark.createDataFrame([(1, "p", "x\n// FILE: a.ts\ny\n// FILE: b.ts\n// FILE: a.ts\nz"), (2, "p", ""), (3, "p", "only")], "k int, name string, content string")
    got = {(r.k, r.file): r.content for r in lines.split_files(df, ["k"]).collect()}
    assert got == {(1, "p"): "x", (1, "a.ts"): "// FILE: a.ts\ny\n// FILE: a.ts\nz", (1, "b.ts"): "// FILE: b.ts", (3, "p"): "only"}


def test_errors_by_file(spark):
    log = "pre\nm.ts(2,1): error TS1: a\n more\nm.ts(90,1): error TS2: b\nm.ts(91,1): error TS3: c\nnode_modules/m.ts(2,1): error"
    rows = [(1, "p", "// FILE: a.ts\ny", log), (2, "p", "no marks", "node_modules/x.ts(1,1): e\n f"), (3, "p", "no marks", ""), (4, "p", "", "m.ts(1,1): e"), (5, "p", "x\n// FILE: a.ts\n// FILE: b.ts", "m.ts(4,1): e\nm.ts(1,1): f"), (6, "p", "no marks", "pre\nm.ts(1,1): e")]
    got = {(r.k, r.file): (r.errors, r.all_errors) for r in lines.split_errors(spark.createDataFrame(rows, "k int, name string, output string, tsc_logs string"), ["k"]).collect()}
    assert got[1, "a.ts"][0] == ["m.ts(2,1): error TS1: a\n more"]
    assert got[1, "p"] == (["m.ts(91,1): error TS3: c"], ["m.ts(90,1): error TS2: b", "m.ts(91,1): error TS3: c"])
    assert got[2, "p"][0] == ["node_modules/x.ts(1,1): e\n f"] and got[3, "p"] == ([], []) and got[4, "p"][0] == ["m.ts(1,1): e"]
    # One past the last line is the last file's; a file without errors is there all the same.
    assert got[5, "b.ts"][0] == ["m.ts(4,1): e"] and got[5, "a.ts"] == ([], []) and got[5, "p"][0] == ["m.ts(1,1): f"]
    assert got[6, "p"][0] == ["pre", "m.ts(1,1): e"] and len(got) == 9


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for name in ("t.parquet", "t.jsonl", "t.csv", "t.orc", "plain"):
        path = f"{tmp_path}/{name}"
        io.save_dataset(df, path)
        assert io.load_dataset(spark, path, "k long, v string").count() == 2
        with pytest.raises(Exception, match="(?i)exists"):
            io.save_dataset(df, path)
    with pytest.raises(FileExistsError):
        io.guard_absent(spark, [f"{tmp_path}/t.orc"])
    with pytest.raises(FileNotFoundError):
        io.load_dataset(spark, "someone/some-dataset")
    assert io.load_corpus(spark, f"{tmp_path}/plain").count() == io.existing_or(spark, f"{tmp_path}/plain", lambda: 1 / 0).count() == 2
    with pytest.raises(ValueError, match="Parquet"):
        io.load_corpus(spark, f"{tmp_path}/t.jsonl")
    assert io.exists(spark, io.scratch(spark)) and io.scratch(spark) != io.scratch(spark)
    io.write_jsonl(f"{tmp_path}/r.jsonl", [{"a": math.nan}])
    assert Path(tmp_path, "r.jsonl").read_text() == '{"a": NaN}\n' and math.isnan(io.read_jsonl(f"{tmp_path}/r.jsonl")[0]["a"])
    assert io.markdown([{"m": "x", "n": 1}]) == "| m | x |\n| --- | --- |\n| n | 1 |\n"


def test_checkpoint(spark, tmp_path):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "hexsha string")
    check = io.Checkpoint(spark, f"{tmp_path}/c")
    assert check.pending(files).count() == 3
    check.append(spark.createDataFrame([("a", True), ("b", False)], "hexsha string, ok boolean"))
    assert [r.hexsha for r in check.pending(files).collect()] == ["c"]
    with pytest.raises(KeyError):
        check.passed(files)
    check.append(spark.createDataFrame([("c", True)], "hexsha string, ok boolean"))
    assert sorted(r.hexsha for r in check.passed(files).collect()) == ["a", "c"]


# Published counts of six configurations (columns of a summary, then rows).
PUBLISHED = ["model", "tot_completions", "tot_pkg_parses", "tot_files", "tot_files_parse", "tot_correct"]
COUNTS = [("a_ts", 1000, 938, 1000, 938, 48), ("b_ts", 1000, 940, 1000, 940, 210), ("c_ts", 1000, 960, 1000, 960, 257), ("a_js", 1000, 890, 2511, 2401, 0), ("b_js", 1000, 992, 2590, 2582, 0), ("c_js", 1000, 1000, 2760, 2760, 0)]
PARSES = ["938 & 1,000 & 93.8 & 938 & 1,000 & 93.8", "940 & 1,000 & 94.0 & 940 & 1,000 & 94.0", "960 & 1,000 & 96.0 & 960 & 1,000 & 96.0", "890 & 1,000 & 89.0 & 2,401 & 2,511 & 95.6", "992 & 1,000 & 99.2 & 2,582 & 2,590 & 99.7", "1,000 & 1,000 & 100.0 & 2,760 & 2,760 & 100.0"]
CORRECT = ["48 & 1,000 & 4.8", "210 & 1,000 & 21.0", "257 & 1,000 & 25.7", "0 & 2,511 & 0.0", "0 & 2,590 & 0.0", "0 & 2,760 & 0.0"]


@pytest.mark.parametrize(("name", "want"), [("parses", PARSES), ("correct", CORRECT)])
def test_published_tables(spark, name, want):
    summary = spark.createDataFrame(COUNTS, PUBLISHED).coalesce(1)
    got = [r.line for r in report.latex_rows(report.percent_table(summary, name, {"a": "A"})).collect()]
    shown = [("TS-Sourced", "A"), ("TS-Sourced", "b"), ("TS-Sourced", "c"), ("JS-Sourced", "A"), ("JS-Sourced", "b"), ("JS-Sourced", "c")]
    assert got == [f"{d} & {m} & {line} \\\\" for (d, m), line in zip(shown, want, strict=True)]


def test_summary_columns(spark):
    from typeloom.plans import fixtures

    names = fixtures._rollup(spark, "/root/testdata/sf0.001")[2].columns
    assert len(names) == len(set(names)) == 58


def test_lookup(spark):
    assert lookup.parse_index("3.4") == (3, 4) and lookup.parse_index("3") == (3, 0) and lookup.parse_index("3.") == (3, 0) and lookup.parse_index(".2", 7) == (7, 2)
    with pytest.raises(ValueError):
        lookup.parse_index("x")
    sizes = [2, 1, 3]
    walk = [((0, 1), "forward", (1, 0)), ((0, 0), "forward", (0, 1)), ((1, 0), "backward", (0, 1)), ((2, 2), "backward", (2, 1)), ((0, 1), "next", (1, 0)), ((2, 2), "previous", (1, 0))]
    assert all(lookup.step(at, move, sizes) == to for at, move, to in walk)
    for at, move in (((2, 2), "forward"), ((0, 0), "backward"), ((2, 0), "next"), ((0, 1), "previous")):
        with pytest.raises(IndexError):
            lookup.step(at, move, sizes)
    with pytest.raises(ValueError):
        lookup.step((0, 0), "up", sizes)
    assert lookup.goto((2, 1), ".2", sizes) == (2, 2) and lookup.goto((2, 1), "0.1", sizes) == (0, 1) and lookup.goto((2, 1), "1", sizes) == (1, 0)
    for wrong in ("1.1", "3", ".3"):
        with pytest.raises(IndexError):
            lookup.goto((2, 1), wrong, sizes)
    assert lookup.selected("abc", [2, 0]) == ["c", "a"] and lookup.selected("abc", []) == ["a", "b", "c"]
    with pytest.raises(IndexError, match="-1, 3 out of range"):
        lookup.selected("abc", [-1, 1, 3])
    assert "+b" in lookup.difference("a", "b")
    told = lookup.shown(spark.createDataFrame([("m", 3, 0.5, 1.26, 0.333)], "model string, n long, pct_x double, avg_y double, `pass@1_z` double")).first()
    assert list(told) == ["m", 3, "50.0%", "1.3", "33.3%"]


def test_stream_of_checks(spark, tmp_path):
    from typeloom.operators.programs import TypeChecker
    from typeloom.streaming.checkpointed import check_new_files

    class Short(TypeChecker):
        def check(self, content):
            return len(content) < 5, ""

    done = io.Checkpoint(spark, f"{tmp_path}/done")
    for rows in ([("a", "let x"), ("b", "y")], [("b", "other text"), ("c", "z")]):
        spark.createDataFrame(rows, "hexsha string, content string").write.mode("append").parquet(f"{tmp_path}/in")
        files = spark.readStream.schema("hexsha string, content string").parquet(f"{tmp_path}/in")
        check_new_files(files, done, Short(), f"{tmp_path}/state").awaitTermination(120)
    assert sorted((r.hexsha, r.ok) for r in done.done().collect()) == [("a", False), ("b", True), ("c", True)]
