"""Queries of the operators over the fixture tables, each beside the SQL that must give the same rows.

The tables hold no programs, so a fixture's columns stand for a corpus': sources for problems,
documents for completions, quality labels for correct ones, conversations for bundles of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures, text
from ..operators import curate, lines, lookup, packing, report, rollup
from ..sources import io
from .rollup_sql import LEVELS, rounded, written_out

SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH g AS (SELECT d.source, count(*) AS n, count(*) FILTER (WHERE l.quality = 1) AS c FROM documents d JOIN labels l USING (doc_id) GROUP BY 1),
p AS (SELECT source, n, c, k, (SELECT product(1 - CAST(k AS DOUBLE) / i) FROM range(n - c + 1, n + 1) t(i)) AS miss FROM g, (VALUES (1), (3)) ks(k))
SELECT source, n, c, round(max(CASE WHEN k = 1 THEN CASE WHEN n - c < 1 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - miss END END), 9) AS pass_at_1,
  round(max(CASE WHEN k = 3 THEN CASE WHEN n - c < 3 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - miss END END), 9) AS pass_at_3 FROM p GROUP BY ALL
""")
def pass_at_k_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scan, join, group, and pass@k as a fold."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"), measures.truthy(F.col("quality") == 1).alias("c"))
    return counts.select("source", "n", "c", *(F.round(measures.pass_at_k(F.col("n"), F.col("c"), k), 9).alias(f"pass_at_{k}") for k in (1, 3)))


_FILE = {c: f"(n_chars * {k + 3}) % 13" for k, c in enumerate(rollup.COUNTERS) if c != "errors"} | {"errors": "n_chars % 3"}
_RUN = {
    "type_checks": "completion_id % 2 = 0",
    "pkg_parses": "completion_id % 3 <> 0",
    "pkg_unchanged": "completion_id % 5 = 0",
    "untyped_equal": "completion_id % 4 <> 1",
    "accuracy": "CASE WHEN completion_id % 6 = 0 THEN CAST('NaN' AS DOUBLE) ELSE completion_id / CAST(32 AS DOUBLE) END",
    "levenshtein": "completion_id / CAST(64 AS DOUBLE)",
    "untyped_levenshtein": "completion_id / CAST(128 AS DOUBLE)",
    "token_count": "CAST(completion_id AS DOUBLE)",
}
_SET = "split(CASE WHEN n_chars % 4 = 0 THEN lang ELSE 't' || n_chars % 9 || ',t' || n_chars % 5 || ',' || lang END, ',')"
_FILES = f"SELECT lang AS config, source AS problem_id, CAST(doc_id % 20 AS INT) AS completion_id, {', '.join(f'CAST({e} AS BIGINT) AS num_{c}' for c, e in _FILE.items())}, n_chars % 7 <> 0 AS parses, n_chars % 5 = 0 AS correct, n_chars % 11 = 0 AS unchanged, {_SET} AS type_annotations FROM documents"
_RUNS = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in _RUN.items())} FROM (SELECT DISTINCT lang AS config, source AS problem_id, CAST(doc_id % 20 AS INT) AS completion_id FROM documents) k"


def _rollup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    files, runs = (spark.sql(q.replace("FROM documents", "FROM {documents}"), documents=documents) for q in (_FILES, _RUNS))
    return rollup.summarise(files, runs)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), 9).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _rollup_query(name: str, table: str, columns: list[str]) -> None:
    SQL[name] = f"WITH files AS ({_FILES}), runs AS ({_RUNS}), {written_out(LEVELS)} {rounded(table)}"
    level = ["completions", "problems", "configurations"].index(table)
    QUERIES[name] = lambda spark, sf_dir: _rounded(_rollup(spark, sf_dir)[level].drop("type_annotations", *columns))


for _name, _table, _hidden in (("rollup_completions", "completions", []), ("rollup_problems", "problems", []), ("rollup_three_level", "configurations", [])):
    _rollup_query(_name, _table, _hidden)


@query(f"WITH files AS ({_FILES}), runs AS ({_RUNS}), {written_out(LEVELS)} SELECT config, problem_id, completion_id, array_to_string(type_annotations, '|') AS type_annotations FROM completions")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all files of a completion hold, each once."""
    return _rollup(spark, sf_dir)[0].select("config", "problem_id", "completion_id", F.array_join("type_annotations", "|").alias("type_annotations"))


@query("""
SELECT user_id, t_click, t_view, t_purchase FROM (
  SELECT user_id, min(ts) FILTER (WHERE event_type = 'click') AS t_click, min(ts) FILTER (WHERE event_type = 'view') AS t_view, min(ts) FILTER (WHERE event_type = 'purchase') AS t_purchase FROM events GROUP BY 1)
WHERE least(t_click, t_view, t_purchase) > TIMESTAMP '2024-01-03 00:00:00'
""")
def cutoff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("click", "view", "purchase")
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.min(F.when(F.col("event_type") == k, F.col("ts"))).alias(f"t_{k}") for k in kinds))
    return first.where(curate.after_cutoff([F.col(f"t_{k}") for k in kinds], F.lit("2024-01-03 00:00:00").cast(first.schema["t_click"].dataType)))


def _stream(length: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, md5(':' || doc_id) AS h, list_concat(list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS INT)), [-1]) AS ids FROM documents WHERE text <> ''),
s AS (SELECT ids, coalesce(sum(len(ids)) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
t AS (SELECT CAST(start + i - 1 AS BIGINT) AS pos, ids[i] AS id FROM (SELECT ids, start, unnest(range(1, len(ids) + 1)) AS i FROM s)),
c AS (SELECT pos // {length} AS chunk, count(*) AS n, CAST(sum(id * (pos % {length} + 1)) AS BIGINT) AS checksum FROM t GROUP BY 1)
"""


def _chunks(spark: SparkSession, sf_dir: str, pad: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.transform(F.split("text", " ", -1), lambda x: F.length(x)).alias("ids"))
    got = packing.constant_length(docs, "ids", "doc_id", 2048, -1, pad=pad)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long")
    weighed = F.aggregate(F.transform("input_ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("chunk", real.alias("n"), F.size("input_ids").alias("length"), weighed.alias("checksum"))


@query(_stream(2048) + "SELECT chunk, n, CAST(2048 AS INT) AS length, checksum FROM c WHERE n = 2048")
def token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, False)


@query(_stream(2048) + "SELECT chunk, n, CAST(2048 AS INT) AS length, CAST(checksum - (SELECT coalesce(sum(i), 0) FROM range(n + 1, 2049) r(i)) AS BIGINT) AS checksum FROM c")
def pad_last_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, True)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.sample_exact(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id", 7)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) <= 50 THEN 'validation' ELSE 'train' END AS part FROM documents")
def take_skip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, rest = curate.take_and_skip(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id", 3)
    return first.withColumn("part", F.lit("validation")).unionByName(rest.withColumn("part", F.lit("train")))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT (SELECT CAST(round_even(count(*) * 0.125, 0) AS BIGINT) FROM documents)")
def sampled_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "12.5%", "doc_id", 5)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) - 1 AS place FROM documents")
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row in the shuffled table, as its partitions follow each other."""
    rows = curate.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 9).withColumn("at", F.monotonically_increasing_id())
    counts = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.withColumn("part", F.shiftright("at", 33)).join(before, "part").select("doc_id", (F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1))).alias("place"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM documents WHERE n_chars % 3 < 2")
def predefined_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE n_chars % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'other' END").alias("split"))
    parts = curate.predefined_split(rows)
    return parts["train"].withColumn("part", F.lit("train")).unionByName(parts["test"].withColumn("part", F.lit("test"))).select("doc_id", "part")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '/' || lang || '.ts' END AS name FROM documents")
def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from repository and path; a table without them keeps what it has."""
    docs = table(spark, sf_dir, "documents")
    some = curate.with_name(docs.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("max_stars_repo_name"), F.concat("lang", F.lit(".ts")).alias("max_stars_repo_path")))
    rest = curate.with_name(docs.where("doc_id % 2 <> 0").select("doc_id", F.lit(None).cast("string").alias("name")))
    return some.select("doc_id", "name").unionByName(rest)


_DATE = "CASE doc_id % {k} WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '20' || (19 + doc_id % 5) || '-0' || (1 + doc_id % 9) || '-1' || (doc_id % 10) || 'T01:02:03.5Z' ELSE '20' || (20 + doc_id % 4) || '-12-3' || (doc_id % 2) || 'T00:00:00.000000Z' END"
_DATES = {d: _DATE.format(k=k) for d, k in zip(curate.DATES, (4, 5, 7), strict=True)}
_PARSED = "try_strptime(nullif({x}, ''), '%Y-%m-%dT%H:%M:%S.%fZ')"


@query("SELECT doc_id, " + ", ".join(f"coalesce(strftime({_PARSED.format(x=e)}, '%Y-%m-%d %H:%M:%S.%g'), '-') AS d{i}" for i, e in enumerate(_DATES.values())) + " FROM documents")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = [F.coalesce(F.date_format(text.parse_date(F.expr(e)), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("-")).alias(f"d{i}") for i, e in enumerate(_DATES.values())]
    return table(spark, sf_dir, "documents").select("doc_id", *parsed)


@query(f"WITH d AS (SELECT doc_id, {', '.join(f'{_PARSED.format(x=e)} AS d{i}' for i, e in enumerate(_DATES.values()))} FROM documents) SELECT doc_id FROM d WHERE coalesce(d0, d1, d2) IS NOT NULL AND coalesce(d0 > TIMESTAMP '2021-12-31', true) AND coalesce(d1 > TIMESTAMP '2021-12-31', true) AND coalesce(d2 > TIMESTAMP '2021-12-31', true)")
def created_after_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.created_after(table(spark, sf_dir, "documents").select("doc_id", *(F.expr(e).alias(d) for d, e in _DATES.items()))).select("doc_id")


_MEASURED = "doc_id, n_chars % 5 AS annotation_sites, n_chars % 3 AS type_definitions, n_chars % 120 AS loc, n_chars % 7 AS functions, (n_chars % 100) / 8.0 AS loc_per_function, n_chars % 9000 AS estimated_tokens"
_KEPT = ["annotation_sites > 0", "type_definitions > 0", "loc >= 50", "functions > 0", "loc_per_function >= 5", "estimated_tokens <= 4096"]
_STEP_NAMES = ["annotation_sites", "type_definitions", "loc", "functions", "loc_per_function", "estimated_tokens"]


@query(f"SELECT doc_id FROM (SELECT {_MEASURED} FROM documents) WHERE {' AND '.join(_KEPT)}")
def threshold_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT {_MEASURED} FROM {{documents}}", documents=table(spark, sf_dir, "documents"))
    return curate.threshold_filters(rows, _STEP_NAMES).select("doc_id")


@query(f"WITH d AS (SELECT {_MEASURED} FROM documents) SELECT 0 AS step, 'all' AS name, count(*) AS size FROM d " + " ".join(f"UNION ALL SELECT {i}, '{n}', count(*) FROM d WHERE {' AND '.join(_KEPT[:i])}" for i, n in enumerate(_STEP_NAMES, 1)))
def sizes_after_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT {_MEASURED} FROM {{documents}}", documents=table(spark, sf_dir, "documents"))
    return curate.sizes_after(rows, curate.THRESHOLDS)


@query("""
SELECT doc_id FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 5 NOT IN (1, 2, 3)
""")
def typescript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, of which some have another extension and some hold text that marks other formats."""
    marks = "CASE doc_id % 5 WHEN 1 THEN '<!DOCTYPE TS>' WHEN 2 THEN 'GOCAD TSurf 1' WHEN 3 THEN 'x @problemName' ELSE 'GOCAD TS' END"
    content = F.concat(F.col("text"), F.lit("\n"), F.expr(marks))
    return table(spark, sf_dir, "documents").where(curate.is_typescript(F.expr("CASE WHEN doc_id % 6 = 0 THEN 'tsx' ELSE 'ts' END"), content)).select("doc_id")


@query("SELECT page_id, url FROM pages WHERE NOT contains(html, 'https://') AND NOT contains(html, 'tracker') AND NOT contains(html, '!!')")
def content_blacklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(curate.lacks(F.col("html"), ("https://", "tracker", "!!"))).select("page_id", "url")


#: Lines of source code, and whether a file that holds one stands alone.
_LINES = [
    ("import a from 'b'", False), ("import{a} from 'b'", False), ("  import* as a from 'b'", False), ("importance = 1", True), ("const a = require('b')", False), ("const a = require ('b')", False),
    ("require('b')", True), ("const a = myrequire('b')", True), ("a = obj.require(1)", True), ("const a = require()", True), ("export { a };", False), ("export * from 'b'", False), ("export = a", False),
    ("export default a", True), ("export  async function f() {}", True), ("  export { a };", True), ("exported()", True), ("export_all()", True), ("export", True), ("export interface A {}", True), ("export let a", False), ("// import a", True),
]
_LINE = "CASE doc_id % {n} {w} END".format(n=len(_LINES), w=" ".join("WHEN {} THEN '{}'".format(i, x.replace("'", "''")) for i, (x, _) in enumerate(_LINES)))


@query(f"SELECT doc_id FROM documents WHERE doc_id % {len(_LINES)} IN ({', '.join(str(i) for i, (_, alone) in enumerate(_LINES) if alone)})")
def self_contained_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with one line of every kind between others; the lines are judged by hand."""
    content = F.concat(F.lit("let a = 1;\n"), F.expr(_LINE.replace("''", "\\'")), F.lit("\r\nfunction g() {}\n"))
    return table(spark, sf_dir, "documents").where(curate.self_contained(content)).select("doc_id")


@query("""
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS section FROM conversations
""")
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return lines.fill_forward(rows, F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "turn", F.lit(-1), "section").select("conv_id", "turn", F.col("section").cast("long").alias("section"))


@query("""
SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM events) GROUP BY 1, 2
""")
def sessionise_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.sessions(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), F.col("event_type") == "error", ["user_id"], "event_id", "session")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
WITH f AS (SELECT conv_id, 'f' || turn || '.ts' AS file, text AS content FROM conversations WHERE turn % 2 = 0),
e AS (SELECT conv_id, 'f' || turn || '.ts' AS file, list(text) AS errors FROM conversations WHERE turn % 3 = 0 GROUP BY ALL)
SELECT coalesce(f.conv_id, e.conv_id) AS conv_id, coalesce(f.file, e.file) AS file, coalesce(content, '') AS content, coalesce(array_to_string(errors, '|'), '') AS errors, coalesce(len(errors), 0) AS num_errors FROM f FULL JOIN e ON f.conv_id = e.conv_id AND f.file = e.file
""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("file", F.concat(F.lit("f"), "turn", F.lit(".ts")))
    files = rows.where("turn % 2 = 0").select("conv_id", "file", F.col("text").alias("content"))
    errors = rows.where("turn % 3 = 0").groupBy("conv_id", "file").agg(F.collect_list("text").alias("errors"))
    return lines.merge_files(files, errors, ["conv_id"]).select("conv_id", "file", "content", F.array_join("errors", "|").alias("errors"), F.size("errors").cast("long").alias("num_errors"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def keep_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").withColumn("ok", F.col("quality") == 1)
    return io.passed(docs.join(labels, "doc_id", "left_semi"), labels, "doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS hexsha, doc_id % 4 <> 0 AS ok, doc_id % 3 = 2 AS pending FROM documents")
def checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files checked, a third of them twice, another third after a stop; the rest is pending."""
    done = io.Checkpoint(spark, io.scratch(spark))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("hexsha"), (F.col("doc_id") % 4 != 0).alias("ok"), (F.col("doc_id") % 3).alias("k"))
    done.append(files.where("k = 0"))
    done.append(files.where("k = 0 and hexsha % 9 = 0"))
    done.append(done.pending(files.where("k < 2").select("hexsha")).join(files, "hexsha"))
    left = done.pending(files).select("hexsha", "ok", F.lit(True).alias("pending"))
    return done.done().withColumn("pending", F.lit(False)).unionByName(left)


@query("SELECT form, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('parquet'), ('jsonl'), ('csv'), ('orc'), ('folder')) f(form)")
def written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written and read in every form, by suffix."""
    nation, base, out = table(spark, sf_dir, "nation"), io.scratch(spark), None
    for form in ("parquet", "jsonl", "csv", "orc", "folder"):
        path = f"{base}/nation{'' if form == 'folder' else '.' + form}"
        back = io.existing_or(spark, path, lambda: nation).select(F.lit(form).alias("form"), *(F.col(c).cast(t).alias(c) for c, t in nation.dtypes))
        out = back if out is None else out.unionByName(back)
    return out


_BUNDLE = "CASE WHEN turn % 3 = 0 THEN '// FILE: ' || role || '.ts' || chr(10) ELSE '' END || text"


@query(f"""
WITH b AS (SELECT conv_id, string_agg({_BUNDLE}, chr(10) ORDER BY turn) AS content FROM conversations WHERE turn > 0 GROUP BY 1),
l AS (SELECT conv_id, unnest(string_split(rtrim(content, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(content, chr(10)), chr(10)), 1) AS pos FROM b WHERE content <> ''),
f AS (SELECT *, coalesce(last_value(nullif(regexp_extract(line, '^// FILE: (\\S+)$', 1), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'p' || conv_id) AS file FROM l)
SELECT conv_id, file, string_agg(line, chr(10) ORDER BY pos) AS content FROM f GROUP BY 1, 2
""")
def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of conversations written as bundles; a marker that comes again goes on with its file."""
    rows = spark.sql(f"SELECT conv_id, turn, {_BUNDLE} AS part FROM {{c}} WHERE turn > 0", c=table(spark, sf_dir, "conversations"))
    bundles = curate.gathered(rows, ["conv_id"], "turn", "part", "parts").select("conv_id", F.rtrim(F.array_join("parts", "\n"), F.lit("\n")).alias("content"), F.concat(F.lit("p"), "conv_id").alias("name"))
    return lines.split_files(bundles, ["conv_id"]).select("conv_id", "file", "content")


_BUNDLED = "'// FILE: a' || doc_id % 3 || '.ts' || chr(10) || 'let a = 1;' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '// FILE: b.ts' || chr(10) ELSE '' END || 'let b = 2;'"
_OUTPUT = f"CASE WHEN doc_id % 5 = 0 THEN 'let a = 1;' || chr(10) || 'let b = 2;' WHEN doc_id % 5 = 1 THEN 'let z = 0;' || chr(10) || {_BUNDLED} ELSE {_BUNDLED} END"
_ERROR = "'main.ts(' || {line} || ',1): error TS' || {code} || ': no' || chr(10)"
#: An error of two lines at line 1, one at line 3, one past the end, two at line 0, and one in a library.
_TSC_LOG = f"CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_ERROR.format(line=1, code=1)} || '  more' || chr(10) || {_ERROR.format(line=3, code=2)} || {_ERROR.format(line='(CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 5 = 1 THEN 5 ELSE 4 END + CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 0 THEN 1 ELSE 0 END)', code=3)} || {_ERROR.format(line=0, code=4)} || 'node_modules/m/index.ts(1,1): error TS5: skip' || chr(10) || {_ERROR.format(line=0, code=6)} END"


@query(f"WITH d AS (SELECT doc_id, {_OUTPUT} AS output FROM documents) SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN doc_id % 5 = 0 OR line_no = 0 OR (doc_id % 5 = 1 AND line_no = 1) THEN '' WHEN doc_id % 2 = 0 AND line_no >= CASE WHEN doc_id % 5 = 1 THEN 4 ELSE 3 END THEN 'b.ts' ELSE 'a' || doc_id % 3 || '.ts' END AS file FROM (SELECT doc_id, unnest(range(0, len(string_split(output, chr(10))) + 2)) AS line_no FROM d)")
def bundle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of every line, from line 0 to one past the last."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_OUTPUT).alias("content"))
    return lines.lines_to_file(rows, ["doc_id"])


@query("""
SELECT doc_id, CAST(record AS BIGINT) AS record, lines, head FROM documents, (VALUES (1, 2, 'TS1'), (2, 1, 'TS2'), (3, 1, 'TS3'), (4, 1, 'TS4'), (5, 1, 'TS5'), (6, 1, 'TS6')) r(record, lines, head) WHERE doc_id % 7 <> 0
""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header starts a record, other lines go on with it."""
    rows = lines.split_log(table(spark, sf_dir, "documents").select("doc_id", F.expr(_TSC_LOG).alias("tsc_logs")), ["doc_id"])
    return rows.select("doc_id", "record", F.size(text.lines(F.col("error"))).alias("lines"), F.regexp_extract("error", "error (TS\\d+)", 1).alias("head"))


@query("""
WITH d AS (SELECT doc_id, 'p' || doc_id AS name, 'a' || doc_id % 3 || '.ts' AS a, doc_id % 7 = 0 AS none, doc_id % 5 = 0 AS plain, doc_id % 5 = 1 AS lead, doc_id % 2 = 0 AS two FROM documents),
f AS (
  SELECT doc_id, name AS file, CASE WHEN none THEN '' ELSE 'TS1,TS2,TS3,TS4,TS5,TS6' END AS errors, CASE WHEN none THEN '' ELSE 'TS1,TS2,TS3,TS4,TS5,TS6' END AS every FROM d WHERE plain
  UNION ALL SELECT doc_id, a, CASE WHEN none THEN '' WHEN two AND lead THEN 'TS2' WHEN two THEN 'TS1' WHEN lead THEN 'TS2,TS3' ELSE 'TS1,TS2,TS3' END, NULL FROM d WHERE NOT plain
  UNION ALL SELECT doc_id, 'b.ts', CASE WHEN none THEN '' WHEN lead THEN 'TS3' ELSE 'TS2,TS3' END, NULL FROM d WHERE NOT plain AND two
  UNION ALL SELECT doc_id, name, 'TS6', CASE WHEN lead THEN 'TS1,TS4,TS6' ELSE 'TS4,TS6' END FROM d WHERE NOT plain AND NOT none)
SELECT doc_id, file, errors, coalesce(every, errors) AS all_errors FROM f
""")
def errors_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles, plain outputs and empty logs; what each file must get is worked out by hand."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), "doc_id").alias("name"), F.expr(_OUTPUT).alias("output"), F.expr(_TSC_LOG).alias("tsc_logs"))
    codes = lambda c: F.array_join(F.transform(c, lambda x: F.regexp_extract(x, "error (TS\\d+)", 1)), ",").alias(c)
    return lines.split_errors(rows, ["doc_id"]).select("doc_id", "file", codes("errors"), codes("all_errors"))


@query("""
WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 7 = 0 OR event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE value END AS x, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END AS flag FROM events)
SELECT event_type, round(coalesce(sum(x) FILTER (WHERE NOT isnan(x)), 0), 6) AS total, round(coalesce(avg(x) FILTER (WHERE NOT isnan(x)), CAST('NaN' AS DOUBLE)), 6) AS mean, count(*) FILTER (WHERE flag) AS flagged, CAST(coalesce(sum(user_id) FILTER (WHERE user_id > 1000000), 0) AS BIGINT) AS none FROM e GROUP BY 1
""")
def reduced_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, means and counts that pass over NaN and NULL; 0 where nothing is left to sum."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.expr("CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 7 = 0 OR event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE value END").alias("x"), F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END").alias("flag"))
    rows = rows.withColumn("big", F.when(F.col("user_id") > 1000000, F.col("user_id")))
    return rows.groupBy("event_type").agg(F.round(measures.nan_sum("x"), 6).alias("total"), F.round(measures.nan_mean("x"), 6).alias("mean"), measures.truthy("flag").alias("flagged"), measures.long_sum("big").alias("none"))


@query("""
WITH w AS (SELECT conv_id, role, list_distinct(list_filter(flatten(list(string_split(text, ' '))), lambda x: x <> '')) AS words FROM conversations GROUP BY 1, 2)
SELECT u.conv_id, len(list_intersect(u.words, a.words)) AS both, len(u.words) - len(list_intersect(u.words, a.words)) AS user_only, len(list_distinct(list_concat(u.words, a.words))) AS either
FROM w u JOIN w a ON u.conv_id = a.conv_id WHERE u.role = 'user' AND a.role = 'assistant'
""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.array_remove(F.array_distinct(F.flatten(F.collect_list(F.split("text", " ", -1)))), "").alias("words"))
    u, a = (words.where(F.col("role") == r).select("conv_id", F.col("words").alias(r)) for r in ("user", "assistant"))
    size = lambda x: F.size(x).cast("long")
    return u.join(a, "conv_id").select("conv_id", size(F.array_intersect("user", "assistant")).alias("both"), size(F.array_except("user", "assistant")).alias("user_only"), size(F.array_union("user", "assistant")).alias("either"))


_PAIRS = "SELECT u.conv_id, u.turn, u.text AS one, a.text AS two FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    u = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("one"))
    a = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("two"))
    return u.join(a, ["conv_id", "turn"])


@query(f"""
WITH p AS (SELECT conv_id, turn, string_split(one, ' ') AS a, string_split(two, ' ') AS b FROM ({_PAIRS}))
SELECT conv_id, turn, round(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) / CAST(greatest(len(a), len(b)) AS DOUBLE), 9) AS accuracy FROM p
""")
def positional_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(measures.positional_accuracy(F.split("one", " ", -1), F.split("two", " ", -1)), 9).alias("accuracy"))


@query()
def levenshtein_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no longest common subsequence; tests compare with dynamic programming."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", measures.indel_ratio("one", "two").alias("ratio"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS BIGINT) AS loc FROM documents")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.count_lines_of_code(F.col("text")).alias("loc"))


_PREFIX = "regexp_replace(substr({s}, 1, {n}), '\\n[^\\n]*\\z', '')"
_SUFFIX = "regexp_replace(CASE WHEN {n} >= length({s}) THEN {s} ELSE right({s}, {n}) END, '\\A[^\\n]*\\n', '')"


@query("SELECT doc_id, " + _PREFIX.format(s="text", n=200) + " AS head, " + _SUFFIX.format(s="text", n=200) + " AS tail FROM documents")
def prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.prefix_of_lines(t, 200).alias("head"), text.suffix_of_lines(t, 200).alias("tail"))


@query(f"""
SELECT conv_id, turn, CASE WHEN length(one) < 150 THEN one WHEN length(two) < 150 THEN {_SUFFIX.format(s='one', n='(300 - length(two))')} ELSE {_SUFFIX.format(s='one', n=150)} END AS one,
  CASE WHEN length(one) < 150 THEN {_PREFIX.format(s='two', n='(300 - length(one))')} WHEN length(two) < 150 THEN two ELSE {_PREFIX.format(s='two', n=150)} END AS two FROM ({_PAIRS})
""")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = text.clip(F.col("one"), F.col("two"), 300)
    return _pairs(spark, sf_dir).select("conv_id", "turn", one.alias("one"), two.alias("two"))


_ENDS = "[\\n\\x0B\\f\\r\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"


@query(f"""
WITH l AS (SELECT doc_id, regexp_extract_all(text, '(?s)(\\r\\n|[^\\n\\x0B\\f\\r\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]*(?:\\r\\n|{_ENDS})|[^\\n\\x0B\\f\\r\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]+)') AS own FROM documents),
s AS (SELECT doc_id, list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'now': ''}}, list_transform(own, lambda x: {{'done': CAST([] AS VARCHAR[]), 'now': x}})),
  lambda a, x: CASE WHEN length(a.now) + length(x.now) > 400 THEN {{'done': list_append(a.done, a.now), 'now': x.now}} ELSE {{'done': a.done, 'now': a.now || x.now}} END) AS r FROM l),
p AS (SELECT doc_id, list_append(r.done, r.now) AS parts FROM s)
SELECT doc_id, CAST(unnest(range(len(parts))) AS INT) AS part, unnest(parts) AS slice FROM p
""")
def slice_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.slices(F.col("text"), 400)).alias("part", "slice"))


@query(f"""
SELECT conv_id, turn, regexp_replace('<commit_before>' || one || '<commit_msg>Answer<commit_after>' || left(two, 20), '^\\s+|\\s+$', '', 'g') AS edit, regexp_replace('<fim_prefix>' || one || '<fim_suffix>' || two || '<fim_middle>', '^\\s+|\\s+$', '', 'g') AS infill FROM ({_PAIRS})
""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = F.col("one"), F.col("two")
    return _pairs(spark, sf_dir).select("conv_id", "turn", text.edit_prompt(one, F.lit("Answer"), F.substring(two, 1, 20)).alias("edit"), text.infill_prompt(one, two).alias("infill"))


@query("SELECT event_id, CAST(CAST(floor(event_id * 7.9 / 3600) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(event_id * 7.9) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(event_id * 7.9) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS took FROM events")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.duration_text(F.col("event_id") * F.lit(7.9)).alias("took"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) + 2 AS BIGINT) AS estimated_tokens FROM documents")
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a text with the two around it, by a tokenizer that SQL has as well."""
    from ..operators import programs

    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return programs.add_token_count(rows, lambda x: F.split(x, " ", -1), 2).drop("content")


@query(f"""
SELECT conv_id, turn, '<commit_before>' || one || '<commit_msg>' || 'Answer' || '<commit_after>' || two AS content FROM ({_PAIRS}) WHERE regexp_matches(one, '\\S') AND regexp_matches(two, '\\S') AND one <> two
""")
def commit_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _pairs(spark, sf_dir).select("conv_id", "turn", text.commit_format(F.col("one"), F.lit("Answer"), F.col("two")).alias("content"))
    return made.where("content is not null and content <> ''")


@query("SELECT text, list_sort(list(doc_id)) AS completion_ids, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "documents").select(F.lit("c").alias("config"), F.lit(0).alias("problem_id"), F.col("text").alias("output"), F.col("doc_id").alias("completion_id"), F.lit(True).alias("correct"))
    return rollup.correct_groups(done).where("n > 1").select(F.col("output").alias("text"), "completion_ids", "n")


_REPORT = "SELECT 'm' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '_ts' ELSE '_js' END AS model, n_name, count(*) AS tot_completions, count(*) FILTER (WHERE o_orderstatus = 'F') AS tot_pkg_parses, count(*) FILTER (WHERE o_totalprice > 100000) AS tot_files, count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus = 'O') AS tot_files_parse FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL"


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    dear = F.col("o_totalprice") > 100000
    rows = orders.join(owner, "o_custkey").groupBy("n_nationkey").agg(F.count("*").alias("tot_completions"), F.count_if(F.col("o_orderstatus") == "F").alias("tot_pkg_parses"), F.count_if(dear).alias("tot_files"), F.count_if(dear & (F.col("o_orderstatus") == "O")).alias("tot_files_parse"))
    name = F.concat(F.lit("m"), F.col("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "_ts").otherwise("_js"))
    return rows.join(nation, "n_nationkey").withColumn("model", name)


_NAMED = "CASE WHEN ends_with(model, '_ts') THEN 'TS-Sourced' ELSE 'JS-Sourced' END AS Dataset, model[:-4] AS Model"


@query(f"SELECT {_NAMED}, tot_pkg_parses AS pkg_n, tot_completions AS pkg_tot, round(tot_pkg_parses / tot_completions::DOUBLE * 100, 9) AS pkg_percent, tot_files_parse AS file_n, tot_files AS file_tot, round(tot_files_parse / nullif(tot_files, 0)::DOUBLE * 100, 9) AS file_percent FROM ({_REPORT})")
def percent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.percent_table(_report(spark, sf_dir), "parses"))


@query(f"SELECT Dataset, Model, scope, n, tot, percent FROM (SELECT {_NAMED}, unnest(['Packages', 'Files']) AS scope, unnest([tot_pkg_parses, tot_files_parse]) AS n, unnest([tot_completions, tot_files]) AS tot, round(unnest([tot_pkg_parses / tot_completions::DOUBLE * 100, tot_files_parse / nullif(tot_files, 0)::DOUBLE * 100]), 9) AS percent FROM ({_REPORT}))")
def pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.by_scope(report.percent_table(_report(spark, sf_dir), "parses")))


@query(f"SELECT {_NAMED}, format('{{:,}}', tot_completions) || ' & ' || format('{{:,}}', tot_files) || ' \\\\' AS line FROM ({_REPORT})")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.named(_report(spark, sf_dir))
    return rows.select("Dataset", "Model", F.concat(F.concat_ws(" & ", text.whole_text(F.col("tot_completions")), text.whole_text(F.col("tot_files"))), F.lit(" \\\\")).alias("line"))


_NAMED_CONFIG = "model || '_m' || CASE WHEN model < 'f' THEN '_ts' ELSE '_js' END"
_PERCENTS = [
    ("parses", "tot_pkg_parses", "tot_completions", "tot_files_parse", "tot_files"), ("typechecks", "tot_type_checks", "tot_completions", "tot_errorfree_files", "tot_files"), ("unchanged", "tot_pkg_unchanged", "tot_completions", "tot_files_unchanged", "tot_files"),
    ("trivial_annotations", "tot_errorfree_files", "tot_annotations_trivial_errorfree_files", "tot_annotations_added_errorfree_files"), ("filled_annotations", "tot_files_parse", "tot_annotations_added_files_parse", "tot_annotation_sites_files_parse"),
    ("type_defs_added", "tot_files_parse", "tot_definitions_added_files_parse", "tot_definitions_files_parse"), ("type_defs_used", "tot_files_parse", "tot_definitions_used_files_parse", "tot_definitions_files_parse"), ("correct", "tot_correct", "tot_files"),
]


def _line_sql(name: str, *columns: str) -> str:
    """The LaTeX rows of one table, formatted by DuckDB."""
    whole, percent = (lambda c: f"format('{{:,}}', {c})"), (lambda a, b: f"format('{{:,.1f}}', {a} / CAST({b} AS DOUBLE) * 100)")
    if len(columns) == 4:
        a, b, c, d = columns
        cells = [whole(a), whole(b), percent(a, b), whole(c), whole(d), percent(c, d)]
    else:
        *lead, n, tot = columns
        cells = [*map(whole, lead), whole(n), whole(tot), percent(n, tot)]
    return f"SELECT '{name}' AS name, " + " || ' & ' || ".join(["CASE WHEN ends_with(config, '_ts') THEN 'TS-Sourced' ELSE 'JS-Sourced' END", "CASE WHEN starts_with(config, 'en') THEN 'English' ELSE config[:-4] END", *cells]) + " || ' \\\\' AS line FROM named"


@query(f"WITH files AS ({_FILES}), runs AS ({_RUNS}), {written_out(LEVELS)}, named AS (SELECT *, {_NAMED_CONFIG} AS config FROM configurations) {' UNION ALL '.join(_line_sql(*p) for p in _PERCENTS)}")
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The LaTeX rows of all eight tables, over the configurations of the rollup."""
    summary = _rollup(spark, sf_dir)[2].withColumn("model", F.expr(_NAMED_CONFIG))
    out = None
    for name, *_ in _PERCENTS:
        rows = report.latex_rows(report.percent_table(summary, name, {"en": "English"})).withColumn("name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("name", "line")


@query(f"WITH files AS ({_FILES}), runs AS ({_RUNS}), {written_out(LEVELS)} SELECT model, num_problems, printf('%.1f%%', pct_pkg_parses * 100) AS pct_pkg_parses, printf('%.1f', errors_per_file) AS errors_per_file, printf('%.1f%%', avg_levenshtein * 100) AS avg_levenshtein, printf('%.1f', avg_annotations_added) AS avg_annotations_added, printf('%.1f%%', \"pass@1_files\" * 100) AS \"pass@1_files\" FROM configurations WHERE model <> 'en'")
def shown_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as a reader sees them, of all configurations but one."""
    found = [lookup.summary_of(_rollup(spark, sf_dir)[2], c) for c in ("de", "es", "fr")]
    rows = found[0].unionByName(found[1]).unionByName(found[2]).select("model", "num_problems", "pct_pkg_parses", "errors_per_file", "avg_levenshtein", "avg_annotations_added", "`pass@1_files`")
    return lookup.shown(rows)


@query(f"WITH runs AS ({_RUNS}) SELECT config, problem_id, completion_id, pkg_parses FROM runs WHERE completion_id = 3 OR completion_id = 7")
def completion_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One completion of every problem, by its index."""
    runs = _rollup(spark, sf_dir)[0]
    return lookup.completion_at(runs, F.col("problem_id"), 3).unionByName(lookup.completion_at(runs, F.col("problem_id"), 7)).select("config", "problem_id", "completion_id", "pkg_parses")


@query("""
SELECT conv_id, pos - 1 AS completion_id, steps[pos] AS output, len(steps) AS num_completions FROM (
  SELECT conv_id, steps, unnest(range(1, len(steps) + 1)) AS pos FROM (SELECT conv_id, list(text ORDER BY turn) AS steps FROM conversations GROUP BY 1))
""")
def explode_results_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = curate.gathered(table(spark, sf_dir, "conversations").repartition(7, "text"), ["conv_id"], "turn", "text", "results")
    return curate.exploded(nested, ["conv_id"], "results", "completion_id", "completion").select("conv_id", "completion_id", F.col("completion").alias("output"), "num_completions")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def replace_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("quality"))
    return curate.replace_by_key(docs, table(spark, sf_dir, "labels"), ["doc_id"], "quality").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT role, text FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT role, text FROM conversations WHERE turn % 2 <> 0) GROUP BY 1")
def partition_and_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no = curate.partition_by(table(spark, sf_dir, "conversations").select("role", "turn", "text"), F.col("turn") % 2 == 0)
    return yes.unionByName(no).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""
WITH n AS (SELECT n_nationkey, n_regionkey AS problem, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS completion, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS step FROM nation)
SELECT 'forward' AS move, step, problem, completion FROM n UNION ALL SELECT 'backward', max(step) OVER () - step, problem, completion FROM n
UNION ALL SELECT 'next', problem, problem, 0 FROM n WHERE completion = 0 UNION ALL SELECT 'previous', max(problem) OVER () - problem, problem, 0 FROM n WHERE completion = 0
UNION ALL SELECT 'goto', step, problem, completion FROM n UNION ALL SELECT 'goto problem', problem, problem, 0 FROM n WHERE completion = 0
""")
def viewer_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks through all completions, with regions for problems and nations for completions, until a move leads nowhere."""
    sizes = [r["count"] for r in table(spark, sf_dir, "nation").groupBy("n_regionkey").count().orderBy("n_regionkey").collect()]
    rows: list[tuple[str, int, int, int]] = []
    ends = {"forward": (0, 0), "backward": (len(sizes) - 1, sizes[-1] - 1), "next": (0, 0), "previous": (len(sizes) - 1, 0)}
    for move, at in ends.items():
        for place in range(sum(sizes) + 1):
            rows.append((move, place, *at))
            try:
                at = lookup.step(at, move, sizes)
            except IndexError:
                break
    named = [(p, c) for p, size in enumerate(sizes) for c in range(size)]
    rows += [("goto", i, *lookup.goto((p, 0), f".{c}" if c % 2 else f"{p}.{c}", sizes)) for i, (p, c) in enumerate(named)]
    rows += [("goto problem", p, *lookup.goto((0, 1), f"{p}." if p % 2 else f"{p}", sizes)) for p in range(len(sizes))]
    return spark.createDataFrame(rows, "move string, step long, problem int, completion long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 7, 11)")
def selected_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Things picked from a list by their places."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    return spark.createDataFrame(lookup.selected(nation.collect(), [7, 3, 11]), nation.schema)
