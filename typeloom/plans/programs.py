"""Queries of the program operators over programs written from the documents table, each beside its SQL.

The tables hold no source code, so every document becomes a program of one of five shapes, with its id, source and
language in it. The SQL says what must come out of each shape, worked out by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import programs
from ..sources import io
from ..streaming.checkpointed import check_new_files

#: The program of a document, in SQL that both engines read. Shapes: arrow, typed, class, broken, comment.
PROGRAM = """CASE doc_id % 5
  WHEN 0 THEN 'const f' || doc_id || ' = x => x + ' || doc_id || ';' || chr(10)
  WHEN 1 THEN 'interface P' || doc_id || ' { x: number; y: any }' || chr(10) || 'function g(p: P' || doc_id || ', q?: Q' || doc_id || '): string {' || chr(10) || '  return (p.x as any) + q;' || chr(10) || '}' || chr(10)
  WHEN 2 THEN '// ' || source || chr(10) || 'export type U' || doc_id || ' = string | null;' || chr(10) || 'class K' || doc_id || ' {' || chr(10) || '  z: Function;' || chr(10) || '  m(): U' || doc_id || ' { let v: any[] = []; }' || chr(10) || '}' || chr(10)
  WHEN 3 THEN 'let x' || doc_id || ' = ;' || chr(10)
  ELSE '// only ' || lang || chr(10) END"""
#: Types removed; with the comment before a definition (shape 2) as well.
UNTYPED = f"""CASE doc_id % 5
  WHEN 1 THEN chr(10) || 'function g(p, q?) {{' || chr(10) || '  return (p.x) + q;' || chr(10) || '}}' || chr(10)
  WHEN 2 THEN chr(10) || chr(10) || 'class K' || doc_id || ' {{' || chr(10) || '  z;' || chr(10) || '  m() {{ let v = []; }}' || chr(10) || '}}' || chr(10)
  ELSE {PROGRAM} END"""
_BARE_TYPED = "'function g(p, q?) {' || chr(10) || '  return (p.x) + q;' || chr(10) || '}'"
_ANNOTATED_TYPED = "'function g(p: P' || doc_id || ', q?: Q' || doc_id || '): string {' || chr(10) || '  return (p.x as any) + q;' || chr(10) || '}'"
_BARE_CLASS = "'// ' || source || chr(10) || chr(10) || 'class K' || doc_id || ' {' || chr(10) || '  z;' || chr(10) || '  m() { let v = []; }' || chr(10) || '}'"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name (the document's id) and content of every program."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("name"), F.expr(PROGRAM).alias("content"))


def _listed(*values: str) -> str:
    """A CASE over the shapes; the last value is for all others."""
    return f"CASE doc_id % 5 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(values[:-1]))} ELSE {values[-1]} END"


@query(f"""
SELECT doc_id AS name, doc_id % 5 <> 3 AS valid, CAST({_listed('1', '5', '3', '-1', '0')} AS BIGINT) AS sites, CAST({_listed('1', '5', '3', '-1', '0')} AS BIGINT) AS outer_sites,
  {_listed("''", "'number|any|P' || doc_id || '|Q' || doc_id || '|string'", "'Function|U' || doc_id || '|any[]'", "'-'", "''")} AS annotations,
  CAST({_listed('0', '1', '2', '-1', '0')} AS BIGINT) AS trivial, {_listed("''", "'P' || doc_id", "'U' || doc_id || '|K' || doc_id", "'-'", "''")} AS definitions,
  {_listed("''", "'P' || doc_id", "'U' || doc_id", "'-'", "''")} AS used, {_listed("''", "'Q' || doc_id", "'Function'", "'-'", "''")} AS undefined, {_listed('false', 'false', 'false', 'false', 'true')} AS empty
FROM documents
""")
def ts_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What broken programs hold is the parser's own, so only that they are broken is compared."""
    told = corpus(spark, sf_dir).withColumn("f", programs.facts("content", "valid", "sites", "outer_sites", "annotations", "trivial", "definitions", "used", "undefined", "empty"))
    known = lambda c, other: F.when(F.col("f.valid"), c).otherwise(other)
    joined = [known(F.array_join(f"f.{c}", "|"), "-").alias(c) for c in ("annotations", "definitions", "used", "undefined")]
    return told.select("name", F.col("f.valid").alias("valid"), *(known(F.col(f"f.{c}"), -1).alias(c) for c in ("sites", "outer_sites", "trivial")), known(F.col("f.empty"), False).alias("empty"), *joined)


@query(f"SELECT doc_id AS name, {UNTYPED} AS content_without_types FROM documents WHERE doc_id % 5 <> 3")
def ts_strip_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.strip_types(programs.only_valid(corpus(spark, sf_dir))).select("name", "content_without_types")


@query(f"""
SELECT doc_id AS name, CAST({_listed('1', '5', '3', '0')} AS BIGINT) AS annotation_sites, CAST({_listed('0', '1', '1', '0')} AS BIGINT) AS type_definitions, CAST({_listed('1', '3', '4', '0')} AS BIGINT) AS loc,
  CAST({_listed('1', '1', '1', '0')} AS BIGINT) AS functions, CAST({_listed('1', '1', '1', '0')} AS DOUBLE) AS loc_per_function FROM documents WHERE doc_id % 5 <> 3
""")
def ts_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.add_metrics(programs.only_valid(corpus(spark, sf_dir))).drop("content")


@query("SELECT doc_id AS name, 'const f' || doc_id || ' = (x) => x + ' || doc_id || ';' || chr(10) AS parenthesized, 'const f' || doc_id || '|' || ' = x => x + ' || doc_id || ';' || chr(10) AS chunks FROM documents WHERE doc_id % 5 = 0")
def ts_parenthesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = programs.facts("content", "parenthesized", "chunks")
    return corpus(spark, sf_dir).where("name % 5 = 0").select("name", told["parenthesized"].alias("parenthesized"), F.array_join(told["chunks"], "|").alias("chunks"))


@query("""
SELECT doc_id AS name, CASE WHEN doc_id % 5 = 1 THEN 'interface P' || doc_id || ' { x|: number; y|: any }' || chr(10) || 'function g(p|: P' || doc_id || ', q?: Q' || doc_id || '|)|: string {' || chr(10) || '  return (p.x as any) + q;' || chr(10) || '}' || chr(10)
  ELSE '// ' || source || chr(10) || 'export type U' || doc_id || ' = string | null;' || chr(10) || 'class K' || doc_id || ' {' || chr(10) || '  z|: Function;' || chr(10) || '  m()|: U' || doc_id || ' { let v|: any[] = []; }' || chr(10) || '}' || chr(10) END AS chunks
FROM documents WHERE doc_id % 5 IN (1, 2)
""")
def ts_split_at_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where("name % 5 in (1, 2)").select("name", F.array_join(programs.fact("content", "chunks"), "|").alias("chunks"))


@query(f"SELECT doc_id AS name, CASE doc_id % 5 WHEN 2 THEN substr({PROGRAM}, 4 + length(source)) WHEN 4 THEN chr(10) ELSE {PROGRAM} END AS uncommented, doc_id % 5 = 4 AS empty FROM documents WHERE doc_id % 5 <> 3")
def ts_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where("name % 5 <> 3").select("name", programs.fact("content", "uncommented").alias("uncommented"), programs.is_empty("content").alias("empty"))


@query("""
SELECT doc_id AS name, CASE doc_id % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'P' || doc_id || '[]' WHEN 2 THEN '{ a: (b: number) => void }' WHEN 3 THEN NULL ELSE 'Map<string, any>' END AS type FROM documents
""")
def ts_extract_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that a generated text begins with."""
    generated = F.expr("CASE name % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'P' || name || '[] = []; let y: string' WHEN 2 THEN '{ a: (b: number) => void } = z' WHEN 3 THEN '' ELSE 'Map<string, any>; f(a: Q) {}' END")
    return corpus(spark, sf_dir).select("name", programs.fact(generated, "type").alias("type"))


@query("""
WITH d AS (SELECT doc_id, length(CAST(doc_id AS VARCHAR)) AS n FROM documents)
SELECT doc_id AS name, 'definition' AS capture, 'type_identifier' AS kind, CAST(10 AS INT) AS start, 'P' || doc_id AS text FROM d WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, 'function', 'identifier', CAST(43 + n AS INT), 'g' FROM d WHERE doc_id % 5 = 1
UNION ALL SELECT d.doc_id, 'definition', 'type_identifier', CAST(16 + length(source) AS INT), 'U' || d.doc_id FROM d JOIN documents USING (doc_id) WHERE doc_id % 5 = 2
UNION ALL SELECT doc_id, 'function', 'identifier', CAST(6 AS INT), 'f' || doc_id FROM d WHERE doc_id % 5 = 0
""")
def ts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of definitions and functions, by a query over the trees."""
    wanted = "[(interface_declaration name: (_) @definition) (type_alias_declaration name: (type_identifier) @definition) (function_declaration name: (identifier) @function) (variable_declarator name: (identifier) @function value: (arrow_function))]"
    return programs.query(corpus(spark, sf_dir).where("name % 5 <> 3"), "name", wanted)


@query("SELECT doc_id AS name, unnest(CASE doc_id % 5 WHEN 1 THEN ['type_annotation', 'type_annotation', 'type_annotation', 'type_annotation', 'type_annotation'] ELSE ['type_annotation', 'type_annotation', 'type_annotation'] END) AS kind FROM documents WHERE doc_id % 5 IN (1, 2)")
def ts_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that stand in no other one, by intervals of the node table."""
    files = corpus(spark, sf_dir).where("name % 5 in (1, 2)")
    nodes = programs.syntax_nodes(files, "name")
    return programs.outermost(nodes, "name", ("type_annotation",)).select("name", "kind")


@query()
def ts_syntax_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table itself is the parser's own; queries over it are compared."""
    return programs.syntax_nodes(corpus(spark, sf_dir), "name")


def _commit(before: str, message: str, after: str) -> str:
    return f"'<commit_before>' || {before} || '<commit_msg>' || {message} || '<commit_after>' || {after}"


_TRIMMED = f"rtrim({PROGRAM}, chr(10))"
_CLASS_WITHOUT_ANNOTATIONS = "'// ' || source || chr(10) || 'export type U' || doc_id || ' = string | null;' || chr(10) || 'class K' || doc_id || ' {' || chr(10) || '  z;' || chr(10) || '  m() { let v = []; }' || chr(10) || '}'"
_CLASS_WITHOUT_DEFINITIONS = "'// ' || source || chr(10) || chr(10) || 'class K' || doc_id || ' {' || chr(10) || '  z: Function;' || chr(10) || '  m(): U' || doc_id || ' { let v: any[] = []; }' || chr(10) || '}'"
_TYPED_WITHOUT_ANNOTATIONS = f"'interface P' || doc_id || ' {{ x; y }}' || chr(10) || {_BARE_TYPED}"
_STEP = "contains('02468ace', substr(md5('0:' || doc_id || ':step'), 32))"


@query(f"""
SELECT doc_id AS name, 'all_at_once' AS form, CASE doc_id % 5 WHEN 1 THEN {_commit(_BARE_TYPED, "'Add type annotations and interfaces'", _TRIMMED)} ELSE {_commit(_BARE_CLASS, "'Add type annotations and interfaces'", _TRIMMED)} END AS content
FROM documents WHERE doc_id % 5 IN (1, 2)
UNION ALL
SELECT doc_id, 'definitions_first', CASE WHEN doc_id % 5 = 1 THEN CASE WHEN {_STEP} THEN {_commit(_BARE_TYPED, "'Add type aliases and interfaces'", _TYPED_WITHOUT_ANNOTATIONS)} ELSE {_commit(_TYPED_WITHOUT_ANNOTATIONS, "'Add type annotations'", _TRIMMED)} END
  ELSE CASE WHEN {_STEP} THEN {_commit(_BARE_CLASS, "'Add type aliases and interfaces'", _CLASS_WITHOUT_ANNOTATIONS)} ELSE {_commit(_CLASS_WITHOUT_ANNOTATIONS, "'Add type annotations'", _TRIMMED)} END END
FROM documents WHERE doc_id % 5 IN (1, 2)
UNION ALL
SELECT doc_id, 'annotations_first', CASE WHEN doc_id % 5 = 1 THEN CASE WHEN {_STEP} THEN {_commit(_BARE_TYPED, "'Add type annotations'", _ANNOTATED_TYPED)} ELSE {_commit(_ANNOTATED_TYPED, "'Add type aliases and interfaces'", _TRIMMED)} END
  ELSE CASE WHEN {_STEP} THEN {_commit(_BARE_CLASS, "'Add type annotations'", _CLASS_WITHOUT_DEFINITIONS)} ELSE {_commit(_CLASS_WITHOUT_DEFINITIONS, "'Add type aliases and interfaces'", _TRIMMED)} END END
FROM documents WHERE doc_id % 5 IN (1, 2)
UNION ALL
SELECT doc_id, 'one_by_one', CASE doc_id % 5 WHEN 1 THEN {_commit(f"chr(10) || {_ANNOTATED_TYPED}", "'Add a type alias or interface for P' || doc_id", _TRIMMED)} ELSE {_commit(_CLASS_WITHOUT_DEFINITIONS, "'Add a type alias or interface for U' || doc_id", _TRIMMED)} END
FROM documents WHERE doc_id % 5 IN (1, 2)
""")
def ts_training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four forms. Programs without types, and those of comments alone, give no example."""
    files = corpus(spark, sf_dir).where("name % 5 <> 3")
    made = [programs.usable(programs.training_examples(files, form, "name")).withColumn("form", F.lit(form)) for form in programs.rewrite.FORMS]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3]).select("name", "form", "content")


@query(f"""
SELECT doc_id AS name, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN {_commit(PROGRAM, "'Rename'", f"'// new' || chr(10) || {PROGRAM}")} END AS content FROM documents WHERE doc_id % 5 <> 3
""")
def ts_commit_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL where a side is nothing but comments."""
    content = F.col("content")
    made = text.commit_format(content, F.lit("Rename"), F.concat(F.lit("// new\n"), content), programs.is_empty)
    return corpus(spark, sf_dir).where("name % 5 <> 3").select("name", made.alias("content"))


class Annotator:
    """A model that writes a type N after `x` of an arrow, defines N when asked to, and knows nothing else."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answer(*p.removeprefix("<commit_before>").removesuffix("<commit_after>").split("<commit_msg>")) for p in prompts]

    @staticmethod
    def answer(code: str, wish: str) -> str:
        if wish.startswith("Add a type alias"):
            return f"type N = number;\n{code}"
        return code.replace("= x =>", "= (x: N) =>") if wish == "Add type annotations" and "= x =>" in code else ""


_ANNOTATED = "'const f' || doc_id || ' = (x: N) => x + ' || doc_id || ';' || chr(10)"


@query(f"""
WITH p AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN {PROGRAM} WHEN 5 THEN NULL END AS code, {_ANNOTATED} AS made FROM documents WHERE doc_id % 5 = 0),
a AS (
  SELECT doc_id, 'at_once' AS approach, '' AS output, [{{'input': code, 'prompt': 'Add type annotations and interfaces'}}] AS steps FROM p
  UNION ALL SELECT doc_id, 'definitions_first', '', [{{'input': code, 'prompt': 'Add type aliases and interfaces'}}, {{'input': '', 'prompt': 'Add type annotations'}}] FROM p
  UNION ALL SELECT doc_id, 'annotations_first', '', [{{'input': code, 'prompt': 'Add type annotations'}}, {{'input': made, 'prompt': 'Add type aliases and interfaces'}}] FROM p
  UNION ALL SELECT doc_id, 'until_defined', 'type N = number;' || chr(10) || made, [{{'input': code, 'prompt': 'Add type annotations'}}, {{'input': made, 'prompt': 'Add a type alias or interface for N'}}] FROM p)
SELECT doc_id AS name, approach, CAST(c AS INT) AS completion_id, CAST(c AS INT) AS generation, CASE WHEN code IS NOT NULL THEN output END AS output, code IS NULL OR output = '' AS error,
  CASE WHEN code IS NULL THEN '' ELSE array_to_string(list_transform(steps, lambda s: s.input || '>' || s.prompt), '|') END AS steps
FROM a JOIN p USING (doc_id), range(2) t(c)
""")
def ts_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All approaches, two completions each; programs that are NULL are never asked about."""
    files = corpus(spark, sf_dir).where("name % 5 = 0").select("name", F.when(F.col("name") % 10 == 0, F.col("content")).alias("content_without_types"))
    made = [programs.infer(files, a, Annotator(), 2, "name").withColumn("approach", F.lit(a)) for a in programs.APPROACHES]
    steps = F.array_join(F.transform("steps", lambda s: F.concat(s["input"], F.lit(">"), s["prompt"])), "|").alias("steps")
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3]).select("name", "approach", "completion_id", "generation", "output", "error", steps)


def _fill(before: str, after: str) -> str:
    """A model that types parameters as number and follows a type with more code; what stands after a list it can't tell."""
    return "number, z: string" if before.endswith("x: ") else "= 5" if before.endswith("): ") else "Function; f()"


@query("""
SELECT doc_id AS name, CASE doc_id % 5 WHEN 0 THEN 'const f' || doc_id || ': Function = (x: number): any => x + ' || doc_id || ';' || chr(10)
  WHEN 1 THEN chr(10) || 'function g(p: Function, q?: Function): any {' || chr(10) || '  return (p.x) + q;' || chr(10) || '}' || chr(10) END AS output
FROM documents WHERE doc_id % 5 IN (0, 1)
""")
def ts_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type in every gap, one by one; `any` where the model says none."""
    return programs.infill(programs.strip_types(corpus(spark, sf_dir).where("name % 5 in (0, 1)")), _fill, "name")


class Counted(programs.TypeChecker):
    """A checker that finds an error in programs with a class, and infers the first word of the others."""

    def check(self, content: str) -> tuple[bool, str]:
        return "class " not in content, "main.ts(3,1): error TS1: class\n" if "class " in content else ""

    def declarations(self, content: str, javascript: bool = True) -> tuple[str, str]:
        return ("", "no") if "class " in content else (f"declare {content.split()[0]}", "")


@query(f"""
SELECT doc_id AS name, doc_id % 5 <> 2 AS ok, CASE WHEN doc_id % 5 = 2 THEN 'main.ts(3,1): error TS1: class' || chr(10) ELSE '' END AS log,
  CASE WHEN doc_id % 5 = 2 THEN '' ELSE 'declare ' || split_part(ltrim({PROGRAM}, chr(10)), ' ', 1) END AS output, doc_id % 5 = 2 AS error FROM documents
""")
def ts_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and inferred declarations, with a checker that can be worked out by hand."""
    files = corpus(spark, sf_dir).withColumn("content_without_types", F.col("content"))
    return programs.typecheck(files, "name", Counted()).join(programs.declared(files, "name", Counted()).select("name", "output", "error"), "name")



@query(f"""
WITH r AS (SELECT doc_id, {UNTYPED} AS base, CASE WHEN doc_id % 3 = 0 THEN {UNTYPED} ELSE {PROGRAM} END AS output, doc_id % 7 = 0 AS error FROM documents WHERE doc_id % 5 IN (0, 1, 2)),
w AS (SELECT *, string_split(base, ' ') AS a, string_split(output, ' ') AS b FROM r)
SELECT doc_id AS name, CASE WHEN NOT error THEN CAST(len(b) AS BIGINT) ELSE -1 END AS token_count,
  CASE WHEN NOT error THEN round(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) / CAST(greatest(len(a), len(b)) AS DOUBLE), 9) ELSE -1.0 END AS accuracy,
  CASE WHEN NOT error THEN 'true' ELSE '-' END AS pkg_parses, CASE WHEN error THEN '-' WHEN base = output THEN 'true' ELSE 'false' END AS pkg_unchanged, CASE WHEN NOT error THEN 'true' ELSE '-' END AS untyped_equal,
  CASE WHEN NOT error AND base = output THEN 1.0 WHEN NOT error THEN round(2.0 * length(base) / (length(base) + length(output)), 9) ELSE -1.0 END AS levenshtein,
  CASE WHEN NOT error THEN CASE WHEN doc_id % 5 = 2 AND doc_id % 3 <> 0 THEN round(2.0 * length(base) / (2 * length(base) + 3 + length(source)), 9) ELSE 1.0 END ELSE -1.0 END AS untyped_levenshtein
FROM w JOIN documents USING (doc_id)
""")
def ts_evaluate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions that are the program itself or its untyped text; the untyped text is a subsequence, so similarities are known."""
    files = programs.strip_types(corpus(spark, sf_dir).where("name % 5 in (0, 1, 2)"))
    runs = files.select("name", "content_without_types", F.when(F.col("name") % 3 == 0, F.col("content_without_types")).otherwise(F.col("content")).alias("output"), (F.col("name") % 7 == 0).alias("error"))
    told = programs.evaluate_runs(runs, lambda x: F.split(x, " ", -1))
    rounded = [F.coalesce(F.round(c, 9), F.lit(-1.0)).alias(c) for c in ("accuracy", "levenshtein", "untyped_levenshtein")]
    flags = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("pkg_parses", "pkg_unchanged", "untyped_equal")]
    return told.select("name", F.coalesce("token_count", F.lit(-1)).cast("long").alias("token_count"), *rounded, *flags)


@query("SELECT CAST(doc_id AS VARCHAR) AS hexsha, doc_id % 5 <> 2 AND doc_id % 10 <> 7 AS ok FROM documents")
def ts_streamed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs checked as they stream in, each key once; what is checked already isn't checked again."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("hexsha"), F.expr(PROGRAM).alias("content"))
    folder = io.scratch(spark)
    files.repartition(3, "hexsha").write.mode("append").parquet(folder)
    files.where("hexsha % 4 = 0").write.mode("append").parquet(folder)  # these come in twice
    done = io.Checkpoint(spark, io.scratch(spark))
    done.append(files.where("hexsha % 10 = 7").select("hexsha", F.lit(False).alias("ok")))
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    check_new_files(stream, done, Counted(), io.scratch(spark)).awaitTermination()
    return done.done()


#: A bundle of two files, its untyped original, and a log that points into both, past the end, and at library files.
_LOG = """CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'main.ts(4,5): error TS1: no' || chr(10) || '  more' || chr(10) || 'node_modules/x.ts(1,1): error TS2: skip'
  WHEN 2 THEN 'main.ts(5,1): error TS3: end' || chr(10) || 'main.ts(2,1): error TS4: a' ELSE 'main.ts(0,1): error TS5: one' || chr(10) || 'main.ts(0,1): error TS6: two' END"""


@query("""
WITH d AS (SELECT doc_id, doc_id % 4 AS k FROM documents),
f AS (
  SELECT doc_id, 'a.ts' AS file, CASE WHEN k = 2 THEN 1 ELSE 0 END AS errors, 'number' AS types, 0 AS trivial FROM d
  UNION ALL SELECT doc_id, 'b.ts', CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END, 'any', 1 FROM d
  UNION ALL SELECT doc_id, 'p' || doc_id, 1, '', 0 FROM d WHERE k = 3)
SELECT doc_id AS name, file, CAST(errors AS BIGINT) AS num_errors, true AS parses, file NOT IN ('a.ts', 'b.ts') AS unchanged, errors = 0 AS correct,
  CAST(CASE WHEN types <> '' THEN 1 ELSE 0 END AS BIGINT) AS num_annotation_sites, CAST(CASE WHEN types <> '' THEN 1 ELSE 0 END AS BIGINT) AS num_annotations_added, types AS type_annotations,
  CAST(trivial AS BIGINT) AS num_annotations_trivial, CAST(0 AS BIGINT) AS num_annotations_trivial_original, CAST(0 AS BIGINT) AS num_definitions_added, CAST(0 AS BIGINT) AS num_types_undefined FROM f
""")
def ts_evaluate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bundle = "// FILE: a.ts\nlet a = 1;\n// FILE: b.ts\nlet b = a;"
    output = "// FILE: a.ts\nlet a: number = 1;\n// FILE: b.ts\nlet b: any = a;"
    runs = docs.select("doc_id", F.concat(F.lit("p"), F.col("doc_id")).alias("name"), F.lit(bundle).alias("content"), F.lit(output).alias("output"), F.expr(_LOG).alias("tsc_logs"))
    told = programs.evaluate_files(runs, ["doc_id"])
    columns = ["num_errors", "parses", "unchanged", "correct", "num_annotation_sites", "num_annotations_added", "num_annotations_trivial", "num_annotations_trivial_original", "num_definitions_added", "num_types_undefined"]
    return told.select(F.col("doc_id").alias("name"), "file", *columns, F.array_join("type_annotations", "|").alias("type_annotations"))
