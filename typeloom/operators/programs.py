"""Source files in Spark: one parse a row, all results in one struct; training texts; completions; evaluation.

Trees don't leave the worker but as syntax_nodes. What needs a compiler or a model is a small
interface: TypeChecker and Completer; a recorded one replays a table, none gives NULLs.
"""

from __future__ import annotations

import random
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import indel_ratio, positional_accuracy
from ..functions.text import edit_prompt
from ..syntax import rewrite
from ..syntax.parser import parse
from ..syntax.query import compiled, run_query
from ..sources.io import extract_tar
from .lines import merge_files, split_errors, split_files

METRICS = "struct<valid:boolean,annotation_sites:bigint,type_definitions:bigint,loc:bigint,functions:bigint,loc_per_function:double>"
#: What can be told of a program, by name: its type and how it is found out. More can be added.
FACTS: dict[str, tuple[str, Callable[[str], object]]] = {
    "untyped": ("string", rewrite.delete_types),
    "untyped_uncommented": ("string", lambda s: rewrite.delete_types(s, comments=True)),
    "valid": ("boolean", rewrite.is_valid),
    "sites": ("bigint", rewrite.count_sites),
    "outer_sites": ("bigint", lambda s: rewrite.count_sites(s, True)),
    "annotations": ("array<string>", rewrite.annotation_texts),
    "trivial": ("bigint", rewrite.count_trivial),
    "definitions": ("array<string>", rewrite.definition_names),
    "used_names": ("array<string>", rewrite.used_names),
    "used": ("array<string>", rewrite.used_definitions),
    "undefined": ("array<string>", rewrite.undefined_names),
    "empty": ("boolean", rewrite.is_empty),
    "chunks": ("array<string>", rewrite.split_at_sites),
    "parenthesized": ("string", rewrite.parenthesize_arrows),
    "uncommented": ("string", rewrite.delete_comments),
    "type": ("string", rewrite.extract_type),
}
NODES = "node_id int, parent_id int, kind string, field string, named boolean, start_byte int, end_byte int, depth int, prev_named_sibling_id int, has_error boolean"
# The two sets of compiler flags, and the line an error starts with.
CHECK_FLAGS = ("--noEmit", "--esModuleInterop", "--moduleResolution", "node", "--target", "es2022", "--lib", "es2022,dom")
CORPUS_FLAGS = ("--noEmit", "--lib", "es2021")
DECLARE_FLAGS = ("--declaration", "--allowJs", "--emitDeclarationOnly", "--esModuleInterop", "--moduleResolution", "node", "--target", "es2022", "--lib", "es2022,dom")


def metrics(content: Column | str) -> Column:
    """Validity and sizes of each program; NULL for NULL."""
    return F.pandas_udf(_metrics, METRICS)(content)


def facts(content: Column | str, *names: str) -> Column:
    """A struct of what FACTS tell of each program, of those named, or all; NULL for NULL. Only what is asked for is found out."""
    names = names or tuple(FACTS)
    unknown = [n for n in names if n not in FACTS]
    if unknown:
        raise ValueError(f"no facts are named {', '.join(unknown)}; there are {', '.join(FACTS)}")

    def tell(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None,) * len(names) if s is None else tuple(FACTS[n][1](s) for n in names) for s in content], columns=list(names))

    return F.pandas_udf(tell, f"struct<{','.join(f'{n}:{FACTS[n][0]}' for n in names)}>")(content)


def fact(content: Column | str, name: str) -> Column:
    return facts(content, name)[name]


def is_empty(content: Column | str) -> Column:
    """Whether nothing but white space and comments is left of a program."""
    return fact(content, "empty")


def query(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, capture, kind, start, text for every capture of an S-expression query over every program; start counts characters."""
    compiled(text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, c, n.kind, n.start, rewrite.part(s, n.start, n.end)) for k, s in zip(frame[key], frame["content"], strict=True) if s is not None for n, c in run_query(s, text)]
            yield pd.DataFrame(rows, columns=[key, "capture", "kind", "start", "text"])

    return files.select(key, "content").mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, capture string, kind string, start int, text string")


def _metrics(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None,) * 6 if s is None else (rewrite.is_valid(s), rewrite.count_sites(s), rewrite.count_definitions(s), rewrite.count_loc(s), rewrite.count_functions(s), rewrite.loc_per_function(s)) for s in content], columns=["valid", "annotation_sites", "type_definitions", "loc", "functions", "loc_per_function"])


def add_metrics(files: DataFrame) -> DataFrame:
    """files with annotation_sites, type_definitions, loc, functions, loc_per_function."""
    return files.withColumn("_m", metrics("content")).select(*files.columns, *(f"_m.{c}" for c in ("annotation_sites", "type_definitions", "loc", "functions", "loc_per_function")))


def only_valid(files: DataFrame) -> DataFrame:
    return files.where(metrics("content")["valid"])


def tokens_of(path: str, special: bool = False) -> Callable[[Column], Column]:
    """A function from a text column to its token ids, by the tokenizers file at path (the same on all machines)."""

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in batches:
            some = [t for t in texts if t is not None]
            found = iter(tokenizer.encode_batch(some, add_special_tokens=special))
            yield pd.Series([None if t is None else next(found).ids for t in texts], dtype=object)

    # Typed by its annotation, so the iterator form is taken.
    return lambda text: F.pandas_udf(ids, "array<int>")(text)


def add_token_count(files: DataFrame, tokens: Callable[[Column], Column], more: int = 0) -> DataFrame:
    """files with estimated_tokens: tokens of the content, and `more` special ones that a tokenizer puts around it."""
    return files.withColumn("estimated_tokens", (F.size(tokens(F.col("content"))) + more).cast("long"))


def strip_types(files: DataFrame) -> DataFrame:
    """files with content_without_types: no types, no comments before definitions."""
    return files.withColumn("content_without_types", fact("content", "untyped_uncommented"))


def syntax_nodes(files: DataFrame, key: str) -> DataFrame:
    """key and NODES for every node of every program: pre-order ids, spans in UTF-8 bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, source in zip(frame[key], frame["content"], strict=True):
                tree = parse(source or "")
                ids, depth = {id(tree.root): 0}, {id(tree.root): 0}
                sizes = [0]
                for c in tree.source:
                    sizes.append(sizes[-1] + len(c.encode("utf-8", "surrogatepass")))
                for i, n in enumerate(tree.root.walk()):
                    ids[id(n)] = i
                    depth[id(n)] = depth[id(n.parent)] + 1 if n.parent else 0
                    before = n.before()
                    rows.append((k, i, ids[id(n.parent)] if n.parent else None, n.kind, n.field, n.named, sizes[n.start], sizes[n.end], depth[id(n)], ids.get(id(before)) if before else None, tree.has_error))
            yield pd.DataFrame(rows, columns=[key, *(f.split()[0] for f in NODES.split(", "))]).astype({"parent_id": "Int32", "prev_named_sibling_id": "Int32"})

    return files.select(key, "content").mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, {NODES}")


def outermost(nodes: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """Nodes of these kinds that stand in no other one of them: interval containment within a program."""
    own = nodes.where(F.col("kind").isin(*kinds))
    above = own.select(F.col(key).alias("_k"), F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e"), F.col("node_id").alias("_i"))
    inside = (F.col(key) == F.col("_k")) & (F.col("_s") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("_e")) & (F.col("_i") < F.col("node_id"))
    return own.join(above, inside, "left_anti")


def training_examples(files: DataFrame, form: str, key: str = "hexsha", seed: int = 0) -> DataFrame:
    """files with content in one of rewrite.FORMS; rows without one keep a NULL. Randomness is by seed and key."""

    def text(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else rewrite.training_text(s, form, f"{seed}:{k}") for s, k in zip(content, name, strict=True)], dtype=object)

    return files.withColumn("content", F.pandas_udf(text, "string")("content", F.col(key).cast("string")))


def usable(examples: DataFrame) -> DataFrame:
    return examples.where("content is not null and content <> ''")


Completer = Callable[[list[str]], list[str]]


class Recorded:
    """A completer that answers from a table of prompts; what it doesn't know it leaves empty."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answers.get(p, "") for p in prompts]


def _edit(code: str, instruction: str) -> str:
    return f"<commit_before>{code}<commit_msg>{instruction}<commit_after>".strip()


Step = dict[str, str]
Run = tuple[int, list[Step]]


def _ask(runs: list[Run], complete: Completer) -> list[str]:
    return complete([_edit(steps[-1]["input"], steps[-1]["prompt"]) for _, steps in runs])


def in_steps(*prompts: str) -> Approach:
    """One prompt after the other, each to the output of the one before."""

    def approach(original: str, n: int, complete: Completer, seed: str) -> list[tuple[int, str, list[Step]]]:
        runs, outputs = [(i, []) for i in range(n)], [original] * n
        for prompt in prompts:
            runs = [(i, [*steps, {"input": o, "prompt": prompt}]) for (i, steps), o in zip(runs, outputs, strict=True)]
            outputs = _ask(runs, complete)
        return [(i, o, steps) for (i, steps), o in zip(runs, outputs, strict=True)]

    return approach


def until_defined(rounds: int = 5) -> Approach:
    """Annotations first; then, for so many rounds at most, the definition of one undefined type. What has none left is finished."""

    def approach(original: str, n: int, complete: Completer, seed: str) -> list[tuple[int, str, list[Step]]]:
        open_, done, draw = in_steps(rewrite.ADD_ANNOTATIONS)(original, n, complete, seed), [], random.Random(seed)
        for left in range(rounds, -1, -1):
            missing = [rewrite.undefined_names(o) for _, o, _ in open_]
            done += [r for r, m in zip(open_, missing, strict=True) if not m]
            rest = [(r, m) for r, m in zip(open_, missing, strict=True) if m]
            if not rest or not left:
                return done + [r for r, _ in rest]
            runs = [(i, [*steps, {"input": o, "prompt": rewrite.ADD_ONE + draw.choice(m)}]) for (i, o, steps), m in rest]
            open_ = [(i, o, steps) for (i, steps), o in zip(runs, _ask(runs, complete), strict=True)]
        return done

    return approach


#: Approaches by name: (program, completions, completer, seed) to (generation, output, steps) in the order of finishing. More can be added.
Approach = Callable[[str, int, Completer, str], list[tuple[int, str, list[Step]]]]
APPROACHES: dict[str, Approach] = {
    "at_once": in_steps(rewrite.ADD_ALL),
    "definitions_first": in_steps(rewrite.ADD_DEFINITIONS, rewrite.ADD_ANNOTATIONS),
    "annotations_first": in_steps(rewrite.ADD_ANNOTATIONS, rewrite.ADD_DEFINITIONS),
    "until_defined": until_defined(),
}


def infer(files: DataFrame, approach: str, completer: Completer, n: int, key: str, seed: int = 0) -> DataFrame:
    """key, completion_id, generation, output, error, steps: n completions a row, by one of APPROACHES.

    completion_id counts in the order of finishing, generation in the order of asking. An empty
    output is an error. A NULL program isn't asked about: its outputs are NULL and errors, without steps.
    """
    ask = APPROACHES[approach]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, source in zip(frame[key], frame["content_without_types"], strict=True):
                got = [(i, None, []) for i in range(n)] if source is None else ask(source, n, completer, f"{seed}:{k}")
                rows += [(k, c, g, o, not o, s) for c, (g, o, s) in enumerate(got)]
            yield pd.DataFrame(rows, columns=[key, "completion_id", "generation", "output", "error", "steps"])

    schema = f"{key} {files.schema[key].dataType.simpleString()}, completion_id int, generation int, output string, error boolean, steps array<struct<input:string,prompt:string>>"
    return files.select(key, "content_without_types").mapInPandas(run, schema)


def infill(files: DataFrame, complete: Callable[[str, str], str], key: str, most: int = 500, retries: int = 3) -> DataFrame:
    """key, output: content_without_types with a type in every gap, asked for one by one (infill_types); NULL for NULL."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "output": [None if s is None else infill_types(s, complete, most, retries) for s in frame["content_without_types"]]}).astype({"output": object})

    return files.select(key, "content_without_types").mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, output string")


def infill_types(source: str, complete: Callable[[str, str], str], most: int = 500, retries: int = 3) -> str:
    """Types asked for gap by gap from left to right; `any` where none can be read after the retries."""
    chunks = rewrite.split_at_sites(rewrite.parenthesize_arrows(source))
    out = chunks[0]
    for i, chunk in enumerate(chunks[1:], 1):
        rest = "".join(chunks[i:])
        before, after = _clipped(f"{out}: ", rest, most)
        answers = (rewrite.extract_type(got) if (got := complete(before, after)) else None for _ in range(retries))
        out += f": {next((a for a in answers if a), 'any')}{chunk}"
    return out


def _clipped(one: str, two: str, most: int) -> tuple[str, str]:
    half = most // 2
    head = lambda s, n: s[:n].rsplit("\n", 1)[0]
    tail = lambda s, n: (s[-n:] if n else s).split("\n", 1)[-1]
    if len(one) < half:
        return one, head(two, most - len(one))
    if len(two) < half:
        return tail(one, most - len(two)), two
    return tail(one, half), head(two, half)


class TypeChecker:
    """The compiler on PATH; check gives (ok, log), or (None, None) where there's no compiler.

    archive: type declarations that are unpacked beside every program, at the same path on all machines.
    """

    def __init__(self, flags: tuple[str, ...] = CHECK_FLAGS, command: str = "tsc", archive: str | None = None):
        self.flags, self.command, self.archive = flags, command, archive

    def _run(self, content: str, suffix: str, flags: tuple[str, ...]) -> tuple[bool, str, str]:
        """Whether it went well, the log, and the declaration file, '' if none was made."""
        with tempfile.TemporaryDirectory() as folder:
            if self.archive:
                extract_tar(self.archive, folder)
            path = Path(folder, f"main.{suffix}")
            path.write_text(content, encoding="utf-8")
            ran = subprocess.run([self.command, *flags, str(path)], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, encoding="utf-8", timeout=300, cwd=folder, check=False)
            made = path.with_suffix(".d.ts")
            return ran.returncode == 0, ran.stdout.replace(f"{folder}/", ""), made.read_text(encoding="utf-8") if made.exists() else ""

    def check(self, content: str) -> tuple[bool | None, str | None]:
        return self._run(content, "ts", self.flags)[:2] if shutil.which(self.command) else (None, None)

    def declarations(self, content: str, javascript: bool = True) -> tuple[str | None, str | None]:
        """(declaration file, log): what the compiler infers."""
        if not shutil.which(self.command):
            return None, None
        _, log, made = self._run(content, "js" if javascript else "ts", DECLARE_FLAGS)
        return made, log


def typecheck(files: DataFrame, key: str, checker: TypeChecker, content: str = "content") -> DataFrame:
    """key, ok, log, by the checker where the rows are; NULL content is checked as an empty program."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [checker.check(s or "") for s in frame[content]]
            yield pd.DataFrame({key: frame[key], "ok": [x[0] for x in found], "log": [x[1] for x in found]}).astype({"ok": object, "log": object})

    return files.select(key, content).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, ok boolean, log string")


def declared(files: DataFrame, key: str, checker: TypeChecker, javascript: bool = True) -> DataFrame:
    """key, completion_id, output, errors, error: the declarations that the compiler infers for content_without_types.

    An empty output is an error; where there's no compiler, or no program, all three are NULL.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(None, None) if s is None else checker.declarations(s, javascript) for s in frame["content_without_types"]]
            yield pd.DataFrame([(k, 0, o, log, None if o is None else o == "") for k, (o, log) in zip(frame[key], found, strict=True)], columns=[key, "completion_id", "output", "errors", "error"]).astype({"error": object})

    return files.select(key, "content_without_types").mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, completion_id int, output string, errors string, error boolean")


def evaluate_files(runs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each file of a completion, with the 16 measures of a file.

    runs: keys, name, content (the original), output, tsc_logs. A file is `correct` without errors, equal
    to the original file without types, and with something added.
    """
    named = runs.select(*keys, "name", "content", "output", "tsc_logs")
    outputs = split_files(named.select(*keys, "name", F.col("output").alias("content")), keys)
    originals = split_files(named, keys).withColumnRenamed("content", "original")
    rows = merge_files(outputs, split_errors(named, keys), keys).join(originals, [*keys, "file"], "left").withColumn("original", F.coalesce("original", F.lit("")))
    rows = rows.withColumn("o", facts("original", "untyped", "trivial")).withColumn("f", facts("content", "valid", "outer_sites", "annotations", "trivial", "definitions", "used", "undefined", "untyped")).withColumn("u", facts("o.untyped", "definitions"))
    added = F.size(F.array_except("f.definitions", "u.definitions"))
    n = lambda x: F.size(x).cast("long")
    out = rows.select(*keys, "file", "content", "errors", n("errors").alias("num_errors"), F.col("f.valid").alias("parses"), F.col("f.outer_sites").alias("num_annotation_sites"), n("f.annotations").alias("num_annotations_added"), F.col("f.trivial").alias("num_annotations_trivial"), F.array_sort(F.array_distinct("f.annotations")).alias("type_annotations"), F.col("o.trivial").alias("num_annotations_trivial_original"), (F.col("o.untyped") == F.col("content")).alias("unchanged"), n("f.definitions").alias("num_definitions"), added.cast("long").alias("num_definitions_added"), n("f.used").alias("num_definitions_used"), n("f.undefined").alias("num_types_undefined"), F.col("f.definitions").alias("type_definitions"), F.col("f.used").alias("type_definitions_used"), F.col("f.undefined").alias("types_undefined"), (F.col("o.untyped") == F.col("f.untyped")).alias("_same"))
    return out.withColumn("correct", (F.col("num_errors") == 0) & F.col("_same") & (F.col("num_annotations_added") + F.col("num_definitions_added") > 0)).drop("_same")


def evaluate_runs(runs: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """runs (content_without_types, output, error, ...) with the measures of a completion; NULL for failed ones.

    tokens: a text column's tokens as an array, by whatever tokenizer is at hand.
    """
    good = F.coalesce(~F.col("error"), F.lit(True))
    told = runs.withColumn("_f", F.when(good, facts("output", "untyped", "untyped_uncommented", "valid")))
    value = lambda c: F.when(good, c)
    base = F.col("content_without_types")
    return told.withColumns(
        {
            "token_count": value(F.size(tokens(F.col("output")))),
            "accuracy": value(positional_accuracy(tokens(base), tokens(F.col("output")))),
            "levenshtein": value(indel_ratio(base, "output")),
            "untyped_levenshtein": value(indel_ratio(base, F.col("_f.untyped"))),
            "pkg_parses": value(F.col("_f.valid")),
            "pkg_unchanged": value(base == F.col("output")),
            "untyped_equal": value(base == F.col("_f.untyped_uncommented")),
        }
    ).drop("_f")


def prompts(files: DataFrame, instruction: str) -> DataFrame:
    return files.withColumn("prompt", edit_prompt(F.col("content_without_types"), F.lit(instruction)))
