"""Parser, rewrites and program operators on hand-written TypeScript."""

import io
import tarfile
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from typeloom.syntax import rewrite
from typeloom.syntax.parser import parse

VALID = [
    "const f = x => x + 1",
    "function f(a: number, b?: string): void { return }",
    "interface A<T> extends B, C.D<T> { x: number; m(a: T): void; [k: string]: any; new (x: any): A; (z): void }",
    "type M = { [K in keyof T]?: T[K] } & { readonly [P in K as `a${P}`]-?: T[P] }",
    "class A<T> extends B<T> implements C { private x: number = 1; constructor(public a: string) { super() } get z(): number { return 1 } async *g() {} #p = 3 }",
    "abstract class Q { abstract foo(): void; abstract x: number }",
    "const r = /ab[/]c/g.test(s) / 2",
    "let t = `a${b + `c${d}`}e`",
    "foo<number>(1); a < b; a > b; if (a < b && c > d) {}",
    "for (const [k, v] of Object.entries(o)) { k in v }",
    "export * from 'a'\nimport x, * as y from 'z'",
    "declare module 'm' { export function f(): void; }",
    "let x: (a: number, ...r: string[]) => Promise<Array<Map<string, number>>> = async (a) => { await a }",
    "let v = a ? (b) : c\nlet w = a ? (b, c) => d : e",
    "x = y as const satisfies Z",
    "type C2 = T extends (infer U)[] ? U : never",
    "@dec() class D { @Input() x: string }",
    "var a = b\n++c",
    "const y = <any>x\nlet q = a! + b!.c",
    "",
]
BROKEN = ["let x = ;", "function f( { }", "interface { }", "let x: = 1", "}", "foo bar baz", "const a = `abc"]
PROGRAM = """// doc
export interface P { x: number; y?: any }
type Q = P | null;
const f = (a: P, b?: any): Promise<Q> => { return (a as any) as Q }
function g(x, y = 1) { return x => x }
class K { z: Function; m(): void { let v: { a: number, b: any[] }; } }
"""


@pytest.mark.parametrize("source", VALID)
def test_valid(source):
    assert rewrite.is_valid(source)


@pytest.mark.parametrize("source", BROKEN)
def test_broken(source):
    assert not rewrite.is_valid(source)


def test_facts():
    assert rewrite.annotation_texts(PROGRAM) == ["number", "any", "P", "any", "Promise<Q>", "Function", "void", "{ a: number, b: any[] }"]
    assert rewrite.definition_names(PROGRAM) == ["P", "Q", "K"]
    assert rewrite.undefined_names(PROGRAM) == ["Function", "Promise"]
    assert rewrite.used_definitions(PROGRAM) == ["P", "Q"]
    assert rewrite.count_trivial(PROGRAM) == 3
    assert rewrite.count_functions(PROGRAM) == 4


def test_delete_types():
    assert "as" not in rewrite.delete_types("let a = (b as any as string).c")
    assert rewrite.delete_types("// c\ninterface A {}\nlet x", comments=True) == "\n\nlet x"
    assert rewrite.delete_types("// c\nexport type A = B;\nlet x") == "// c\n\nlet x"
    assert rewrite.parenthesize_arrows("x => y => x") == "(x) => (y) => x"
    assert rewrite.split_at_sites("let a = (b, c) => 1") == ["let a", " = (b", ", c", ")", " => 1"]
    assert rewrite.is_empty("// a\n/* b */ ") and not rewrite.is_empty("a")
    assert rewrite.delete_annotations("﻿let x: number = 1") == "let x = 1"
    assert rewrite.without_spans("abcdef", [(1, 4), (2, 3), (3, 5)]) == "af"


@pytest.mark.parametrize("source", [*VALID, PROGRAM])
def test_identities(source):
    assert "".join(rewrite.split_at_sites(source)) == source
    once = rewrite.delete_types(source)
    assert rewrite.delete_types(once) == once
    assert not parse(once).find("as_expression")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="let x:=(){}<>[];,.?'`/ as any\n=>|&+1ué", max_size=40))
def test_any_text_is_read(source):
    tree = parse(source)
    assert tree.root.end == len(source)
    assert "".join(rewrite.split_at_sites(source)) == source


def test_training_forms():
    assert rewrite.training_text("let x: number = 1", "all_at_once", "s") == "<commit_before>let x = 1<commit_msg>Add type annotations and interfaces<commit_after>let x: number = 1"
    assert rewrite.training_text("let x = 1", "all_at_once", "s") is None
    assert rewrite.training_text("interface A {}", "all_at_once", "s") is None
    assert rewrite.training_text("// c\ninterface A {}", "all_at_once", "s") is None
    assert rewrite.commit_format("// c", "m", "let x") is None and rewrite.commit_format("let x", "m", "/* c */ ") is None
    with pytest.raises(ValueError):
        rewrite.training_text("", "get9", "s")
    for form in ("definitions_first", "annotations_first"):
        seen = {rewrite.training_text(PROGRAM, form, str(i)).split("<commit_msg>")[1].split("<commit_after>")[0] for i in range(20)}
        assert seen == {"Add type aliases and interfaces", "Add type annotations"}


def test_all_sets_of_definitions_are_drawn_alike():
    """Of three definitions, all seven sets of some, and each of a set's own to come back."""
    names, source = "ABC", "interface A {}\ntype B = A;\ninterface C {}\nlet x: A;"
    seen = Counter()
    for i in range(2100):
        before, _, rest = rewrite.training_text(source, "one_by_one", str(i)).removeprefix("<commit_before>").partition("<commit_msg>")
        wish, _, after = rest.partition("<commit_after>")
        gone = "".join(n for n in names if f" {n} " not in before)
        back = wish.removeprefix("Add a type alias or interface for ")
        assert back in gone and [n for n in names if f" {n} " not in after] == [n for n in gone if n != back]
        seen[gone, back] += 1
    assert len(seen) == 12
    assert all(abs(n - 300 / len(gone)) < 80 for (gone, _), n in seen.items())


def test_query_strings():
    from typeloom.syntax.query import run_query

    source = "interface A { x: number }\nfunction f(a: A, b = (c: string) => c) {}\nlet y: { z: any }"
    told = lambda q: [(source[n.start : n.end], c) for n, c in run_query(source, q)]
    assert told("(interface_declaration name: (type_identifier) @name)") == [("A", "name")]
    assert told("[(required_parameter pattern: (_) @p) (variable_declarator name: (_) @v)] ; a comment") == [("a", "p"), ("b", "p"), ("c", "p"), ("y", "v")]
    assert told("(function_declaration name: (identifier) @f parameters: (formal_parameters (required_parameter pattern: (identifier) @first type: (_)))) @all") == [(source.split("\n")[1], "all"), ("f", "f"), ("a", "first")]
    assert told("(required_parameter value: (arrow_function (formal_parameters (required_parameter type: (_) @t))))") == [(": string", "t")]
    assert told("(type_annotation (object_type)) @o") == [(": { z: any }", "o")] and told("(no_such_kind) @x") == []
    for wrong in ("(a", "[a", "()", "name:", "%", "(a))"):
        with pytest.raises(ValueError):
            run_query("", wrong)


def test_byte_order_marks():
    """Each piece that is cut out drops one at its start."""
    assert rewrite.without_spans("\ufeffab", [(2, 3)]) == "a" and rewrite.without_spans("ab\ufeffc", [(1, 2)]) == "ac"
    assert rewrite.delete_annotations("\ufefflet x: A = 1") == "let x = 1"
    assert rewrite.extract_type("A<B> = c") == "A<B>" and rewrite.extract_type("= (a: number) => a") is None and rewrite.extract_type("") is None


def test_infill():
    from typeloom.operators.programs import infill_types

    answers = iter(["number", "", "", "", "P[]", "void"])
    assert infill_types("let a = (b) => 1", lambda before, after: next(answers)) == "let a: number = (b: any): P[] => 1"


def test_files_of_a_bundle(spark):
    from typeloom.operators import programs

    bundle = "// FILE: a.ts\nlet a = 1;\n// FILE: b.ts\nlet b = a;"
    output = "// FILE: a.ts\nlet a: number = 1;\n// FILE: b.ts\nlet b: any = a;"
    log = "main.ts(4,5): error TS1: no\n  more\nnode_modules/x.ts(1,1): error TS2: skip"
    runs = spark.createDataFrame([(0, "p", bundle, output, log), (1, "q", "let a = 1", "", "")], "k int, name string, content string, output string, tsc_logs string")
    rows = {(r.k, r.file): r for r in programs.evaluate_files(runs, ["k"]).collect()}
    assert rows[0, "a.ts"].correct and rows[0, "a.ts"].num_errors == 0 and rows[0, "a.ts"].num_annotations_added == 1
    assert not rows[0, "b.ts"].correct and rows[0, "b.ts"].errors == ["main.ts(4,5): error TS1: no\n  more"] and rows[0, "b.ts"].num_annotations_trivial == 1
    # An empty output is one file of its name, without anything in it.
    assert rows[1, "q"].content == "" and rows[1, "q"].parses and not rows[1, "q"].correct and len(rows) == 3


def test_approaches(spark):
    from typeloom.operators import programs

    answers = {"<commit_before>f = x => x<commit_msg>Add type annotations<commit_after>": "f = (x: N) => x", "<commit_before>f = (x: N) => x<commit_msg>Add a type alias or interface for N<commit_after>": "type N = number\nf = (x: N) => x"}
    files = spark.createDataFrame([("a", "f = x => x"), ("b", None)], "name string, content_without_types string")
    rows = {(a, r.name, r.completion_id): r for a in programs.APPROACHES for r in programs.infer(files, a, programs.Recorded(answers), 2, "name").collect()}
    assert len(rows) == 16 and rows["at_once", "a", 0].error and len(rows["at_once", "a", 0].steps) == 1
    assert len(rows["definitions_first", "a", 0].steps) == len(rows["annotations_first", "a", 0].steps) == 2
    assert rows["until_defined", "a", 1].output.startswith("type N = number") and [s.prompt for s in rows["until_defined", "a", 1].steps] == ["Add type annotations", "Add a type alias or interface for N"]
    assert all((r.output, r.error, r.steps) == (None, True, []) for (_, name, _), r in rows.items() if name == "b")


def test_rounds_end():
    """What stays undefined is asked for five times; those that finish earlier come first."""
    from typeloom.operators import programs

    asked = []

    def model(prompts):
        asked.append(len(prompts))
        return ["let a: number" if len(asked) == 1 and i == 2 else "let a: T" for i in range(len(prompts))]

    got = programs.APPROACHES["until_defined"]("let a", 3, model, "s")
    assert asked == [3, 2, 2, 2, 2, 2] and [i for i, _, _ in got] == [2, 0, 1] and [len(s) for _, _, s in got] == [1, 6, 6]


def test_a_compiler_is_run(spark, tmp_path, monkeypatch):
    """A script in the compiler's place: flags, logs, unpacked declarations, inferred ones."""
    from typeloom.operators import programs

    with tarfile.open(tmp_path / "types.tar", "w") as tar:
        data = b"declare var z"
        info = tarfile.TarInfo("node_modules/@types/z.d.ts")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    command = tmp_path / "fakec"
    command.write_text('#!/bin/sh\nfor last; do :; done\necho "$last: $1 $(cat node_modules/@types/z.d.ts 2>/dev/null)"\ncase "$1" in --declaration) grep -q bad "$last" || echo "declare $(cat $last)" > "${last%.*}.d.ts";; esac\n! grep -q bad "$last"\n')
    command.chmod(0o755)
    files = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", None)], "name string, content string").withColumn("content_without_types", F.col("content"))
    checker = programs.TypeChecker(command=str(command), archive=str(tmp_path / "types.tar"))
    got = {r.name: (r.ok, r.log) for r in programs.typecheck(files, "name", checker).collect()}
    assert got == {"a": (True, "main.ts: --noEmit declare var z\n"), "b": (False, "main.ts: --noEmit declare var z\n"), "c": (True, "main.ts: --noEmit declare var z\n")}
    plain = programs.TypeChecker(programs.CORPUS_FLAGS, str(command))
    assert plain.check("good") == (True, "main.ts: --noEmit \n")
    made = {r.name: (r.output, r.errors, r.error) for r in programs.declared(files, "name", plain).collect()}
    assert made == {"a": ("declare good\n", "main.js: --declaration \n", False), "b": ("", "main.js: --declaration \n", True), "c": (None, None, None)}


def test_tar_members_stay_inside(tmp_path):
    from typeloom.sources.io import extract_tar

    with tarfile.open(tmp_path / "t.tar", "w") as tar:
        tar.addfile(tarfile.TarInfo("../out"), io.BytesIO(b""))
    with pytest.raises(tarfile.OutsideDestinationError):
        extract_tar(str(tmp_path / "t.tar"), str(tmp_path / "in"))


def test_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from typeloom.operators import programs

    path = public_tokenizers.path("byte_bpe_50k.json")
    files = spark.createDataFrame([("a", "let x: number = 1"), ("b", None), ("c", "")], "name string, content string")
    plain = Tokenizer.from_file(path)
    got = {r.name: r.n for r in files.select("name", programs.tokens_of(path)(F.col("content")).alias("n")).collect()}
    assert got == {"a": plain.encode("let x: number = 1").ids, "b": None, "c": []}
    assert {r.name: r.estimated_tokens for r in programs.add_token_count(files.where("name = 'a'"), programs.tokens_of(path), 1).collect()} == {"a": len(got["a"]) + 1}
    with pytest.raises(ValueError):
        programs.facts("content", "nothing")


def test_nodes(spark):
    from typeloom.operators import programs

    files = spark.createDataFrame([("a", "let é: { x: any } = 1")], "name string, content string")
    nodes = programs.syntax_nodes(files, "name")
    assert [(r.start_byte, r.end_byte) for r in programs.outermost(nodes, "name", rewrite.ANNOTATIONS).collect()] == [(6, 18)]


def test_without_a_compiler(spark):
    from typeloom.operators.programs import TypeChecker

    assert TypeChecker(command="no-such-compiler").check("let x") == (None, None)
