"""What a program holds and how it looks without its types: plain functions on source text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from .parser import Node, Tree, parse
from .query import run_query

# Kinds of annotations, definitions and functions; annotations that say nothing.
ANNOTATIONS = ("type_annotation", "opting_type_annotation", "omitting_type_annotation")
DEFINITIONS = ("interface_declaration", "type_alias_declaration")
CLASSES = ("class_declaration", "abstract_class_declaration")
FUNCTIONS = ("function_declaration", "function", "arrow_function", "method_definition")
TRIVIAL = ("any", "Array<any>", "any[]", "Function")


def part(source: str, start: int, end: int) -> str:
    """A piece of a program as a file would be read: a byte order mark at its start is dropped."""
    return source[start:end].removeprefix("\ufeff")


def without_spans(source: str, spans: list[tuple[int, int]]) -> str:
    """The source without these spans; overlapping ones are merged first."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(part(source, at, max(at, start)))
        at = max(at, end)
    return "".join([*out, part(source, at, len(source))])


def is_valid(source: str) -> bool:
    return not parse(source).has_error


def annotations(source: str) -> list[Node]:
    """Outermost annotations."""
    return [n for n in parse(source).find(*ANNOTATIONS) if not n.has(*ANNOTATIONS)]


def annotation_texts(source: str) -> list[str]:
    """The types of the outermost annotations, without their colons."""
    tree = parse(source)
    return [tree.text(n.children[0]) for n in annotations(source) if n.children]


def definitions(source: str, classes: bool = False) -> list[Node]:
    return parse(source).find(*DEFINITIONS, *(CLASSES if classes else ()))


def site_ends(source: str, outermost: bool = False) -> list[int]:
    """Positions where an annotation may stand: after parameters, parameter lists, fields, properties, variables."""
    ends = []
    for n in parse(source).root.walk():
        target = n if n.kind in ("formal_parameters", "optional_parameter") else n.of_field("pattern") if n.kind == "required_parameter" else n.of_field("name") if n.kind in ("public_field_definition", "property_signature", "variable_declarator") else None
        if target is not None and not (outermost and target.has(*ANNOTATIONS)):
            ends.append(target.end)
    return sorted(ends)


def split_at_sites(source: str, outermost: bool = False) -> list[str]:
    ends = [0, *site_ends(source, outermost), len(source)]
    return [part(source, a, b) for a, b in zip(ends, ends[1:], strict=False)]


def count_sites(source: str, outermost: bool = False) -> int:
    return len(site_ends(source, outermost))


def count_trivial(source: str) -> int:
    return sum(t in TRIVIAL for t in annotation_texts(source))


def parenthesize_arrows(source: str) -> str:
    """`x => y` as `(x) => y`."""
    spans = sorted((p.start, p.end) for n in parse(source).find("arrow_function") if (p := n.of_field("parameter")) is not None)
    out, at = [], 0
    for start, end in spans:
        out += [source[at:start], "(", source[start:end], ")"]
        at = end
    return "".join([*out, source[at:]]).removeprefix("﻿")


def delete_annotations(source: str) -> str:
    return without_spans(source, [(n.start, n.end) for n in annotations(source)])


def delete_definition_nodes(source: str, nodes: list[Node], comments: bool = False) -> str:
    """Without these definitions, their `export`, and the one comment before each if asked for."""
    spans = []
    for n in nodes:
        if n.parent is not None and n.parent.kind == "export_statement":
            n = n.parent
        if comments and (before := n.before()) is not None and before.kind == "comment":
            spans.append((before.start, before.end))
        spans.append((n.start, n.end))
    return without_spans(source, spans)


def delete_definitions(source: str, classes: bool = False, comments: bool = False) -> str:
    return delete_definition_nodes(source, definitions(source, classes), comments)


def delete_assertions(source: str) -> str:
    """`e as T` as `e`, the outermost first, until none is left."""
    while True:
        outer = [n for n in parse(source).find("as_expression") if not n.has("as_expression")]
        if not outer:
            return source
        source = without_spans(source, [(n.children[0].end, n.end) for n in outer])


def delete_types(source: str, classes: bool = False, comments: bool = False) -> str:
    return delete_assertions(delete_annotations(delete_definitions(source, classes, comments)))


def delete_comments(source: str) -> str:
    return without_spans(source, [(n.start, n.end) for n in parse(source).find("comment")])


def is_empty(source: str) -> bool:
    return not delete_comments(source).strip()


def _defined_name(tree: Tree, node: Node) -> str:
    name = node.of_field("name")
    return tree.text(name) if name is not None else ""


def definition_names(source: str) -> list[str]:
    tree = parse(source)
    return [_defined_name(tree, n) for n in definitions(source, True)]


def used_names(source: str) -> list[str]:
    """Every type's name in the outermost annotations, repeats kept."""
    tree = parse(source)
    return [tree.text(n) for a in annotations(source) for n in a.walk() if n.kind == "type_identifier"]


def undefined_names(source: str) -> list[str]:
    """Sorted: names that annotations use and the program doesn't define."""
    return sorted(set(used_names(source)) - set(definition_names(source)))


def used_definitions(source: str) -> list[str]:
    return sorted(set(used_names(source)) & set(definition_names(source)))


def count_definitions(source: str) -> int:
    return len(definitions(source))


def count_functions(source: str) -> int:
    """Functions of the program without its types."""
    return len(parse(delete_types(source)).find(*FUNCTIONS))


def count_loc(source: str) -> int:
    """Lines with something on them, without types and comments."""
    return sum(bool(line.strip()) for line in delete_comments(delete_types(source)).split("\n"))


def loc_per_function(source: str) -> float:
    """Mean lines of a function's body without types and its own braces, as count_loc counts them; 0 without functions."""
    tree = parse(delete_types(source))
    bodies = [b for n in tree.find(*FUNCTIONS) if (b := n.of_field("body")) is not None]
    return sum(count_loc(tree.text(b).strip().strip("{}")) for b in bodies) / len(bodies) if bodies else 0.0


def extract_type(generated: str) -> str | None:
    """The type that a model wrote for a gap: that of the first variable of `let x: ...`."""
    template = f"let x: {generated}"
    found = run_query(template, "(variable_declarator type: (type_annotation (_) @type))")
    return part(template, found[0][0].start, found[0][0].end) if found else None


def commit_format(before: str, message: str, after: str) -> str | None:
    """Training text of an edit; None if a side holds nothing but comments, or nothing changes."""
    if is_empty(before) or is_empty(after) or before == after:
        return None
    return f"<commit_before>{before}<commit_msg>{message}<commit_after>{after}"


# What a model is asked to do.
ADD_ALL, ADD_ANNOTATIONS, ADD_DEFINITIONS, ADD_ONE = "Add type annotations and interfaces", "Add type annotations", "Add type aliases and interfaces", "Add a type alias or interface for "


def drawn(seed: str, label: str, below: int) -> int:
    """A number under `below` that depends on the seed and the label alone: their MD5, modulo `below`."""
    return int(hashlib.md5(f"{seed}:{label}".encode()).hexdigest(), 16) % below


def _untyped(source: str) -> str:
    return delete_assertions(delete_annotations(source)).strip()


def all_at_once(source: str, seed: str) -> str | None:
    return commit_format(delete_types(source).strip(), ADD_ALL, source)


def definitions_first(source: str, seed: str) -> str | None:
    """Definitions to a program without types, or annotations to one with definitions."""
    bare = _untyped(source)
    if drawn(seed, "step", 2) == 0:
        return commit_format(delete_definitions(bare).strip(), ADD_DEFINITIONS, bare)
    return commit_format(bare, ADD_ANNOTATIONS, source)


def annotations_first(source: str, seed: str) -> str | None:
    """Annotations to a program without types, or definitions to one with annotations."""
    undefined = delete_definitions(source).strip()
    if drawn(seed, "step", 2) == 0:
        return commit_format(_untyped(undefined), ADD_ANNOTATIONS, undefined)
    return commit_format(undefined, ADD_DEFINITIONS, source)


def one_by_one(source: str, seed: str) -> str | None:
    """One definition back to a program that lacks some; annotations where there is no definition.

    Every definition is drawn or not, again until one is: all sets of some are equally likely.
    """
    nodes = definitions(source)
    if not nodes:
        return commit_format(_untyped(source), ADD_ANNOTATIONS, source)
    gone, again = [], 0
    while not gone:
        gone = [n for i, n in enumerate(nodes) if drawn(seed, f"{again}:{i}", 2) == 0]
        again += 1
    back = gone[drawn(seed, "back", len(gone))]
    return commit_format(delete_definition_nodes(source, gone), ADD_ONE + _defined_name(parse(source), back), delete_definition_nodes(source, [n for n in gone if n is not back]))


#: Training forms by name: (stripped source, seed) to a text or None. More can be added.
FORMS: dict[str, Callable[[str, str], str | None]] = {"all_at_once": all_at_once, "definitions_first": definitions_first, "annotations_first": annotations_first, "one_by_one": one_by_one}


def training_text(source: str, form: str, seed: str) -> str | None:
    """A training example in one of FORMS; what is random depends on the seed alone. None where there's nothing to learn."""
    if form not in FORMS:
        raise ValueError(f"no form is named {form}; there are {', '.join(FORMS)}")
    return FORMS[form](source.strip(), seed)
