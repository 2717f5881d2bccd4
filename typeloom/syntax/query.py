"""S-expression queries over syntax trees, as tree tools write them.

A pattern is `(kind child ...)`, `(_)` for any named node, or `[a b ...]` for any of several. A child may be
given a field, `name: (identifier)`, and a pattern a capture, `(identifier) @name`. Children of a pattern match children of a
node in their order, others may stand between them. Text after `;` is a comment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from .parser import Node, parse

_TOKEN = re.compile(r"\s+|;[^\n]*|([()\[\]]|@[\w.-]+|\w+:|\w+)")


class Pattern(NamedTuple):
    kinds: tuple[str, ...]  # empty: any named node
    children: tuple[Pattern, ...]
    either: tuple[Pattern, ...]  # not empty: one of these
    field: str | None
    captures: tuple[str, ...]


def _tokens(text: str) -> list[str]:
    found, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"{text[at]!r} has no place in a query")
        if m[1]:
            found.append(m[1])
        at = m.end()
    return found


def _read(tokens: list[str], at: int, field: str | None = None) -> tuple[Pattern, int]:
    if at >= len(tokens):
        raise ValueError("the query ends too early")
    if tokens[at].endswith(":"):
        return _read(tokens, at + 1, tokens[at][:-1])
    if tokens[at] == "_":
        kinds, children, either, at = (), [], [], at + 1
    elif tokens[at] in "([":
        close = ")" if tokens[at] == "(" else "]"
        kinds, children, at = (), [], at + 1
        if close == ")":
            if at >= len(tokens) or not re.fullmatch(r"\w+", tokens[at]):
                raise ValueError("a kind must follow (")
            kinds, at = () if tokens[at] == "_" else (tokens[at],), at + 1
        while at < len(tokens) and tokens[at] != close:
            child, at = _read(tokens, at)
            children.append(child)
        if at >= len(tokens):
            raise ValueError(f"{close} is missing")
        at += 1
        either, children = (children, []) if close == "]" else ([], children)
    else:
        raise ValueError(f"{tokens[at]!r} can't begin a pattern")
    captures = []
    while at < len(tokens) and tokens[at].startswith("@"):
        captures.append(tokens[at][1:])
        at += 1
    return Pattern(kinds, tuple(children), tuple(either), field, tuple(captures)), at


@lru_cache(maxsize=64)
def compiled(text: str) -> tuple[Pattern, ...]:
    """The query's patterns; ValueError where it isn't well formed."""
    tokens, at, out = _tokens(text), 0, []
    while at < len(tokens):
        pattern, at = _read(tokens, at)
        out.append(pattern)
    return tuple(out)


def _matches(pattern: Pattern, node: Node) -> Iterator[list[tuple[Node, str]]]:
    """The captures of every way in which the pattern fits the node."""
    if pattern.field is not None and node.field != pattern.field:
        return
    own = [(node, c) for c in pattern.captures]
    if pattern.either:
        for one in pattern.either:
            for got in _matches(one, node):
                yield own + got
    elif node.named and (not pattern.kinds or node.kind in pattern.kinds):
        for got in _children(pattern.children, node.children):
            yield own + got


def _children(patterns: tuple[Pattern, ...], nodes: list[Node]) -> Iterator[list[tuple[Node, str]]]:
    if not patterns:
        yield []
        return
    for i, node in enumerate(nodes):
        for got in _matches(patterns[0], node):
            for rest in _children(patterns[1:], nodes[i + 1 :]):
                yield got + rest


def run_query(source: str, query: str) -> list[tuple[Node, str]]:
    """(node, capture) in the order of the nodes' starts, outer nodes first; every pair once."""
    tree = parse(source)
    place = {id(n): i for i, n in enumerate(tree.root.walk())}
    found = {(place[id(n)], c): n for p in compiled(query) for node in tree.root.walk() for got in _matches(p, node) for n, c in got}
    return [(n, c) for (_, c), n in sorted(found.items(), key=lambda x: x[0])]
