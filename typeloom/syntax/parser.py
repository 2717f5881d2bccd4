"""A recursive-descent parser of TypeScript: enough structure for annotations, definitions and functions.

Node kinds are named as the grammar's public documentation names them. Positions count characters.
A statement that can't be read becomes an ERROR node up to a likely end, and parsing goes on; the
tree then has_error. This approximates an error-tolerant parser; it doesn't equal one.
"""

from __future__ import annotations

from functools import lru_cache

from .lexer import Lexer, Token

# Operators by binding strength, words with a meaning, types written as words.
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
RESERVED = {"break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "function", "if", "import", "in", "instanceof", "new", "null", "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with"}
PREDEFINED = {"any", "number", "boolean", "string", "symbol", "void", "unknown", "never", "object"}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor"}
PREFIX = {"!", "~", "+", "-", "++", "--"}
PREFIX_WORDS = {"typeof", "void", "delete", "await"}


class Node:
    __slots__ = ("kind", "start", "end", "children", "parent", "named", "field")

    def __init__(self, kind: str, start: int, end: int = -1, children: list[Node] | None = None, named: bool = True):
        self.kind, self.start, self.end, self.children, self.named = kind, start, end, children or [], named
        self.parent: Node | None = None
        self.field: str | None = None

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def has(self, *kinds: str) -> bool:
        """Whether a node above is of one of the kinds."""
        node = self.parent
        while node is not None:
            if node.kind in kinds:
                return True
            node = node.parent
        return False

    def of_field(self, name: str) -> Node | None:
        return next((c for c in self.children if c.field == name), None)

    def before(self) -> Node | None:
        """The named sibling before it."""
        if self.parent is None:
            return None
        own = [c for c in self.parent.children if c.named]
        i = own.index(self)
        return own[i - 1] if i else None


class Tree:
    def __init__(self, source: str, root: Node, has_error: bool):
        self.source, self.root, self.has_error = source, root, has_error

    def text(self, node: Node) -> str:
        return self.source[node.start : node.end].removeprefix("﻿")

    def find(self, *kinds: str) -> list[Node]:
        return [n for n in self.root.walk() if n.kind in kinds]


class Unreadable(Exception):
    pass


class Parser:
    def __init__(self, source: str):
        self.source, self.lexer = source, Lexer(source)
        self.now: Token = self.lexer.at(0)
        self.last, self.failed, self.no_arrow = 0, False, set()
        self.no_in = False

    # Tokens.
    def go(self, position: int) -> None:
        self.last, self.now = position, self.lexer.at(position)

    def step(self) -> Token:
        token = self.now
        if token.kind in ("end", "bad"):
            raise Unreadable
        self.go(token.end)
        return token

    def sees(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind in ("punct", "name")

    def takes(self, *texts: str) -> bool:
        if self.sees(*texts):
            self.step()
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.sees(text):
            if text in (">", "=") and self.now.kind == "punct" and self.now.text.startswith(text) and len(self.now.text) > 1:
                token = Token("punct", text, self.now.start, self.now.start + 1, self.now.newline)
                self.go(token.end)
                return token
            raise Unreadable
        return self.step()

    def peek(self, n: int = 1) -> Token:
        token = self.now
        for _ in range(n):
            token = self.lexer.at(token.end)
        return token

    def attempt(self, rule):
        """rule(), or None with nothing read if it fails."""
        at, last, now, no_in = self.now.start, self.last, self.now, self.no_in
        try:
            return rule()
        except Unreadable:
            self.last, self.now, self.no_in = last, now, no_in
            assert at == now.start
            return None

    def node(self, kind: str, start: int, *children: Node | None, **fields: Node | None) -> Node:
        out = Node(kind, start, self.last, [c for c in children if c is not None])
        for name, child in fields.items():
            if child is not None:
                child.field = name
                out.children.append(child)
        out.children.sort(key=lambda c: (c.start, c.end))
        return out

    def name(self, kind: str = "identifier") -> Node:
        token = self.now
        if token.kind != "name" or token.text in RESERVED and token.text != "this":
            raise Unreadable
        self.step()
        return self.node(kind, token.start)

    def any_name(self, kind: str) -> Node:
        if self.now.kind != "name":
            raise Unreadable
        return self.node(kind, self.step().start)

    def semicolon(self) -> None:
        if not self.takes(";") and not (self.now.newline or self.sees("}") or self.now.kind == "end"):
            raise Unreadable

    def listed(self, close: str, rule, separators: tuple[str, ...] = (",",)) -> list[Node]:
        out = []
        while not self.sees(close):
            if self.takes(*separators):
                continue
            out.append(rule())
            if not self.sees(close) and not self.takes(*separators) and not (";" in separators and self.now.newline):
                raise Unreadable
        self.need(close)
        return out

    # Statements.
    def program(self) -> Node:
        children = []
        while self.now.kind != "end":
            children.append(self.recovered())
        root = Node("program", 0, len(self.source), children)
        return root

    def recovered(self) -> Node:
        at = self.now
        try:
            return self.statement()
        except (Unreadable, RecursionError):
            self.failed = True
            self.go(at.start)
            depth = 0
            while self.now.kind != "end":
                token = self.now
                if token.text in ("(", "[", "{") and token.kind == "punct":
                    depth += 1
                elif token.text in (")", "]", "}") and token.kind == "punct":
                    depth = max(0, depth - 1)
                self.go(max(token.end, token.start + 1))
                if depth == 0 and (token.text in (";", "}") or self.now.newline):
                    break
            return Node("ERROR", at.start, max(self.last, at.start + 1))

    def block(self) -> Node:
        start = self.need("{").start
        children = []
        while not self.sees("}"):
            if self.now.kind == "end":
                raise Unreadable
            children.append(self.recovered())
        self.need("}")
        return self.node("statement_block", start, *children)

    def statement(self) -> Node:
        token, start = self.now, self.now.start
        word = token.text if token.kind == "name" else ""
        if token.kind == "punct":
            if token.text == "{":
                return self.block()
            if token.text == ";":
                self.step()
                return self.node("empty_statement", start)
            if token.text == "@":
                marks = self.decorators()
                inner = self.statement()
                inner.children[:0] = marks
                inner.start = start
                return inner
        if word and (found := self.declaration()) is not None:
            return found
        if word == "import" and self.peek().text not in ("(", "."):
            return self.import_statement()
        if word == "export":
            return self.export_statement()
        rule = getattr(self, f"{word}_statement", None) if word in ("if", "for", "while", "do", "return", "throw", "try", "switch", "break", "continue", "with", "debugger") else None
        if rule:
            return rule()
        if word and word not in RESERVED and self.peek().text == ":":
            label = self.name("statement_identifier")
            self.need(":")
            return self.node("labeled_statement", start, label, self.statement())
        inner = self.expression()
        self.semicolon()
        return self.node("expression_statement", start, inner)

    def declaration(self) -> Node | None:
        """A declaration that starts here, or None."""
        start, word, after = self.now.start, self.now.text, self.peek()
        named = after.kind == "name" and not after.newline
        if word in ("var", "let", "const"):
            if word == "const" and after.text == "enum":
                self.step()
                return self.enum(start)
            if word == "let" and not (after.kind == "name" or after.text in ("{", "[")):
                return None
            out = self.variables()
            self.semicolon()
            out.end = self.last
            return out
        if word == "function" or word == "async" and after.text == "function" and not after.newline:
            return self.function(True)
        if word == "class":
            return self.class_like(start, "class_declaration")
        if word == "abstract" and after.text == "class":
            self.step()
            return self.class_like(start, "abstract_class_declaration")
        if word == "enum" and named:
            return self.enum(start)
        if word == "interface" and named:
            return self.attempt(lambda: self.interface(start))
        if word == "type" and named:
            return self.attempt(lambda: self.alias(start))
        if word in ("namespace", "module") and (named or after.kind == "string" and not after.newline):
            return self.attempt(lambda: self.namespace(start))
        if word == "global" and after.text == "{":
            self.step()
            return self.node("internal_module", start, self.block())
        if word == "declare" and named:
            return self.attempt(lambda: self.ambient(start))
        return None

    def ambient(self, start: int) -> Node:
        self.step()
        inner = self.declaration()
        if inner is None:
            raise Unreadable
        return self.node("ambient_declaration", start, inner)

    def variables(self) -> Node:
        word = self.step()
        out = [self.variable()]
        while self.takes(","):
            out.append(self.variable())
        return self.node("variable_declaration" if word.text == "var" else "lexical_declaration", word.start, *out)

    def variable(self) -> Node:
        start = self.now.start
        name = self.pattern()
        self.takes("!")
        kind = self.annotation() if self.sees(":") else None
        value = self.assignment() if self.takes("=") else None
        return self.node("variable_declarator", start, name=name, type=kind, value=value)

    def pattern(self) -> Node:
        start = self.now.start
        if self.sees("{"):
            self.step()
            return self.node("object_pattern", start, *self.listed("}", self.pattern_property))
        if self.sees("["):
            self.step()
            return self.node("array_pattern", start, *self.listed("]", self.pattern_element))
        return self.name()

    def pattern_element(self) -> Node:
        start = self.now.start
        if self.takes("..."):
            return self.node("rest_pattern", start, self.pattern())
        inner = self.pattern()
        if self.takes("="):
            return self.node("assignment_pattern", start, inner, self.assignment())
        return inner

    def pattern_property(self) -> Node:
        start = self.now.start
        if self.sees("..."):
            return self.pattern_element()
        if self.peek().text == ":" or self.sees("["):
            key = self.property_name()
            self.need(":")
            return self.node("pair_pattern", start, key, self.pattern_element())
        return self.pattern_element()

    def interface(self, start: int) -> Node:
        self.step()
        name = self.name("type_identifier")
        parameters = self.type_parameters()
        heritage = None
        if self.sees("extends"):
            at = self.step().start
            bases = [self.type_reference()]
            while self.takes(","):
                bases.append(self.type_reference())
            heritage = self.node("extends_type_clause", at, *bases)
        return self.node("interface_declaration", start, parameters, heritage, name=name, body=self.object_type("interface_body"))

    def alias(self, start: int) -> Node:
        self.step()
        name = self.name("type_identifier")
        parameters = self.type_parameters()
        self.need("=")
        value = self.type()
        self.semicolon()
        return self.node("type_alias_declaration", start, parameters, name=name, value=value)

    def namespace(self, start: int) -> Node:
        kind = "module" if self.step().text == "module" else "internal_module"
        name = self.node("string", self.step().start) if self.now.kind == "string" else self.name()
        while self.takes("."):
            name = self.node("nested_identifier", name.start, name, self.name())
        if not self.sees("{"):
            self.semicolon()
            return self.node(kind, start, name=name)
        return self.node(kind, start, name=name, body=self.block())

    def enum(self, start: int) -> Node:
        self.need("enum")
        name = self.name()
        at = self.need("{").start

        def member() -> Node:
            own = self.property_name()
            return self.node("enum_assignment", own.start, own, self.assignment()) if self.takes("=") else own

        return self.node("enum_declaration", start, name=name, body=self.node("enum_body", at, *self.listed("}", member)))

    def import_statement(self) -> Node:
        start = self.step().start
        if self.now.kind == "string":
            self.step()
        else:
            if self.sees("type") and self.peek().text not in ("from", ","):
                self.step()
            if self.now.kind == "name" and not self.sees("from"):
                self.name()
                if self.takes("="):
                    self.assignment()
                    self.semicolon()
                    return self.node("import_statement", start)
                self.takes(",")
            elif self.sees("from") and self.peek().text == "from":
                self.name()
            if self.takes("*"):
                self.need("as")
                self.any_name("identifier")
            elif self.takes("{"):
                self.listed("}", self.specifier)
            self.need("from")
            if self.now.kind != "string":
                raise Unreadable
            self.step()
        if self.sees("with", "assert") and not self.now.newline:
            self.step()
            self.primary()
        self.semicolon()
        return self.node("import_statement", start)

    def specifier(self) -> Node:
        start = self.now.start
        while self.now.kind in ("name", "string"):
            self.step()
        if self.last == start:
            raise Unreadable
        return self.node("specifier", start)

    def export_statement(self) -> Node:
        start = self.step().start
        inner: Node | None = None
        if self.takes("default"):
            word = self.now.text
            inner = self.declaration() if word in ("function", "class", "abstract", "interface", "async") else None
            if inner is None:
                inner = self.assignment()
                self.semicolon()
        elif self.takes("="):
            inner = self.assignment()
            self.semicolon()
        elif self.sees("as") and self.peek().text == "namespace":
            self.step()
            self.step()
            inner = self.name()
            self.semicolon()
        elif self.sees("*", "{") or self.sees("type") and self.peek().text in ("{", "*"):
            self.takes("type")
            if self.takes("*"):
                if self.takes("as"):
                    self.any_name("identifier")
                if not self.sees("from"):
                    raise Unreadable
            else:
                self.need("{")
                self.listed("}", self.specifier)
            if self.takes("from"):
                if self.now.kind != "string":
                    raise Unreadable
                self.step()
            self.semicolon()
        elif self.sees("import"):
            inner = self.import_statement()
        else:
            marks = self.decorators() if self.sees("@") else []
            inner = self.declaration()
            if inner is None:
                raise Unreadable
            inner.children[:0] = marks
        out = self.node("export_statement", start)
        if inner is not None:
            inner.field = "declaration"
            out.children.append(inner)
        return out

    def condition(self) -> Node:
        self.need("(")
        inner = self.expression()
        self.need(")")
        return inner

    def if_statement(self) -> Node:
        start = self.step().start
        parts = [self.condition(), self.statement()]
        if self.takes("else"):
            parts.append(self.statement())
        return self.node("if_statement", start, *parts)

    def while_statement(self) -> Node:
        start = self.step().start
        return self.node("while_statement", start, self.condition(), self.statement())

    def with_statement(self) -> Node:
        start = self.step().start
        return self.node("with_statement", start, self.condition(), self.statement())

    def do_statement(self) -> Node:
        start = self.step().start
        body = self.statement()
        self.need("while")
        inner = self.condition()
        self.takes(";")
        return self.node("do_statement", start, body, inner)

    def for_statement(self) -> Node:
        start = self.step().start
        self.takes("await")
        self.need("(")
        parts: list[Node] = []
        if not self.sees(";"):
            self.no_in = True
            parts.append(self.variables() if self.sees("var", "const") or self.sees("let") and self.peek().kind != "punct" or self.sees("let") and self.peek().text in ("{", "[") else self.expression())
            self.no_in = False
        if self.takes("of"):
            parts.append(self.assignment())
        elif self.takes("in"):
            parts.append(self.expression())
        else:
            self.need(";")
            if not self.sees(";"):
                parts.append(self.expression())
            self.need(";")
            if not self.sees(")"):
                parts.append(self.expression())
        self.need(")")
        return self.node("for_statement", start, *parts, self.statement())

    def return_statement(self) -> Node:
        kind, start = f"{self.now.text}_statement", self.step().start
        inner = None if self.now.newline or self.sees(";", "}") or self.now.kind == "end" else self.expression()
        self.semicolon()
        return self.node(kind, start, inner)

    throw_statement = return_statement

    def break_statement(self) -> Node:
        kind, start = f"{self.now.text}_statement", self.step().start
        if self.now.kind == "name" and not self.now.newline and not self.sees("case", "default"):
            self.name()
        self.semicolon()
        return self.node(kind, start)

    continue_statement = debugger_statement = break_statement

    def try_statement(self) -> Node:
        start = self.step().start
        parts = [self.block()]
        if self.sees("catch"):
            at = self.step().start
            own: list[Node | None] = []
            if self.takes("("):
                own.append(self.pattern())
                own.append(self.annotation() if self.sees(":") else None)
                self.need(")")
            parts.append(self.node("catch_clause", at, *own, self.block()))
        if self.takes("finally"):
            parts.append(self.block())
        if len(parts) < 2:
            raise Unreadable
        return self.node("try_statement", start, *parts)

    def switch_statement(self) -> Node:
        start = self.step().start
        parts = [self.condition()]
        self.need("{")
        while not self.takes("}"):
            if self.takes("case"):
                parts.append(self.expression())
            else:
                self.need("default")
            self.need(":")
            while not self.sees("case", "default", "}"):
                if self.now.kind == "end":
                    raise Unreadable
                parts.append(self.recovered())
        return self.node("switch_statement", start, *parts)

    # Functions and classes.
    def function(self, declared: bool) -> Node:
        start = self.now.start
        self.takes("async")
        self.need("function")
        generator = self.takes("*")
        name = self.name() if self.now.kind == "name" else None
        head = self.signature()
        kind = "function_declaration" if declared else "function"
        if declared and not self.sees("{"):
            self.semicolon()
            return self.node("function_signature", start, *head, name=name)
        body = self.block()
        return self.node("generator_" + ("function_declaration" if declared else "function") if generator else kind, start, *head, name=name, body=body)

    def signature(self) -> list[Node | None]:
        """Type parameters, formal parameters, return annotation."""
        types = self.type_parameters()
        parameters = self.parameters()
        back = self.annotation(True) if self.sees(":") else None
        for child, field in ((types, "type_parameters"), (back, "return_type")):
            if child is not None:
                child.field = field
        return [types, parameters, back]

    def parameters(self) -> Node:
        start = self.need("(").start
        out = self.node("formal_parameters", start, *self.listed(")", self.parameter))
        out.field = "parameters"
        return out

    def parameter(self) -> Node:
        start = self.now.start
        marks = self.decorators() if self.sees("@") else []
        while self.now.text in ("public", "private", "protected", "readonly", "override") and (self.peek().kind == "name" or self.peek().text in ("{", "[")):
            self.step()
        if self.sees("..."):
            at = self.step().start
            pattern = self.node("rest_pattern", at, self.pattern())
        else:
            pattern = self.pattern()
        optional = self.takes("?")
        kind = self.annotation() if self.sees(":") else None
        value = self.assignment() if self.takes("=") else None
        return self.node("optional_parameter" if optional else "required_parameter", start, *marks, pattern=pattern, type=kind, value=value)

    def decorators(self) -> list[Node]:
        out = []
        while self.sees("@"):
            start = self.step().start
            inner = self.condition() if self.sees("(") else self.name()
            while self.sees(".", "(") and not self.sees("@"):
                if self.takes("."):
                    self.any_name("property_identifier")
                else:
                    inner.children.append(self.arguments())
            out.append(self.node("decorator", start, inner))
        return out

    def class_like(self, start: int, kind: str) -> Node:
        self.need("class")
        name = self.name("type_identifier") if self.now.kind == "name" and not self.sees("extends", "implements") else None
        parameters = self.type_parameters()
        heritage: list[Node] = []
        if self.takes("extends"):
            heritage.append(self.postfix(self.primary(), False))
            if self.sees("<"):
                heritage.append(self.type_arguments())
        if self.takes("implements"):
            heritage.append(self.type_reference())
            while self.takes(","):
                heritage.append(self.type_reference())
        at = self.need("{").start
        members: list[Node] = []
        while not self.sees("}"):
            if self.takes(";"):
                continue
            members.append(self.member())
        self.need("}")
        return self.node(kind, start, parameters, *heritage, name=name, body=self.node("class_body", at, *members))

    def property_name(self) -> Node:
        start = self.now.start
        if self.takes("["):
            inner = self.expression()
            self.need("]")
            return self.node("computed_property_name", start, inner)
        if self.now.kind in ("string", "number"):
            self.step()
            return self.node("literal_name", start)
        return self.any_name("property_identifier")

    def member(self) -> Node:
        start = self.now.start
        marks = self.decorators() if self.sees("@") else []
        if self.sees("static") and self.peek().text == "{":
            self.step()
            return self.node("class_static_block", start, self.block())
        words = set()
        while self.now.kind == "name" and self.now.text in MODIFIERS | {"get", "set"}:
            after = self.peek()
            if after.text in ("(", "=", ";", ":", "?", "!", "}", "<", ",") or after.kind == "end" or after.newline and self.now.text in ("get", "set", "static", "accessor", "declare"):
                break
            words.add(self.step().text)
        if self.sees("["):
            found = self.attempt(self.index_signature)
            if found is not None:
                self.semicolon()
                found.start, found.end = start, self.last
                return found
        generator = self.takes("*")
        name = self.property_name()
        self.takes("?", "!")
        if self.sees("(", "<"):
            head = self.signature()
            if self.sees("{"):
                return self.node("method_definition", start, *marks, *head, name=name, body=self.block())
            self.semicolon()
            return self.node("abstract_method_signature" if "abstract" in words else "method_signature", start, *marks, *head, name=name)
        if generator:
            raise Unreadable
        kind = self.annotation() if self.sees(":") else None
        value = self.assignment() if self.takes("=") else None
        out = self.node("public_field_definition", start, *marks, name=name, type=kind, value=value)
        self.semicolon()
        return out

    # Types.
    def annotation(self, returns: bool = False, kind: str = "type_annotation") -> Node:
        start = self.now.start
        self.need(":")
        if returns:
            if self.sees("asserts") and self.peek().kind == "name" and not self.peek().newline and self.peek().text != "is":
                self.step()
                self.name()
                inner = self.type() if self.takes("is") else None
                return self.node("asserts_annotation", start, inner)
            if self.now.kind == "name" and self.peek().text == "is" and not self.peek().newline:
                self.name()
                self.step()
                return self.node("type_predicate_annotation", start, self.type())
        return self.node(kind, start, self.type())

    def type_parameters(self) -> Node | None:
        if not self.sees("<"):
            return None
        start = self.step().start

        def one() -> Node:
            at = self.now.start
            while self.sees("const", "in", "out") and self.peek().kind == "name":
                self.step()
            name = self.name("type_identifier")
            bound = self.type() if self.takes("extends") else None
            default = self.type() if self.takes("=") else None
            return self.node("type_parameter", at, name, bound, default)

        out = [one()]
        while self.takes(","):
            if self.now.text.startswith(">"):
                break
            out.append(one())
        self.need(">")
        return self.node("type_parameters", start, *out)

    def type_arguments(self) -> Node:
        start = self.need("<").start
        out = [self.type()]
        while self.takes(","):
            out.append(self.type())
        self.need(">")
        return self.node("type_arguments", start, *out)

    def type(self) -> Node:
        start = self.now.start
        if self.sees("asserts") and self.peek().kind == "name" and not self.peek().newline:
            self.step()
        inner = self.function_type() or self.union()
        if self.sees("is") and not self.now.newline:
            self.step()
            return self.node("type_predicate", start, self.type())
        if self.sees("extends") and not self.now.newline:
            at = self.attempt(lambda: self.conditional(start, inner))
            if at is not None:
                return at
        return inner

    def conditional(self, start: int, inner: Node) -> Node:
        self.step()
        bound = self.function_type() or self.union()
        self.need("?")
        yes = self.type()
        self.need(":")
        return self.node("conditional_type", start, inner, bound, yes, self.type())

    def function_type(self) -> Node | None:
        start = self.now.start
        if self.sees("new") or self.sees("abstract") and self.peek().text == "new":
            self.takes("abstract")
            self.step()
            types = self.type_parameters()
            parameters = self.parameters()
            self.need("=>")
            return self.node("constructor_type", start, types, parameters, self.type())
        if not self.sees("(", "<"):
            return None

        def rule() -> Node:
            types = self.type_parameters()
            parameters = self.parameters()
            self.need("=>")
            return self.node("function_type", start, types, parameters, self.type())

        return self.attempt(rule)

    def union(self) -> Node:
        start = self.now.start
        self.takes("|")
        parts = [self.intersection()]
        while self.takes("|"):
            parts.append(self.function_type() or self.intersection())
        return parts[0] if len(parts) == 1 and parts[0].start == start else self.node("union_type", start, *parts)

    def intersection(self) -> Node:
        start = self.now.start
        self.takes("&")
        parts = [self.type_operator()]
        while self.takes("&"):
            parts.append(self.function_type() or self.type_operator())
        return parts[0] if len(parts) == 1 and parts[0].start == start else self.node("intersection_type", start, *parts)

    def type_operator(self) -> Node:
        start, after = self.now.start, self.peek()
        starts = after.kind in ("name", "string", "number", "template") or after.text in ("(", "[", "{")
        if self.sees("keyof", "readonly", "unique") and starts and not after.newline:
            self.step()
            return self.node("type_query_operator", start, self.type_operator())
        if self.sees("infer") and after.kind == "name":
            self.step()
            name = self.name("type_identifier")
            bound = self.attempt(self.infer_bound) if self.sees("extends") else None
            return self.node("infer_type", start, name, bound)
        return self.type_postfix()

    def infer_bound(self) -> Node:
        self.step()
        bound = self.union()
        if self.sees("?"):
            raise Unreadable
        return bound

    def type_postfix(self) -> Node:
        start = self.now.start
        out = self.type_primary()
        while self.sees("[") and not self.now.newline:
            self.step()
            if self.takes("]"):
                out = self.node("array_type", start, out)
            else:
                index = self.type()
                self.need("]")
                out = self.node("lookup_type", start, out, index)
        return out

    def type_reference(self) -> Node:
        start = self.now.start
        if self.sees("import"):
            self.step()
            self.need("(")
            self.type()
            self.need(")")
            out = self.node("import_type", start)
        else:
            out = self.name("type_identifier")
        while self.sees(".") and self.peek().kind == "name":
            self.step()
            if out.kind == "type_identifier":
                out.kind = "identifier"
            out = self.node("nested_type_identifier", start, out, self.any_name("type_identifier"))
        if self.sees("<") and not self.now.newline:
            arguments = self.type_arguments()
            out = self.node("generic_type", start, out, arguments)
        return out

    def type_primary(self) -> Node:
        token, start = self.now, self.now.start
        if token.kind in ("string", "number"):
            self.step()
            return self.node("literal_type", start)
        if token.kind == "template":
            return self.template(True)
        if token.kind == "name":
            if token.text in PREDEFINED and self.peek().text != ".":
                self.step()
                return self.node("predefined_type", start)
            if token.text in ("null", "undefined", "true", "false"):
                self.step()
                return self.node("literal_type", start)
            if token.text in ("this", "void"):
                self.step()
                return self.node("this_type", start)
            if token.text == "typeof":
                self.step()
                if self.sees("import"):
                    inner = self.type_reference()
                else:
                    inner = self.name()
                    while self.sees(".") and self.peek().kind == "name":
                        self.step()
                        self.step()
                    if self.sees("<") and not self.now.newline:
                        self.type_arguments()
                return self.node("type_query", start, inner)
            return self.type_reference()
        if token.text == "-" and self.peek().kind == "number":
            self.step()
            self.step()
            return self.node("literal_type", start)
        if token.text == "(":
            self.step()
            inner = self.type()
            self.need(")")
            return self.node("parenthesized_type", start, inner)
        if token.text == "[":
            self.step()
            return self.node("tuple_type", start, *self.listed("]", self.tuple_member))
        if token.text == "{":
            return self.object_type("object_type")
        raise Unreadable

    def tuple_member(self) -> Node:
        start = self.now.start
        rest = self.takes("...")
        if self.now.kind == "name" and (self.peek().text == ":" or self.peek().text == "?" and self.peek(2).text == ":"):
            name = self.any_name("identifier")
            optional = self.takes("?")
            return self.node("optional_parameter" if optional else "required_parameter", start, pattern=name, type=self.annotation())
        inner = self.type()
        optional = self.takes("?")
        return self.node("rest_type" if rest else "optional_type", start, inner) if rest or optional else inner

    def object_type(self, kind: str) -> Node:
        start = self.need("{").start
        return self.node(kind, start, *self.listed("}", self.type_member, (",", ";")))

    def index_signature(self) -> Node:
        start = self.now.start
        if self.takes("+", "-"):
            self.need("readonly")
        elif self.sees("readonly") and self.peek().text == "[":
            self.step()
        self.need("[")
        name = self.name("identifier")
        if self.takes(":"):
            inner = self.type()
        else:
            self.need("in")
            name.kind = "type_identifier"
            inner = self.type()
            if self.takes("as"):
                inner = self.node("mapped_type_clause", inner.start, inner, self.type())
        self.need("]")
        kind = "type_annotation"
        if self.takes("-"):
            self.need("?")
            kind = "omitting_type_annotation"
        elif self.takes("+"):
            self.need("?")
            kind = "adding_type_annotation"
        elif self.takes("?"):
            kind = "opting_type_annotation"
        value = self.annotation(False, kind) if self.sees(":") else None
        return self.node("index_signature", start, name, inner, value)

    def type_member(self) -> Node:
        start = self.now.start
        if self.sees("(", "<"):
            return self.node("call_signature", start, *self.signature())
        if self.sees("new") and self.peek().text in ("(", "<"):
            self.step()
            return self.node("construct_signature", start, *self.signature())
        if self.sees("[", "+", "-") or self.sees("readonly") and self.peek().text == "[":
            found = self.attempt(self.index_signature)
            if found is not None:
                return found
        while self.now.text in ("readonly", "get", "set") and (self.peek().kind in ("name", "string", "number") or self.peek().text == "[") and not self.peek().newline:
            self.step()
        name = self.property_name()
        self.takes("?")
        if self.sees("(", "<"):
            return self.node("method_signature", start, *self.signature(), name=name)
        return self.node("property_signature", start, name=name, type=self.annotation() if self.sees(":") else None)

    # Expressions.
    def expression(self) -> Node:
        start = self.now.start
        out = self.assignment()
        while self.takes(","):
            out = self.node("sequence_expression", start, out, self.assignment())
        return out

    def assignment(self) -> Node:
        start = self.now.start
        if self.sees("yield") and not (self.peek().text in ASSIGN | {".", ")"}):
            self.step()
            delegated = self.takes("*")
            empty = not delegated and (self.now.newline or self.sees(")", "]", "}", ",", ";", ":") or self.now.kind == "end")
            return self.node("yield_expression", start, None if empty else self.assignment())
        found = self.arrow()
        if found is not None:
            return found
        out = self.binary(0)
        if self.sees("?"):
            self.step()
            hold, self.no_in = self.no_in, False
            yes = self.assignment()
            self.no_in = hold
            self.need(":")
            return self.node("ternary_expression", start, out, yes, self.assignment())
        if self.now.kind == "punct" and self.now.text in ASSIGN:
            self.step()
            return self.node("assignment_expression", start, out, self.assignment())
        return out

    def arrow(self) -> Node | None:
        start, after = self.now.start, self.peek()
        if start in self.no_arrow:
            return None
        if self.now.kind == "name" and self.now.text not in RESERVED:
            if after.text == "=>" and not after.newline:
                one = self.name()
                return self.arrow_rest(start, [one], True)
            if self.now.text == "async" and not after.newline and (after.kind == "name" and self.peek(2).text == "=>" or after.text in ("(", "<")):
                pass
            else:
                return None
        elif not self.sees("(", "<"):
            return None

        def rule() -> Node:
            self.takes("async")
            if self.now.kind == "name":
                return self.arrow_rest(start, [self.name()], True)
            head = self.signature()
            if not self.sees("=>") or self.now.newline:
                raise Unreadable
            return self.arrow_rest(start, head, False)

        found = self.attempt(rule)
        if found is None:
            self.no_arrow.add(start)
        return found

    def arrow_rest(self, start: int, head: list[Node | None], single: bool) -> Node:
        self.need("=>")
        hold, self.no_in = self.no_in, False
        body = self.block() if self.sees("{") else self.assignment()
        self.no_in = hold
        return self.node("arrow_function", start, *(head if not single else []), parameter=head[0] if single else None, body=body)

    def binary(self, least: int) -> Node:
        start = self.now.start
        out = self.unary()
        while True:
            token = self.now
            if token.kind == "name" and token.text in ("as", "satisfies") and not token.newline and least < 8:
                self.step()
                if self.takes("const"):
                    out = self.node("as_expression", start, out)
                else:
                    kind = self.type()
                    out = self.node(f"{token.text}_expression", start, out, kind)
                continue
            strength = BINARY.get(token.text, 0) if token.kind in ("punct", "name") else 0
            if not strength or strength <= least or token.text == "in" and self.no_in:
                return out
            self.step()
            out = self.node("binary_expression", start, out, self.binary(strength - (token.text == "**")))

    def unary(self) -> Node:
        token, start = self.now, self.now.start
        if token.kind == "punct" and token.text in PREFIX or token.kind == "name" and token.text in PREFIX_WORDS and not (token.text == "await" and (self.peek().text in (".", ")", ",", ";", "=") or self.peek().kind == "end")):
            self.step()
            return self.node("unary_expression", start, self.unary())
        if token.text == "<" and token.kind == "punct":
            self.step()
            kind = self.type()
            self.need(">")
            return self.node("type_assertion", start, kind, self.unary())
        out = self.postfix(self.primary(), True)
        if self.sees("++", "--") and not self.now.newline:
            self.step()
            out = self.node("update_expression", start, out)
        return out

    def arguments(self) -> Node:
        start = self.need("(").start
        hold, self.no_in = self.no_in, False
        out = self.node("arguments", start, *self.listed(")", self.spread))
        self.no_in = hold
        return out

    def spread(self) -> Node:
        start = self.now.start
        if self.takes("..."):
            return self.node("spread_element", start, self.assignment())
        return self.assignment()

    def typed_call(self) -> list[Node]:
        kinds = self.type_arguments()
        if self.sees("("):
            return [kinds, self.arguments()]
        if self.now.kind == "template":
            return [kinds, self.template(False)]
        if self.now.kind in ("name", "number", "string") and not self.now.newline or self.sees("[", "{"):
            raise Unreadable
        return [kinds]

    def postfix(self, out: Node, calls: bool) -> Node:
        start = out.start
        while True:
            if self.sees(".", "?."):
                optional = self.step().text == "?."
                if optional and self.sees("("):
                    out = self.node("call_expression", start, out, self.arguments())
                elif optional and self.sees("["):
                    continue
                else:
                    out = self.node("member_expression", start, out, self.any_name("property_identifier"))
            elif self.sees("["):
                self.step()
                hold, self.no_in = self.no_in, False
                index = self.expression()
                self.no_in = hold
                self.need("]")
                out = self.node("subscript_expression", start, out, index)
            elif self.sees("("):
                out = self.node("call_expression", start, out, self.arguments())
            elif self.now.kind == "template":
                out = self.node("call_expression", start, out, self.template(False))
            elif self.sees("!") and not self.now.newline:
                self.step()
                out = self.node("non_null_expression", start, out)
            elif self.sees("<", "<<") and calls and (found := self.attempt(self.typed_call)) is not None:
                out = self.node("call_expression", start, out, *found)
            else:
                return out

    def template(self, types: bool) -> Node:
        start = self.now.start
        at, children = start + 1, []
        while True:
            if at >= len(self.source):
                raise Unreadable
            c = self.source[at]
            if c == "\\":
                at += 2
            elif c == "`":
                self.go(at + 1)
                return self.node("template_literal_type" if types else "template_string", start, *children)
            elif self.source.startswith("${", at):
                self.go(at + 2)
                children.append(self.type() if types else self.expression())
                if not self.sees("}"):
                    raise Unreadable
                at = self.now.end
            else:
                at += 1

    def primary(self) -> Node:
        token, start = self.now, self.now.start
        if token.kind in ("number", "string"):
            self.step()
            return self.node(token.kind, start)
        if token.kind == "template":
            return self.template(False)
        if token.kind == "name":
            if token.text == "function" or token.text == "async" and self.peek().text == "function" and not self.peek().newline:
                return self.function(False)
            if token.text == "class":
                return self.class_like(start, "class")
            if token.text == "new":
                self.step()
                if self.takes("."):
                    self.step()
                    return self.node("meta_property", start)
                callee = self.callee()
                kinds = self.attempt(self.type_arguments) if self.sees("<") else None
                return self.node("new_expression", start, callee, kinds, self.arguments() if self.sees("(") else None)
            if token.text in ("this", "super", "null", "true", "false", "import"):
                self.step()
                return self.node(token.text, start)
            return self.name()
        if token.text == "(":
            self.step()
            hold, self.no_in = self.no_in, False
            inner = self.expression()
            self.no_in = hold
            self.need(")")
            return self.node("parenthesized_expression", start, inner)
        if token.text == "[":
            self.step()
            return self.node("array", start, *self.listed("]", self.spread))
        if token.text == "{":
            self.step()
            hold, self.no_in = self.no_in, False
            out = self.node("object", start, *self.listed("}", self.property))
            self.no_in = hold
            return out
        if token.text in ("/", "/=") and (end := self.lexer.regex(token)):
            self.go(end)
            return self.node("regex", start)
        if token.text == "@":
            marks = self.decorators()
            out = self.class_like(self.now.start, "class")
            out.children[:0] = marks
            return out
        raise Unreadable

    def callee(self) -> Node:
        """What `new` makes: names and indexes, no calls."""
        out = self.primary()
        start = out.start
        while True:
            if self.takes("."):
                out = self.node("member_expression", start, out, self.any_name("property_identifier"))
            elif self.takes("["):
                index = self.expression()
                self.need("]")
                out = self.node("subscript_expression", start, out, index)
            else:
                return out

    def property(self) -> Node:
        start = self.now.start
        if self.takes("..."):
            return self.node("spread_element", start, self.assignment())
        while self.now.text in ("get", "set", "async") and self.now.kind == "name" and self.peek().text not in (",", ":", "(", "}", "=", "<"):
            self.step()
        self.takes("*")
        name = self.property_name()
        if self.takes(":"):
            return self.node("pair", start, name, self.assignment())
        if self.sees("(", "<"):
            head = self.signature()
            return self.node("method_definition", start, *head, name=name, body=self.block())
        if self.takes("="):
            return self.node("assignment_pattern", start, name, self.assignment())
        return name


def _place_comments(root: Node, comments: dict[int, int]) -> None:
    for start, end in sorted(comments.items()):
        home = root
        while (inner := next((c for c in home.children if c.start <= start and end <= c.end and c.kind != "comment"), None)) is not None:
            home = inner
        home.children.append(Node("comment", start, end))
        home.children.sort(key=lambda c: (c.start, c.end))


@lru_cache(maxsize=64)
def parse(source: str) -> Tree:
    """The tree of a program; the same source is parsed once while it is remembered."""
    parser = Parser(source)
    root = parser.program()
    _place_comments(root, parser.lexer.comments)
    stack = [root]
    while stack:
        node = stack.pop()
        for child in node.children:
            child.parent = node
            stack.append(child)
    return Tree(source, root, parser.failed)
