"""Tokens of TypeScript source, one at a time, so the parser can say where a regex or a type may start."""

from __future__ import annotations

import re
from typing import NamedTuple

PUNCTUATION = [">>>=", "...", "===", "!==", "**=", "<<=", ">>=", ">>>", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "**", "{", "}", "(", ")", "[", "]", ";", ",", "<", ">", "+", "-", "*", "/", "%", "&", "|", "^", "!", "~", "?", ":", "=", ".", "@", "#"]
_PUNCT = re.compile("|".join(re.escape(p) for p in PUNCTUATION))
_BLANK = re.compile(r"[\s﻿]+")
_NAME = re.compile(r"#?(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4})*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*")
_COMMENT = re.compile(r"//[^\n\r  ]*|/\*[\s\S]*?\*/|<!--[^\n\r]*")


class Token(NamedTuple):
    kind: str  # name, number, string, template, punct, end, bad
    text: str
    start: int
    end: int
    newline: bool  # whether a line ends before it


class Lexer:
    """The token at a position, remembered; comments as they are passed."""

    def __init__(self, source: str):
        self.source = source
        self.comments: dict[int, int] = {}
        self.known: dict[int, Token] = {}

    def at(self, position: int) -> Token:
        found = self.known.get(position)
        if found is None:
            found = self.known[position] = self._read(position)
        return found

    def _read(self, at: int) -> Token:
        source, newline = self.source, False
        if at == 0 and source.startswith("#!"):
            at = source.find("\n") if "\n" in source else len(source)
        while True:
            if m := _BLANK.match(source, at):
                newline |= "\n" in m[0] or "\r" in m[0]
            elif source.startswith(("//", "/*"), at) and (m := _COMMENT.match(source, at)):
                newline |= "\n" in m[0]
                self.comments[at] = m.end()
            else:
                break
            at = m.end()
        if at >= len(source):
            return Token("end", "", len(source), len(source), True)
        c = source[at]
        if m := _NAME.match(source, at):
            return Token("name", m[0], at, m.end(), newline)
        if (c.isdigit() or c == "." and source[at + 1 : at + 2].isdigit()) and (m := _NUMBER.match(source, at)):
            return Token("number", m[0], at, m.end(), newline)
        if c in "'\"":
            m = _STRING.match(source, at)
            return Token("string", m[0], at, m.end(), newline) if m else Token("bad", c, at, at + 1, newline)
        if c == "`":
            return Token("template", c, at, at + 1, newline)
        if m := _PUNCT.match(source, at):
            return Token("punct", m[0], at, m.end(), newline)
        return Token("bad", c, at, at + 1, newline)

    def regex(self, token: Token) -> int | None:
        """End of the regex that starts at the token, if one does."""
        m = _REGEX.match(self.source, token.start)
        return m.end() if m else None
