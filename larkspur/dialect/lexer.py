"""Tokens of the dialect: words, numbers, strings in either quote (doubled inside), signs; ``--`` comments run to the line's end."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*)|(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^']|'')*'|"(?:[^"]|"{2})*")|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<sign><>|!=|<=|>=|[-+*/%=<>(),.;])""")


class DialectError(ValueError):
    """A statement that the dialect does not accept, with the place."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            line = text.count("\n", 0, at) + 1
            raise DialectError(f"unexpected character {text[at]!r} in line {line}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
