"""GraphQL documents: a recursive-descent parser for executable documents.

Operations with variables, aliases, arguments, lists, objects, enums and directives;
fragments are rejected.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from ..errors import GraphQLError

_TOKEN = re.compile(
    r"""(?P<skip>[\s,﻿]+|\#[^\n]*)
    |(?P<spread>\.\.\.)
    |(?P<punct>[!$()\[\]{}:=@|&])
    |(?P<float>-?(?:0|[1-9]\d*)(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+))
    |(?P<int>-?(?:0|[1-9]\d*))
    |(?P<name>[A-Za-z_]\w*)
    |(?P<block>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")
    |(?P<string>"(?:[^"\\\n]|\\.)*")""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Enum:
    name: str


@dataclass(frozen=True)
class Directive:
    name: str
    arguments: dict[str, Any]


@dataclass(frozen=True)
class Selection:
    name: str
    alias: str | None
    arguments: dict[str, Any]
    directives: list[Directive]
    selections: list[Selection]

    @property
    def key(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class VariableDefinition:
    name: str
    type: str
    has_default: bool
    default: Any


@dataclass(frozen=True)
class Operation:
    kind: str
    name: str | None
    variables: list[VariableDefinition]
    selections: list[Selection] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise GraphQLError(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, value: str | None = None) -> bool:
        if self.at >= len(self.tokens):
            return False
        return value is None or self.tokens[self.at][1] == value and self.tokens[self.at][0] in ("punct", "name", "spread")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise GraphQLError("unexpected end of the document")
        found = self.tokens[self.at]
        if kind and found[0] != kind or value and found[1] != value:
            raise GraphQLError(f"expected {value or kind}, found {found[1]!r}")
        self.at += 1
        return found[1]

    def document(self) -> list[Operation]:
        out = []
        while self.peek():
            out.append(self.operation())
        if not out:
            raise GraphQLError("the document holds no operation")
        return out

    def operation(self) -> Operation:
        if self.peek("{"):
            return Operation("query", None, [], self.selection_set())
        kind = self.take("name")
        if kind == "fragment":
            raise GraphQLError("fragments are not supported")
        if kind not in ("query", "mutation", "subscription"):
            raise GraphQLError(f"unknown operation {kind}")
        name = self.take("name") if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else None
        variables = []
        if self.peek("("):
            self.take()
            while not self.peek(")"):
                self.take("punct", "$")
                own = self.take("name")
                self.take("punct", ":")
                kind_of = self.type()
                has = self.peek("=")
                if has:
                    self.take()
                variables.append(VariableDefinition(own, kind_of, has, self.value() if has else None))
            self.take()
        if self.directives():
            raise GraphQLError("directives on operations are not supported")
        return Operation(kind, name, variables, self.selection_set())

    def type(self) -> str:
        if self.peek("["):
            self.take()
            inner = f"[{self.type()}"
            self.take("punct", "]")
            out = inner + "]"
        else:
            out = self.take("name")
        if self.peek("!"):
            self.take()
            out += "!"
        return out

    def selection_set(self) -> list[Selection]:
        self.take("punct", "{")
        out = []
        while not self.peek("}"):
            if self.peek("..."):
                raise GraphQLError("fragments are not supported")
            first = self.take("name")
            alias = None
            if self.peek(":"):
                self.take()
                alias, first = first, self.take("name")
            arguments = self.arguments()
            directives = self.directives()
            inner = self.selection_set() if self.peek("{") else []
            out.append(Selection(first, alias, arguments, directives, inner))
        self.take()
        if not out:
            raise GraphQLError("a selection set is empty")
        return out

    def arguments(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.peek("("):
            self.take()
            while not self.peek(")"):
                name = self.take("name")
                if name in out:
                    raise GraphQLError(f"argument {name} is given twice")
                self.take("punct", ":")
                out[name] = self.value()
            self.take()
        return out

    def directives(self) -> list[Directive]:
        out = []
        while self.peek("@"):
            self.take()
            out.append(Directive(self.take("name"), self.arguments()))
        return out

    def value(self) -> Any:
        if self.peek("$"):
            self.take()
            return Variable(self.take("name"))
        if self.peek("["):
            self.take()
            out = []
            while not self.peek("]"):
                out.append(self.value())
            self.take()
            return out
        if self.peek("{"):
            self.take()
            made = {}
            while not self.peek("}"):
                name = self.take("name")
                self.take("punct", ":")
                made[name] = self.value()
            self.take()
            return made
        kind = self.tokens[self.at][0] if self.peek() else None
        text = self.take()
        if kind == "int":
            return int(text)
        if kind == "float":
            return float(text)
        if kind == "string":
            return json.loads(text)
        if kind == "block":
            return text[3:-3].strip("\n")
        if kind == "name":
            return {"true": True, "false": False, "null": None}.get(text, Enum(text)) if text in ("true", "false", "null") else Enum(text)
        raise GraphQLError(f"unexpected {text!r}")


def parse(text: str) -> list[Operation]:
    return _Parser(text).document()
