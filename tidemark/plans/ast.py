"""Expression trees of the factor language and its parser.

The grammar is an allow-list: numbers, variables, calls of registered functions,
``+ - * / **``, comparisons, ``& | ~``, ``c ? a : b`` and parentheses. Nothing is
ever evaluated as Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(\*\*|<=|>=|==|!=|&&|\|\||[-+*/()<>&|~?:,]))")


class ExpressionError(ValueError):
    """The text is no expression of the language."""


@dataclass(frozen=True)
class Node:
    """op: a function's or operator's name, ``num`` or ``var``; args: operands;
    value: the number or the variable's name."""

    op: str
    args: tuple[Node, ...] = ()
    value: object = None

    def __str__(self) -> str:
        if self.op == "num":
            return repr(self.value) if self.value != int(self.value) or abs(self.value) >= 1e15 else str(int(self.value))
        if self.op == "var":
            return str(self.value)
        if self.op in _INFIX and len(self.args) == 2:
            return f"({self.args[0]} {self.op} {self.args[1]})"
        if self.op in ("neg", "not"):
            return f"({'-' if self.op == 'neg' else '~'}{self.args[0]})"
        return f"{self.op}({', '.join(map(str, self.args))})"


_INFIX = {"|": 1, "&": 2, "<": 3, ">": 3, "<=": 3, ">=": 3, "==": 3, "!=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "**": 7}


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 12]!r} at {at}")
        kind = "num" if m[1] else "name" if m[2] else "sign"
        out.append((kind, {"&&": "&", "||": "|"}.get(m[0].strip(), m[0].strip())))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends too early")
        t = self.tokens[self.at][1]
        if want and t != want:
            raise ExpressionError(f"{want!r} expected, {t!r} found")
        self.at += 1
        return t

    def whole(self) -> Node:
        n = self.choice()
        if self.peek() is not None:
            raise ExpressionError(f"unexpected {self.peek()!r}")
        return n

    def choice(self) -> Node:
        c = self.binary(1)
        if self.peek() != "?":
            return c
        self.take("?")
        a = self.choice()
        self.take(":")
        return Node("where", (c, a, self.choice()))

    def binary(self, level: int) -> Node:
        left = self.unary()
        while (op := self.peek()) in _INFIX and _INFIX[op] >= level:
            self.take()
            right = self.binary(_INFIX[op] + (op != "**"))
            left = Node(op, (left, right))
        return left

    def unary(self) -> Node:
        if self.peek() == "-":
            self.take()
            inner = self.binary(6)
            return Node("num", value=-inner.value) if inner.op == "num" else Node("neg", (inner,))
        if self.peek() == "+":
            self.take()
            return self.binary(6)
        if self.peek() == "~":
            self.take()
            return Node("not", (self.binary(6),))
        return self.atom()

    def atom(self) -> Node:
        if self.peek() == "(":
            self.take()
            n = self.choice()
            self.take(")")
            return n
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Node("num", value=float(text))
        if kind != "name":
            raise ExpressionError(f"unexpected {text!r}")
        if self.peek() != "(":
            return Node("var", value=text)
        self.take("(")
        args: list[Node] = []
        while self.peek() != ")":
            args.append(self.choice())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        return Node(text, tuple(args))


def parse(text: str) -> Node:
    """The tree of an expression; ExpressionError says what is wrong with it."""
    return _Parser(text).whole()


def walk(node: Node):
    for a in node.args:
        yield from walk(a)
    yield node
