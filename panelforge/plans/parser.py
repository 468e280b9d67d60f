"""A precedence-climbing parser of the expression language; nothing is evaluated as code."""

from __future__ import annotations

import re

from .ast import Binary, Call, Cond, Node, Number, Unary, Var


class ExpressionError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\$?[A-Za-z_]\w*)|(&&|\|\||[<>=!]=|[-+*/<>&|?:(),]))")
_LEVEL = {"||": 1, "|": 1, "&&": 2, "&": 2, ">": 3, "<": 3, ">=": 3, "<=": 3, "==": 3, "!=": 3, "+": 4, "-": 4, "*": 5, "/": 5}
_SAME = {"|": "||", "&": "&&"}
_LITERALS = {"TRUE": 1.0, "FALSE": 0.0, "NAN": None, "NULL": None}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:10]!r} at {at}")
        out.append(("number" if m[1] else "name" if m[2] else "op", m[1] or m[2] or m[3]))
        at = m.end()
    return out


def parse(text: str) -> Node:
    stream, at = tokens(text), 0

    def peek() -> str | None:
        return stream[at][1] if at < len(stream) and stream[at][0] == "op" else None

    def take(what: str) -> None:
        nonlocal at
        if peek() != what:
            raise ExpressionError(f"{what!r} is missing in {text!r}")
        at += 1

    def atom() -> Node:
        nonlocal at
        if at >= len(stream):
            raise ExpressionError(f"{text!r} ends too early")
        kind, value = stream[at]
        at += 1
        if kind == "number":
            return Number(float(value))
        if kind == "name":
            if value.startswith("$"):
                return Var(value[1:])
            if peek() == "(":
                take("(")
                args = []
                while peek() != ")":
                    args.append(ternary())
                    if peek() == ",":
                        take(",")
                    elif peek() != ")":
                        raise ExpressionError(f"')' is missing in {text!r}")
                take(")")
                return Call(value.upper(), tuple(args))
            if value.upper() in _LITERALS:
                return Number(_LITERALS[value.upper()])
            return Var(value)
        if value == "-":
            inner = atom()
            return Number(-inner.value) if isinstance(inner, Number) and inner.value is not None else Unary("-", inner)
        if value == "+":
            return atom()
        if value == "(":
            inner = ternary()
            take(")")
            return inner
        raise ExpressionError(f"unexpected {value!r} in {text!r}")

    def binary(least: int) -> Node:
        nonlocal at
        left = atom()
        while (op := peek()) in _LEVEL and _LEVEL[op] >= least:
            at += 1
            left = Binary(_SAME.get(op, op), left, binary(_LEVEL[op] + 1))
        return left

    def ternary() -> Node:
        test = binary(1)
        if peek() != "?":
            return test
        take("?")
        then = ternary()
        take(":")
        return Cond(test, then, ternary())

    node = ternary()
    if at != len(stream):
        raise ExpressionError(f"unexpected {stream[at][1]!r} in {text!r}")
    return node


def fields(node: Node) -> list[str]:
    return list(dict.fromkeys(n.name for n in node.walk() if isinstance(n, Var)))
