"""Compiles expressions to staged DataFrame plans.

Windows can't nest, so every window subtree becomes one column, made a level after the
windows it reads; equal subtrees of any of the expressions are one column.  Windows of a
level share a select, so Spark puts those of one spec into one operator and sorts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import REGISTRY, Function
from ..functions.windows import Axes, num
from .ast import Binary, Call, Cond, Node, Number, Unary, Var, canonical
from .parser import ExpressionError, fields, parse

#: Fields no expression may read: keys, and labels that look ahead.
FORBIDDEN = frozenset(("ret", "log_ret", "ex_ret", "ex_log_ret", "ret_10m", "ex_ret_10m", "log_ret_10m", "ex_log_ret_10m"))
_OPS = {"+": "ADD", "-": "SUBTRACT", "*": "MULTIPLY", "/": "DIVIDE", ">": "GT", "<": "LT", ">=": "GE", "<=": "LE", "==": "EQ", "!=": "NE", "&&": "AND", "||": "OR"}
MAX_LEVELS = 24  # windows over windows: each level may sort once more


def validate(node: Node, known: list[str], axes: Axes) -> None:
    for name in fields(node):
        if name in FORBIDDEN or name in axes.keys:
            raise ExpressionError(f"${name} is a key or a label and can't be read")
        if name not in known:
            raise ExpressionError(f"${name} is not a field")
    for n in node.walk():
        if isinstance(n, Call) and n.name not in REGISTRY:
            raise ExpressionError(f"{n.name} is not a function")


def _function(call: Call) -> tuple[Function, list[Node], list[float | None]]:
    """The overload that fits: leading arguments with fields are columns, the rest literals."""
    args = list(call.args)
    literal = lambda n: isinstance(n, Number)
    lead = 0
    while lead < len(args) and not (lead and all(map(literal, args[lead:]))):
        lead += 1
    # A literal in the middle swaps places with a column behind it: SUMIF(x, 5, c).
    middle = [a for a in args[:lead] if literal(a)]
    for f in REGISTRY[call.name]:
        low, high = f.columns
        if f.kind == "scalar" and low <= len(args) <= high:
            return f, args, []
        cols = args[:lead] if low <= lead <= high else [a for a in args[:lead] if not literal(a)]
        if low <= len(cols) <= high:
            rest = ([] if low <= lead <= high else middle) + args[lead:]
            if all(map(literal, rest)):
                return f, cols, [r.value for r in rest]
    raise ExpressionError(f"{call.name} doesn't take the arguments of {call}")


def evaluate(df: DataFrame, expressions: dict[str, str], axes: Axes = Axes()) -> DataFrame:
    """The panel's keys and one column for each named expression."""
    trees = {name: parse(text) for name, text in expressions.items()}
    known = [c for c in df.columns if c not in axes.keys]
    for tree in trees.values():
        validate(tree, known, axes)
    columns: dict[str, tuple[int, Column]] = {}
    levels: dict[int, dict[str, Column]] = {}

    def make(node: Node) -> tuple[int, Column]:
        key = canonical(node)
        if key not in columns:
            columns[key] = build(node)
            if columns[key][0] > MAX_LEVELS:
                raise ExpressionError(f"more than {MAX_LEVELS} windows over windows")
        return columns[key]

    def build(node: Node) -> tuple[int, Column]:
        match node:
            case Number(value=v):
                return 0, F.lit(v).cast("double")
            case Var(name=name):
                return 0, F.col(f"_f_{name}")
            case Unary(arg=a):
                level, x = make(a)
                return level, -x.cast("double")
            case Cond(test=t, then=a, other=b):
                return make(Call("WHERE", (t, a, b)))
            case Binary(op=op, left=a, right=b):
                return make(Call(_OPS[op], (a, b)))
        f, args, rest = _function(node)
        made = [make(a) for a in args]
        level = max((m[0] for m in made), default=0)
        value = f.build(axes, *[m[1] for m in made], *rest)
        if f.kind == "scalar":
            return level, value
        if f.kind == "steps":
            *steps, final = value
            seen: list[Column] = []
            for step in steps:
                level += 1
                name = f"_w{len(columns)}_{level}"
                levels.setdefault(level, {})[name] = step(*seen)
                seen.append(F.col(name))
            return level, final(*seen)
        name = f"_w{len(columns)}_{level + 1}"
        levels.setdefault(level + 1, {})[name] = value
        return level + 1, F.col(name)

    outputs = {name: make(tree) for name, tree in trees.items()}
    used = sorted({n for t in trees.values() for n in fields(t)})
    plan = df.select(*axes.keys, *[num(F.col(c).cast("double")).alias(f"_f_{c}") for c in used])
    for level in sorted(levels):
        plan = plan.withColumns(levels[level])
    return plan.select(*axes.keys, *[c.alias(name) for name, (_, c) in outputs.items()])
