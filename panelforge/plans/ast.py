"""Expression trees: nodes, canonical text, complexity measures, common subtrees."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

COMMUTATIVE = frozenset(("+", "*", "==", "!=", "&&", "||"))


@dataclass(frozen=True)
class Node:
    def children(self) -> tuple[Node, ...]:
        return ()

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Var(Node):
    name: str

    def __str__(self) -> str:
        return f"${self.name}"


@dataclass(frozen=True)
class Number(Node):
    value: float | None

    def __str__(self) -> str:
        if self.value is None:
            return "NULL"
        return str(int(self.value)) if self.value == int(self.value) and abs(self.value) < 1e15 else repr(self.value)


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]

    def children(self):
        return self.args

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.args))})"


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node

    def children(self):
        return (self.arg,)

    def __str__(self) -> str:
        return f"({self.op}{self.arg})"


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node

    def children(self):
        return (self.left, self.right)

    def __str__(self) -> str:
        return f"({self.left}{self.op}{self.right})"


@dataclass(frozen=True)
class Cond(Node):
    test: Node
    then: Node
    other: Node

    def children(self):
        return (self.test, self.then, self.other)

    def __str__(self) -> str:
        return f"({self.test}?{self.then}:{self.other})"


def canonical(node: Node) -> str:
    """Text that is equal for trees equal up to the order of commutative operands."""
    kids = [canonical(c) for c in node.children()]
    match node:
        case Binary(op=op):
            return f"({op.join(sorted(kids) if op in COMMUTATIVE else kids)})"
        case Call(name=name):
            return f"{name}({','.join(kids)})"
        case Unary(op=op):
            return f"({op}{kids[0]})"
        case Cond():
            return f"({kids[0]}?{kids[1]}:{kids[2]})"
    return str(node)


def size(node: Node) -> int:
    return sum(1 for _ in node.walk())


def measures(node: Node, text: str) -> dict[str, int]:
    """Length without white space, nodes, free numbers, distinct fields, fields in all."""
    nodes = list(node.walk())
    names = [n.name for n in nodes if isinstance(n, Var)]
    return {
        "symbol_length": len("".join(text.split())),
        "nodes": len(nodes),
        "numbers": sum(isinstance(n, Number) for n in nodes),
        "unique_vars": len(set(names)),
        "vars": len(names),
    }


def common_subtree(a: Node, b: Node) -> tuple[int, str]:
    """Nodes and canonical text of the largest subtree both trees have; ties by text."""
    mine = {canonical(n): size(n) for n in a.walk()}
    both = [(k, t) for n in b.walk() if (k := mine.get(t := canonical(n)))]
    return max(both, key=lambda x: (x[0], x[1]), default=(0, ""))


def duplicated(node: Node) -> Counter:
    return Counter(canonical(n) for n in node.walk() if size(n) > 1)


def acceptable(node: Node, text: str, zoo: list[Node], max_dup: int = 8, max_free: float = 0.5, max_unique: float = 0.5, max_length: int = 300, max_fields: int = 6) -> dict[str, object]:
    """Verdict on an expression against size limits and the overlap with known ones."""
    m = measures(node, text)
    overlap = max((common_subtree(node, z)[0] for z in zoo), default=0)
    reasons = [
        name
        for name, bad in (
            ("overlap", overlap > max_dup),
            ("free_numbers", m["numbers"] / m["nodes"] > max_free),
            ("unique_fields", m["unique_vars"] / m["nodes"] > max_unique),
            ("length", m["symbol_length"] > max_length),
            ("fields", m["unique_vars"] > max_fields),
        )
        if bad
    ]
    return m | {"overlap": overlap, "accepted": not reasons, "reasons": reasons}


def match_zoo(candidates, zoo, most: int = 100_000):
    """(name, zoo_name, nodes, subtree): the largest subtree each candidate shares with the zoo; the first name of equals.

    Both are tables of name and expression; the zoo's size is checked, then it goes to the tasks.
    """
    import pandas as pd

    from .parser import parse

    known = zoo.select("name", "expression").orderBy("name").limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"a zoo of more than {most} expressions")
    known = [(r["name"], r["expression"]) for r in known]

    def each(frames):
        trees = [(n, {canonical(x): size(x) for x in parse(e).walk()}) for n, e in known]
        for frame in frames:
            rows = []
            for name, text in zip(frame["name"], frame["expression"], strict=True):
                mine = {canonical(x): size(x) for x in parse(text).walk()}
                found = [(-k, n, t) for n, t in ((n, max(mine.keys() & z.keys(), key=lambda c: (mine[c], c), default="")) for n, z in trees) if (k := mine.get(t, 0))]
                k, n, t = min(found, default=(0, None, ""))
                rows.append((name, n, -k, t))
            yield pd.DataFrame(rows, columns=["name", "zoo_name", "nodes", "subtree"])

    return candidates.select("name", "expression").mapInPandas(each, "name string, zoo_name string, nodes int, subtree string")


def measured(candidates):
    """(name, symbol_length, nodes, numbers, unique_vars, vars) of a table of name and expression."""
    import pandas as pd

    from .parser import parse

    def each(frames):
        for frame in frames:
            rows = [(n, *measures(parse(e), e).values()) for n, e in zip(frame["name"], frame["expression"], strict=True)]
            yield pd.DataFrame(rows, columns=["name", "symbol_length", "nodes", "numbers", "unique_vars", "vars"])

    return candidates.select("name", "expression").mapInPandas(each, "name string, symbol_length int, nodes int, numbers int, unique_vars int, vars int")
