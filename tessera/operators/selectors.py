"""Column selection: names, ranges by position, patterns, lists, and their negation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Selector:
    kind: str
    value: tuple = ()
    negated: bool = False

    def __invert__(self) -> Selector:
        return Selector(self.kind, self.value, not self.negated)


def starts_with(s: str) -> Selector:
    return Selector("starts_with", (s,))


def ends_with(s: str) -> Selector:
    return Selector("ends_with", (s,))


def contains(s: str) -> Selector:
    return Selector("contains", (s,))


def everything() -> Selector:
    return Selector("everything")


def span(first: str, last: str) -> Selector:
    """All columns from the first to the last, by position."""
    return Selector("span", (first, last))


def cols(*names) -> Selector:
    return Selector("list", names)


def exclude(*names) -> Selector:
    return ~Selector("list", names)


def of(x) -> Selector:
    """A selector from what a verb is given: 'a', 'a:b', '!a', '!a:b', a list, or a selector."""
    if isinstance(x, Selector):
        return x
    if isinstance(x, (list, tuple, set)):
        return Selector("list", tuple(x))
    if hasattr(x, "path"):
        x = x.path
    if x.startswith("!"):
        return ~of(x[1:].strip("()"))
    return span(*x.split(":", 1)) if ":" in x else Selector("name", (x,))


def _found(s: Selector, columns: list[str], name) -> list[str]:
    if s.kind == "list":
        return [c for x in s.value for c in resolve([x], columns, name)]
    if s.kind == "name":
        got = name(s.value[0])
        if got not in columns:
            raise KeyError(f"no column {s.value[0]!r} among {columns}")
        return [got]
    if s.kind == "span":
        a, b = (columns.index(_found(Selector("name", (v,)), columns, name)[0]) for v in s.value)
        if a > b:
            raise ValueError(f"{s.value[0]} comes after {s.value[1]}")
        return columns[a : b + 1]
    test = {"starts_with": str.startswith, "ends_with": str.endswith, "contains": str.__contains__, "everything": lambda c, *_: True}[s.kind]
    return [c for c in columns if test(c, *s.value)]


def resolve(items, columns: list[str], name=lambda n: n) -> list[str]:
    """Included columns in the order written, without those excluded; only exclusions start from all columns."""
    chosen = [of(x) for x in items]
    include = [c for s in chosen if not s.negated for c in _found(s, columns, name)]
    drop = {c for s in chosen if s.negated for c in _found(s, columns, name)}
    if not any(not s.negated for s in chosen):
        include = columns
    return [c for c in dict.fromkeys(include) if c not in drop]


class Across:
    """Functions applied to selected columns: across(selection, (mean, std)); results are named column_function."""

    def __init__(self, selection, functions):
        self.selection = selection if isinstance(selection, (list, tuple)) else [selection]
        self.functions = list(functions) if isinstance(functions, (list, tuple)) else [functions]

    def expand(self, columns: list[str], name) -> dict:
        picked = resolve(self.selection, columns, name)
        return {f"{c}_{f.__name__}": f(c) for f in self.functions for c in picked}


def across(selection, functions) -> Across:
    return Across(selection, functions)
