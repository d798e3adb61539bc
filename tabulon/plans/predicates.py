"""Predicates as immutable values: built by callers, compiled by ``compile``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def parts(self) -> tuple[Predicate, ...]:
        return ()

    def walk(self) -> Iterator[Predicate]:
        """This predicate and all within it, outermost first."""
        yield self
        for p in self.parts():
            yield from p.walk()

    def renamed(self, names: Callable[[str], str]) -> Predicate:
        """The same predicate over other field names."""
        return self


@dataclass(frozen=True)
class Comparison(Predicate):
    op: str  # = > >= < <=
    field: str
    value: Any

    def renamed(self, names):
        return replace(self, field=names(self.field))


@dataclass(frozen=True)
class StrictComparison(Predicate):
    field: str
    value: Any

    def renamed(self, names):
        return replace(self, field=names(self.field))


@dataclass(frozen=True)
class Membership(Predicate):
    field: str
    values: Any

    def renamed(self, names):
        return replace(self, field=names(self.field))


@dataclass(frozen=True)
class Pattern(Predicate):
    field: str
    pattern: str

    def renamed(self, names):
        return replace(self, field=names(self.field))


@dataclass(frozen=True)
class FieldComparison(Predicate):
    op: str
    field: str
    other: str

    def renamed(self, names):
        return replace(self, field=names(self.field), other=names(self.other))


@dataclass(frozen=True)
class Junction(Predicate):
    kind: str  # and, or, not: none of the parts
    of: tuple[Predicate, ...]

    def parts(self):
        return self.of

    def renamed(self, names):
        return replace(self, of=tuple(p.renamed(names) for p in self.of))


@dataclass(frozen=True)
class Always(Predicate):
    pass


@dataclass(frozen=True)
class Custom(Predicate):
    """A Python function over a whole record, as a dict; stays behind what Spark can evaluate."""

    test: Callable[[dict], bool]


@dataclass(frozen=True)
class CustomField(Predicate):
    """A function over a pandas Series of one field's values."""

    field: str
    test: Callable[[Any], Any]

    def renamed(self, names):
        return replace(self, field=names(self.field))


def Eq(field: str, value: Any) -> Predicate:  # noqa: N802
    return Comparison("=", field, value)


def Ne(field: str, value: Any) -> Predicate:  # noqa: N802
    return Not(Eq(field, value))


def Gt(field: str, value: Any) -> Predicate:  # noqa: N802
    return Comparison(">", field, value)


def Gte(field: str, value: Any) -> Predicate:  # noqa: N802
    return Comparison(">=", field, value)


def Lt(field: str, value: Any) -> Predicate:  # noqa: N802
    return Comparison("<", field, value)


def Lte(field: str, value: Any) -> Predicate:  # noqa: N802
    return Comparison("<=", field, value)


def StrictEq(field: str, value: Any) -> Predicate:  # noqa: N802
    return StrictComparison(field, value)


def In(field: str, values: Any) -> Predicate:  # noqa: N802
    return Membership(field, tuple(values) if isinstance(values, (list, set, frozenset)) else values)


def Re(field: str, pattern: str) -> Predicate:  # noqa: N802
    return Pattern(field, pattern)


def EqF(field: str, other: str) -> Predicate:  # noqa: N802
    return FieldComparison("=", field, other)


def GtF(field: str, other: str) -> Predicate:  # noqa: N802
    return FieldComparison(">", field, other)


def GteF(field: str, other: str) -> Predicate:  # noqa: N802
    return FieldComparison(">=", field, other)


def LtF(field: str, other: str) -> Predicate:  # noqa: N802
    return FieldComparison("<", field, other)


def LteF(field: str, other: str) -> Predicate:  # noqa: N802
    return FieldComparison("<=", field, other)


def And(*of: Predicate) -> Predicate:  # noqa: N802
    return Junction("and", of)


def Or(*of: Predicate) -> Predicate:  # noqa: N802
    return Junction("or", of)


def Not(*of: Predicate) -> Predicate:  # noqa: N802
    return Junction("not", of)


def True_() -> Predicate:  # noqa: N802
    return Always()


def explain(p: Predicate) -> tuple[dict, bool]:
    """A description of a predicate, and whether Spark can evaluate all of it."""
    known = not any(isinstance(x, (Custom, CustomField)) for x in p.walk())

    def told(x: Predicate) -> dict:
        if isinstance(x, Junction):
            return {"kind": x.kind, "of": [told(y) for y in x.of]}
        if isinstance(x, Comparison):
            return {"kind": x.op, "field": x.field, "value": x.value}
        if isinstance(x, Always):
            return {"kind": "true"}
        return {"kind": type(x).__name__, **{k: v for k, v in vars(x).items() if not callable(v)}}

    return told(p), known


def fields(p: Predicate) -> list[str]:
    """The fields a predicate reads, in order, each once."""
    out: dict[str, None] = {}
    for x in p.walk():
        for name in ("field", "other"):
            if isinstance(getattr(x, name, None), str):
                out[getattr(x, name)] = None
    return list(out)
