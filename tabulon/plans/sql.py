"""The SQL subset: one table, SELECT / COUNT / INSERT / UPDATE / DELETE.

A small recursive-descent parser is the whole front end.  It gives the
predicates and pages of the query builder, so both have one semantics, and
says no to everything outside the subset.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from ..errors import IncompatibleValue, SQLArguments, SQLUnknownField, SQLUnsafeWrite, UnsupportedSQL
from ..schema import INTEGRAL, NUMERIC, FieldSpec, TableSpec
from . import predicates as q
from .compile import moment

_TOKEN = re.compile(
    r"\s+|--[^\n]*|/\*.*?\*/|(?P<str>'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\")|(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)"
    r"|`(?P<quoted>[^`]+)`|(?P<word>[A-Za-z_]\w*)|(?P<op><=>|<=|>=|<>|!=|[=<>(),.*?;+/%-])",
    re.S,
)
_RESERVED = frozenset("select from where order by limit offset and or not in is null between like regexp rlike exists group having join on as asc desc union distinct".split())
PLACE = object()


@dataclass
class Select:
    table: str
    alias: str = ""
    star: bool = False
    count: bool = False
    columns: list[tuple[str, str]] = field(default_factory=list)  # (name, as)
    where: Any = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: Any = None
    offset: Any = None


@dataclass
class Insert:
    table: str
    columns: list[str]
    rows: list[list[Any]]


@dataclass
class Update:
    table: str
    assignments: list[tuple[str, Any]]
    where: Any


@dataclass
class Delete:
    table: str
    where: Any


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise UnsupportedSQL(f"cannot read {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.at = 0
        self.places = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def is_word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.lower() in words

    def take(self, what: str) -> None:
        kind, text = self.peek()
        if (kind == "word" and text.lower() == what) or (kind == "op" and text == what):
            self.at += 1
            return
        raise UnsupportedSQL(f"expected {what.upper()}, found {text or 'the end'}")

    def maybe(self, what: str) -> bool:
        kind, text = self.peek()
        if (kind == "word" and text.lower() == what) or (kind == "op" and text == what):
            self.at += 1
            return True
        return False

    def name(self) -> str:
        kind, text = self.peek()
        if kind == "quoted" or (kind == "word" and text.lower() not in _RESERVED):
            self.at += 1
            return text
        raise UnsupportedSQL(f"expected a name, found {text or 'the end'}")

    def statement(self) -> Select | Insert | Update | Delete:
        kinds = {"select": self.select, "insert": self.insert, "update": self.update, "delete": self.delete}
        kind, text = self.peek()
        if kind != "word" or text.lower() not in kinds:
            raise UnsupportedSQL(f"{text or 'nothing'} is not a supported statement")
        self.at += 1
        out = kinds[text.lower()]()
        self.maybe(";")
        if self.peek()[0] != "end":
            raise UnsupportedSQL(f"unexpected {self.peek()[1]!r}")
        return out

    def select(self) -> Select:
        out = Select("")
        qualifiers: list[str] = []
        if self.is_word("distinct", "all"):
            raise UnsupportedSQL("DISTINCT is not supported")
        while True:
            if self.maybe("*"):
                out.star = True
            elif self.is_word("count") and self.peek(1) == ("op", "("):
                self.at += 2
                if not (self.maybe("*") and self.maybe(")")):
                    raise UnsupportedSQL("only COUNT(*) is supported")
                out.count = True
            else:
                name = self.name()
                if self.peek() == ("op", "("):
                    raise UnsupportedSQL("functions are not supported")
                if self.maybe("."):
                    qualifiers.append(name)
                    if self.maybe("*"):
                        out.star = True
                        name = ""
                    else:
                        name = self.name()
                if name:
                    label = self.name() if self.maybe("as") or self.peek()[0] == "quoted" or (self.peek()[0] == "word" and self.peek()[1].lower() not in _RESERVED) else name
                    out.columns.append((name, label))
                elif out.columns:
                    raise UnsupportedSQL("a star does not stand with columns")
            if not self.maybe(","):
                break
        if (out.star or out.count) and (out.columns or (out.star and out.count)):
            raise UnsupportedSQL("a star or COUNT(*) does not stand with columns")
        self.take("from")
        out.table = self.name()
        if self.peek() in (("op", "."), ("op", ","), ("op", "(")) or self.is_word("join", "inner", "left", "right", "cross", "use", "force", "ignore", "partition"):
            raise UnsupportedSQL("one plain table is supported")
        if self.maybe("as") or (self.peek()[0] in ("word", "quoted") and not self.is_word(*_RESERVED, "for", "lock")):
            out.alias = self.name()
        for used in qualifiers:
            self.qualified(used, out)
        self.scope = out
        if self.maybe("where"):
            out.where = self.disjunction()
        if self.is_word("group", "having", "union", "for", "lock"):
            raise UnsupportedSQL(f"{self.peek()[1].upper()} is not supported")
        if self.maybe("order"):
            self.take("by")
            while True:
                name = self.column()
                down = self.maybe("desc")
                if not down:
                    self.maybe("asc")
                out.order.append((name, down))
                if not self.maybe(","):
                    break
            if len({d for _, d in out.order}) > 1:
                raise UnsupportedSQL("one direction for all keys is supported")
        if self.maybe("limit"):
            first = self.number()
            if self.maybe(","):
                out.offset, out.limit = first, self.number()
            else:
                out.limit = first
                if self.maybe("offset"):
                    out.offset = self.number()
        return out

    def qualified(self, used: str, scope: Select | None) -> None:
        if scope is None or used not in (scope.table, scope.alias):
            raise SQLUnknownField(f"{used} is not the table of this statement")

    def number(self) -> Any:
        value = self.value()
        if value[0] == "place" or (value[0] == "lit" and isinstance(value[1], int) and not isinstance(value[1], bool) and value[1] >= 0):
            return value
        raise UnsupportedSQL("LIMIT and OFFSET take whole numbers from 0")

    def value(self) -> tuple[str, Any]:
        kind, text = self.peek()
        self.at += 1
        if kind == "str":
            body = text[1:-1].replace(text[0] * 2, text[0])
            return "lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), body)
        if kind == "num":
            return "lit", int(text) if text.isdigit() else float(text)
        if (kind, text) == ("op", "-") and self.peek()[0] == "num":
            return "lit", -self.value()[1]
        if (kind, text) == ("op", "?"):
            self.places += 1
            return "place", self.places - 1
        if kind == "word" and text.lower() in ("true", "false", "null"):
            return "lit", {"true": True, "false": False, "null": None}[text.lower()]
        raise UnsupportedSQL(f"expected a value, found {text or 'the end'}")

    def column(self) -> str:
        name = self.name()
        if self.maybe("."):
            self.qualified(name, getattr(self, "scope", None))
            name = self.name()
        if self.peek() == ("op", "("):
            raise UnsupportedSQL("functions are not supported")
        return name

    def disjunction(self) -> Any:
        parts = [self.conjunction()]
        while self.maybe("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def conjunction(self) -> Any:
        parts = [self.negation()]
        while self.maybe("and"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def negation(self) -> Any:
        if self.maybe("not"):
            return ("not", [self.negation()])
        if self.is_word("exists"):
            raise UnsupportedSQL("EXISTS is not supported")
        if self.maybe("("):
            inner = self.disjunction()
            self.take(")")
            return inner
        return self.comparison()

    def comparison(self) -> Any:
        if self.peek()[0] not in ("word", "quoted"):
            raise UnsupportedSQL("a column stands on the left of a comparison")
        name = self.column()
        if self.is_word("is", "between", "like", "regexp", "rlike"):
            raise UnsupportedSQL(f"{self.peek()[1].upper()} is not supported")
        away = self.maybe("not")
        if self.maybe("in"):
            self.take("(")
            values = [self.value()]
            while self.maybe(","):
                values.append(self.value())
            self.take(")")
            node = ("in", name, values)
            return ("not", [node]) if away else node
        kind, op = self.peek()
        if away or kind != "op" or op not in ("=", "!=", "<>", ">", ">=", "<", "<="):
            raise UnsupportedSQL(f"{op or 'this'} is not a supported operator")
        self.at += 1
        node = ("cmp", "=" if op in ("!=", "<>") else op, name, self.value())
        if self.peek()[0] == "op" and self.peek()[1] in ("+", "-", "*", "/", "%", "="):
            raise UnsupportedSQL("arithmetic is not supported")
        return ("not", [node]) if op in ("!=", "<>") else node

    def insert(self) -> Insert:
        if self.is_word("ignore"):
            raise UnsupportedSQL("INSERT IGNORE is not supported")
        self.take("into")
        table = self.name()
        if self.peek() != ("op", "("):
            raise UnsupportedSQL("INSERT needs a column list")
        self.take("(")
        columns = [self.name()]
        while self.maybe(","):
            columns.append(self.name())
        self.take(")")
        self.take("values")
        rows = []
        while True:
            self.take("(")
            row = [self.value()]
            while self.maybe(","):
                row.append(self.value())
            self.take(")")
            if len(row) != len(columns):
                raise UnsupportedSQL("a row has another number of values than there are columns")
            rows.append(row)
            if not self.maybe(","):
                break
        return Insert(table, columns, rows)

    def update(self) -> Update:
        table = self.name()
        self.scope = Select(table)
        self.take("set")
        sets = []
        while True:
            name = self.column()
            self.take("=")
            sets.append((name, self.value()))
            if self.peek()[0] == "op" and self.peek()[1] in ("+", "-", "*", "/", "%"):
                raise UnsupportedSQL("only literals are assigned")
            if not self.maybe(","):
                break
        return Update(table, sets, self.disjunction() if self.maybe("where") else None)

    def delete(self) -> Delete:
        self.take("from")
        table = self.name()
        self.scope = Select(table)
        return Delete(table, self.disjunction() if self.maybe("where") else None)


RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def convert(f: FieldSpec, value: Any) -> Any:
    """A literal as a value of the field's type; raises where it has none."""
    if value is None:
        if not f.nullable:
            raise IncompatibleValue(f"{f.name} takes no NULL")
        return None
    if isinstance(value, bool) != isinstance(f.type, T.BooleanType):
        raise IncompatibleValue(f"{value!r} does not fit {f.name}")
    if isinstance(f.type, NUMERIC):
        if isinstance(value, str):
            raise IncompatibleValue(f"{value!r} does not fit {f.name}")
        if isinstance(f.type, INTEGRAL):
            value = int(value)  # a fraction goes towards zero
            bits = RANGES[type(f.type)]
            if not -(1 << bits) <= value < 1 << bits:
                raise IncompatibleValue(f"{value} overflows {f.name}")
        return value
    if isinstance(f.type, T.StringType) and not isinstance(value, str):
        raise IncompatibleValue(f"{value!r} does not fit {f.name}")
    if isinstance(f.type, (T.TimestampType, T.TimestampNTZType)) and moment(value, f.type) is None:
        raise IncompatibleValue(f"{value!r} is not a time")
    return value


class Binder:
    """Puts arguments in the places of a statement and names into fields."""

    def __init__(self, spec: TableSpec, args: tuple[Any, ...], places: int):
        if len(args) != places:
            raise SQLArguments(f"{places} placeholders, {len(args)} arguments")
        self.spec, self.args = spec, args

    def value(self, v: tuple[str, Any]) -> Any:
        return self.args[v[1]] if v[0] == "place" else v[1]

    def whole(self, v: Any, default: int) -> int:
        if v is None:
            return default
        n = self.value(v)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise UnsupportedSQL("LIMIT and OFFSET take whole numbers from 0")
        return n

    def predicate(self, node: Any) -> q.Predicate:
        if node is None:
            return q.True_()
        if node[0] in ("and", "or", "not"):
            parts = [self.predicate(x) for x in node[1]]
            return {"and": q.And, "or": q.Or, "not": q.Not}[node[0]](*parts)
        if node[0] == "in":
            f = self.spec.lookup(node[1])
            flat: list[Any] = []
            for v in node[2]:
                v = self.value(v)
                flat += list(v) if isinstance(v, (list, tuple)) else [v]
            return q.In(f.column, [convert(f, v) for v in flat])
        f = self.spec.lookup(node[2])
        return q.Comparison(node[1], f.column, convert(f, self.value(node[3])))


def guarded(where: Any, allow_full: bool) -> None:
    if where is None and not allow_full:
        raise SQLUnsafeWrite()
