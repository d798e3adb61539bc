"""Predicates to columns.

Logic is two-valued: a comparison with a missing value is false, and its
negation true.  Where null and false select the same rows (not below a
``Not``) the bare comparison is kept, so Parquet can prune by it.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadType, UnknownField
from ..functions.patterns import matches
from ..schema import INTEGRAL, NUMERIC, TIMES
from . import predicates as q

_FALSE = "false"
_OPS = {
    "=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def resolve(schema: T.StructType, name: str) -> tuple[Column, T.DataType | None]:
    """A column by name, nested path, or path into a JSON text column (type None)."""
    for f in schema:
        if f.name == name:
            return F.col(f"`{f.name}`"), f.dataType
    low = name.lower()
    for f in schema:
        if low in (f.name.lower(), str((f.metadata or {}).get("name", "")).lower()):
            return F.col(f"`{f.name}`"), f.dataType
    head, dot, rest = name.partition(".")
    if dot:
        col, kind = resolve(schema, head)
        if isinstance(kind, T.StructType):
            for part in rest.split("."):
                if not isinstance(kind, T.StructType) or part not in kind.names:
                    raise UnknownField(f"no field {name}")
                col, kind = col[part], kind[part].dataType
            return col, kind
        if isinstance(kind, T.StringType):
            return F.get_json_object(col, "$." + rest), None
    raise UnknownField(f"no field {name}")


def _number(text: str) -> float | None:
    try:
        return None if "_" in text or text != text.strip() else float(text)
    except ValueError:
        return None


def moment(value: Any, kind: T.DataType) -> Column | None:
    """A time literal for a time column; strings in RFC 3339 are times too."""
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value)
        except ValueError:
            return None
    if not isinstance(value, dt.datetime):
        return None
    if value.tzinfo:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
        return F.lit(value.isoformat(" ")).cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else F.lit(value.isoformat() + "Z").cast("timestamp")
    return F.lit(value.isoformat(" ")).cast(kind)


def literal(value: Any, kind: T.DataType) -> Column:
    """A nested value as a literal of a type, for whole-value equality."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType) and isinstance(value, (list, tuple)):
        return F.array(*[literal(x, kind.elementType) for x in value]).cast(kind)
    return F.lit(value).cast(kind)


def _compare(op: str, col: Column, kind: T.DataType | None, value: Any) -> Column | str:
    """The comparison, null where the column is; ``_FALSE`` where the types never match."""
    if value is None:
        return col.isNull()
    do = _OPS[op]
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    if kind is None:  # out of JSON text
        if number:
            return do(col.try_cast("double"), F.lit(value).cast("double"))
        if isinstance(value, bool):
            return col == F.lit(str(value).lower()) if op == "=" else _FALSE
        return do(col, F.lit(value)) if isinstance(value, str) else _FALSE
    if isinstance(kind, NUMERIC):
        if isinstance(value, str):
            value = _number(value)
            number = value is not None
        if not number:
            return _FALSE
        if isinstance(value, float) and value.is_integer() and abs(value) < 2**53 and isinstance(kind, INTEGRAL):
            value = int(value)
        if isinstance(value, int) and not -(2**63) <= value < 2**63:
            return do(col.cast("decimal(38,0)"), F.lit(Decimal(value)))
        return do(col, F.lit(value))
    if isinstance(kind, T.StringType):
        return do(col, F.lit(value)) if isinstance(value, str) else _FALSE
    if isinstance(kind, TIMES):
        at = moment(value, kind)
        return _FALSE if at is None else do(col, at)
    if isinstance(kind, T.BinaryType):
        return do(col, F.lit(bytes(value))) if isinstance(value, (bytes, bytearray)) else _FALSE
    if op != "=":
        return _FALSE
    if isinstance(kind, T.BooleanType):
        return col == F.lit(value) if isinstance(value, bool) else _FALSE
    if isinstance(value, (dict, list, tuple)):
        return col == literal(value, kind)
    return _FALSE


def _same_family(kind: T.DataType | None, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, INTEGRAL) or (isinstance(kind, T.DecimalType) and not kind.scale)
    if isinstance(value, float):
        return isinstance(kind, (T.FloatType, T.DoubleType))
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    if isinstance(value, (bytes, bytearray)):
        return isinstance(kind, T.BinaryType)
    if isinstance(value, dt.datetime):
        return isinstance(kind, TIMES)
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def _between_fields(op: str, a: Column, ka: T.DataType | None, b: Column, kb: T.DataType | None) -> Column | str:
    both = a.isNull() & b.isNull()  # two missing values match under every operator
    if isinstance(ka, NUMERIC) and isinstance(kb, T.StringType):
        b, kb = b.try_cast("double"), T.DoubleType()
    alike = (isinstance(ka, NUMERIC) and isinstance(kb, NUMERIC)) or (isinstance(ka, TIMES) and isinstance(kb, TIMES)) or ka == kb
    if not alike:
        return both
    ordered = isinstance(ka, (*NUMERIC, *TIMES, T.StringType, T.BinaryType))
    return both | F.coalesce(_OPS[op](a, b), F.lit(False)) if op == "=" or ordered else both


def compile(p: q.Predicate, schema: T.StructType, bare: bool = True) -> Column:  # noqa: A001
    """The column of a predicate over rows of ``schema``.

    With ``bare`` the result may be null where it stands for false.
    """
    if isinstance(p, q.Always):
        return F.lit(True)
    if isinstance(p, q.Junction):
        if p.kind == "not":
            return ~reduce(Column.__or__, [compile(x, schema, False) for x in p.of], F.lit(False))
        parts = [compile(x, schema, bare) for x in p.of]
        if not parts:
            return F.lit(p.kind == "and")
        return reduce(Column.__and__ if p.kind == "and" else Column.__or__, parts)
    if isinstance(p, q.Custom):
        names, test = schema.names, p.test

        @F.udf("boolean")
        def over(row) -> bool:
            return bool(test(row.asDict(True)))

        return over(F.struct(*[F.col(f"`{n}`") for n in names]))
    if isinstance(p, q.FieldComparison):
        out = _between_fields(p.op, *resolve(schema, p.field), *resolve(schema, p.other))
    else:
        col, kind = resolve(schema, p.field)
        if isinstance(p, q.CustomField):
            test_of = p.test

            def over_field(values):
                return test_of(values)

            import pandas as pd

            over_field.__annotations__ = {"values": pd.Series, "return": pd.Series}
            out = F.pandas_udf(over_field, "boolean")(col)
        elif isinstance(p, q.StrictComparison):
            if p.value is None:
                return col.isNull()
            out = _compare("=", col, kind, p.value) if _same_family(kind, p.value) else _FALSE
        elif isinstance(p, q.Membership):
            if not isinstance(p.values, tuple) or not p.values:
                return F.lit(False)
            found = [c for c in (_compare("=", col, kind, v) for v in p.values if v is not None) if not isinstance(c, str)]
            plain = [v for v in p.values if v is not None]
            if len(found) == len(plain) > 1 and all(_same_family(kind, v) for v in plain) and isinstance(kind, (*INTEGRAL, T.StringType)):
                found = [col.isin(*plain)]  # one set for Parquet, not a chain
            if any(v is None for v in p.values):
                found = [*(F.coalesce(c, F.lit(False)) for c in found), col.isNull()]
            out = reduce(Column.__or__, found) if found else _FALSE
        elif isinstance(p, q.Pattern):
            if not isinstance(kind, (T.StringType, T.BinaryType)):
                raise BadType(f"a pattern needs text, {p.field} has {kind.simpleString() if kind else 'JSON'}")
            out = matches(col.cast("string"), p.pattern)
        else:
            out = _compare(p.op, col, kind, p.value)
            if p.value is None:
                return out
    if isinstance(out, str):
        return F.lit(False)
    return out if bare else F.coalesce(out, F.lit(False))
