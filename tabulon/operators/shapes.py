"""Projections into dataclasses of the caller's own."""

from __future__ import annotations

import dataclasses
import datetime as dt
import types
import typing
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadType, IncompatibleValue
from ..schema import INTEGRAL, NUMERIC

#: The column type and the zero value of each type that a field of a class may have; dates and times have none.
KINDS: dict[type, tuple[T.DataType, Any]] = {
    bool: (T.BooleanType(), False), int: (T.LongType(), 0), float: (T.DoubleType(), 0.0), str: (T.StringType(), ""), bytes: (T.BinaryType(), b""),
    Decimal: (T.DecimalType(38, 18), Decimal(0)), dt.datetime: (T.TimestampType(), None), dt.date: (T.DateType(), None),
}


@dataclasses.dataclass(frozen=True)
class Target:
    """A field of the class: its type (None takes any value) and what stands where there is none."""

    name: str
    stored: str
    type: T.DataType | None
    zero: Any


def targets(into: type) -> list[Target]:
    """The fields of a dataclass; ``field(metadata={"json": ...})`` names the stored column."""
    if not (isinstance(into, type) and dataclasses.is_dataclass(into)):
        raise BadType(f"{into!r} is not a dataclass")
    hints, out = typing.get_type_hints(into), []
    for f in dataclasses.fields(into):
        if not f.init:
            continue
        kinds = [hints[f.name]]
        if typing.get_origin(kinds[0]) in (typing.Union, types.UnionType):
            kinds = list(typing.get_args(kinds[0]))
        optional = type(None) in kinds
        kinds = [k for k in kinds if k is not type(None)]
        stored = f.metadata.get("json", "")
        if kinds == [Any] or len(kinds) != 1:
            out.append(Target(f.name, stored, None, None))
        elif kinds[0] in KINDS:
            kind, zero = KINDS[kinds[0]]
            out.append(Target(f.name, stored, kind, None if optional else zero))
        else:
            raise BadType(f"field {f.name} is of {kinds[0]!r}")
    return out


def converted(value: Column, source: T.DataType, to: Target) -> Column:
    """``value`` as the field's type: fractions go towards zero, overflow raises, and texts are neither numbers nor truth values."""
    if to.type is None:
        return value
    numbers = isinstance(source, NUMERIC) and isinstance(to.type, NUMERIC)
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    dated = isinstance(to.type, times) and isinstance(source, (*times, T.StringType))
    if not (numbers or dated or type(source) is type(to.type)):
        raise IncompatibleValue(f"{source.simpleString()} does not fit field {to.name}")
    if numbers and isinstance(to.type, INTEGRAL) and not isinstance(source, INTEGRAL):
        whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)) if isinstance(source, T.DecimalType) else value
        fits = (value >= F.lit(-(2.0**63))) & (value < F.lit(2.0**63))
        value = F.when(value.isNotNull() & ~fits, F.raise_error(F.lit(f"a value overflows field {to.name}"))).otherwise(whole.cast(to.type))
    out = value if type(source) is type(to.type) and not isinstance(source, T.DecimalType) else value.cast(to.type)
    return out if to.zero is None else F.coalesce(out, F.lit(to.zero).cast(to.type))


def shaped(rows: DataFrame, chosen: list[tuple[str, str, str]], into: type) -> DataFrame:
    """The fields of ``into`` that a projection fills; nothing else is read.

    ``chosen`` has label, name and column of each projected field.  A field is
    filled by the label, else by the name, else by the stored column, whatever
    the case; of several columns that fill one, the last does.  Columns that
    no field takes are left out.
    """
    all_of = targets(into)
    by_name = {n.lower(): t for t in all_of for n in (t.name, t.stored) if n}
    filled: dict[str, Column] = {}
    for label, name, column in chosen:
        to = next((by_name[n.lower()] for n in (label, name, column) if n.lower() in by_name), None)
        if to:
            filled[to.name] = converted(F.col(f"`{column}`"), rows.schema[column].dataType, to)
    return rows.select(*[filled[t.name].alias(t.name) for t in all_of if t.name in filled])


def instances(rows: DataFrame, into: type) -> Iterator[Any]:
    """An object for each row, a partition on the driver at a time; fields that no column fills have their default or a zero value."""
    there = set(rows.columns)
    rest = {f.name: None for f in dataclasses.fields(into) if f.init and f.name not in there and f.default is f.default_factory is dataclasses.MISSING}
    rest.update((t.name, t.zero) for t in targets(into) if t.name in rest)
    binary = [f.name for f in rows.schema if isinstance(f.dataType, T.BinaryType)]
    for row in rows.toLocalIterator():
        values = rest | row.asDict()
        values.update((n, bytes(values[n])) for n in binary if values[n] is not None)
        yield into(**values)
