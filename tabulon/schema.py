"""Table descriptions: fields with their tags, and the Spark schema they make."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import IncompatibleValue, NoID, NoName, SQLUnknownField, UnknownTag

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType)
#: Types by name that need no session to be parsed; unsigned numbers are one step wider.
PLAIN = {
    "boolean": T.BooleanType(), "string": T.StringType(), "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float": T.FloatType(),
    "double": T.DoubleType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class FieldSpec:
    """One field; ``json`` is the stored name, ``composites`` maps index names to positions from 1."""

    name: str
    type: T.DataType
    json: str = ""
    id: bool = False
    index: str = ""  # "", "index", "unique" or "fulltext"
    increment: int | None = None
    composites: tuple[tuple[str, int], ...] = ()
    nullable: bool = False

    @property
    def column(self) -> str:
        return self.json or self.name

    @classmethod
    def tagged(cls, name: str, type_: T.DataType | str, tags: str = "", json: str = "", nullable: bool = False) -> FieldSpec:
        """From a comma-separated tag string such as ``id,increment=5`` or ``index,composite=by_age:2``."""
        kind = (PLAIN.get(type_) or T._parse_datatype_string(type_)) if isinstance(type_, str) else type_
        out: dict[str, Any] = {}
        for tag in filter(None, (t.strip() for t in tags.split(","))):
            key, _, value = tag.partition("=")
            if key == "id":
                out["id"] = True
            elif key in ("index", "unique", "fulltext"):
                out["index"] = key
            elif key == "increment":
                try:
                    out["increment"] = int(value) if value else 1
                except ValueError:
                    raise UnknownTag(f"increment needs a whole number, not {value!r}") from None
            elif key == "composite":
                pairs = []
                for part in value.split(";"):
                    index, _, order = part.partition(":")
                    if not index or not order.isdigit() or int(order) < 1:
                        raise UnknownTag(f"composite tag {part!r} is not name:order")
                    pairs.append((index, int(order)))
                out["composites"] = (*out.get("composites", ()), *pairs)
            elif key != "inline":
                raise UnknownTag(f"unknown tag {key!r}")
        return cls(name, kind, json, nullable=nullable, **out)


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[FieldSpec, ...]
    composites: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if not self.name:
            raise NoName()
        fields = list(self.fields)
        if not any(f.id for f in fields):
            named = [k for k, f in enumerate(fields) if f.name == "ID"]
            if not named:
                raise NoID(f"table {self.name} has no ID field")
            fields[named[0]] = replace(fields[named[0]], id=True)
        # an ID is unique without saying so
        fields = [replace(f, index=f.index or "unique") if f.id else f for f in fields]
        object.__setattr__(self, "fields", tuple(fields))
        found: dict[str, dict[int, str]] = {}
        for f in fields:
            for index, order in f.composites:
                if found.setdefault(index, {}).setdefault(order, f.column) != f.column:
                    raise UnknownTag(f"composite {index} has two fields at {order}")
        for index, at in found.items():
            if sorted(at) != list(range(1, len(at) + 1)):
                raise UnknownTag(f"composite {index} has a gap in its order")
        object.__setattr__(self, "composites", {k: tuple(v[i] for i in sorted(v)) for k, v in found.items()})

    @property
    def id(self) -> FieldSpec:
        return next(f for f in self.fields if f.id)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.column, f.type, True, {"name": f.name, "index": f.index, "id": f.id}) for f in self.fields])

    def lookup(self, name: str) -> FieldSpec:
        """A field by its name or its stored name, whatever the case."""
        low = name.strip("`").lower()
        for f in self.fields:
            if low in (f.name.lower(), f.column.lower()):
                return f
        raise SQLUnknownField(f"table {self.name} has no field {name}")

    @classmethod
    def of(cls, name: str, df: DataFrame, id: str, **tags: str) -> TableSpec:
        """A description of an existing DataFrame; ``tags`` by column."""
        return cls(name, tuple(FieldSpec.tagged(f.name, f.dataType, ",".join(filter(None, ("id" if f.name == id else "", tags.get(f.name, "")))), nullable=f.nullable) for f in df.schema))

    def to_json(self) -> str:
        return json.dumps({
            "name": self.name,
            "fields": [
                {"name": f.name, "json": f.json, "type": f.type.jsonValue(), "id": f.id, "index": f.index, "increment": f.increment, "composites": f.composites, "nullable": f.nullable}
                for f in self.fields
            ],
        })

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        data = json.loads(text)
        fields = []
        for f in data["fields"]:
            kind = f["type"]
            parsed = T._parse_datatype_json_value(kind)
            fields.append(FieldSpec(f["name"], parsed, f["json"], f["id"], f["index"], f["increment"], tuple(map(tuple, f["composites"])), f["nullable"]))
        return cls(data["name"], tuple(fields))


def inline(prefix_fields: tuple[FieldSpec, ...], *rest: FieldSpec) -> tuple[FieldSpec, ...]:
    """The fields of an embedded record, followed by the record's own."""
    return (*prefix_fields, *rest)


def zero(kind: T.DataType) -> Column:
    """The zero value of a type: 0, "", false, empty bytes; null for all else."""
    if isinstance(kind, NUMERIC):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    return F.lit(None).cast(kind)


def non_zero(name: str, kind: T.DataType) -> Column:
    """Whether a column's value is neither null nor its type's zero value."""
    col = F.col(f"`{name}`")
    if isinstance(kind, (*NUMERIC, T.StringType, T.BooleanType, T.BinaryType)):
        return F.coalesce(col != zero(kind), F.lit(False))
    return col.isNotNull()


def key_order(name: str, kind: T.DataType, reverse: bool = False) -> list[Column]:
    """The order of encoded keys: negative whole numbers come after the others."""
    col = F.col(f"`{name}`")
    keys = [col < 0, col] if isinstance(kind, INTEGRAL) else [col]
    return [k.desc() for k in keys] if reverse else keys


def check_value(f: FieldSpec, value: Any) -> None:
    kinds: tuple[type, ...] | None = None
    if isinstance(f.type, INTEGRAL):
        kinds = (int,)
    elif isinstance(f.type, NUMERIC):
        kinds = (int, float)
    elif isinstance(f.type, T.StringType):
        kinds = (str,)
    elif isinstance(f.type, T.BooleanType):
        kinds = (bool,)
    if value is None:
        if not f.nullable:
            raise IncompatibleValue(f"field {f.name} takes no null")
    elif kinds and (not isinstance(value, kinds) or (bool not in kinds and isinstance(value, bool))):
        raise IncompatibleValue(f"field {f.name} takes {f.type.simpleString()}, not {type(value).__name__}")
