"""Finders over declared indexes.  Parquet statistics stand in for index files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IncompatibleValue, IndexNotFound, NotFound
from ..functions.text import contains_fold, scored
from ..plans import predicates as q
from ..plans.compile import compile
from ..schema import FieldSpec, TableSpec, key_order, non_zero
from .query import page


class Finder:
    """``skip``, ``limit`` and ``reverse`` apply to the hits in index order: the field, then the key."""

    def __init__(self, df: DataFrame, spec: TableSpec, index: Callable[[str, str, int], DataFrame | None] | None = None):
        self.df, self.spec = df, spec
        self.index = index  # (field, query, rows) to (id, score), or None where it is behind the rows

    def _by(self, df: DataFrame, field: FieldSpec | None, skip: int, limit: int, reverse: bool) -> DataFrame:
        own = key_order(self.spec.id.column, self.spec.id.type, reverse)
        first = []
        if field is not None and not field.id:
            col = F.col(f"`{field.column}`")
            first = [col.desc_nulls_last() if reverse else col.asc_nulls_first()]
        return page(df.orderBy(*first, *own), skip, limit)

    def find(self, field: str, value: Any, skip: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
        """Rows whose field equals a value; None finds the missing ones."""
        f = self.spec.lookup(field)
        return self._by(self.df.where(compile(q.Eq(f.column, value), self.df.schema)), None, skip, limit, reverse)

    def one(self, field: str, value: Any) -> Row:
        found = self.find(field, value, limit=1).collect()
        if not found:
            raise NotFound()
        return found[0]

    def find_by_index(self, index: str, values: list[Any], skip: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
        """Equality on all fields of a composite index; zero values are not in it."""
        names = self.spec.composites.get(index)
        if names is None:
            raise IndexNotFound(f"no composite index {index}")
        if len(names) != len(values):
            raise IncompatibleValue(f"index {index} has {len(names)} fields")
        hit = compile(q.And(*[q.Eq(n, v) for n, v in zip(names, values, strict=True)]), self.df.schema)
        for n in names:
            hit = hit & non_zero(n, self.spec.lookup(n).type)
        return self._by(self.df.where(hit), None, skip, limit, reverse)

    def range(self, field: str, low: Any, high: Any, skip: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
        """Both ends included; they must be two times, two texts or two numbers."""

        def family(v: Any) -> str:
            if isinstance(v, dt.datetime):
                return "time"
            if isinstance(v, str):
                return "text"
            if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
                return "number"
            raise IncompatibleValue(f"no range over {type(v).__name__}")

        if family(low) != family(high):
            raise IncompatibleValue("a range needs two values of one kind")
        f = self.spec.lookup(field)
        hit = compile(q.And(q.Gte(f.column, low), q.Lte(f.column, high)), self.df.schema)
        return self._by(self.df.where(hit), f, skip, limit, reverse)

    def prefix(self, field: str, prefix: str, skip: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
        f = self.spec.lookup(field)
        if not isinstance(f.type, T.StringType):
            raise IncompatibleValue(f"no prefixes of {f.type.simpleString()}")
        return self._by(self.df.where(F.col(f"`{f.column}`").startswith(prefix)), f, skip, limit, reverse)

    def all_by_index(self, field: str = "", skip: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
        """All rows in the order of a field, without zero values; no field is the key order."""
        if not field or self.spec.lookup(field).id:
            return self.all(skip, limit, reverse)
        f = self.spec.lookup(field)
        if not f.index:
            raise IndexNotFound(f"field {field} has no index")
        return self._by(self.df.where(non_zero(f.column, f.type)), f, skip, limit, reverse)

    def search(self, field: str, text: str, skip: int = 0, limit: int = -1) -> DataFrame:
        """Full text, best first; the score is the last column.  The index is read where it has all writes."""
        f = self.spec.lookup(field)
        if f.index != "fulltext":
            raise IndexNotFound(f"field {field} has no full-text index")
        found = self.index(f.column, text, self.df.count()) if self.index else None
        if found is None:
            hits = scored(self.df, F.col(f"`{f.column}`"), text)
        else:
            found = found.withColumnRenamed("id", "_hit")
            hits = self.df.join(found, F.col(f"`{self.spec.id.column}`").cast("string") == F.col("_hit")).drop("_hit")
        return page(hits.orderBy(F.col("score").desc(), *key_order(self.spec.id.column, self.spec.id.type)), skip, limit)

    def search_substring(self, field: str, text: str, skip: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
        f = self.spec.lookup(field)
        return self._by(self.df.where(contains_fold(F.col(f"`{f.column}`"), text)), None, skip, limit, reverse)

    def all(self, skip: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
        return self._by(self.df, None, skip, limit, reverse)

    def count(self) -> int:
        return self.df.count()

    def coverage(self) -> DataFrame:
        """(field, n): how many rows have a non-zero value in each indexed field."""
        named = [f for f in self.spec.fields if f.index]
        one = self.df.agg(*[F.count_if(non_zero(f.column, f.type)).alias(f"c{k}") for k, f in enumerate(named)])
        pairs = F.array(*[F.struct(F.lit(f.column).alias("field"), F.col(f"c{k}").alias("n")) for k, f in enumerate(named)])
        return one.select(F.inline(pairs))
