"""The query builder: immutable, and only a terminal runs anything."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import NotFound, UnknownField
from ..plans import predicates as q
from ..plans.compile import compile, resolve
from ..schema import TableSpec, key_order

if TYPE_CHECKING:
    from ..sources.store import Table


def page(df: DataFrame, skip: int, limit: int) -> DataFrame:
    """Rows from ``skip`` on, ``limit`` at most; a negative limit is none, a negative skip 0."""
    if skip > 0:
        df = df.offset(skip)
    return df.limit(limit) if limit >= 0 else df


@dataclass(frozen=True)
class Query:
    source: DataFrame
    spec: TableSpec
    predicate: q.Predicate = q.Always()
    keys: tuple[str, ...] = ()
    backwards: bool = False
    skipped: int = 0
    limited: int = -1
    table: Table | None = None

    def where(self, *predicates: q.Predicate) -> Query:
        return replace(self, predicate=q.And(self.predicate, *predicates))

    def order_by(self, *keys: str) -> Query:
        return replace(self, keys=keys)

    def reverse(self) -> Query:
        """All keys, or the key order, backwards."""
        return replace(self, backwards=True)

    def skip(self, n: int) -> Query:
        return replace(self, skipped=max(n, 0))

    def limit(self, n: int) -> Query:
        return replace(self, limited=n if n >= 0 else -1)

    def bucket(self, table: Table) -> Query:
        """The same query over another table of the same fields."""
        return replace(self, source=table.df, table=table)

    def filtered(self) -> DataFrame:
        return self.source if isinstance(self.predicate, q.Always) else self.source.where(compile(self.predicate, self.source.schema))

    def ordered(self, df: DataFrame) -> DataFrame:
        own = key_order(self.spec.id.column, self.spec.id.type, self.backwards)
        cols = []
        for k in self.keys:
            try:
                col, _ = resolve(df.schema, k)
            except UnknownField as e:
                raise NotFound(str(e)) from None
            cols.append(col.desc_nulls_last() if self.backwards else col.asc_nulls_first())
        return df.orderBy(*cols, *own)

    @property
    def df(self) -> DataFrame:
        """The rows; sorted only where the order shows or a page is cut from it."""
        out = self.filtered()
        if self.keys or self.backwards or self.skipped or self.limited > 0:
            out = self.ordered(out)
        return page(out, self.skipped, self.limited)

    def rows(self) -> list[Row]:
        """The rows in order, on the driver."""
        return page(self.ordered(self.filtered()), self.skipped, self.limited).collect()

    def find(self) -> DataFrame:
        """The rows; raises where there are none."""
        out = self.df
        if out.isEmpty():
            raise NotFound()
        return out

    def first(self) -> Row:
        found = replace(self, limited=1).rows() if self.limited else []
        if not found:
            raise NotFound()
        return found[0]

    def count(self) -> int:
        """After skip and limit; their order does not matter for a number."""
        return page(self.filtered(), self.skipped, self.limited).count()

    def delete(self) -> int:
        """Deletes the rows of this page from the table; raises where there are none."""
        if self.table is None:
            raise NotFound("this query is not over a stored table")
        hit = self.df.select(self.spec.id.column)
        n = hit.count()
        if not n:
            raise NotFound()
        self.table.delete_ids(hit)
        return n

    def raw(self) -> DataFrame:
        """(key, value): each record as JSON text."""
        rows = self.df
        return rows.select(F.col(f"`{self.spec.id.column}`").alias("key"), F.to_json(F.struct("*")).alias("value"))

    def each(self, fn: Callable[[dict[str, Any]], None]) -> None:
        """Calls ``fn`` with each record, in order, a partition on the driver at a time."""
        for row in page(self.ordered(self.filtered()), self.skipped, self.limited).toLocalIterator():
            fn(row.asDict(True))

    def raw_each(self, fn: Callable[[Any, str], None]) -> None:
        for row in replace(self, keys=self.keys or (self.spec.id.column,)).raw().toLocalIterator():
            fn(row["key"], row["value"])

    def explain(self) -> tuple[dict, bool]:
        return q.explain(self.predicate)


def select(source: DataFrame, spec: TableSpec, *predicates: q.Predicate) -> Query:
    return Query(source, spec, q.And(*predicates) if predicates else q.Always())
