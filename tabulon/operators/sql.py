"""SQL over stored or given tables, by the query builder and the write operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import IncompatibleValue, NotFound, SQLBadProjection, SQLTableNotRegistered, UnsupportedSQL
from ..plans import sql as front
from ..schema import TableSpec
from . import writes
from .query import Query
from .shapes import instances, shaped


@dataclass(frozen=True)
class SQLResult:
    rows_affected: int
    last_insert_id: Any = None


class SQL:
    """Statements over ``tables``: name to (rows, description), or to a stored table."""

    def __init__(self, tables: dict[str, tuple[DataFrame, TableSpec]] | Callable[[str], Any]):
        self.tables = tables

    def _table(self, name: str) -> tuple[DataFrame, TableSpec, Any]:
        found = self.tables(name) if callable(self.tables) else self.tables.get(name)
        if found is None:
            raise SQLTableNotRegistered(f"no table {name}")
        return (*found, None) if isinstance(found, tuple) else (found.df, found.spec, found)

    def _select(self, text: str, args: tuple) -> tuple[front.Select, Query, TableSpec]:
        parser = front.Parser(text)
        node = parser.statement()
        if not isinstance(node, front.Select):
            raise UnsupportedSQL("SELECT is expected")
        df, spec, table = self._table(node.table)
        bind = front.Binder(spec, args, parser.places)
        query = Query(df, spec, bind.predicate(node.where), tuple(spec.lookup(n).column for n, _ in node.order), table=table)
        if node.order and node.order[0][1]:
            query = query.reverse()
        return node, query.skip(bind.whole(node.offset, 0)).limit(bind.whole(node.limit, -1)), spec

    def select(self, text: str, *args: Any) -> DataFrame:
        """Rows of ``SELECT *``."""
        node, query, _ = self._select(text, args)
        if not node.star:
            raise SQLBadProjection("whole records need SELECT *")
        return query.df

    def find(self, text: str, *args: Any) -> DataFrame:
        out = self.select(text, *args)
        if out.isEmpty():
            raise NotFound()
        return out

    def first(self, text: str, *args: Any) -> Row:
        node, query, _ = self._select(text, args)
        if not node.star:
            raise SQLBadProjection("whole records need SELECT *")
        return query.first()

    def project(self, text: str, *args: Any) -> DataFrame:
        """Chosen columns under their aliases; a star gives all in the order of field names."""
        node, query, spec = self._select(text, args)
        if node.count:
            raise SQLBadProjection("COUNT(*) is counted, not projected")
        if node.star:
            return query.df.select(*[F.col(f"`{f.column}`") for f in sorted(spec.fields, key=lambda f: f.name)])
        return query.df.select(*[F.col(f"`{spec.lookup(n).column}`").alias(label) for n, label in node.columns])

    def project_frame(self, into: type, text: str, *args: Any) -> DataFrame:
        """The chosen columns as the fields of a dataclass, without running it."""
        node, query, spec = self._select(text, args)
        if node.count:
            raise SQLBadProjection("COUNT(*) is counted, not projected")
        chosen = [(label, spec.lookup(n)) for n, label in node.columns] if not node.star else [(f.name, f) for f in sorted(spec.fields, key=lambda f: f.name)]
        return shaped(query.df, [(label, f.name, f.column) for label, f in chosen], into)

    def project_into(self, into: type, text: str, *args: Any) -> Iterator[Any]:
        """An object of the dataclass ``into`` for each row."""
        return instances(self.project_frame(into, text, *args), into)

    def count(self, text: str, *args: Any) -> int:
        node, query, _ = self._select(text, args)
        if not node.count:
            raise UnsupportedSQL("SELECT COUNT(*) is expected")
        return query.count()

    def count_frame(self, text: str, *args: Any, to: str = "n") -> DataFrame:
        """The count as a row, without running it."""
        node, query, _ = self._select(text, args)
        if not node.count:
            raise UnsupportedSQL("SELECT COUNT(*) is expected")
        return query.df.agg(F.count("*").alias(to))

    def after(self, text: str, *args: Any, allow_full: bool = False) -> DataFrame:
        """The table's rows after an INSERT, UPDATE or DELETE, without storing them."""
        return self._write(text, args, allow_full)[0]

    def _write(self, text: str, args: tuple, allow_full: bool):
        parser = front.Parser(text)
        node = parser.statement()
        if isinstance(node, front.Select):
            raise UnsupportedSQL("a write is expected")
        df, spec, table = self._table(node.table)
        bind = front.Binder(spec, args, parser.places)
        if isinstance(node, front.Insert):
            fields = [spec.lookup(n) for n in node.columns]
            if len({f.column for f in fields}) != len(fields):
                raise UnsupportedSQL("a column is named twice")
            rows = [{f.column: front.convert(f, bind.value(v)) for f, v in zip(fields, row, strict=True)} for row in node.rows]
            batch = filled(df.sparkSession, rows, spec)
            if table is None:
                one = writes.last_of_each(batch, spec.id.column, "_at")
                return writes.upsert(df, one, spec), node, rows, None
            return None, node, rows, table
        front.guarded(node.where, allow_full)
        where = bind.predicate(node.where)
        if isinstance(node, front.Update):
            sets = {}
            for name, v in node.assignments:
                f = spec.lookup(name)
                if f.id:
                    raise IncompatibleValue("a key is not assigned")
                sets[f.column] = front.convert(f, bind.value(v))
            return writes.set_where(df, sets, where), node, where, table
        return writes.delete_where(df, where), node, where, table

    def exec(self, text: str, *args: Any, allow_full: bool = False) -> SQLResult:
        """Runs a write on a stored table; 0 rows are not an error."""
        after, node, what, table = self._write(text, args, allow_full)
        if isinstance(node, front.Insert):
            if table is None:
                raise UnsupportedSQL("the table is not stored")
            ids = table.save_all(what)
            return SQLResult(len(ids), ids[-1] if ids else None)
        if table is None:
            raise UnsupportedSQL("the table is not stored")
        hit = Query(table.df, table.spec, what)
        n = hit.count()
        if n:
            update = isinstance(node, front.Update)
            table.replace(after, check=update, change=("update" if update else "delete", hit.filtered().select(table.spec.id.column)))
        return SQLResult(n)


def filled(spark, rows: list[dict[str, Any]], spec: TableSpec) -> DataFrame:
    """Records as a DataFrame of the table's schema, missing fields at zero, with their order in ``_at``."""
    from pyspark.sql import types as T

    from ..schema import NUMERIC

    def value(f, row):
        if f.column in row or f.name in row:
            return row.get(f.column, row.get(f.name))
        if f.nullable:
            return None
        if isinstance(f.type, T.DecimalType):
            from decimal import Decimal

            return Decimal(0)
        if isinstance(f.type, (T.FloatType, T.DoubleType)):
            return 0.0
        if isinstance(f.type, NUMERIC):
            return 0
        return {T.StringType: "", T.BooleanType: False, T.BinaryType: b""}.get(type(f.type))

    def typed(f, v):
        if v is not None and isinstance(f.type, (T.FloatType, T.DoubleType)):
            return float(v)
        if isinstance(v, str) and isinstance(f.type, (T.TimestampType, T.TimestampNTZType)):
            import datetime as dt

            return dt.datetime.fromisoformat(v)
        return v

    schema = T.StructType([*spec.schema.fields, T.StructField("_at", T.LongType())])
    return spark.createDataFrame([(*(typed(f, value(f, r)) for f in spec.fields), k) for k, r in enumerate(rows)], schema)
