"""Writes as transformations from a table's rows to its next rows.

Nothing here touches storage: each function takes DataFrames and gives the
state after the write, for ``sources.store`` to commit.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, IncompatibleValue, ZeroID
from ..plans import predicates as q
from ..plans.compile import compile
from ..schema import INTEGRAL, TableSpec, non_zero


def last_of_each(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; a partial maximum, so a hot key costs one row per task."""
    cols = [c for c in batch.columns if c != order]
    top = batch.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_row"))
    return top.select("_row.*")


def upsert(target: DataFrame, batch: DataFrame, spec: TableSpec) -> DataFrame:
    """``target`` with the rows of ``batch``, which has one row for each key, in place of its own."""
    key = spec.id.column
    kept = target.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch.select(*target.columns))


def number(batch: DataFrame, target: DataFrame, spec: TableSpec, counters: dict[str, int], order: str) -> tuple[DataFrame, dict[str, int]]:
    """Fills zero values of auto-increment fields by input order; returns the new counters too.

    Fields other than the key are numbered only in rows that are new.
    """
    after = dict(counters)
    key = spec.id
    fields = [f for f in spec.fields if f.increment is not None and isinstance(f.type, INTEGRAL)]
    for f in sorted(fields, key=lambda f: not f.id):
        col = F.col(f"`{f.column}`")
        need = ~non_zero(f.column, f.type)
        if not f.id:
            known = target.select(F.col(key.column).alias("_known")).distinct()
            batch = batch.join(known, F.col(key.column) == F.col("_known"), "left")
            need = need & F.col("_known").isNull()
        start = after.get(f.column, f.increment - 1)
        # numbered within the runs that ``order`` names in its upper bits (a partition of the input), after what the runs before need
        batch = batch.withColumns({"_run": F.shiftright(F.col(order).cast("long"), 33), "_need": F.when(need, 1).otherwise(0)})
        runs = batch.groupBy("_run").agg(F.sum("_need").alias("_n"))  # one row per run
        runs = runs.select("_run", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        place = F.col("_before") + F.sum("_need").over(Window.partitionBy("_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        batch = batch.join(runs, "_run").withColumn(f.column, F.when(F.col("_need") > 0, F.lit(start) + place).otherwise(col).cast(f.type))
        batch = batch.drop("_run", "_need", "_before", *(() if f.id else ("_known",)))
        top = batch.agg(F.max(f"`{f.column}`")).first()[0]
        after[f.column] = max(start, top if top is not None else start)
    return batch, after


def check_ids(batch: DataFrame, spec: TableSpec) -> None:
    f = spec.id
    if not batch.where(~non_zero(f.column, f.type)).isEmpty():
        raise ZeroID()


def duplicates(df: DataFrame, field: str, spec: TableSpec) -> DataFrame:
    """(value, n): non-zero values of a unique field that more than one row has."""
    f = spec.lookup(field)
    col = F.col(f"`{f.column}`")
    return df.where(non_zero(f.column, f.type)).groupBy(col.alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(target: DataFrame, batch: DataFrame, spec: TableSpec) -> None:
    """Raises where a unique value of the batch is another row's, in the batch or the rest of the table.

    All unique fields are looked at in one pass over the table.
    """
    key = spec.id.column
    fields = [f for f in spec.fields if f.index == "unique" and not f.id]
    if not fields:
        return

    def values(df: DataFrame, own: bool) -> DataFrame:
        each = [F.struct(F.lit(k).alias("field"), F.when(non_zero(f.column, f.type), _text(f)).alias("v")) for k, f in enumerate(fields)]
        return df.select(F.explode(F.array(*each)).alias("x"), F.lit(own).alias("own")).select("x.field", "x.v", "own").where("v IS NOT NULL")

    rest = target.join(batch.select(key), key, "left_anti")
    shared = values(batch, True).unionByName(values(rest, False)).groupBy("field", "v").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    first = shared.where("n > 1 AND own").agg(F.min("field")).first()[0]
    if first is not None:
        raise AlreadyExists(f"a value of {fields[first].name} is taken")


def _text(f):
    """A field's value as text that no other value has."""
    col = F.col(f"`{f.column}`")
    if isinstance(f.type, T.BinaryType):
        return F.hex(col)
    if isinstance(f.type, T.TimestampType):
        return F.unix_micros(col).cast("string")
    return col.cast("string") if isinstance(f.type, T.AtomicType) else F.to_json(F.struct(col))


def partial_update(target: DataFrame, changes: DataFrame, spec: TableSpec) -> DataFrame:
    """Non-zero fields of ``changes`` replace those of the row with the same key."""
    key = spec.id.column
    new = changes.select(F.col(key).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("_new"))
    joined = target.join(new, F.col(key) == F.col("_key"), "left")
    out = []
    for f in spec.fields:
        c = f.column
        fresh = F.col("_new")[c]
        if f.id:
            out.append(F.col(f"`{c}`"))
        else:
            given = joined_non_zero(fresh, f)
            out.append(F.when(F.col("_key").isNotNull() & given, fresh).otherwise(F.col(f"`{c}`")).alias(c))
    return joined.select(*out)


def joined_non_zero(value, f):
    from ..schema import NUMERIC, T, zero

    simple = isinstance(f.type, (*NUMERIC, T.StringType, T.BooleanType, T.BinaryType))
    return F.coalesce(value != zero(f.type), F.lit(False)) if simple else value.isNotNull()


def set_where(target: DataFrame, assignments: dict[str, Any], where: q.Predicate) -> DataFrame:
    """``target`` with literals in some columns of the matching rows."""
    hit = compile(where, target.schema, bare=False)
    out = []
    for f in target.schema:
        col = F.col(f"`{f.name}`")
        if f.name in assignments:
            new = F.lit(assignments[f.name]).cast(f.dataType)
            col = F.when(hit, new).otherwise(col).alias(f.name)
        out.append(col)
    return target.select(*out)


def set_field(target: DataFrame, spec: TableSpec, key: Any, field: str, value: Any) -> DataFrame:
    """One field of one row; zero values allowed."""
    from ..schema import check_value

    f = spec.lookup(field)
    if f.id:
        raise IncompatibleValue("a key is not updated")
    check_value(f, value)
    return set_where(target, {f.column: value}, q.Eq(spec.id.column, key))


def delete_where(target: DataFrame, where: q.Predicate) -> DataFrame:
    return target.where(~compile(where, target.schema, bare=False))


def delete_ids(target: DataFrame, ids: DataFrame, spec: TableSpec) -> DataFrame:
    return target.join(ids.select(F.col(ids.columns[0]).alias(spec.id.column)).distinct(), spec.id.column, "left_anti")
