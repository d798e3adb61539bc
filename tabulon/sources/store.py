"""Databases of versioned tables.

A table's rows are immutable Parquet versions; a manifest, numbered and
created exclusively, says which version of each table is current, with its
description and counters.  A commit writes data first and then one manifest,
so it is atomic over any number of tables; readers keep the manifest they
began with.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import (
    AlreadyExists, Conflict, DifferentCodec, IncompatibleValue, NilParam, NotFound, NotInTransaction, ReadOnly, SQLTableNotRegistered,
)
from ..operators import writes
from ..operators.finders import Finder
from ..operators.query import Query, select
from ..operators.sql import SQL, filled
from ..plans import predicates as q
from ..schema import FieldSpec, TableSpec, key_order, non_zero
from .codecs import Codec, Json
from .files import Files

#: Written to every manifest; a store of a newer major version is not opened.
VERSION = "1.0.0"


@dataclass
class Entry:
    """What a manifest knows of one table."""

    path: str | None
    spec: str
    counters: dict[str, int] = field(default_factory=dict)
    codec: str = "columnar"
    coverage: dict[str, int] = field(default_factory=dict)


def _key(namespace: tuple[str, ...], table: str) -> str:
    return "/".join((*namespace, table))


class Database:
    """A store under ``root``; the session is the caller's."""

    def __init__(self, spark: SparkSession, root: str, changes: Any = None, sync: bool = False):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.changes = changes  # a streaming.outbox.ChangeLog, if changes are to be logged
        self.sync = sync  # whether a write returns only when the index has it
        if changes is not None:
            changes.attach(self)
        if not self.files.names(f"{self.root}/_manifest"):
            self.files.create(self._path(0), json.dumps({"version": VERSION, "number": 0, "logged": 0, "log": [], "tables": {}}))
        if json.loads(self.files.read(self._path(self.current())))["version"].split(".")[0] != VERSION.split(".")[0]:
            raise Conflict("the store has another major version")

    def _path(self, n: int) -> str:
        return f"{self.root}/_manifest/{n:012d}.json"

    def current(self) -> int:
        return max(int(n.split(".")[0]) for n in self.files.names(f"{self.root}/_manifest") if n.endswith(".json"))

    def _data(self, n: int | None = None) -> dict[str, Any]:
        return json.loads(self.files.read(self._path(self.current() if n is None else n)))

    def manifest(self, n: int | None = None) -> dict[str, Entry]:
        return {k: Entry(**v) for k, v in self._data(n)["tables"].items()}

    def logged(self) -> int:
        """The last manifest that names logged changes."""
        return self._data()["logged"]

    def commit(self, base: int, tables: dict[str, Entry], log: list[dict[str, Any]] = ()) -> int:
        """Makes ``tables`` current, and the changes of ``log`` with them."""
        log = [e | {"at": k} for k, e in enumerate(log)]
        number = base + 1
        data = {"version": VERSION, "number": number, "logged": number if log else self._data(base)["logged"], "log": log}
        if not self.files.create(self._path(number), json.dumps(data | {"tables": {k: vars(e) for k, e in tables.items()}})):
            raise Conflict()
        if self.sync and log:
            self.index.flush()
        return number

    @property
    def index(self) -> Any:
        """The stream that keeps the full-text index."""
        from ..streaming.outbox import IndexStream

        return IndexStream(self.changes)

    def log(self, op: str, key: str, spec: TableSpec, rows: DataFrame | None = None) -> list[dict[str, Any]]:
        """Writes changed rows to the log, for the manifest to name."""
        said = self.changes.write(op, key, spec, rows) if self.changes is not None else None
        return [said] if said else []

    def close(self) -> None:
        """Nothing is held open."""

    # catalog

    def list_froms(self) -> DataFrame:
        spaces = sorted({k.rpartition("/")[0] for k in self.manifest()})
        return self.spark.createDataFrame([(s,) for s in spaces], "namespace string")

    def list_tables(self, *namespace: str) -> DataFrame:
        at = "/".join(namespace)
        names = sorted(k.rpartition("/")[2] for k in self.manifest() if k.rpartition("/")[0] == at)
        return self.spark.createDataFrame([(n,) for n in names if not n.startswith("__")], "name string")

    def list_columns(self, table: str, *namespace: str) -> DataFrame:
        entry = self.manifest().get(_key(namespace, table))
        if entry is None:
            raise NotFound(f"no table {table}")
        return columns(self.spark, TableSpec.from_json(entry.spec))

    def set_table_metadata(self, table: str, fields: list[FieldSpec], *namespace: str) -> None:
        """Replaces a table's description, or makes a table of it, in the given order.

        Columns that are new read as zero values; dropped ones are no longer read.
        """
        with_id = TableSpec(table, tuple(fields))
        names = [f.column.lower() for f in fields]
        if len(set(names)) != len(names):
            raise AlreadyExists("two columns have one name")
        node = self.from_(*namespace)
        base = self.current()
        tables = self.manifest(base)
        old = tables.get(_key(namespace, table))
        entry = Entry(old.path if old else None, with_id.to_json(), old.counters if old else {}, old.codec if old else "columnar")
        if old and old.path:
            had = TableSpec.from_json(old.spec)
            for f in with_id.fields:
                if f.column in had.schema.names and had.schema[f.column].dataType != f.type:
                    raise IncompatibleValue(f"{f.name} cannot become {f.type.simpleString()}")
            df = node.table(table).df
            entry.path = node._store(table, df.select(*[_column(df, f) for f in with_id.fields]), with_id)
        key = _key(namespace, table)
        self.commit(base, tables | {key: entry}, self.log("reindex", key, with_id) if entry.path else ())

    # namespaces

    def from_(self, *path: str) -> Node:
        return Node(self, path)

    def node(self) -> Node:
        return Node(self, ())

    def begin(self, writable: bool = True) -> Transaction:
        return Transaction(self, writable)


def columns(spark: SparkSession, spec: TableSpec) -> DataFrame:
    rows = [(k, f.name, f.column, f.type.simpleString(), f.index, f.id, f.increment is not None) for k, f in enumerate(spec.fields)]
    return spark.createDataFrame(rows, "position int, name string, column string, type string, index string, is_id boolean, increments boolean")


def _column(df: DataFrame, f: FieldSpec):
    from ..schema import zero

    if f.column in df.columns:
        return F.col(f"`{f.column}`")
    return (F.lit(None).cast(f.type) if f.nullable else zero(f.type)).alias(f.column)


class Node:
    """A namespace of a database, as the last commit left it or inside a transaction."""

    def __init__(self, db: Database, path: tuple[str, ...], tx: Transaction | None = None, codec: Codec | None = None):
        self.db, self.path, self.tx, self.codec = db, path, tx, codec

    def from_(self, *path: str) -> Node:
        return Node(self.db, (*self.path, *path), self.tx, self.codec)

    def with_codec(self, codec: Codec) -> Node:
        return Node(self.db, self.path, self.tx, codec)

    def begin(self, writable: bool = True) -> Node:
        return Node(self.db, self.path, Transaction(self.db, writable), self.codec)

    def with_transaction(self, tx: Transaction) -> Node:
        return Node(self.db, self.path, tx, self.codec)

    def commit(self) -> None:
        if self.tx is None:
            raise NotInTransaction()
        self.tx.commit()

    def rollback(self) -> None:
        if self.tx is None:
            raise NotInTransaction()
        self.tx.rollback()

    def _entries(self) -> dict[str, Entry]:
        return self.tx.tables if self.tx else self.db.manifest()

    def _store(self, table: str, df: DataFrame, spec: TableSpec) -> str:
        """Writes a version, its files ranges of the key and sorted by it, so that key filters prune."""
        path = f"{self.db.root}/{_key(self.path, table)}/v={uuid.uuid4().hex}"
        order = key_order(spec.id.column, spec.id.type)
        df.select(*spec.schema.names).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
        return path

    def _put(self, table: str, entry: Entry | None, log: list[dict[str, Any]] = ()) -> None:
        key = _key(self.path, table)
        if self.tx:
            if not self.tx.writable:
                raise ReadOnly()
            self.tx.tables = {k: v for k, v in self.tx.tables.items() if k != key} | ({key: entry} if entry else {})
            self.tx.logs += log
            return
        base = self.db.current()
        tables = {k: v for k, v in self.db.manifest(base).items() if k != key}
        self.db.commit(base, tables | ({key: entry} if entry else {}), list(log))

    def put_partitioned(self, df: DataFrame, by: str, spec: TableSpec) -> list[Node]:
        """Puts the rows of each value of ``by`` into a namespace of that name, as its table ``spec.name``: one write, one commit."""
        if self.tx:
            raise ReadOnly("partitions are put outside transactions")
        path = f"{self.db.root}/{_key(self.path, spec.name)}-by/v={uuid.uuid4().hex}"
        order = key_order(spec.id.column, spec.id.type)
        part = F.col(by).cast("string").alias("_part")
        df.select(*spec.schema.names, part).repartitionByRange("_part", *order).sortWithinPartitions("_part", *order).write.partitionBy("_part").parquet(path)
        names = [r[0] for r in df.select(part).distinct().collect()]  # namespaces, not rows
        base = self.db.current()
        found = {n: f"{path}/_part={self.db.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(n)}" for n in names}
        new = {_key((*self.path, n), spec.name): Entry(p, spec.to_json()) for n, p in found.items()}
        self.db.commit(base, self.db.manifest(base) | new, [e for k in new for e in self.db.log("reindex", k, spec)])
        return [self.from_(n) for n in sorted(found)]

    def init(self, spec: TableSpec) -> Table:
        """An empty table, or the table there is with this description."""
        entries = self._entries()
        key = _key(self.path, spec.name)
        old = entries.get(key)
        stored = bool(old and old.path and old.spec != spec.to_json())
        log = self.db.log("reindex", key, spec) if stored else ()
        self._put(spec.name, Entry(old.path if old else None, spec.to_json(), old.counters if old else {}, (self.codec or _COLUMNAR).name), log)
        return self.table(spec.name)

    def table(self, name: str) -> Table:
        entry = self._entries().get(_key(self.path, name))
        if entry is None:
            raise NotFound(f"no table {name}")
        if self.codec and entry.codec != self.codec.name:
            raise DifferentCodec()
        return Table(self, name, entry)

    def get_table(self, name: str) -> Table | None:
        return self.table(name) if _key(self.path, name) in self._entries() else None

    def drop(self, name: str) -> None:
        """Drops a table, or a namespace with all in it."""
        entries = self._entries()
        key = _key(self.path, name)
        gone = [k for k in entries if k == key or k.startswith(key + "/")]
        if not gone:
            raise NotFound(f"nothing to drop at {name}")
        for k in gone:
            space, _, table = k.rpartition("/")
            Node(self.db, tuple(filter(None, space.split("/"))), self.tx)._put(table, None, self.db.log("drop", k, TableSpec.from_json(entries[k].spec)))

    def sql(self) -> SQL:
        def found(name: str) -> Table:
            try:
                return self.table(name)
            except NotFound:
                raise SQLTableNotRegistered(f"no table {name}") from None

        return SQL(found)

    def _children(self) -> list[str]:
        depth = len(self.path)
        inside = [k.split("/") for k in self._entries()]
        return sorted({p[depth] for p in inside if tuple(p[:depth]) == self.path and len(p) > depth + 1})

    def prefix_scan(self, prefix: str) -> list[Node]:
        return [self.from_(c) for c in self._children() if c.startswith(prefix)]

    def range_scan(self, low: str, high: str) -> list[Node]:
        """Both ends included."""
        return [self.from_(c) for c in self._children() if low <= c <= high]

    def gather(self, nodes: list[Node], table: str) -> DataFrame:
        """One table of several namespaces, with the namespace's last part as ``namespace``."""
        parts = [n.table(table).df.withColumn("namespace", F.lit(n.path[-1])) for n in nodes if n.get_table(table)]
        if not parts:
            raise NotFound(f"no table {table}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    # key/value buckets

    def bucket(self, name: str, codec: Codec | None = None) -> Bucket:
        return Bucket(self, name, codec or self.codec or Json())


class _Columnar:
    name = "columnar"


_COLUMNAR = _Columnar()


class Table:
    def __init__(self, node: Node, name: str, entry: Entry):
        self.node, self.name, self.entry = node, name, entry
        self.spec = TableSpec.from_json(entry.spec)

    @property
    def df(self) -> DataFrame:
        """The rows, in no order."""
        spark = self.node.db.spark
        if self.entry.path is None:
            return spark.createDataFrame([], self.spec.schema)
        return spark.read.schema(self.spec.schema).parquet(self.entry.path)

    @property
    def finder(self) -> Finder:
        return Finder(self.df, self.spec, self._search if self.node.db.changes is not None and not self.node.tx else None)

    def _search(self, field: str, query: str, rows: int) -> DataFrame | None:
        """The index's hits, where it has all writes and these rows are the current ones."""
        index, key = self.node.db.index, _key(self.node.path, self.name)
        now = self.node.db.manifest().get(key)
        if now is None or now.path != self.entry.path:
            return None
        return index.search(key, field, query, rows) if index.current() else None

    def select(self, *predicates: q.Predicate) -> Query:
        query = select(self.df, self.spec, *predicates)
        return Query(query.source, query.spec, query.predicate, table=self)

    def _refresh(self) -> None:
        """Before a write: the rows as the last commit left them."""
        self.entry = self.node.table(self.name).entry

    def replace(self, rows: DataFrame, counters: dict[str, int] | None = None, check: bool = False, change: tuple[str, DataFrame | None] = ("reindex", None)) -> None:
        """Commits ``rows`` as the table's next version; ``change`` is its kind, and the changed rows (or the deleted keys)."""
        if self.node.tx and not self.node.tx.writable:
            raise ReadOnly()
        db, key = self.node.db, _key(self.node.path, self.name)
        path = self.node._store(self.name, rows, self.spec)
        stored = db.spark.read.schema(self.spec.schema).parquet(path)
        if check:
            for f in self.spec.fields:
                if f.index == "unique" and not writes.duplicates(stored, f.column, self.spec).isEmpty():
                    db.files.delete(path)
                    raise AlreadyExists(f"two rows would have one {f.name}")
        if self.node.table(self.name).entry.path != self.entry.path:  # a commit since these rows were read
            raise Conflict()
        entry = Entry(path, self.entry.spec, self.entry.counters if counters is None else counters, self.entry.codec)
        op, changed = change
        if op == "update":  # keys; the rows as they are now
            op, changed = "upsert", stored.join(changed, self.spec.id.column, "left_semi")
        if op == "reindex" and self.node.tx:  # the manifest to come has the transaction's last version
            changed = None
        self.node._put(self.name, entry, db.log(op, key, self.spec, changed))
        self._refresh()

    def _batch(self, records: list[dict[str, Any]] | dict[str, Any] | DataFrame) -> DataFrame:
        if records is None:
            raise NilParam()
        if isinstance(records, DataFrame):
            named = [_column(records, f) for f in self.spec.fields]
            return records.select(*named).withColumn("_at", F.monotonically_increasing_id())
        return filled(self.node.db.spark, [records] if isinstance(records, dict) else records, self.spec)

    def save(self, record: dict[str, Any]) -> Any:
        return self.save_all([record])[0]

    def save_all(self, records: list[dict[str, Any]] | DataFrame) -> list[Any]:
        """Inserts or replaces by key, all or none; returns the keys of a list in its order."""
        self._refresh()
        batch, counters = writes.number(self._batch(records), self.df, self.spec, self.entry.counters, "_at")
        key = self.spec.id.column
        writes.check_ids(batch, self.spec)
        one = writes.last_of_each(batch, key, "_at")
        writes.check_unique(self.df, one, self.spec)
        self.replace(writes.upsert(self.df, one, self.spec), counters, change=("upsert", one))
        return [] if isinstance(records, DataFrame) else [r[key] for r in batch.orderBy("_at").select(key).collect()]

    def _existing(self, key: Any) -> None:
        if key is None or self.df.where(F.col(f"`{self.spec.id.column}`") == F.lit(key)).isEmpty():
            raise NotFound()

    def update(self, record: dict[str, Any]) -> None:
        """Non-zero fields only; the row must be there."""
        self._refresh()
        batch = self._batch(record).drop("_at")
        writes.check_ids(batch, self.spec)
        key = self.spec.id
        self._existing(record.get(key.column, record.get(key.name)))
        self.replace(writes.partial_update(self.df, batch, self.spec), check=True, change=("update", batch.select(key.column)))

    def update_field(self, key: Any, field: str, value: Any) -> None:
        self._refresh()
        after = writes.set_field(self.df, self.spec, key, field, value)
        self._existing(key)
        self.replace(after, check=True, change=("update", self._keys(key)))

    def delete(self, key: Any) -> None:
        self._refresh()
        self._existing(key)
        self.delete_ids(self._keys(key))

    def _keys(self, key: Any) -> DataFrame:
        return self.node.db.spark.createDataFrame([(key,)], T.StructType([T.StructField(self.spec.id.column, self.spec.id.type)]))

    def delete_ids(self, ids: DataFrame) -> None:
        self._refresh()
        self.replace(writes.delete_ids(self.df, ids, self.spec), change=("delete", ids))

    def reindex(self) -> dict[str, int]:
        """Rewrites the layout and measures how many rows each index covers."""
        self._refresh()
        counts = {r["field"]: r["n"] for r in self.finder.coverage().collect()}
        self.replace(self.df)
        entry = Entry(self.entry.path, self.entry.spec, self.entry.counters, self.entry.codec, counts)
        self.node._put(self.name, entry)
        self._refresh()
        return counts

    def unique_exists(self, field: str, value: Any) -> bool:
        return not self.df.where(non_zero(self.spec.lookup(field).column, self.spec.lookup(field).type)).where(
            F.col(f"`{self.spec.lookup(field).column}`") == F.lit(value)
        ).isEmpty()


class Transaction:
    """Changes seen by its own nodes only, until one commit makes all of them current."""

    def __init__(self, db: Database, writable: bool):
        self.db, self.writable = db, writable
        self.base = db.current()
        self.tables = db.manifest(self.base)
        self.logs: list[dict[str, Any]] = []
        self.open = True

    def from_(self, *path: str) -> Node:
        return Node(self.db, path, self)

    def node(self) -> Node:
        return Node(self.db, (), self)

    def commit(self) -> None:
        if not self.open:
            raise NotInTransaction()
        if self.writable and self.tables != self.db.manifest(self.base):
            self.db.commit(self.base, self.tables, self.logs)
        self.open = False

    def rollback(self) -> None:
        if not self.open:
            raise NotInTransaction()
        self.open = False
        self.tables, self.logs = self.db.manifest(self.base), []


class Bucket:
    """Key to value: keys as JSON text, values through a codec, one row each."""

    FIELDS = (FieldSpec("key", T.StringType(), id=True), FieldSpec("value", T.BinaryType()))

    def __init__(self, node: Node, name: str, codec: Codec):
        self.node, self.name, self.codec = node, f"__kv_{name}", codec

    def _table(self) -> Table | None:
        found = self.node.get_table(self.name)
        if found and found.entry.codec != self.codec.name:
            raise DifferentCodec()
        return found

    @staticmethod
    def _text(key: Any) -> str:
        if key is None:
            raise NilParam()
        return json.dumps(key.decode("latin-1") if isinstance(key, bytes) else key, sort_keys=True)

    def get_bytes(self, key: Any) -> bytes:
        table = self._table()
        hit = table.df.where(F.col("key") == self._text(key)).select("value").head() if table else None
        if hit is None:
            raise NotFound()
        return bytes(hit[0])

    def set_bytes(self, key: Any, value: bytes) -> None:
        table = self._table() or Node(self.node.db, self.node.path, self.node.tx, self.codec).init(TableSpec(self.name, self.FIELDS))
        table.save({"key": self._text(key), "value": bytes(value)})

    def get(self, key: Any, schema: str) -> Any:
        """The value, decoded as ``schema``."""
        table = self._table()
        kind = T.StructType([T.StructField("v", T._parse_datatype_string(schema))])
        hit = table.df.where(F.col("key") == self._text(key)).select(self.codec.decode(F.col("value"), kind)["v"].alias("v")).head() if table else None
        if hit is None:
            raise NotFound()
        return hit[0].asDict(True) if isinstance(hit[0], T.Row) else hit[0]

    def set(self, key: Any, value: Any, schema: str) -> None:
        kind = T.StructType([T.StructField("v", T._parse_datatype_string(schema))])
        one = self.node.db.spark.createDataFrame([(value,)], kind)
        self.set_bytes(key, one.select(self.codec.encode(F.struct("v")).alias("b")).first()[0])

    def set_all(self, pairs: DataFrame, schema: str) -> None:
        """Sets all pairs (key: text, value of ``schema``) in one write; one row for each key."""
        kind = T.StructType([T.StructField("v", T._parse_datatype_string(schema))])
        table = self._table() or Node(self.node.db, self.node.path, self.node.tx, self.codec).init(TableSpec(self.name, self.FIELDS))
        value = self.codec.encode(F.struct(F.col("value").cast(kind["v"].dataType).alias("v")))
        # keys are JSON texts, as one key's are
        table.save_all(pairs.select(F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2).alias("key"), value.alias("value")))

    def items(self, schema: str) -> DataFrame:
        """(key, value) of all pairs whose keys are texts."""
        kind = T.StructType([T.StructField("v", T._parse_datatype_string(schema))])
        table = self._table()
        if table is None:
            raise NotFound()
        key = F.from_json(F.concat(F.lit("["), "key", F.lit("]")), "array<string>")[0]
        return table.df.select(key.alias("key"), self.codec.decode(F.col("value"), kind)["v"].alias("value"))

    def exists(self, key: Any) -> bool:
        table = self._table()
        return bool(table) and not table.df.where(F.col("key") == self._text(key)).isEmpty()

    def delete(self, key: Any) -> None:
        table = self._table()
        if table is None:
            raise NotFound()
        table.delete(self._text(key))
