"""The change log and the stream that applies it to an inverted index.

A write puts the changed records into the log's folder first; the manifest that
makes the write current names them, so rows and log commit together.  A
Structured Streaming query reads the manifests in micro-batches, keeps the last
change of each record and adds one segment to the index.  The base tables stay
the truth: a reader uses the index only when it has applied all that was logged.

A segment holds postings (a row for each token of a record's field) by token
bucket, sorted, so a search reads the lists of its tokens alone, and the
records it has changed, which end what earlier segments say of them.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict
from ..functions.text import query_tokens, score_of, tokens
from ..schema import TableSpec
from ..sources.files import Files

ROWS = "entry string, id string, texts map<string,string>, digest long"
ENTRIES = "number long, log array<struct<op:string,key:string,entry:string,at:int>>"
DOCS = "key string, id string, digest long, gone boolean"
POSTINGS = "key string, field string, token string, id string, tf int, length int, bucket int"
#: Buckets of tokens, and segments from which they are merged.
BUCKETS, SEGMENTS = 64, 8


def coalesced(changes: DataFrame, by: list[str], seq: str) -> DataFrame:
    """The last change of each record: a maximum per record, so hot records are combined where they are."""
    rest = [c for c in changes.columns if c not in by]
    last = changes.groupBy(*by).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return last.select(*by, "_last.*")


def indexed_fields(spec: TableSpec) -> list[str]:
    return [f.column for f in spec.fields if f.index == "fulltext"]


def _texts(spec: TableSpec, rows: DataFrame, entry: str) -> DataFrame:
    """(entry, id, texts, digest) of some records."""
    named = [c for c in indexed_fields(spec) if c in rows.columns]
    pairs = [x for c in named for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    texts = F.create_map(*pairs) if pairs else F.lit(None)
    ident = spec.id.column if spec.id.column in rows.columns else rows.columns[0]
    digest = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in named]) if named else F.lit(0).cast("long")
    return rows.select(
        F.lit(entry).alias("entry"), F.col(f"`{ident}`").cast("string").alias("id"), texts.cast("map<string,string>").alias("texts"), digest.alias("digest")
    )


class ChangeLog:
    """The changed records of a database's writes: upserts and deletes by record, drops and rebuilds by table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.db: Any = None

    def attach(self, db: Any) -> None:
        self.db = db

    def path(self, entry: str) -> str:
        return f"{self.root}/log/{entry}"

    def desired(self) -> int:
        """The last manifest that names changes."""
        return self.db.logged() if self.db else 0

    def write(self, op: str, key: str, spec: TableSpec, rows: DataFrame | None) -> dict[str, Any] | None:
        """Writes the full-text fields of the changed records; returns what the manifest is to say of it."""
        if not indexed_fields(spec):
            return None
        entry = ""
        if rows is not None:
            entry = uuid.uuid4().hex
            _texts(spec, rows, entry).write.parquet(self.path(entry))
        return {"op": op, "key": key, "entry": entry}


class IndexStream:
    """Keeps the postings of all logged records up to date."""

    def __init__(self, log: ChangeLog, max_files: int = 128, attempts: int = 3, retry_seconds: float = 0.25):
        self.log, self.max_files, self.attempts, self.retry = log, max_files, attempts, retry_seconds

    @property
    def spark(self) -> SparkSession:
        return self.log.spark

    def _state(self) -> dict[str, Any]:
        where = f"{self.log.root}/index/state"
        names = [n for n in self.log.files.names(where) if n.endswith(".json")]
        return json.loads(self.log.files.read(f"{where}/{names[-1]}")) if names else {"applied": 0, "n": 0, "segments": [], "ended": {}}

    def applied(self) -> int:
        return self._state()["applied"]

    def current(self) -> bool:
        return self.applied() >= self.log.desired()

    # reading

    def _read(self, schema: str, state: dict[str, Any], kind: str, after: int = 0) -> DataFrame | None:
        """Rows of ``kind`` of the segments from number ``after`` on, with the segment's number; without tables that a later one ended."""
        parts = []
        for n, path in state["segments"]:
            if n >= after:
                dead = [k for k, since in state["ended"].items() if since > n]
                df = self.spark.read.schema(schema).parquet(f"{path}/{kind}")
                parts.append((df.where(~F.col("key").isin(dead)) if dead else df).withColumn("seg", F.lit(n)))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def records(self, state: dict[str, Any] | None = None) -> DataFrame:
        """(key, id, digest) of all indexed records."""
        found = self._read(DOCS, state or self._state(), "docs")
        if found is None:
            return self.spark.createDataFrame([], "key string, id string, digest long")
        return coalesced(found, ["key", "id"], "seg").where("NOT gone").select("key", "id", "digest")

    rows = records

    def postings(self, key: str | None = None, wanted: list[str] | None = None, state: dict[str, Any] | None = None) -> DataFrame:
        """The postings that count, of one table and some tokens or of all."""
        state = state or self._state()

        def chosen(df: DataFrame) -> DataFrame:
            return df if key is None else df.where(F.col("key") == key)

        found = self._read(POSTINGS, state, "postings")
        if found is None:
            return self.spark.createDataFrame([], POSTINGS)
        found = chosen(found)
        if wanted is not None:
            buckets = sorted({r[0] for r in self.spark.createDataFrame([(w,) for w in wanted], "token string").select(_bucket()).collect()}) if wanted else []
            found = found.where(F.col("bucket").isin(buckets) & F.col("token").isin(wanted))
        if len(state["segments"]) > 1:
            changed = chosen(self._read(DOCS, state, "docs", state["segments"][1][0])).groupBy("key", "id").agg(F.max("seg").alias("last"))
            found = found.join(changed, ["key", "id"], "left").where("last IS NULL OR seg >= last").drop("last")
        return found.drop("seg")

    def matching(self, key: str, query: str, fallback: tuple[DataFrame, str, Any] | None = None) -> DataFrame:
        """Ids of a table's records with any token of the query in any field.

        Where the index is behind, the base table (rows, key column, text) is read instead.
        """
        if not self.current() and fallback is not None:
            from ..functions.text import any_token

            rows, ident, text = fallback
            return rows.where(any_token(text, query)).select(F.col(ident).cast("string").alias("id"))
        return self.postings(key, query_tokens(query)).select("id").distinct()

    def search(self, key: str, field: str, query: str, total: int) -> DataFrame:
        """(id, score) of the records with any token of the query in ``field``; ``total`` records are in the table."""
        wanted = query_tokens(query)
        found = self.postings(key, wanted).where(F.col("field") == field)
        held = {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}  # one row for each token of the query
        per = found.groupBy("id").agg(F.max("length").alias("length"), *[F.max(F.when(F.col("token") == w, F.col("tf"))).alias(f"tf{k}") for k, w in enumerate(wanted)])
        times = [F.coalesce(F.col(f"tf{k}"), F.lit(0)) for k in range(len(wanted))]
        return per.select("id", score_of(times, [held.get(w, 0) for w in wanted], total, F.col("length")).alias("score"))

    # writing

    def _advance(self, state: dict[str, Any], docs: DataFrame, postings: DataFrame, applied: int, ended: list[str], alone: bool = False) -> None:
        """One more segment, or one ``alone``, made current by one small file."""
        n = state["n"] + 1
        path = f"{self.log.root}/index/segment-{n:06d}-{uuid.uuid4().hex}"
        docs.write.parquet(f"{path}/docs")
        # a frequent token's postings are dealt to several tasks
        dealt = postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "key", "field", "token")
        dealt.select("key", "field", "token", "id", "tf", "length", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
        after = {
            "applied": max(applied, state["applied"]), "n": n, "segments": [[n, path]] if alone else [*state["segments"], [n, path]],
            "ended": {} if alone else state["ended"] | dict.fromkeys(ended, n),
        }
        if not self.log.files.create(f"{self.log.root}/index/state/{n:012d}.json", json.dumps(after)):
            raise Conflict()

    def apply(self, batch: DataFrame, _: int = 0) -> None:
        """Applies the changes that some manifests name; a batch applied before changes nothing."""
        state = self._state()
        rows = [r for r in batch.collect() if r["number"] is not None]  # names of changes, not the changes
        if not rows:
            return
        top = max(r["number"] for r in rows)
        found = sorted((r["number"], e["at"], e["op"], e["key"], e["entry"]) for r in rows if r["number"] > state["applied"] for e in r["log"] or ())
        ended = {key: k for k, (_, _, op, key, _) in enumerate(found) if op in ("drop", "reindex")}
        live = [(k, *x) for k, x in enumerate(found) if k >= ended.get(x[3], 0) and x[2] != "drop"]
        if not found:
            if top > state["applied"]:
                self._advance(state, self._none(DOCS), self._none(POSTINGS), top, [])
            return
        changes = []
        paths = [self.log.path(entry) for _, _, _, op, _, entry in live if op != "reindex"]
        if paths:
            named = self.spark.createDataFrame([(entry, k, key, op) for k, _, _, op, key, entry in live if op != "reindex"], "entry string, seq long, key string, op string")
            changes.append(self.spark.read.schema(ROWS).parquet(*paths).join(F.broadcast(named), "entry"))  # one row per logged write
        for k, number, _, op, key, _ in live:
            if op == "reindex":
                base = self._base(number, key)
                if base is not None:
                    changes.append(base.withColumns({"seq": F.lit(k).cast("long"), "key": F.lit(key), "op": F.lit("upsert")}))
        every = [c.select("key", "id", "seq", "op", "texts", "digest") for c in changes]
        last = coalesced(reduce(DataFrame.unionByName, every), ["key", "id"], "seq") if every else None
        if last is None:
            self._advance(state, self._none(DOCS), self._none(POSTINGS), top, list(ended))
            return
        # records whose indexed text did not change keep their postings
        have = self.records(state).where(~F.col("key").isin(list(ended))) if ended else self.records(state)
        same = last.where("op = 'upsert'").join(have, ["key", "id", "digest"], "left_semi").select("key", "id")
        changed = last.join(same, ["key", "id"], "left_anti")
        docs = changed.select("key", "id", "digest", (F.col("op") == "delete").alias("gone"))
        self._advance(state, docs, _postings(changed.where("op = 'upsert'")), top, list(ended))
        self._merge()

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _base(self, number: int, key: str) -> DataFrame | None:
        """The log's columns of a table as the manifest ``number`` has it."""
        entry = self.log.db.manifest(number).get(key)
        if entry is None or entry.path is None:
            return None
        spec = TableSpec.from_json(entry.spec)
        return _texts(spec, self.spark.read.schema(spec.schema).parquet(entry.path), "")

    def _merge(self) -> None:
        state = self._state()
        if len(state["segments"]) >= SEGMENTS:
            docs = self.records(state).withColumn("gone", F.lit(False))
            self._advance(state, docs, self.postings(state=state), state["applied"], [], alone=True)

    def flush(self) -> None:
        """Applies all that is logged; retried, and after some failures built anew."""
        if self.current():
            return
        for k in range(self.attempts):
            try:
                stream = self.spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", self.max_files).json(f"{self.log.db.root}/_manifest")
                query = (
                    stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.log.root}/checkpoint").trigger(availableNow=True).start()
                )
                query.awaitTermination()
                if self.current():
                    return
                raise Conflict("the stream ended before what was logged")
            except Exception:
                if k + 1 == self.attempts:
                    self.rebuild()
                    return
                time.sleep(self.retry)

    def rebuild(self) -> None:
        """The index from the base tables as they are; what is written meanwhile follows by the stream."""
        number = self.log.db.current()
        parts = []
        for key, entry in self.log.db.manifest(number).items():
            base = self._base(number, key) if indexed_fields(TableSpec.from_json(entry.spec)) else None
            if base is not None:
                parts.append(base.withColumn("key", F.lit(key)))
        rows = reduce(DataFrame.unionByName, parts) if parts else None
        docs = rows.select("key", "id", "digest", F.lit(False).alias("gone")) if rows is not None else self._none(DOCS)
        self._advance(self._state(), docs, _postings(rows) if rows is not None else self._none(POSTINGS), number, [], alone=True)


def _bucket():
    return F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _postings(rows: DataFrame) -> DataFrame:
    """The postings of (key, id, texts)."""
    fields = rows.select("key", "id", F.explode("texts").alias("field", "text")).select("key", "id", "field", tokens(F.col("text")).alias("toks"))
    each = fields.select("key", "id", "field", F.size("toks").alias("length"), F.explode("toks").alias("token"))
    counted = each.groupBy("key", "id", "field", "token", "length").agg(F.count("*").cast("int").alias("tf"))
    return counted.select("key", "field", "token", "id", "tf", "length", _bucket())


