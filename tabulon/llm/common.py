"""What several operators share: scratch tables, blocks of text, components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: Sorts after every real id; stands for a null doc_id inside Python blocks.
NULL_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where driver and executors are one process."""
    return shared_folder(spark)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone by now
            return


class Scratch:
    """Tables written to the shared folder to cut lineage.

    They survive the loss of an executor.  ``drop`` removes those that no
    later step reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/tabulon-{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        _written.append((spark, self.base))

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.base}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._scratch_path)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


class Block:
    """Some documents: ids, their UTF-8 bytes in one array, and offsets."""

    __slots__ = ("ids", "data", "offsets", "nulls")

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, nulls: np.ndarray):
        self.ids, self.data, self.offsets, self.nulls = ids, data, offsets, nulls

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def text_block(ids: pa.Array, text: pa.Array) -> Block:
    """The bytes of a text column without copying; null is empty."""
    text = text.cast(pa.large_utf8()) if pa.types.is_string(text.type) else text
    nulls = text.is_null().to_numpy(zero_copy_only=False)
    if nulls.any():
        text = text.fill_null("")
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Block(ids_of(ids), raw[off[0] : off[-1]], off - off[0], nulls)


def blocks(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, rows: int = 1 << 30) -> Iterator[Block]:
    """Blocks of about ``most`` bytes of text and ``rows`` documents at most; one document is never divided.

    The batches hold ``doc_id`` and ``text``.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = text_block(batch.column("doc_id"), batch.column("text"))
        lo = 0
        while lo < len(whole):
            hi = int(np.searchsorted(whole.offsets, whole.offsets[lo] + most, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + rows, len(whole))
            a, b = whole.offsets[lo], whole.offsets[hi]
            yield Block(whole.ids[lo:hi], whole.data[a:b], whole.offsets[lo : hi + 1] - a, whole.nulls[lo:hi])
            lo = hi


def id_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b) as (node, component).

    Alternating large-star and small-star steps: every round sends each node
    to the smallest neighbour it knows, so the work is a few shuffles of the
    links and no node's neighbours meet beyond a partial minimum.  Nodes
    without links are not in the result; ``component`` is the smallest node.
    """
    edges = scratch.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        # done where every node has one smaller neighbour at most, and that one has none
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), "v")).groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        if not ends.where("lo < hi").limit(1).count():
            break
        # large star: the larger neighbours of each node go to its smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u <> v").distinct(), "large")
        # small star: a node's smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(large, edges)
        edges = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def release() -> None:
    """Gives the memory that Python has freed back to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``fn`` for ``mapInArrow``, with ``release`` when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run
