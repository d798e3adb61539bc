"""Operator 4: quality by the perplexity of a Kneser-Ney model of trusted text.

The model is an interpolated modified Kneser-Ney model of order ``ORDER`` over
the bytes of the text, so no language needs a word list, invented words
included, and its n-grams reach from one word into the next.  An n-gram is its
own key, a whole number: nothing is folded or hashed together.

Documents are read in blocks.  A block gives its distinct n-grams and how often
each occurs in trusted documents; these counts go to shards and are summed
there.  A shard is named by the ``KEY`` bytes before the predicted one, so it
holds whole contexts and whole continuations of all orders above ``KEY``; the
lower orders have 256**KEY n-grams at most, come from the shards' sums and go
to all of them.  Then each block sends the shards its distinct n-grams and gets
their log-probabilities back.  What a shard is asked is dealt to several tasks
where it is much, so no task grows with the corpus.

One trusted document in ``HELD``, by a hash of its id, is not counted.  The
thresholds are quantiles of the perplexity of these held-out documents, by
language; a document above that of its language is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix64, release, released, table, text_block

#: Bytes of an n-gram, and bytes before its last one that name a shard.
ORDER, KEY = 6, 3
#: One trusted document in so many is held out for the thresholds.
HELD = 5
#: Held-out documents that a language needs for a threshold of its own.
LEAST = 30
#: Bytes at the held-out text's mean that are added to each document before it
#: is judged: the perplexity of a few words says little about them.
PRIOR = 100
#: Bytes of text in a block, and compressed bytes of counts in a shard and of questions to a task, about.
BLOCK, SHARD, ASKED = 12 << 20, 4 << 20, 64 << 20
#: Bytes of text whose n-grams are held at once, and n-grams that a shard gathers before it sums them.
WINDOW, PENDING = 2 << 20, 4 << 20
#: Log-probabilities are sent in steps of 1 / STEPS, as 16 bits.
STEPS = 2048


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * order)) - 1)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, n-grams that end at it and the following ones); before a document there are zeros."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    for lo in range(0, len(data), WINDOW):
        hi, first = min(lo + WINDOW, len(data)), max(lo - ORDER + 1, 0)
        part = data[first:hi].astype(np.uint64)
        out = part.copy()
        for back in range(1, ORDER):
            out[back:] |= part[:-back] << np.uint64(8 * back)
        near = starts[np.searchsorted(starts, first) : np.searchsorted(starts, hi)] - first
        for k in range(ORDER - 1):  # the k-th byte of a document has k before it
            at = near + k
            out[at[at < len(out)]] &= _mask(k + 1)
        yield lo, out[lo - first :]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and how many there are of each."""
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[new], np.add.reduceat(counts[order], new) if len(k) else counts


def distinct(data: np.ndarray, offsets: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of some documents, sorted, and how often each is in those that are ``counted``."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lo, codes in grams(data, offsets):
        here = np.repeat(counted, np.diff(np.clip(offsets, lo, lo + len(codes))))
        unique, _ = runs(np.sort(codes))
        own, n = runs(np.sort(codes[here]))
        count = np.zeros(len(unique), np.uint64)
        count[np.searchsorted(unique, own)] = n
        keys.append(unique)
        counts.append(count)
    return summed(np.concatenate(keys), np.concatenate(counts))


def _planes(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays of one length, byte by byte of equal weight."""
    return zlib.compress(b"".join(np.ascontiguousarray(a).view("u1").reshape(len(a), -1).T.tobytes() for a in arrays if len(a)), 1)


def _unplanes(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(zlib.decompress(raw), "u1")
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(k).reshape(-1))
        at += n * size
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=np.uint64(0))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, "<u8")[0], dtype=np.uint64)


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys); the keys of a shard stay in order."""
    context = (keys >> np.uint64(8)) & _mask(KEY)
    shard = ((mix64(context) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        yield int(shard[places[0]]), places


def discounts(n: list[int]) -> np.ndarray:
    """The modified discounts for counts 1, 2 and more, from the counts of the counts 1 to 4."""
    n = [max(int(x), 1) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return np.array([0.0, *(min(max(x, 0.1), k + 1.0) for k, x in enumerate(d))])


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


class Level:
    """The n-grams of one order, sorted, with their counts and what those of one context sum up to."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes, counts.astype(np.int64)
        context = codes >> np.uint64(8)
        new = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(codes) else np.zeros(0, np.int64)
        self.contexts = context[new]
        kind = np.minimum(self.counts, 3)
        add = lambda x: np.add.reduceat(x, new) if len(new) else np.zeros(0, np.int64)
        self.totals, self.kinds = add(self.counts), [add((kind == k).astype(np.int64)) for k in (1, 2, 3)]

    def below(self, order: int) -> Level:
        """The next lower order: in how many contexts each of its n-grams occurs."""
        return Level(*np.unique(self.codes & _mask(order), return_counts=True))

    def p(self, asked: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of the ``asked`` n-grams; ``lower`` are those of the order below."""
        count, total = _found(asked, self.codes, self.counts), _found(asked >> np.uint64(8), self.contexts, self.totals)
        back = sum(d[k + 1] * _found(asked >> np.uint64(8), self.contexts, x) for k, x in enumerate(self.kinds))
        p = (np.maximum(count - d[np.minimum(count, 3)], 0) + back * lower) / np.maximum(total, 1)
        return np.where(total > 0, p, lower)


def _found(asked: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of the ``asked`` keys, 0 where there are none; ``keys`` are sorted."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


def levels(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """A shard's orders above ``KEY``, the highest first."""
    out = [Level(codes, counts)]
    for order in range(ORDER - 1, KEY, -1):
        out.append(out[-1].below(order))
    return out


def low_levels(codes: np.ndarray, counts: np.ndarray) -> list[tuple[Level, np.ndarray]]:
    """The orders 1 to ``KEY`` with their discounts, from the continuation counts of order ``KEY``."""
    out = [Level(codes, counts)]
    for order in range(KEY - 1, 0, -1):
        out.append(out[-1].below(order))
    return [(x, discounts(counts_of_counts(x.counts))) for x in reversed(out)]


def log_p(asked: np.ndarray, low: list[tuple[Level, np.ndarray]], high: list[Level], d: list[np.ndarray]) -> np.ndarray:
    """log p of the last byte of each n-gram after the others; ``d`` are the discounts of ``high``."""
    p = np.full(len(asked), 1 / 256)
    for k, (level, own) in enumerate(low):
        p = level.p(asked & _mask(k + 1), p, own)
    for k in range(len(high) - 1, -1, -1):
        p = high[k].p(asked & _mask(ORDER - k), p, d[k])
    return np.log(p)


def _parts(raw: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(raw) as f:
        yield from f


def _block(part: pa.RecordBatch):
    return text_block(pa.nulls(part.num_rows, pa.int64()), part.column("text"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, payload): the rows of ``docs`` in blocks of about ``BLOCK`` bytes of ``text``; a block is one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        for batch in batches:
            length = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(length, dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK - size, side="right")))
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - before
                lo = hi
                if size >= BLOCK or lo < batch.num_rows:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    return docs.mapInArrow(released(run), "block long, payload binary")


def _whole(raw: bytes) -> pa.RecordBatch:
    return pa.Table.from_batches(list(_parts(raw))).combine_chunks().to_batches()[0]


def seen(blocks: DataFrame) -> DataFrame:
    """(block, mark, keys, counts): a block's distinct n-grams and their counts; ``mark`` tells whether a block read again is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                part = _whole(raw)
                block = _block(part)
                keys, counts = distinct(block.data, block.offsets, part.column("counted").to_numpy(zero_copy_only=False))
                row = (number, zlib.crc32(raw), _planes(_steps(keys)), _planes(counts.astype("<u4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "mark", "keys", "counts"]
                )

    return blocks.mapInArrow(released(run), "block long, mark long, keys binary, counts binary")


def count(found: DataFrame, shards: int) -> DataFrame:
    """(shard, payload, low, sizes): a shard's n-grams with their counts, the continuation counts of order ``KEY``, and counts of counts by order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, raw_counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, counts = _keys(raw), _unplanes(raw_counts, "<u4")[0]
                keys, counts = keys[counts > 0], counts[counts > 0]
                rows = [(s, _planes(_steps(keys[at]), counts[at])) for s, at in by_shard(keys, shards)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "payload"])

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        keys, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
        for frame in frames:
            for raw in frame["payload"]:
                steps, n = _unplanes(raw, "<u8", "<u4")
                keys.append(np.cumsum(steps, dtype=np.uint64))
                counts.append(n.astype(np.uint64))
                size += len(n)
                if size > PENDING:
                    k, c = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, size = [k], [c], 0
        k, c = summed(np.concatenate(keys), np.concatenate(counts))
        own = levels(k, c)
        low = own[-1].below(KEY)
        sizes = [x for level in own for x in counts_of_counts(level.counts)]
        raw_low = _planes(_steps(low.codes), low.counts.astype("<u4"))
        yield pd.DataFrame({"shard": [key[0]], "payload": [_planes(_steps(k), c.astype("<u8"))], "low": [raw_low], "sizes": [sizes]})

    sent = found.mapInArrow(released(run), "shard int, payload binary")
    return sent.groupBy("shard").applyInPandas(add, "shard int, payload binary, low binary, sizes array<long>")


class Model:
    """The counts in their shards, and what all shards have in common."""

    def __init__(self, spark: SparkSession, found: DataFrame, scratch: Scratch):
        total = found.agg(F.sum(F.octet_length("keys")), F.sum(F.octet_length("counts"))).first()
        asked, counted = (x or 0 for x in total)
        self.shards = max(1, -(-(asked + counted) // SHARD) if asked + counted < 64 * SHARD else 64 + (asked + counted) // (64 * SHARD))
        self.counted = scratch.keep(count(found, self.shards), "counts")
        # tasks that share the questions to one shard
        self.salts = max(1, -(-asked // (self.shards * ASKED)))
        low = np.zeros(1 << (8 * KEY), np.uint32)  # 64 MB at most, whatever the input
        sizes = np.zeros(4 * (ORDER - KEY), np.int64)
        for row in self.counted.select("low", "sizes").toLocalIterator():
            steps, n = _unplanes(row["low"], "<u8", "<u4")
            low[np.cumsum(steps, dtype=np.uint64).astype(np.int64)] += n
            sizes += np.array(row["sizes"])
        self.known = bool(low.any())
        d = [discounts(sizes[4 * k : 4 * k + 4]) for k in range(ORDER - KEY)]
        codes = np.flatnonzero(low).astype(np.uint64)
        self.shared = spark.sparkContext.broadcast((codes, low[codes.astype(np.int64)], d)) if self.known else None

    def answers(self, found: DataFrame) -> DataFrame:
        """(block, answers): the log-probabilities of each block's n-grams, by shard."""
        shards, salts, shared = self.shards, self.salts, self.shared

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, mark, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "mark", "keys")), strict=True):
                    keys = _keys(raw)
                    rows = [(number, s, mark % salts, _planes(_steps(keys[at]))) for s, at in by_shard(keys, shards)]
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["block", "shard", "salt", "asked"])

        def answer(key: tuple, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            release()
            if len(own):
                steps, n = _unplanes(own["payload"].iloc[0], "<u8", "<u8")
                high = levels(np.cumsum(steps, dtype=np.uint64), n)
            else:
                high = levels(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
            *lowest, d = shared.value
            low, out = low_levels(*lowest), []
            for raw in asked["asked"]:
                out.append(_planes(np.clip(np.round(-STEPS * log_p(_keys(raw), low, high, d)), 0, 65535).astype("<u2")))
            return pd.DataFrame({"block": asked["block"], "shard": key[0], "answer": out})

        asks = found.select("block", "mark", "keys").mapInArrow(released(ask), "block long, shard int, salt int, asked binary")
        own = self.counted.select("shard", "payload", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        said = asks.groupBy("shard", "salt").cogroup(own.groupBy("shard", "salt")).applyInPandas(answer, "block long, shard int, answer binary")
        return said.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))


def doc_logs(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The summed log-probabilities of each document; ``keys`` are sorted n-grams with their ``logs``."""
    out = np.zeros(len(offsets) - 1)
    most = 1 << (64 - 8 * ORDER)  # documents whose number fits beside an n-gram
    for lo, codes in grams(data, offsets):
        first = int(np.searchsorted(offsets, lo, side="right")) - 1
        last = int(np.searchsorted(offsets, lo + len(codes), side="left"))
        for d in range(first, last, most):
            edges = np.clip(offsets[d : min(d + most, last) + 1], lo, lo + len(codes)) - lo
            size = np.diff(edges)
            doc = np.repeat(np.arange(len(size), dtype=np.uint64), size)
            both = np.sort((codes[edges[0] : edges[-1]] << np.uint64(64 - 8 * ORDER)) | doc)
            unique, n = runs(both >> np.uint64(64 - 8 * ORDER))
            of = np.repeat(logs[np.searchsorted(keys, unique)], n)
            out[d : d + len(size)] += np.bincount((both & np.uint64(most - 1)).astype(np.int64), of, len(size))
    return out


def scored(blocks: DataFrame, found: DataFrame, model: Model, schema: T.StructType, texts: bool) -> DataFrame:
    """The rows of the blocks (of ``schema``) with perplexity (per byte; null without text) and size (null for null)."""
    shards = model.shards
    names = [f.name for f in schema if texts or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column("payload")[row].as_py()
                if batch.column("mark")[row].as_py() != zlib.crc32(raw):
                    raise RuntimeError("the documents were not the same when they were read again")
                part = _whole(raw)
                keys = _keys(batch.column("keys")[row].as_py())
                heard = {a["shard"]: a["answer"] for a in batch.column("answers")[row].as_py() or ()}
                logs = np.zeros(len(keys))
                for s, at in by_shard(keys, shards):
                    logs[at] = _unplanes(heard[s], "<u2")[0] / -STEPS
                block = _block(part)
                size, total = np.diff(block.offsets), doc_logs(block.data, block.offsets, keys, logs)
                perplexity = pa.array(np.exp(-total / np.maximum(size, 1)), pa.float64(), mask=size == 0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), perplexity, pa.array(size.astype(np.int64), mask=block.nulls)], names=[*names, "perplexity", "size"])

    fields = [f for f in schema if f.name in names] + [T.StructField("perplexity", T.DoubleType()), T.StructField("size", T.LongType())]
    said = found.select("block", "mark", "keys").join(model.answers(found), "block", "left")
    met = blocks.join(said, "block", "left").select("block", "mark", "payload", "keys", "answers")
    return met.mapInArrow(released(run), T.StructType(fields))


def steadied(perplexity: Column, size: Column, mean: float) -> Column:
    """The perplexity with ``PRIOR`` further bytes of the mean log-probability."""
    return F.exp((F.log(perplexity) * size + PRIOR * mean) / (size + PRIOR))


def thresholds(own: DataFrame, langs: DataFrame, mean: float, quantile: float, slack: float) -> DataFrame:
    """(lang, threshold): one row per language of ``langs``, from held-out ``own`` (lang, perplexity, size)."""
    q = F.percentile_approx(steadied(F.col("perplexity"), F.col("size"), mean), quantile, 100_000)
    pooled = own.agg(q).first()[0]
    per = own.groupBy("lang").agg(q.alias("own"), F.count("*").alias("n"))
    # both sides have one row per language
    langs = langs.join(per.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    limit = F.when(F.col("n") >= LEAST, F.col("own")).otherwise(F.lit(pooled).cast("double"))
    return langs.select("lang", (limit * slack).alias("threshold"))


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, quantile: float, slack: float, texts: bool) -> DataFrame:
    """(row, text, lang, ..., perplexity, judged, threshold, kept): ``row`` holds the columns of ``docs`` but for the text."""
    trusted = scratch.keep(trusted_ids(labels).withColumnRenamed("doc_id", "trusted_id"), "ids")
    ident = F.col("doc_id").cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), ident.alias("id"))
    marked = rows.join(trusted, F.col("id") == F.col("trusted_id"), "left")
    out = F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(HELD)) == 0
    known = F.col("trusted_id").isNotNull()
    marked = marked.select("row", "text", "lang", (known & ~out).alias("counted"), (known & out).alias("held"))
    blocks = text_blocks(marked)
    found = scratch.keep(seen(blocks), "seen")
    model = Model(spark, found, scratch)
    if not model.known:
        nothing = [F.lit(None).cast("double").alias(c) for c in ("perplexity", "judged", "threshold")]
        return marked.select("row", "text", *nothing, F.lit(True).alias("kept"))
    scores = scratch.keep(scored(blocks, found, model, marked.schema, texts), "scores")
    scratch.drop(found)
    own = scores.where("held AND perplexity IS NOT NULL").select("lang", "perplexity", "size")
    mean = own.agg(F.sum(F.log("perplexity") * F.col("size")) / F.sum("size")).first()[0] or 0.0
    limits = scratch.keep(thresholds(own, scores.select("lang").distinct(), mean, quantile, slack), "limits").withColumnRenamed("lang", "of")
    both = scores.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("judged", steadied(F.col("perplexity"), F.col("size"), mean))
    kept = ~F.coalesce(F.col("judged") > F.col("threshold"), F.lit(False))
    return both.select("row", *(["text"] if texts else []), "perplexity", "judged", "threshold", kept.alias("kept"))


#: Of the held-out documents' perplexity, and what the threshold is above it.
QUANTILE, SLACK = 0.995, 1.02


def _columns(docs: DataFrame, texts: bool = True) -> list[Column]:
    """The columns of ``docs`` from the rows of ``judged``."""
    own = lambda c: F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col("row")[c]
    return [own(c).alias(c) for c in docs.columns if texts or c != "text"]


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, quantile: float = QUANTILE, slack: float = SLACK, texts: bool = True) -> DataFrame:
    """``docs`` with _perplexity, _judged, _threshold and _kept.

    Trusted text: the documents of ``labels`` with quality 1.  Judged is the
    perplexity steadied by ``PRIOR``; the threshold is ``slack`` times that
    quantile of it over the held-out trusted documents of the language (null is
    a language of its own), or of all languages where it has under ``LEAST``.
    A document without text has a null perplexity and is kept, as are all where
    there is no trusted text.  Rows that repeat an id are judged each for
    itself; ties and an empty table need nothing.  A very long text is taken
    in windows.  Without ``texts`` the column ``text`` is left out.  Other
    columns may have any name; ``keep_good`` adds none.
    """
    out = judged(spark, docs, labels, scratch, quantile, slack, texts)
    return out.select(*_columns(docs, texts), *[F.col(c).alias(f"_{c}") for c in ("perplexity", "judged", "threshold", "kept")])


def op4_kneser_ney_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judged(spark, docs, table(spark, sf_dir, "labels"), Scratch(spark, "lm"), QUANTILE, SLACK, False)
    return out.select("row.doc_id", "row.lang", "perplexity", "judged", "threshold", "kept")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model keeps, with their columns."""
    out = judged(spark, docs, labels, Scratch(spark, "lmdocs"), QUANTILE, SLACK, True)
    return out.where("kept").select(*_columns(docs))
