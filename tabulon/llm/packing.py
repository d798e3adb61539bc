"""Operator 6: variable-capacity best-fit packing.

Documents are cut into pieces of no more words than the largest permitted
sequence; pieces go, longest first, to the open bin that they fill best.  Where
none has room, a bin is opened: for each permitted length it is worked out what
the pieces that are left would fill it with, and what the bin, shrunk to that,
costs a word; the cheapest is taken.  At the end each bin shrinks to the
smallest permitted length that holds its contents.

Texts are packed where they are read, in blocks of about ``BLOCK`` bytes.  Bins
that a block leaves under ``FULL`` are opened again, and their pieces, dealt
evenly to groups of about the same bytes, are packed once more.  So only these
are shuffled, and no task grows with the input or with a key of it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Block, Scratch, blocks, id_text, table

#: Permitted lengths, in words.
CAPACITIES = (512, 1024, 2048, 4096)
#: Bytes of text that are packed together, about.
BLOCK = 16 << 20
#: Share of its length that a bin of the first round must hold to stay.
FULL = 0.97

PIECES = "array<struct<doc_id:long,piece:int,start:long,length:long,text:string>>"
PACKED = f"seq_id long, capacity int, used int, pieces {PIECES}"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def cost(capacity: int, fixed: float = 64.0, quadratic: float = 1 / 16384) -> float:
    """Of one sequence: a fixed part, its words, and attention over them."""
    return fixed + capacity + quadratic * capacity * capacity


class Rest:
    """The lengths that are not packed yet, and what a bin would be filled with."""

    def __init__(self, lengths: list[int]):
        values, counts = np.unique(np.array(lengths, np.int64), return_counts=True)
        self.values, self.left = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def take(self, n: int) -> None:
        self.left[n] -= 1
        if not self.left[n]:
            del self.left[n]
            self.values.pop(bisect_left(self.values, n))

    def fill(self, room: int) -> int:
        """How much of ``room`` the largest pieces that fit take, one size after the other."""
        start, at = room, len(self.values)
        while room:
            at = bisect_left(self.values, room + 1, 0, at) - 1
            if at < 0:
                break
            n = self.values[at]
            room -= n * min(self.left[n], room // n)
        return start - room


def pack(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """The bin of each piece, and each bin's final capacity and contents.

    ``lengths`` are at most the largest capacity.  Ties keep their order.
    """
    caps = sorted(capacities)
    shrunk = lambda used: next(c for c in caps if c >= used)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rest = Rest(lengths)
    room: dict[int, list[int]] = {}  # open bins by the room they have
    sizes: list[int] = []  # the keys of room, sorted
    where, used = [0] * len(lengths), []
    for i in order:
        n = lengths[i]
        rest.take(n)
        at = bisect_left(sizes, n)
        if at < len(sizes):
            space = sizes[at]
            b = room[space].pop()
            if not room[space]:
                del room[space]
                sizes.pop(at)
        else:
            filled = {c: n + rest.fill(c - n) for c in caps if c >= n}
            space, b = min(filled, key=lambda c: (cost(shrunk(filled[c])) / filled[c], c)), len(used)
            used.append(0)
        where[i] = b
        used[b] += n
        left = space - n
        if left:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append(b)
    return where, [shrunk(u) for u in used], used


def pieces_of(block: Block, largest: int) -> tuple[np.ndarray, ...]:
    """(document, piece, first word, words, first byte) of each piece of a block's documents, in order.

    A piece reaches to the next one's first byte, so pieces give back the text.
    """
    inner = ~_SPACE[block.data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    begins = block.offsets[:-1][block.lengths > 0]
    first[begins] = inner[begins]
    starts = np.flatnonzero(first)
    upto = np.searchsorted(starts, block.offsets)
    words = np.diff(upto)
    n = np.maximum(-(-words // largest), 1)
    doc = np.repeat(np.arange(len(block)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * largest
    at = block.offsets[doc].copy()
    later = piece > 0
    at[later] = starts[upto[doc[later]] + start[later]]
    return doc, piece, start, np.minimum(words[doc] - start, largest), at


def _sequences(rows: list[tuple], ids: pa.Array, piece, start, length, text: pa.Array) -> pa.RecordBatch:
    """(seq_id, capacity, used, pieces) from ``rows`` with the places of each bin's pieces."""
    order = pa.array(np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64), pa.int64())
    columns = [ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), text]
    taken = pa.StructArray.from_arrays([c.take(order) for c in columns], names=["doc_id", "piece", "start", "length", "text"])
    ends = np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32)
    whole = pa.ListArray.from_arrays(pa.array(ends), taken)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), whole],
        names=["seq_id", "capacity", "used", "pieces"],
    )


def _bins(length: np.ndarray, capacities: tuple[int, ...], name) -> list[tuple]:
    """Rows for ``_sequences``; pieces without words are in no bin."""
    real = np.flatnonzero(length > 0)
    where, caps, used = pack(length[real].tolist(), capacities)
    by = np.argsort(np.array(where, np.int64), kind="stable")
    cuts = np.cumsum(np.bincount(np.array(where, np.int64), minlength=len(caps)))[:-1] if caps else []
    rows = [(name(b), caps[b], used[b], real[own]) for b, own in enumerate(np.split(by, cuts))] if caps else []
    return rows + [(None, 0, 0, np.array([k])) for k in np.flatnonzero(length == 0).tolist()]


def pack_texts(docs: DataFrame, scratch: Scratch, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """The sequences of the documents (doc_id, text): seq_id, capacity, used, and the pieces with their texts.

    A document longer than the largest capacity gives several pieces, all but
    the last of that many words; the pieces of a document, in order, are its
    text.  One without words, or with a null text, is a piece by itself, with
    no sequence id and capacity 0.  Rows that repeat an id, or have none, are
    packed each for itself; other columns have no influence; ties keep their
    order; an empty table gives no rows.
    """
    largest = max(capacities)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 40
        for k, block in enumerate(blocks(batches, BLOCK)):
            doc, piece, start, length, at = pieces_of(block, largest)
            ends = pa.py_buffer(np.append(at, len(block.data)).astype(np.int64))
            text = pa.LargeStringArray.from_buffers(len(at), ends, pa.py_buffer(np.ascontiguousarray(block.data))).cast(pa.string())
            ids = block.ids[doc]
            rows = _bins(length, capacities, lambda b, k=k: part | k << 22 | b)
            yield _sequences(rows, pa.array(ids, mask=ids == NULL_ID), piece, start, length, text)

    made = scratch.keep(id_text(docs).mapInArrow(first, PACKED), "first")
    done = F.col("seq_id").isNull() | (F.col("used") >= F.col("capacity") * FULL)
    rest = made.where(~done).select("seq_id", F.posexplode("pieces").alias("at", "p"))
    size = rest.agg(F.sum(F.octet_length("p.text"))).first()[0] or 0
    groups = max(1, -(-size // BLOCK))

    def again(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["seq_id", "at"], kind="stable").reset_index(drop=True)
        name = lambda b: -(int(key[0]) << 24 | b) - 1
        rows = _bins(frame["length"].to_numpy(), capacities, name)
        ids = pa.array(frame["doc_id"].astype("Int64"), pa.int64())
        made = _sequences(rows, ids, frame["piece"], frame["start"], frame["length"], pa.array(frame["text"], pa.string()))
        return made.to_pandas().astype({"seq_id": "Int64"})

    dealt = rest.select(F.pmod(F.xxhash64("seq_id", "at"), F.lit(groups)).alias("g"), "seq_id", "at", "p.*")
    return made.where(done).unionByName(dealt.groupBy("g").applyInPandas(again, PACKED))


def pack_documents(spark, docs: DataFrame) -> DataFrame:
    return pack_texts(docs, Scratch(spark, "pack"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))
