"""Operator 7: the n-gram Jaccard join, by grouped prefixes.

Sets of shingles with 100 |A and B| >= 85 |A or B| share a shingle among the
first |A| - ceil(0.85 |A|) + 1 of each, in any one order of all shingles.  The
order is by a frequency class, rare first, then by hash.  The classes come
from a table of 2**20 counters of all shingles: bounded, and without influence
on the result.

Equal sets are one unit.  Units with the same prefix and size form a group;
only groups are listed under the shingles of their prefix.  Groups that share
a shingle, fit in size and may still overlap enough from there on are
candidate pairs; their members are compared first by an upper bound from
small histograms, then by their whole sets.

A list of m near copies is not turned into its m * m pairs at once.  A first
round compares each list's first group with the others, a second one eight
groups; connected components follow each.  The last round takes every pair
that is not yet in one component, so no link between components is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Block, Scratch, blocks, components, id_text, mix64, release, released, table, unused

#: Counters of the frequency classes, and slices in which tasks send them.
COUNTERS, SLICES = 1 << 20, 64
#: Units of one group at most, about; further ones form groups of their own.
GROUP = 500
#: Fewest and most bins of a unit's histogram, and those of the short one that goes with list entries.
BINS, MOST_BINS, SHORT = 64, 1 << 15, 32
#: Bytes of histograms that a comparison holds side by side, about.
SIDE = 32 << 20
#: Bits of the filter of candidate documents; where it fills up, it lets all pass.
FILTER = 1 << 24
#: Prefix entries in a shard of lists, and candidate units in a block of the comparison, about.
SHARD, BLOCK_UNITS = 200_000, 8_000
#: Entries of one list that a task of the last round holds twice at most, about; longer lists are cut into pieces that meet in pairs.
PIECE = 4_096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_BASE = 0xC2B2AE3D27D4EB4F


def shingles(block: Block, words: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each document's distinct shingles as sorted 52-bit numbers.

    A block has 4096 documents at most.
    """
    data, off = block.data, block.offsets
    n = len(data)
    if not n:
        return np.zeros(len(block) + 1, np.int64), np.zeros(0, np.uint64)
    text = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = text[:-1]
    heads = off[:-1][np.diff(off) > 0]
    before[heads] = False
    start = np.flatnonzero(text & ~before)
    after = np.zeros(n, bool)
    after[:-1] = text[1:]
    after[heads[1:] - 1] = False
    stop = np.flatnonzero(text & ~after) + 1
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * down, out=total[1:])
    w = mix64((total[stop] - total[start]) * up[start] + (stop - start).astype(np.uint64))
    doc = np.searchsorted(off, start, side="right") - 1
    count = np.bincount(doc, minlength=len(block))
    multiply = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B185EBCA87, 0x165667B19E3779F9)]
    m = len(w) - words + 1
    parts_d, parts_h = [], []
    if m > 0:
        same = doc[words - 1 :] == doc[:m]
        h = np.zeros(m, np.uint64)
        for k in range(words):
            h = (h + w[k : k + m]) * multiply[k % 4]
            h ^= h >> np.uint64(32)
        parts_d.append(doc[:m][same])
        parts_h.append(mix64(h[same]))
    first = np.cumsum(count) - count
    for d in np.flatnonzero((count > 0) & (count < words)).tolist():  # too short for a shingle
        h = count[d : d + 1].astype(np.uint64)
        for k in range(first[d], first[d] + count[d]):
            h = mix64(h + w[k : k + 1])
        parts_d.append(np.array([d]))
        parts_h.append(mix64(h))
    if not parts_d:
        return np.zeros(len(block) + 1, np.int64), np.zeros(0, np.uint64)
    key = (np.concatenate(parts_d).astype(np.uint64) << np.uint64(52)) | (np.concatenate(parts_h) >> np.uint64(12))
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    cut = np.searchsorted(key, np.arange(len(block) + 1).astype(np.uint64) << np.uint64(52))
    return cut, key & np.uint64((1 << 52) - 1)


def read(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    for block in blocks(batches, 1 << 20, 4096):
        yield block, *shingles(block, words)


def _sum_slices(parts: DataFrame, kind: str, combine) -> np.ndarray:
    """Slices (slice, data) of all tasks, combined per slice and put together; the total is bounded."""

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        out = None
        for frame in frames:
            for raw in frame["data"]:
                x = np.frombuffer(zlib.decompress(raw), kind)
                out = x.copy() if out is None else combine(out, x)
        yield pd.DataFrame({"slice": [key[0]], "data": [out.tobytes()]})

    rows = parts.groupBy("slice").applyInPandas(add, "slice int, data binary").collect()
    return np.concatenate([np.frombuffer(r["data"], kind) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(0, kind)


def frequency_classes(docs: DataFrame, words: int) -> np.ndarray:
    """For each counter, by how much it exceeds what rare shingles put there, as a power of two.

    Rare shingles fill all counters alike, but for the noise of their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, _, h in read(batches, words):
            at = (h & np.uint64(COUNTERS - 1)).astype(np.int64)
            np.add.at(total, at, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(total, SLICES)], pa.binary())],
            names=["slice", "data"],
        )

    counts = _sum_slices(docs.mapInArrow(released(run), "slice int, data binary"), "<i8", np.add)
    if not len(counts) or not counts.sum():
        return np.zeros(COUNTERS, np.uint8)
    usual = np.median(counts)
    return np.clip(np.floor(np.log2(np.maximum(counts - usual, 1) / (5 * np.sqrt(usual) + 3))) + 1, 0, 60).astype(np.uint8)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def bins_of(n: np.ndarray) -> np.ndarray:
    """Bins for sets of ``n`` shingles: a power of two, about one for every two shingles."""
    wanted = 1 << np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64)
    return np.clip(wanted, BINS, MOST_BINS)


def histograms(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each set's counts in its bins, two to a byte; 15 stands for any larger count too."""
    bins = bins_of(n)
    first = np.concatenate([[0], np.cumsum(bins)])
    at = first[doc] + (h >> np.uint64(20)).astype(np.int64) % bins[doc]
    counts = np.minimum(np.bincount(at, minlength=first[-1]), 15).astype("u1")
    raw = (counts[0::2] | counts[1::2] << 4).tobytes()
    return [raw[a // 2 : b // 2] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def counts_in(raws: list[bytes], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts in ``bins`` bins, whether a count is not known) of histograms that have as many bins or more."""
    out, full = np.zeros((len(raws), bins), "u2"), np.zeros(len(raws), bool)
    sizes = np.array([2 * len(x) for x in raws])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        packed = np.frombuffer(b"".join(raws[k] for k in rows.tolist()), "u1").reshape(len(rows), -1)
        counts = np.stack([packed & 15, packed >> 4], 2).reshape(len(rows), size)
        full[rows] = (counts == 15).any(1)
        out[rows] = counts.reshape(len(rows), size // bins, bins).sum(1, dtype="u2")
    return out, full


def profiles(docs: DataFrame, classes: np.ndarray, percent: int, words: int) -> DataFrame:
    """(doc_id, n, f1, f2, g1, g2, prefix, histogram): size, hashes of the set and of its prefix, the prefix in order, counts in bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, cut, h in read(batches, words):
            n = np.diff(cut)
            doc = np.repeat(np.arange(len(block)), n)
            order = np.lexsort((h, classes[(h & np.uint64(COUNTERS - 1)).astype(np.int64)], doc))
            ranked = h[order]
            inside = np.arange(len(h)) - cut[doc] < prefix_size(n, percent)[doc]
            one, two = mix64(h + np.uint64(0x632BE59BD9B4E019)), mix64(h ^ np.uint64(0xE220A8397B1DCDAF))
            sums = [_sums(x, cut) for x in (one, two)]
            size = np.concatenate([[0], np.cumsum(np.bincount(doc[inside], minlength=len(block)))])
            chosen = ranked[inside]
            pre = [_sums(mix64(chosen + np.uint64(k)), size) for k in (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93)]
            raw = chosen.astype("<u8").tobytes()
            pieces = [raw[8 * a : 8 * b] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            ids = pa.array(block.ids, pa.int64(), mask=block.ids == NULL_ID)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in (*sums, *pre)), pa.array(pieces, pa.binary()),
                    pa.array(histograms(doc, h, n), pa.binary()),
                ],
                names=["doc_id", "n", "f1", "f2", "g1", "g2", "prefix", "histogram"],
            )

    return docs.mapInArrow(released(run), "doc_id long, n long, f1 long, f2 long, g1 long, g2 long, prefix binary, histogram binary")


def _sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[cut[1:]] - total[cut[:-1]]


def candidate_pairs(frame: pd.DataFrame, centers: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups (smaller, larger leader) from a shard's lists.

    ``centers`` groups of each list meet all others, but for the first one
    where there are several: an earlier round has compared it.  0 means all
    pairs of the lists, which eight centers do not cover; of a list in pieces,
    those between the two pieces that the frame has.
    """
    frame = frame.sort_values(["token", "leader"], kind="stable")
    token, leader = frame["token"].to_numpy(), frame["leader"].to_numpy()
    n, pos = frame["n"].to_numpy(), frame["pos"].to_numpy()
    label = frame["label"].to_numpy()
    full = bytes([255]) * SHORT  # no short histogram: it bounds nothing
    short = np.frombuffer(b"".join(x or full for x in frame["short"]), np.uint8).reshape(-1, SHORT)
    loose = (short == 255).any(1)
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(token)))
    out: list[np.ndarray] = []

    def offer(a: np.ndarray, b: np.ndarray) -> None:
        lo, hi = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        # at most this many shingles can be common, the ones before included
        most = np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b])
        ok = (a != b) & (100 * lo >= percent * hi) & ((label[a] != label[b]) | (label[a] == -1))
        ok &= (100 + percent) * most >= percent * (lo + hi)
        a, b = a[ok], b[ok]
        for k in range(0, len(a), 500_000):
            c, d = a[k : k + 500_000], b[k : k + 500_000]
            common = np.minimum(short[c], short[d]).sum(1, dtype=np.int64)
            may = loose[c] | loose[d] | ((100 + percent) * common >= percent * (n[c] + n[d]))
            emit(leader[c[may]], leader[d[may]])

    def emit(x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            out.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))

    if centers:
        for k in range(1 if centers > 1 else 0, centers):
            some = size > max(k, 1)
            s, z = start[some], size[some]
            middle = s + np.where(z <= centers, k, (k * z) // centers)
            ends = np.cumsum(z)
            every = np.repeat(s - (ends - z), z) + np.arange(int(ends[-1]) if len(ends) else 0)
            offer(np.repeat(middle, z), every)
    else:
        piece = frame["piece"].to_numpy()
        two = (frame["low"] != frame["high"]).to_numpy()
        low = frame["low"].to_numpy()
        for s, z in zip(start.tolist(), size.tolist(), strict=True):
            if not (label[s : s + z] != label[s]).any() and label[s] != -1:
                continue
            here = np.arange(s, s + z)
            left, right = (here[piece[here] == low[here]], here[piece[here] != low[here]]) if two[s] else (here, here)
            for k in range(0, len(left), 256):
                a, b = left[k : k + 256], right if two[s] else right[k + 1 :]
                x, y = np.repeat(a, len(b)), np.tile(b, len(a))
                if not two[s]:
                    x, y = x[x < y], y[x < y]
                offer(x, y)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(out), axis=0)
    return both[:, 0], both[:, 1]


def in_pieces(lists: DataFrame) -> DataFrame:
    """The entries of ``lists`` with a ``piece``, once for each pair of pieces (``low``, ``high``) that they are part of.

    A list of one component is not cut: none of its pairs is compared.
    """
    pieces = F.ceil(F.col("length") / PIECE).cast("long")
    every = lists.where(F.col("length") <= PIECE)
    cut = lists.where(F.col("length") > PIECE)
    mixed = cut.groupBy("shard", "token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi OR lo = -1")
    cut = cut.join(mixed.select("shard", "token"), ["shard", "token"], "left_semi").withColumn("piece", F.pmod(F.xxhash64("leader"), pieces))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    cut = cut.withColumns({"hot": F.col("token"), "low": F.least("piece", "other"), "high": F.greatest("piece", "other")}).drop("other")
    zero = F.lit(0).cast("long")
    return every.withColumns({"piece": zero, "hot": zero, "low": zero, "high": zero}).unionByName(cut)


def _block_of(leader: np.ndarray, blocks_: int) -> np.ndarray:
    return (mix64(leader.astype(np.uint64)) % np.uint64(blocks_)).astype(np.int64)


def _packed(a: np.ndarray, b: np.ndarray, blocks_: int) -> list[tuple[int, int, bytes]]:
    """Pairs by the blocks of their leaders: (bx, by, the pairs), bx <= by."""
    x, y = _block_of(a, blocks_), _block_of(b, blocks_)
    key = np.minimum(x, y) * blocks_ + np.maximum(x, y)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return [
        (int(key[p[0]] // blocks_), int(key[p[0]] % blocks_), np.stack([a[p], b[p]]).astype("<i8").tobytes())
        for p in (np.split(order, cuts) if len(order) else ())
    ]


def _unique_pairs(raws) -> np.ndarray:
    if not len(raws):
        return np.zeros((0, 2), np.int64)
    return np.unique(np.concatenate([np.frombuffer(r, "<i8").reshape(2, -1).T for r in raws]), axis=0)


PAIRS = "bx long, by long, pairs binary"


def paired(centers: int, percent: int, blocks_: int):
    def pairs_of(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        return pd.DataFrame(_packed(*candidate_pairs(frame, centers, percent), blocks_), columns=["bx", "by", "pairs"])

    return pairs_of


def unique(pairs: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Each pair of a block pair once, without those that earlier rounds have compared."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        both = _unique_pairs(frame["pairs"][frame["fresh"]].tolist())
        old = _unique_pairs(frame["pairs"][~frame["fresh"]].tolist())
        if len(old) and len(both):
            _, at, times = np.unique(np.concatenate([both, old, old]), axis=0, return_index=True, return_counts=True)
            both = both[np.sort(at[(times == 1) & (at < len(both))])]
        raws = [both[k : k + (1 << 22)].T.astype("<i8").tobytes() for k in range(0, len(both), 1 << 22)]
        return pd.DataFrame({"bx": frame["bx"].iloc[0], "by": frame["by"].iloc[0], "pairs": raws})

    every = pairs.withColumn("fresh", F.lit(True))
    for d in done:
        every = every.unionByName(d.withColumn("fresh", F.lit(False)))
    return every.groupBy("bx", "by").applyInPandas(run, PAIRS)


def leaders_in(pairs: DataFrame) -> DataFrame:
    """(bx, by, leader) of the groups in each row of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bx, by, raw in zip(*(batch.column(c).to_pylist() for c in ("bx", "by", "pairs")), strict=True):
                leaders = np.unique(np.frombuffer(raw, "<i8"))
                k = len(leaders)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, bx)), pa.array(np.full(k, by)), pa.array(leaders)], names=["bx", "by", "leader"]
                )

    return pairs.mapInArrow(released(run), "bx long, by long, leader long")


def leaders_of(pairs: DataFrame) -> DataFrame:
    return leaders_in(pairs).select("leader").distinct()


def meet(pairs: DataFrame, units: DataFrame, compare, schema: str) -> DataFrame:
    """Brings the units of both groups of each pair together and compares them.

    A group goes to a block pair once, however many partners it has there.
    """

    sent = leaders_in(pairs).distinct().join(units, "leader")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        release()
        return compare(_unique_pairs(left["pairs"].tolist()), right)

    return pairs.groupBy("bx", "by").cogroup(sent.groupBy("bx", "by")).applyInPandas(run, schema)


class Cluster:
    """Components of the units of one comparison, for skipping what is connected."""

    def __init__(self, labels: np.ndarray):
        _, first, at = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[at]

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _members(right: pd.DataFrame) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, leader in enumerate(right["leader"].tolist()):
        out.setdefault(leader, []).append(k)
    return out


def bounded(percent: int, blocks_: int):
    """Keeps the pairs of groups of which two members may be similar by their histograms."""

    def compare(pairs: np.ndarray, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("leader", kind="stable")
        leaders, first, size = np.unique(right["leader"].to_numpy(), return_index=True, return_counts=True)
        raws = right["histogram"].tolist()
        width = np.array([2 * len(x) for x in raws])
        n, label = right["n"].to_numpy(), right["label"].to_numpy()
        a, b = (np.searchsorted(leaders, pairs[:, k]) for k in (0, 1))
        ok, lo = np.zeros(len(pairs), bool), 0
        upto = np.concatenate([[0], np.cumsum(size[a] * size[b])])
        while lo < len(pairs):  # member pairs of some pairs of groups at a time
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + 100_000, side="right")) - 1)
            each = size[a[lo:hi]] * size[b[lo:hi]]
            pair = np.repeat(np.arange(lo, hi), each)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            x, y = first[a[pair]] + k // size[b[pair]], first[b[pair]] + k % size[b[pair]]
            apart = label[x] != label[y]
            x, y, pair = x[apart], y[apart], pair[apart]
            both = np.minimum(width[x], width[y])
            for bins in np.unique(both).tolist():
                here = np.flatnonzero(both == bins)
                for k in range(0, len(here), max(1, SIDE // (2 * bins))):
                    some = here[k : k + max(1, SIDE // (2 * bins))]
                    used, at = np.unique(np.concatenate([x[some], y[some]]), return_inverse=True)
                    counts, full = counts_in([raws[j] for j in used.tolist()], bins)
                    c, d = at[: len(some)], at[len(some) :]
                    common = np.minimum(counts[c], counts[d]).sum(1, dtype=np.int64)
                    may = full[c] | full[d] | ((100 + percent) * common >= percent * (n[x[some]] + n[y[some]]))
                    ok[pair[some[may]]] = True
            lo = hi
        made = _packed(pairs[ok, 0], pairs[ok, 1], blocks_)
        return pd.DataFrame(made, columns=["bx", "by", "pairs"])

    return compare


def verified(percent: int):
    """Links (a, b) between members whose sets are similar, one for each two components."""

    def compare(pairs: np.ndarray, right: pd.DataFrame) -> pd.DataFrame:
        members = _members(right)
        clusters = Cluster(right["label"].to_numpy())
        unit, n = right["unit"].to_numpy(), right["n"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in right["shingles"]]
        out = []
        for a, b in pairs.tolist():
            for x in members[a]:
                for y in members[b]:
                    if x == y or clusters.root(x) == clusters.root(y) or 100 * min(n[x], n[y]) < percent * max(n[x], n[y]):
                        continue
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * common >= percent * (n[x] + n[y] - common):
                        clusters.join(x, y)
                        out.append((int(unit[x]), int(unit[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compare


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each doc_id of ``ids``; of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, bool)
        for batch in batches:
            bits[_bit(batch.column("doc_id").to_numpy(zero_copy_only=False))] = True
        packed = np.packbits(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(packed, SLICES)], pa.binary())], names=["slice", "data"]
        )

    packed = _sum_slices(ids.mapInArrow(released(run), "slice int, data binary"), "u1", np.bitwise_or)
    return packed if len(packed) else np.zeros(FILTER // 8, np.uint8)


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) >> np.uint64(8)).astype(np.int64) % FILTER


def similar(spark: SparkSession, docs: DataFrame, scratch: Scratch, percent: int = 85, words: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    A text of fewer than ``words`` words is one shingle; without words, or
    null, it is empty and linked with nothing.  Rows without an id are linked
    with nothing and have no component.  Rows that share an id are one node:
    what either is linked to is in the component of both.
    """
    texts = id_text(docs)
    classes = frequency_classes(texts, words)
    profile = scratch.keep(profiles(texts, classes, percent, words), "profiles")
    known = profile.where("n > 0 AND doc_id IS NOT NULL")
    equal = scratch.keep(known.groupBy("f1", "f2", "n", "g1", "g2").agg(F.min("doc_id").alias("unit")), "units")
    held = equal.groupBy("g1", "g2", "n").agg(F.count("*").alias("k"))
    big = held.where(F.col("k") > GROUP)
    part = F.coalesce(F.pmod(F.xxhash64("f1"), F.ceil(F.col("k") / GROUP).cast("long")), F.lit(0))
    grouped = equal.join(big, ["g1", "g2", "n"], "left").select("unit", "n", "g1", "g2", part.alias("part"))
    grouped = scratch.keep(grouped, "grouped")
    # a unit's id may stand for several sets where rows share ids
    groups = grouped.groupBy("g1", "g2", "n", "part").agg(F.min("unit").alias("leader"), F.count("*").alias("units"))
    groups = scratch.keep(groups, "groups")
    units = scratch.keep(grouped.join(groups, ["g1", "g2", "n", "part"]).select("unit", "n", "g1", "g2", "leader", "units"), "members")
    entries = groups.agg(F.sum(F.lit(1) + F.col("n") * (100 - percent) / 100)).first()[0] or 0
    shards = max(1, int(entries // SHARD))
    # one prefix for each group: its leader's
    leaders = groups.select("leader", "n", "g1", "g2").join(
        known.select(F.col("doc_id").alias("leader"), "n", "g1", "g2", "prefix").dropDuplicates(["leader", "n", "g1", "g2"]), ["leader", "n", "g1", "g2"]
    )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("prefix").to_pylist()
            size = np.array([len(x) // 8 for x in raw])
            token = np.frombuffer(b"".join(raw), "<u8")
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            leader = np.repeat(batch.column("leader").to_numpy(zero_copy_only=False), size)
            n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), size)
            shard = (mix64(token) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            rows = []
            for p in np.split(order, cuts) if len(order) else ():
                payload = token[p].tobytes() + leader[p].astype("<i8").tobytes() + n[p].astype("<i4").tobytes() + pos[p].astype("<i4").tobytes()
                rows.append((int(shard[p[0]]), len(p), payload))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["shard", "k", "payload"]
            )

    def repeated(frame: pd.DataFrame) -> pd.DataFrame:
        """The lists of a shard that hold two groups or more."""
        release()
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for k, raw in zip(frame["k"], frame["payload"], strict=True):
            for c, (kind, at) in enumerate((("<u8", 0), ("<i8", 8 * k), ("<i4", 16 * k), ("<i4", 20 * k))):
                cols[c].append(np.frombuffer(raw, kind, k, at))
        token, leader, n, pos = (np.concatenate(c) for c in cols)
        _, at, count = np.unique(token, return_inverse=True, return_counts=True)
        many = count[at] > 1
        return pd.DataFrame({
            "shard": int(frame["shard"].iloc[0]), "token": token[many].astype(np.int64), "leader": leader[many], "n": n[many], "pos": pos[many],
            "length": count[at][many],
        })

    lists = leaders.select("leader", "n", "prefix").mapInArrow(released(listed), "shard long, k int, payload binary")
    lists = lists.groupBy("shard").applyInPandas(repeated, "shard long, token long, leader long, n int, pos int, length int")
    lists = scratch.keep(lists, "lists")
    candidates = lists.select("leader").unionByName(groups.where("units > 1").select("leader")).distinct()
    chosen = scratch.keep(units.join(candidates, "leader", "left_semi").select("leader", "unit", "n", "g1", "g2"), "candidates")
    sketches = known.select(F.col("doc_id").alias("unit"), "n", "g1", "g2", "histogram").dropDuplicates(["unit", "n", "g1", "g2"])
    full = scratch.keep(chosen.join(sketches, ["unit", "n", "g1", "g2"]).select("leader", "unit", "n", "histogram"), "sketches")
    one_each = equal.select("unit", "n", "f1")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, full = counts_in(batch.column("histogram").to_pylist(), SHORT)
            bins = np.where(full[:, None], 255, np.minimum(bins, 255)).astype("u1")
            yield pa.RecordBatch.from_arrays([batch.column("leader"), pa.array([x.tobytes() for x in bins], pa.binary())], names=["leader", "short"])

    # for groups of one unit; the others are looked at by their members
    lone = full.join(groups.where("units = 1").select("leader", "n").distinct(), ["leader", "n"]).where("unit = leader")
    lone = lone.groupBy("leader").agg(F.max("histogram").alias("histogram"), F.count("*").alias("k")).where("k = 1")
    short = scratch.keep(lone.select("leader", "histogram").mapInArrow(folded, "leader long, short binary"), "short")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(leader, unit, n, label, shingles) of the units of ``wanted``: their texts are read again."""
        bits = spark.sparkContext.broadcast(_filter_bits(wanted.select(F.col("unit").alias("doc_id"))))  # 2 MB

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = np.unpackbits(bits.value).astype(bool)

            def passing() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    ids = batch.column("doc_id")
                    hit = some[_bit(ids.fill_null(0).to_numpy(zero_copy_only=False))] & ids.is_valid().to_numpy(zero_copy_only=False)
                    if hit.any():
                        yield batch.filter(pa.array(hit))

            for block, cut, h in read(passing(), words):
                raw = h.astype("<u8").tobytes()
                one = _sums(mix64(h + np.uint64(0x632BE59BD9B4E019)), cut).view(np.int64)
                pieces = [raw[8 * a : 8 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids), pa.array(np.diff(cut), pa.int64()), pa.array(one), pa.array(pieces, pa.binary())],
                    names=["unit", "n", "f1", "shingles"],
                )

        found = texts.mapInArrow(released(sets), "unit long, n long, f1 long, shingles binary")
        keyed = wanted.join(one_each, ["unit", "n"])
        return found.join(keyed, ["unit", "n", "f1"]).dropDuplicates(["unit", "n", "f1", "leader"]).select("leader", "unit", "n", "label", "shingles")

    some = full.count()
    blocks_ = max(1, round((some / BLOCK_UNITS) ** 0.5))
    labels: DataFrame | None = None
    links: DataFrame | None = None
    compared: list[DataFrame] = []
    # centers of each round, and the longest list that the rounds before have covered
    for number, (centers, covered) in enumerate(((1, 1), (8, 2), (0, 8))):
        labelled = full.withColumn("label", F.col("unit"))
        open_lists = lists.where(F.col("length") > covered)
        listed_as = open_lists.withColumn("label", F.lit(-1).cast("long") if labels is None else F.lit(0))
        if labels is not None:
            labelled = full.join(labels, F.col("unit") == F.col("node"), "left").withColumn("label", F.coalesce("component", "unit")).drop("node", "component")
            # a group has a label where all its units have the same
            own = labelled.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
            own = own.select("leader", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("label"))
            listed_as = open_lists.join(own, "leader")

        entries_ = ["shard", "token", "leader", "n", "pos", "label", "short"]
        listed_as = listed_as.join(short, "leader", "left").select(*entries_, "length")
        if centers:
            pairs = listed_as.select(*entries_).groupBy("shard")
        else:
            pairs = in_pieces(listed_as).drop("length").groupBy("shard", "hot", "low", "high")
        pairs = pairs.applyInPandas(paired(centers, percent, blocks_), PAIRS)
        if number == 0:  # and each group with itself

            def own_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    a = batch.column("leader").to_numpy(zero_copy_only=False)
                    rows = _packed(a, a, blocks_)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["bx", "by", "pairs"]
                    )

            pairs = pairs.unionByName(groups.where("units > 1").select("leader").mapInArrow(own_pairs, PAIRS))
        pairs = scratch.keep(unique(pairs, compared), f"pairs{number}")
        pairs = scratch.keep(meet(pairs, labelled, bounded(percent, blocks_), PAIRS), f"bounded{number}")
        compared.append(pairs)
        left = scratch.keep(labelled.join(leaders_of(pairs), "leader", "left_semi").select("leader", "unit", "n", "label"), f"left{number}")
        found = meet(pairs, scratch.keep(sets_of(left), f"sets{number}"), verified(percent), "a long, b long")
        found = scratch.keep(found, f"links{number}")
        links = found if links is None else links.unionByName(found)
        labels = components(scratch, links)
    scratch.drop(full, lists)
    # every row's unit, then the unit's component; rows that share an id are joined by it
    nodes = known.select("doc_id", "f1", "f2", "n", "g1", "g2").join(equal, ["f1", "f2", "n", "g1", "g2"]).select("doc_id", "unit")
    nodes = nodes.join(labels, F.col("unit") == F.col("node"), "left").select("doc_id", F.coalesce("component", "unit").alias("component"))
    nodes = scratch.keep(nodes, "nodes")
    shared = nodes.groupBy("doc_id").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    moved = components(scratch, shared.where("lo < hi").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    nodes = shared.join(moved, F.col("lo") == F.col("node"), "left").select("doc_id", F.coalesce("component", "lo").alias("component_id"))
    out = profile.select("doc_id", F.col("n").alias("n_shingles")).join(nodes, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "ngrams"))


#: DuckDB SQL of the same rows: all pairs of documents that share a shingle.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
half AS (
  SELECT a, b FROM common JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)
), link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(c, t.doc_id))::BIGINT AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON t.doc_id = a
"""


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without those whose component has a smaller id; of rows that share an id, all or none stay.

    Near-duplicates are at 0.8 or more on shingles of five words.
    """
    found = similar(spark, docs.select("doc_id", "text"), Scratch(spark, "ngramdocs"), 80, 5)
    (name,) = unused(docs, "gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
