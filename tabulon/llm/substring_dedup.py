"""Operator 5: removal of repeated 100-byte strings, over a suffix structure.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier:
in a document with a smaller id, or earlier in its own.

Every window of ``SPAN`` bytes has an anchor, the ``GRAM``-gram in it with the
smallest hash (the leftmost of equals); so equal windows have equal anchors at
the same place, and can be brought together by the anchor alone.  Windows
that share one occurrence of an anchor form a segment of less than twice
``SPAN`` bytes.  Three things follow, each over blocks of documents that send
packed arrays to shards and get one byte for each segment back:

1. Segments whose anchor occurs nowhere else are done.  Where all segments of
   an anchor are the same string, all but its earliest go.
2. The distinct segments of the other anchors meet in shards.  A shard builds
   the suffix array and Burrows-Wheeler transform of its segments and expands
   suffix intervals breadth-first by backward extension: the intervals of
   strings of length l give those of length l + 1 and with them all common
   prefixes of length l.  It stops at ``SPAN``: suffixes between which no
   boundary was found by then share a window.  The earliest of each such run
   stays.
3. The blocks remove what the windows cover.

An anchor with very many distinct segments would make one shard large.  Its
windows are sent one by one instead, dealt by their own hash, to the same
expansion, which compares them.  Where a hash brought segments together as
equal in a shard, their bytes are compared too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, blocks, id_text, mix64, release, released, table

SPAN, GRAM = 100, 24
#: Windows that are scanned at once.
CHUNK = 1 << 18
#: Bytes of text in a block, and of text for each shard, about.
BLOCK, SHARD = 4 << 20, 8 << 20
#: Distinct segments of an anchor, in all and in one block, from which its windows are dealt one by one.
HOT, HOT_BLOCK = 20_000, 256
#: Bytes whose suffixes are sorted together.
BATCH = 1 << 20

#: What a shard says of a segment.
ONCE, AGAIN, FIRST, ASK, WINDOWS = range(5)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        p = np.ones(n, np.uint64)
        p[1:] = b
        out.append(np.cumprod(p))
    return out[0], out[1]


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_UP, _DOWN = _powers(CHUNK + 2 * SPAN + GRAM)


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of some documents: first and last window, hash of the anchor, hash of the bytes."""
    width = SPAN - GRAM + 1
    low = np.uint64((1 << 20) - 1)
    out: list[tuple[np.ndarray, ...]] = []
    last = offsets[1:] - SPAN  # the last window of each document
    for c0 in range(0, max(len(data) - SPAN + 1, 0), CHUNK):
        part = data[c0 : c0 + CHUNK + SPAN - 1]
        n = len(part) - SPAN + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _DOWN[: len(part)], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * _UP[: len(part) - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        key = np.minimum(key[: n], key[width - have : width - have + n])
        anchor = (key & low).astype(np.int64)
        # windows within one document
        d0, d1 = np.searchsorted(offsets, [c0, c0 + n], side="right")
        inside, fresh = np.zeros(n + 1, np.int32), np.zeros(n, bool)
        for d in range(d0 - 1, min(d1, len(offsets) - 1)):
            a, b = max(int(offsets[d]) - c0, 0), min(int(last[d]) - c0, n - 1)
            if a <= b:
                inside[a] += 1
                inside[b + 1] -= 1
                fresh[a] = True
        ok = np.cumsum(inside[:-1]) > 0
        fresh[1:] |= anchor[1:] != anchor[:-1]
        start = np.flatnonzero(ok & fresh)
        if not len(start):
            continue
        stop = np.append(start[1:], n)
        ends = np.cumsum(ok)  # windows that count, so that a segment ends at its last one
        stop = start + (ends[stop - 1] - ends[start])
        # grams at fixed steps and at the end cover all bytes of a segment
        size = stop - start + SPAN
        seg = size.astype(np.uint64)
        for k in range(0, 2 * SPAN - GRAM, GRAM):
            seg = seg * np.uint64(0xFF51AFD7ED558CCD) + h[start + np.minimum(k, size - GRAM)]
            seg ^= seg >> np.uint64(32)
        out.append((start + c0, stop + c0, h[anchor[start]], seg))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def distinct(keys: np.ndarray, segs: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups equal (key, seg): the earliest member of each by (id, place), and each member's group."""
    order = np.lexsort((at, ids, segs, keys))
    k, s = keys[order], segs[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(raw: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    data, at, out = zlib.decompress(raw), 0, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(data, kind, n, at))
        at += size
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


class Units:
    """A block's segments after the first answers: what each occurrence becomes."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets
        self.start, self.stop, self.anchor, self.seg = scan(data, offsets)
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        place = self.start - offsets[self.doc]
        self.first, self.group = distinct(self.anchor, self.seg, ids[self.doc], place)


def first_messages(block: int, units: Units, shards: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(shard, block, payload, entries): a block's distinct segments, by shard and then by hash."""
    first = units.first
    keys, segs, ids = units.anchor[first], units.seg[first], units.ids[units.doc[first]]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(new) - 1
    crowd = np.bincount(run)[run] > HOT_BLOCK if len(run) else np.zeros(0, bool)
    shard = shard_of(keys, shards)
    # of a crowded anchor one entry tells; the others know it by their anchor
    tell = ~crowd | new
    order = np.flatnonzero(tell)
    order = order[np.argsort(shard[order], kind="stable")]
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        k = keys[part] >> np.uint64(16)
        payload = pack(
            (k & np.uint64(0xFFFFFFFF)).astype("<u4"), (k >> np.uint64(32)).astype("<u2"), segs[part], ids[part].astype("<i8"), crowd[part].astype("u1")
        )
        yield int(shard[part[0]]), block, payload, len(part)


def first_answers(frame: pd.DataFrame) -> list[bytes]:
    """For each message of a shard, what its segments are."""
    parts = [unpack(r, n, "<u4", "<u2", "<u8", "<i8", "u1") for r, n in zip(frame["payload"], frame["n"], strict=True)]
    lo, hi, seg, ids, crowd = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = lo.astype(np.uint64) | (hi.astype(np.uint64) << np.uint64(32))
    order = np.lexsort((ids, seg, key))
    key, seg, ids, crowd = key[order], seg[order], ids[order], crowd[order]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_seg = new_key.copy()
    new_seg[1:] |= seg[1:] != seg[:-1]
    run, sub = np.cumsum(new_key) - 1, np.cumsum(new_seg) - 1
    entries = np.bincount(run)[run]
    kinds = np.bincount(run, weights=new_seg)[run]
    hot = (np.bincount(run, weights=crowd)[run] > 0) | (kinds > HOT)
    least = ids[np.flatnonzero(new_seg)][sub]
    said = np.where(entries == 1, ONCE, np.where(kinds > 1, ASK, np.where(ids == least, FIRST, AGAIN)))
    said = np.where(hot, WINDOWS, said).astype(np.uint8)
    back = np.empty(len(said), np.uint8)
    back[order] = said
    return [zlib.compress(x.tobytes(), 1) for x in np.split(back, np.cumsum(frame["n"].to_numpy())[:-1])]


def told(units: Units, answers: list[tuple[int, bytes]], shards: int) -> np.ndarray:
    """The answer for each of a block's distinct segments."""
    first = units.first
    keys = units.anchor[first]
    shard = shard_of(keys, shards)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(new) - 1
    crowd = np.bincount(run)[run] > HOT_BLOCK if len(run) else np.zeros(0, bool)
    tell = ~crowd | new
    out = np.full(len(keys), ONCE, np.uint8)
    for k, raw in answers:
        out[np.flatnonzero(tell & (shard == k))] = np.frombuffer(zlib.decompress(raw), np.uint8)
    out[crowd] = WINDOWS
    return out


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some stretches, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(start - (ends - size), size) + np.arange(total)]


def suffixes(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in the order of at least their first ``SPAN`` symbols."""
    n = len(text)
    padded = np.zeros(n + 2 * SPAN, np.uint64)
    padded[:n] = text
    # 7 symbols of 9 bits to begin with
    rank = np.zeros(n, np.uint64)
    for k in range(7):
        rank = (rank << np.uint64(9)) | padded[k : k + n]
    width = 7
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        dense = np.empty(n, np.uint64)
        dense[order] = np.cumsum(new)
        if width >= SPAN or new.all():
            return order
        tail = np.zeros(n, np.uint64)
        if n > width:
            tail[: n - width] = dense[width:]
        rank = (dense << np.uint64(32)) | tail
        width *= 2


def expand(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which suffixes begin a run whose members share ``SPAN`` symbols, after breadth-first expansion.

    ``text`` has the separator 0 and symbols from 1.  ``order`` sorts its
    suffixes.  A boundary is marked when the interval that ends at it is
    first reached, which is at the length of the common prefix there.
    """
    n = len(text)
    bwt = text[order - 1]  # of the first suffix, the last symbol: a separator
    by_symbol = np.argsort(bwt, kind="stable")  # position of each row's predecessor
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    nxt, prv = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    nxt[by_symbol[:-1][same]] = by_symbol[1:][same]
    prv[by_symbol[1:][same]] = by_symbol[:-1][same]
    counts = np.bincount(text, minlength=257)
    base = np.concatenate([[0], np.cumsum(counts)])
    symbols = np.flatnonzero(counts).tolist()
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for length in range(SPAN):
        if not len(lo):
            break
        size = hi - lo
        news: list[tuple[np.ndarray, np.ndarray]] = []
        big = size > (4 * len(symbols) if length else 0)
        if big.any():  # few and long: by symbol
            l2, h2 = lo[big], hi[big]
            for s in symbols:
                if s == 0 and length:
                    continue
                own = by_symbol[base[s] : base[s + 1]]
                a, b = np.searchsorted(own, l2), np.searchsorted(own, h2)
                some = b > a
                news.append((base[s] + a[some], base[s] + b[some]))
        one = ~big & (size == 1)
        if one.any():
            at = lo[one]
            at = at[bwt[at] != 0]
            news.append((lf[at], lf[at] + 1))
        few = ~big & (size > 1)
        if few.any():  # short ones: by row; a symbol's first and last row in an interval
            l2, s2 = lo[few], size[few]
            ends = np.cumsum(s2)
            rows = np.repeat(l2 - (ends - s2), s2) + np.arange(int(ends[-1]))
            which = np.repeat(np.arange(len(l2)), s2)
            real = bwt[rows] != 0
            tail = real & (nxt[rows] >= np.repeat(l2 + s2, s2))
            head = real & (prv[rows] < np.repeat(l2, s2))
            heads = rows[head]
            tails = rows[tail]
            if len(heads):
                # in the order of (interval, symbol) the two agree
                a = heads[np.argsort(which[head] * 512 + bwt[heads], kind="stable")]
                b = tails[np.argsort(which[tail] * 512 + bwt[tails], kind="stable")]
                news.append((lf[a], lf[b] + 1))
        if not news:
            break
        lo, hi = (np.concatenate(x) for x in zip(*news, strict=True))
        fresh = ~found[hi]
        lo, hi = lo[fresh], hi[fresh]
        found[hi] = True
    return found[:n]


def shared_windows(segs: list[np.ndarray], sizes: np.ndarray, ids: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (segment, first, last window) of windows that also start earlier, among distinct segments.

    ``place`` is where a segment's earliest occurrence starts in its document.
    """
    n = len(sizes)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    text[at] = np.concatenate(segs).astype(np.uint16) + 1
    order = suffixes(text)
    runs = np.cumsum(expand(text, order)) - 1
    # windows that begin at each suffix
    owner = np.repeat(np.arange(n), sizes + 1)[order]
    offset = order - begin[owner]
    windows = offset + SPAN <= sizes[owner]
    owner, offset, runs = owner[windows], offset[windows], runs[windows]
    many = np.bincount(runs)[runs] > 1
    owner, offset, runs = owner[many], offset[many], runs[many]
    if not len(runs):
        return []
    by = np.lexsort((place[owner] + offset, ids[owner], runs))
    later = np.ones(len(by), bool)
    later[0] = False
    later[1:] = runs[by][1:] == runs[by][:-1]
    owner, offset = owner[by][later], offset[by][later]
    by = np.lexsort((offset, owner))
    owner, offset = owner[by], offset[by]
    cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(offset) != 1)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(owner)]]) - 1
    return list(zip(owner[a].tolist(), offset[a].tolist(), offset[b].tolist(), strict=True)) if len(owner) else []


def unlike(data: np.ndarray, begin: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which stretches differ from the ones ``of`` in their bytes."""
    out = size != size[of]
    check = np.flatnonzero(~out & (of != np.arange(len(of))))
    step = 1 + (1 << 24) // (2 * SPAN)
    for lo in range(0, len(check), step):
        u = check[lo : lo + step]
        differs = gather(data, begin[u], size[u]) != gather(data, begin[of[u]], size[u])
        out[u] = np.add.reduceat(differs, np.cumsum(size[u]) - size[u]) > 0
    return out


def second_answers(frame: pd.DataFrame) -> list[tuple[bytes, bytes, int]]:
    """For each message: which units are not the earliest of their string, and runs in those that are."""
    counts = frame["n"].to_numpy()
    key, seg, ids, place, size, alone, data = [], [], [], [], [], [], []
    for raw, n in zip(frame["payload"], counts, strict=True):
        k, s, i, p, z, w = unpack(raw, n, "<u8", "<u8", "<i8", "<i8", "<i4", "u1")
        key.append(k), seg.append(s), ids.append(i), place.append(p), size.append(z), alone.append(w)
        data.append(np.frombuffer(zlib.decompress(raw), np.uint8)[37 * n :])
    key, seg, ids, place, size, alone = (np.concatenate(x) for x in (key, seg, ids, place, size, alone))
    data = np.concatenate(data)
    begin = np.cumsum(size.astype(np.int64)) - size
    # segments of one hash are one if their bytes are; a window by itself is compared by the expansion alone
    alone = alone > 0
    seg = np.where(alone, np.arange(len(seg), dtype=np.uint64), seg)
    first, group = distinct(key, seg, ids, place)
    other = unlike(data, begin, size.astype(np.int64), first[group])
    if other.any():
        seg = seg.copy()
        for u in np.flatnonzero(other).tolist():
            raw = data[begin[u] : begin[u] + size[u]].tobytes()
            seg[u] ^= np.frombuffer(hashlib.sha256(raw).digest()[:8], "<u8")[0] | np.uint64(1)
        first, group = distinct(key, seg, ids, place)
    # an entry is the earliest if it has the id of the earliest
    earliest = (ids == ids[first][group]) & (place == place[first][group])
    # batches of whole keys
    k = key[first]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    many = (np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1) if len(k) else new
    runs: dict[int, list[tuple[int, int]]] = {}
    todo = first[many]
    starts = np.flatnonzero(new[many])
    upto = np.concatenate([[0], np.cumsum(size[todo] + 1)])
    lo = 0
    while lo < len(todo):
        hi = int(np.searchsorted(upto, upto[lo] + BATCH, side="right")) - 1
        whole = np.searchsorted(starts, max(hi, lo + 1), side="left")
        hi = int(starts[whole]) if whole < len(starts) else len(todo)
        part = todo[lo:hi]
        bytes_of = [data[begin[u] : begin[u] + size[u]] for u in part.tolist()]
        for owner, a, b in shared_windows(bytes_of, size[part].astype(np.int64), ids[part], place[part]):
            runs.setdefault(int(part[owner]), []).append((a, b))
        lo = hi
    out, base = [], 0
    for n in counts.tolist():
        rows = [(u, a, b) for u in range(n) for a, b in runs.get(base + u, ()) if earliest[base + u]]
        out.append((zlib.compress((~earliest[base : base + n]).astype("u1").tobytes(), 1), np.array(rows, "<i4").tobytes(), n))
        base += n
    return out


def digest(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, str]:
    """(removed, spans, sha256 of the rest) of a document, from the windows that go: first and last of each run."""
    if not len(lo):
        return 0, 0, hashlib.sha256(data).hexdigest()
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by] + SPAN)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    a, b = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]
    rest, at = hashlib.sha256(), 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rest.update(data[at:x])
        at = y
    rest.update(data[at:])
    return int((b - a).sum()), len(a), rest.hexdigest()


def kept_bytes(data: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    gone = np.zeros(len(data) + 1, np.int64)
    np.add.at(gone, lo, 1)
    np.add.at(gone, hi + SPAN, -1)
    return np.frombuffer(data, np.uint8)[np.cumsum(gone[:-1]) == 0].tobytes()


ANSWERS = "array<struct<shard:int,answer:binary,runs:binary>>"


def pack_block(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> bytes:
    import zstandard

    raw = np.array([len(ids)], "<i8").tobytes() + ids.astype("<i8").tobytes() + offsets.astype("<i8").tobytes() + data.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, offsets = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n + 1, 8 + 8 * n)
    return ids, np.frombuffer(raw, np.uint8, offset=16 + 16 * n), offsets


def window_hashes(windows: np.ndarray) -> np.ndarray:
    weights = mix64(np.arange(1, SPAN + 1, dtype=np.uint64)) | np.uint64(1)
    return mix64((_BYTE[windows] * weights).sum(1, dtype=np.uint64))


def resolve(units: Units, said: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]:
    """What the first answers decide: (document, first, last window) that go, and the units that ask on."""
    answer = said[units.group]
    earliest = np.zeros(len(units.start), bool)
    earliest[units.first] = True
    goes = (answer == AGAIN) | ((answer != WINDOWS) & ~earliest)
    place = units.start - units.offsets[units.doc]
    last = units.stop - units.offsets[units.doc]
    asks = (answer == ASK) & earliest
    ask = {
        "key": units.anchor[asks] >> np.uint64(16), "seg": units.seg[asks], "doc": units.doc[asks], "place": place[asks],
        "size": (units.stop - units.start)[asks] + SPAN, "alone": np.zeros(int(asks.sum()), np.uint8),
    }
    out = [units.doc[goes], place[goes], last[goes]]
    crowded = np.flatnonzero(answer == WINDOWS)
    if len(crowded):
        count = (units.stop - units.start)[crowded] + 1
        ends = np.cumsum(count)
        start = np.repeat(units.start[crowded] - (ends - count), count) + np.arange(int(ends[-1]))
        doc = np.repeat(units.doc[crowded], count)
        at = start - units.offsets[doc]
        h = np.concatenate([window_hashes(units.data[start[k : k + 50_000, None] + np.arange(SPAN)]) for k in range(0, len(start), 50_000)])
        first, group = distinct(h, h, units.ids[doc], at)
        again = np.ones(len(h), bool)
        again[first] = False
        # a window whose bytes are not those of the first of its hash asks for itself
        other = unlike(units.data, start, np.full(len(start), SPAN), first[group])
        again &= ~other
        first = np.concatenate([first, np.flatnonzero(other)])
        out = [np.concatenate([a, b]) for a, b in zip(out, (doc[again], at[again], at[again]), strict=True)]
        # all windows that may be equal have one key in a shard, but keys are few, so that a key's windows are expanded together
        more = {"key": h[first] >> np.uint64(16), "seg": h[first], "doc": doc[first], "place": at[first], "size": np.full(len(first), SPAN), "alone": np.ones(len(first), np.uint8)}
        ask = {k: np.concatenate([v, more[k]]) for k, v in ask.items()}
    return tuple(out), ask


def results(ids, data, offsets, gone, chosen, texts: bool) -> list[tuple]:
    """Result rows of the chosen documents of a block."""
    doc, lo, hi = gone
    order = np.argsort(doc, kind="stable")
    doc, lo, hi = doc[order], lo[order], hi[order]
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    out = []
    for d in chosen.tolist():
        own = data[offsets[d] : offsets[d + 1]]
        a, b = lo[cut[d] : cut[d + 1]], hi[cut[d] : cut[d + 1]]
        removed, spans, sha = digest(own, a, b)
        text = kept_bytes(own.tobytes(), a, b) if texts and removed else None
        doc_id = None if ids[d] == NULL_ID else int(ids[d])
        out.append((doc_id, len(own), removed, spans, sha, zlib.crc32(own) if texts else None, text))
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, crc long, kept binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "crc", "kept"]


def _result_arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)]


def _by_kind(df: DataFrame, scratch: Scratch, name: str, kinds: tuple[str, ...]) -> list[DataFrame]:
    """Writes ``df`` once, its rows apart by ``kind``, and reads each kind."""
    path = scratch.path(name)
    df.write.option("compression", "none").partitionBy("kind").parquet(path)
    schema = df.drop("kind").schema
    out = []
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for kind in kinds:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        where.getFileSystem(conf).mkdirs(where)
        one = df.sparkSession.read.schema(schema).parquet(f"{path}/kind={kind}")
        one._scratch_path = f"{path}/kind={kind}"
        out.append(one)
    return out


def _answers(df: DataFrame) -> DataFrame:
    """All answers to a block, together: at most one from each shard."""
    return df.groupBy("block").agg(F.collect_list(F.struct("shard", "answer", "runs")).alias("answers"))


def remove_repeats(spark: SparkSession, docs: DataFrame, scratch: Scratch, texts: bool = False) -> DataFrame:
    """What is removed from each document of (doc_id, text): a row of ``RESULT`` for each.

    With ``texts``, ``kept`` holds the remaining bytes where any were removed.
    A null text is empty; documents under ``SPAN`` bytes lose nothing.  A
    document without an id comes after all others.  Rows that share an id, or
    have none, come in the order of their texts' hashes; equal rows are
    alike, so the result does not depend on how the table is divided.  Very
    long texts are scanned in chunks; other columns have no influence; an empty
    table gives no rows.
    """
    rows = id_text(docs)
    if not _repeated_ids(rows):
        return _removed(spark, rows, scratch, texts)
    keyed = _keyed(rows, scratch)
    found = _removed(spark, keyed.select(F.col("key").alias("doc_id"), "text"), scratch, texts).withColumnRenamed("doc_id", "key")
    return found.join(keyed.select("key", "doc_id"), "key").select(*_NAMES)


def _repeated_ids(rows: DataFrame) -> bool:
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID)))
    return bool(rows.groupBy(ident.alias("id")).count().where("count > 1").limit(1).count())


def _keyed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``key``, different for each, in the order of the ids and then of the texts' hashes."""
    rows = scratch.keep(rows.withColumn("row_at", F.monotonically_increasing_id()), "rows")
    order = rows.select("row_at", F.col("doc_id").cast("long").alias("id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("sha"))
    order = order.orderBy(F.col("id").asc_nulls_last(), "sha", "row_at").select("row_at", F.monotonically_increasing_id().alias("key"))
    return scratch.keep(rows.join(scratch.keep(order, "order"), "row_at").drop("row_at"), "keyed")


def _removed(spark: SparkSession, docs: DataFrame, scratch: Scratch, texts: bool) -> DataFrame:
    """``remove_repeats`` for ids that are different."""
    texts_of = id_text(docs)
    total = texts_of.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches, BLOCK)):
            number = (part << 32) | k
            units = Units(block.ids, block.data, block.offsets)
            rows = [("text", number, -1, len(block), pack_block(block.ids, block.data, block.offsets))]
            rows += [("ask", number, s, n, payload) for s, _, payload, n in first_messages(number, units, shards)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                names=["kind", "block", "shard", "n", "payload"],
            )

    read_in = texts_of.mapInArrow(released(read), "kind string, block long, shard int, n int, payload binary")
    text, ask = _by_kind(read_in, scratch, "blocks", ("text", "ask"))

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "answer": first_answers(frame), "runs": None})

    said = ask.groupBy("shard").applyInPandas(first, "block long, shard int, answer binary, runs binary")
    said = scratch.keep(said, "said")
    scratch.drop(ask)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column("block")[row].as_py()
                units = Units(*unpack_block(batch.column("payload")[row].as_py()))
                told_of = [(a["shard"], a["answer"]) for a in batch.column("answers")[row].as_py() or ()]
                gone, asks = resolve(units, told(units, told_of, shards))
                ids, data, offsets = units.ids, units.data, units.offsets
                open_docs = np.unique(asks["doc"])
                sure = np.setdiff1d(np.arange(len(ids)), open_docs, assume_unique=True)
                done = results(ids, data, offsets, gone, sure, texts)
                out = [("done", number, -1, 0, None, *r) for r in done]
                if len(open_docs):
                    nobody = (None,) * len(_NAMES)
                    shard = shard_of(asks["key"] << np.uint64(16), shards)
                    for s in np.unique(shard).tolist():
                        at = np.flatnonzero(shard == s)
                        size = asks["size"][at]
                        payload = pack(
                            asks["key"][at], asks["seg"][at], ids[asks["doc"][at]].astype("<i8"), asks["place"][at].astype("<i8"), size.astype("<i4"), asks["alone"][at],
                            gather(data, offsets[asks["doc"][at]] + asks["place"][at], size),
                        )
                        out.append(("ask", number, s, len(at), payload, *nobody))
                    size = np.diff(offsets)[open_docs]
                    own = pack_block(ids[open_docs], gather(data, offsets[open_docs], size), np.concatenate([[0], np.cumsum(size)]))
                    keep = np.isin(gone[0], open_docs)
                    fixed = [np.searchsorted(open_docs, gone[0][keep]), gone[1][keep], gone[2][keep]]
                    state = [np.searchsorted(open_docs, asks["doc"]), asks["place"], asks["size"], shard]
                    rest = pack(*(x.astype("<i8") for x in (*fixed, *state)))
                    both = np.array([int(keep.sum()), len(shard), len(own)], "<i8").tobytes() + own + rest
                    out.append(("carry", number, -1, len(shard), both, *nobody))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))),
                        *_result_arrays([r[5:] for r in out]),
                    ],
                    names=["kind", "block", "shard", "n", "payload", *_NAMES],
                )

    met = text.select("block", "payload").join(_answers(said), "block", "left").select("block", "payload", "answers")
    met = met.mapInArrow(released(second), f"kind string, block long, shard int, n int, payload binary, {RESULT}")
    done, ask, carry = _by_kind(met, scratch, "resolved", ("done", "ask", "carry"))
    scratch.drop(text, said)

    def expanded(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        got = second_answers(frame)
        return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "answer": [g[0] for g in got], "runs": [g[1] for g in got]})

    said = ask.select("block", "shard", "n", "payload").groupBy("shard").applyInPandas(expanded, "block long, shard int, answer binary, runs binary")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column("payload")[row].as_py()
                fixed, n, size = np.frombuffer(raw, "<i8", 3).tolist()
                ids, data, offsets = unpack_block(raw[24 : 24 + size])
                both = np.frombuffer(zlib.decompress(raw[24 + size :]), "<i8")
                doc, lo, hi = both[: 3 * fixed].reshape(3, -1)
                own, place, length, shard = both[3 * fixed :].reshape(4, -1)
                docs_of, los, his = [doc], [lo], [hi]
                for a in batch.column("answers")[row].as_py() or ():
                    at = np.flatnonzero(shard == a["shard"])
                    later = at[np.frombuffer(zlib.decompress(a["answer"]), "u1") > 0]
                    runs = np.frombuffer(a["runs"], "<i4").reshape(-1, 3).astype(np.int64)
                    part = at[runs[:, 0]]
                    docs_of += [own[later], own[part]]
                    los += [place[later], place[part] + runs[:, 1]]
                    his += [place[later] + length[later] - SPAN, place[part] + runs[:, 2]]
                gone = tuple(np.concatenate(x) for x in (docs_of, los, his))
                yield pa.RecordBatch.from_arrays(_result_arrays(results(ids, data, offsets, gone, np.arange(len(ids)), texts)), names=_NAMES)

    late = carry.select("block", "payload").join(_answers(scratch.keep(said, "expanded")), "block", "left").select("block", "payload", "answers")
    late = scratch.keep(late.mapInArrow(released(last), RESULT), "late")
    scratch.drop(ask, carry)
    return done.select(*_NAMES).unionByName(late)


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(spark, docs, Scratch(spark, "spans")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: DuckDB SQL of the same rows: every string of 100 bytes, in the order in which they start.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s
  FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 99, 0))) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), begun AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS b FROM later
), run AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM begun),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 100 AS z FROM run GROUP BY doc_id, r),
kept AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(z), 0), any_value(length(h)) // 2 FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id
), rest AS (
  SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS t FROM kept JOIN d USING (doc_id) GROUP BY doc_id
), n AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(t)) AS kept_sha256
FROM d JOIN rest USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings out of ``text``.

    A character that a removal has cut is left out; ``n_chars``, if there, is
    counted anew where the text changed.  Of rows that share an id, or have
    none, each counts for itself.  Other columns may have any name.
    """
    scratch = Scratch(spark, "spandocs")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    keyed = _keyed(rows, scratch) if _repeated_ids(rows) else rows.withColumn("key", F.col("doc_id"))
    ids = keyed.select(F.col("key").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _removed(spark, ids, scratch, texts=True).where("n_removed > 0")
    changed = found.select(F.col("doc_id").alias("id"), _decoded("kept").alias("kept"))
    joined = keyed.join(changed, F.col("key").eqNullSafe(F.col("id")), "left")
    out = []
    for c in docs.columns:
        own = F.col("row")[c] if c != "text" else F.coalesce("kept", F.col("text").cast("string")).cast(docs.schema["text"].dataType)
        if c == "n_chars":
            own = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(own).cast(docs.schema[c].dataType)
        out.append(own.alias(c))
    return joined.select(*out)


def _decoded(column: str):
    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    return decode(F.col(column))
