"""Operator 2: chroma fingerprints of audio columns, and their alignment.

A recording (a WAV file in a binary column) becomes frames of 12 pitch-class
energies.  An integral image over the frames gives each filter, a comparison of
two areas, in constant time; 16 filters, two bits each, make one packed
32-bit integer per frame position.  Two recordings are aligned by the most
frequent offset between equal integers and compared by the share of differing
bits at that offset.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Seconds of a frame and between frames.
FRAME, HOP = 0.256, 1 / 16
#: Frames that one integer looks at.
WIDTH = 8
#: Frequencies that count.
LOW, HIGH = 55.0, 3520.0
#: Between the four values of a filter; Gray codes keep neighbours one bit apart.
LEVELS = (-0.2, 0.0, 0.2)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: An alignment counts from this overlap on, up to this share of differing bits.
LEAST_OVERLAP, MOST_ERROR = 12, 0.15
#: The integer of frames in which no filter finds a difference, as in silence.  It says nothing of a recording.
SILENT = 0xFFFFFFFF


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the 16 filters, by rule: four kinds at four places."""
    return [(kind, (3 * place + kind) % 9, 3 + place % 2, WIDTH - 2 * (place % 2)) for kind in range(4) for place in range(4)]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of 12 pitch-class energies, each of unit length; silent frames are 0."""
    size, hop = max(int(rate * FRAME), 16), max(int(rate * HOP), 1)
    if len(samples) < size:
        return np.zeros((0, 12))
    frequency = np.fft.rfftfreq(size, 1 / rate)
    use = (frequency >= LOW) & (frequency <= min(HIGH, rate / 2))
    classes = np.round(12 * np.log2(frequency[use] / 440.0)).astype(int) % 12
    fold = np.zeros((use.sum(), 12))
    fold[np.arange(len(classes)), classes] = 1
    window = np.hanning(size)
    starts = np.arange(0, len(samples) - size + 1, hop)
    out = []
    for k in range(0, len(starts), 256):  # long recordings: some frames at a time
        rows = samples[starts[k : k + 256, None] + np.arange(size)] * window
        out.append(np.abs(np.fft.rfft(rows))[:, use] ** 2 @ fold)
    energy = np.concatenate(out)
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-6, energy / np.maximum(norm, 1e-300), 0)


def packed(frames: np.ndarray) -> np.ndarray:
    """The integers of some chroma frames."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return image[at + x1, y1] - image[at + x0, y1] - image[at + x1, y0] + image[at + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        if kind == 0:  # low against high pitch classes
            a, b = area(0, w, y, y + h // 2 + 1), area(0, w, y + h // 2, y + h)
        elif kind == 1:  # before against after
            a, b = area(0, w // 2, y, y + h), area(w // 2, w, y, y + h)
        elif kind == 2:  # the corners against each other
            m, k = w // 2, y + h // 2
            a, b = area(0, m, y, k) + area(m, w, k, y + h), area(0, m, k, y + h) + area(m, w, y, k)
        else:  # the middle against both sides
            a, b = area(w // 3, w - w // 3, y, y + h), area(0, w // 3, y, y + h) + area(w - w // 3, w, y, y + h)
        level = np.digitize(np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0))), LEVELS)
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def fingerprint(wav: bytes | None) -> np.ndarray | None:
    """The integers of a WAV file; none for null, unreadable or too short audio."""
    if not wav:
        return None
    try:
        with wave.open(io.BytesIO(wav)) as f:
            raw, width, channels, rate = f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels(), f.getframerate()
    except (wave.Error, EOFError):
        return None
    if width not in (1, 2, 4) or not rate or not channels:
        return None
    x = np.frombuffer(raw[: len(raw) - len(raw) % (width * channels)], {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / (1 << (8 * width - 1))
    out = packed(chroma(x.reshape(-1, channels).mean(1), rate))
    return out if len(out) else None


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(offset, overlap, bit error): where ``b`` lies on ``a``, by the histogram of offsets of equal integers.

    Ties go to the larger overlap, then the smaller offset.  Silent places have
    no vote and count neither as overlap nor as error in what is returned.
    """
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = np.where(a == SILENT, 0, hi - lo)
    if not n.sum():
        return None
    ends = np.cumsum(n)
    places = order[np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]))]
    offsets, votes = np.unique(np.repeat(np.arange(len(a)), n) - places, return_counts=True)
    overlap = np.minimum(len(a), len(b) + offsets) - np.maximum(0, offsets)
    best = np.lexsort((offsets, -overlap, -votes))[0]
    offset, common = int(offsets[best]), int(overlap[best])
    x, y = a[max(0, offset) : max(0, offset) + common], b[max(0, -offset) : max(0, -offset) + common]
    heard = (x != SILENT) & (y != SILENT)
    common = int(heard.sum())
    return offset, common, float(np.bitwise_count(x[heard] ^ y[heard]).sum() / (32 * common))


def fingerprints(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, items): the integers of each row's audio as little-endian bytes; null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [fingerprint(x.as_py()) for x in part.column(column)]
                items = [None if x is None else x.astype("<u4").tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(items, pa.binary())], names=[key, "items"])

    return df.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"{key} long, items binary")


def matched(spark: SparkSession, prints: DataFrame, scratch: Scratch, every: int = 20) -> DataFrame:
    """Each recording of (rec_id, items) with its class and, for queries, its best match.

    Equal fingerprints are one class, named by its smallest id.  Queries are
    the ids divisible by ``every``, against all other classes that share an
    integer other than that of silence: without one there is no alignment, so
    no match is left out.  Recordings without a fingerprint have no class.  Rows
    that repeat an id are recordings of their own; ties go to the larger
    overlap, then the smaller id; a long recording is read in parts; an empty
    table gives no rows.
    """
    prints = scratch.keep(prints, "prints")
    classes = prints.where("items IS NOT NULL").groupBy("items").agg(F.min("rec_id").alias("class_id"), F.max(F.expr(f"rec_id % {every} = 0")).alias("asks"))
    classes = scratch.keep(classes, "classes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, asks = [], [], []
            for ident, raw, ask in zip(*(batch.column(c).to_pylist() for c in ("class_id", "items", "asks")), strict=True):
                x = np.frombuffer(raw, "<u4").astype(np.int64)
                own = np.unique(x[x != SILENT])
                ids.append(np.full(len(own), ident))
                keys.append(own)
                asks.append(np.full(len(own), ask))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, keys, asks)], names=["class_id", "k", "asks"])

    listed = scratch.keep(classes.mapInArrow(keyed, "class_id long, k long, asks boolean"), "keys")
    # keys that no query has, or one class alone, find nothing
    useful = listed.groupBy("k").agg(F.count("*").alias("n"), F.max("asks").alias("any")).where("n > 1 AND any").select("k")
    shared = listed.join(useful, "k")
    asked = shared.where("asks").select("k", F.col("class_id").alias("q"))
    pairs = asked.join(shared.select("k", F.col("class_id").alias("r")), "k").where("q <> r").select("q", "r").distinct()
    sides = [classes.select(F.col("class_id").alias(c), F.col("items").alias(f"items_{c}")) for c in ("q", "r")]

    @F.pandas_udf("struct<offset:int,overlap:int,bit_error:double>")
    def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [align(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) or (None, None, None) for x, y in zip(a, b, strict=True)]
        out = pd.DataFrame(rows, columns=["offset", "overlap", "bit_error"])
        return out.astype({"offset": "Int32", "overlap": "Int32", "bit_error": "float64"})

    met = pairs.join(sides[0], "q").join(sides[1], "r").select("q", "r", aligned("items_q", "items_r").alias("m"))
    good = met.where((F.col("m.overlap") >= LEAST_OVERLAP) & (F.col("m.bit_error") <= MOST_ERROR))
    best = good.groupBy("q").agg(F.min(F.struct("m.bit_error", -F.col("m.overlap"), "r", "m.offset", "m.overlap")).alias("b"), F.count("*").alias("n_matches"))
    best = best.select(F.col("q").alias("class_id"), F.col("b.r").alias("match_id"), "b.offset", "b.overlap", "b.bit_error", "n_matches")
    named = classes.select("items", "class_id").join(scratch.keep(best, "best"), "class_id", "left")
    out = prints.join(named, "items", "left").withColumn("asked", F.expr(f"coalesce(rec_id % {every} = 0, false)"))
    hide = lambda c: F.when(F.col("asked"), F.col(c)).alias(c)
    return out.select(
        "rec_id", F.coalesce(F.length("items") / 4, F.lit(0)).cast("long").alias("n_items"), F.lower(F.hex("items")).alias("fingerprint"), "class_id", "asked",
        *[hide(c) for c in ("match_id", "offset", "overlap", "bit_error", "n_matches")],
    )


def tune(values: list[float | None] | None, rate: int = 8000, seconds: float = 1 / 16) -> bytes | None:
    """A vector played as notes, in a WAV file: near vectors give near recordings."""
    if values is None:
        return None
    v = np.array([np.nan if x is None else x for x in values], float)
    size, scale = int(rate * seconds), 1 / max(np.sqrt(np.nanmean(v * v)) if np.isfinite(v).any() else 1.0, 1e-9)
    note = np.clip(np.floor((np.nan_to_num(v, posinf=0, neginf=0) * scale + 2) * 6), 0, 23)
    t = np.arange(size) / rate
    sound = np.sin(2 * np.pi * (220 * 2 ** (note / 12))[:, None] * t) * np.where(np.isfinite(v), 0.5, 0)[:, None]
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((sound.reshape(-1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def recordings(vectors: DataFrame) -> DataFrame:
    """(rec_id, audio): no table has audio, so the vectors of ``embeddings`` are played."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                audio = [tune(x) for x in part.column("embedding").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("rec_id"), pa.array(audio, pa.binary())], names=["rec_id", "audio"])

    return vectors.select(F.col("vec_id").cast("long").alias("rec_id"), "embedding").mapInArrow(run, "rec_id long, audio binary")


def op2_audio_fingerprints(spark, sf_dir: str) -> DataFrame:
    audio = recordings(table(spark, sf_dir, "embeddings"))
    return matched(spark, fingerprints(audio, "rec_id", "audio"), Scratch(spark, "audio"))
