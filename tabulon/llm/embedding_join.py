"""Operator 3: near-duplicate vectors by an exact metric range join.

On unit vectors cosine >= c is Euclidean distance <= e = sqrt(2 - 2c).  Equal
vectors are collapsed.  Pivots, a bounded sample of the vectors, partition the
rest by the nearest pivot.  A vector y of cell b also goes to each cell a < b
that may hold a vector within e: by the triangle inequality d(y, a) <=
d(y, b) + 2e there, and y is no further than e from the plane between the two
pivots.  So every pair meets once, in the lower of its two cells, and cells
are joined independently.  A large cell is divided into blocks of its own
vectors against blocks of all it holds, so a task's memory is bounded.

A block sends each vector's number of links and a spanning forest of the links
it found, not the links themselves, so a dense group costs rows in proportion
to its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table

#: Bytes of pivots at most, as they are sent to every task; their number grows with the root of the vectors'.
PIVOT_BYTES = 64 << 20
#: Vectors of a side of a block, about.
BLOCK = 8192


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(batch: pa.RecordBatch, kind: str) -> tuple[list, list[bytes]]:
    """The ids and bytes of the vectors that can link with others."""
    vectors = batch.column("embedding")
    flat = vectors.flatten()
    ok = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False).astype(kind)  # null components become nan
    ends = np.cumsum(sizes)
    finite = np.isfinite(values)
    bad = np.concatenate([[0], np.cumsum(~finite)])
    live = np.concatenate([[0], np.cumsum(values != 0)])
    ok &= (bad[ends] == bad[ends - sizes]) & (live[ends] > live[ends - sizes])
    ok &= batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[at]
    return ids.astype(np.int64).tolist(), [values[ends[i] - sizes[i] : ends[i]].tobytes() for i in at]


def links_within(a: np.ndarray, b: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of ``a`` (unit vectors), the rows of ``b`` at ``cosine`` or above.

    Single precision finds candidates, with room for its error; double decides.
    """
    small = b.astype(np.float32)
    for lo in range(0, len(a), 512):
        near = a[lo : lo + 512].astype(np.float32) @ small.T >= cosine - 1e-4
        for i in np.flatnonzero(near.any(1)):
            js = np.flatnonzero(near[i])
            js = js[b[js] @ a[lo + i] >= cosine]
            if len(js):
                yield lo + int(i), js


def near_links(spark: SparkSession, vectors: DataFrame, scratch: Scratch, cosine: float = 0.9) -> DataFrame:
    """One row per vector of (vec_id, embedding): vec_id, n_links, component_id, kept.

    Null, zero or non-finite vectors, and those with null components, link
    with nothing, nor do vectors of different lengths, nor rows without an id
    (their component is null and they are not kept).  Equal vectors are each
    other's links.  Rows that repeat an id are vectors of their own.  Ties need
    nothing, other columns have no influence, an empty table gives no rows.
    """
    kind = "f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "f4"
    eps = math.sqrt(2 - 2 * cosine) + 1e-9

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = _valid(batch, kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.mapInArrow(read, "vec_id long, v binary")
    keyed = scratch.keep(rows.select("vec_id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")), "rows")
    same = keyed.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "v")).alias("m"), F.count("*").alias("copies"))
    # each distinct vector is a unit of its own, whatever ids its rows have
    same = same.select(F.monotonically_increasing_id().alias("unit"), "h1", "h2", "m.vec_id", "m.v", "copies")
    same = scratch.keep(same, "distinct")
    count, widest = same.agg(F.count("*"), F.max(F.length("v"))).first()
    wanted = max(1, min(round(math.sqrt(count) / 16), PIVOT_BYTES // max(widest or 1, 1)))
    sampled = same.select("h1", "h2", "v").orderBy(F.xxhash64(F.lit(3), "h1", "h2"), "h1", "h2").limit(wanted).collect()
    # pivots are of one length; vectors of others are cells of their own, without a pivot
    width = len(sampled[0]["v"]) if sampled else 0
    pivots = [bytes(r["v"]) for r in sampled if len(r["v"]) == width]
    m = len(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not pivots:  # no vector can be linked
            return
        p = _unit(pivots, kind)
        for batch in batches:
            raw = batch.column("v").to_pylist()
            home, others = np.full(len(raw), m), [[] for _ in raw]
            at = [i for i, v in enumerate(raw) if len(v) == width]
            for lo in range(0, len(at), 1024):
                some = at[lo : lo + 1024]
                d = np.sqrt(np.maximum(2 - 2 * _unit([raw[i] for i in some], kind) @ p.T, 0))
                own = d.argmin(1)
                mine = d[np.arange(len(some)), own][:, None]
                between = np.sqrt(np.maximum(2 - 2 * p[own] @ p.T, 0))
                plane = (d * d - mine * mine) / np.maximum(2 * between, 1e-300)
                near = (d <= mine + 2 * eps) & (plane <= eps) & (np.arange(m)[None, :] < own[:, None])
                for k, i in enumerate(some):
                    home[i] = own[k]
                    others[i] = np.flatnonzero(near[k]).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("unit"), batch.column("copies"), batch.column("v"), pa.array(home, pa.int32()), pa.array(others, pa.list_(pa.int32()))],
                names=["unit", "copies", "v", "home", "others"],
            )

    placed = same.select("unit", "copies", "v").mapInArrow(assign, "unit long, copies long, v binary, home int, others array<int>")
    placed = scratch.keep(placed, "placed")
    held = {r["home"]: r["count"] for r in placed.groupBy("home").count().collect()}
    sent = {r["c"]: r["count"] for r in placed.select(F.explode("others").alias("c")).groupBy("c").count().collect()}
    own_blocks = [max(1, -(-held.get(c, 0) // BLOCK)) for c in range(m + 1)]
    all_blocks = [max(1, -(-(held.get(c, 0) + sent.get(c, 0)) // BLOCK)) for c in range(m + 1)]
    of = lambda per, c: F.element_at(F.array(*map(F.lit, per)), F.col(c) + 1)

    homes = placed.select("unit", "copies", "v", F.col("home").alias("cell"))
    homes = homes.withColumn("i", F.pmod(F.xxhash64(F.lit(4), "unit"), of(own_blocks, "cell")).cast("int"))
    homes = homes.withColumn("j", F.explode(F.sequence(F.lit(0), of(all_blocks, "cell") - 1))).withColumn("side", F.lit(0))
    members = placed.select(
        "unit", "copies", "v", F.explode(F.concat(F.array("home"), "others")).alias("cell"), F.col("home")
    ).withColumn("side", F.when(F.col("home") == F.col("cell"), 1).otherwise(2)).drop("home")
    members = members.withColumn("j", F.pmod(F.xxhash64(F.lit(5), "unit"), of(all_blocks, "cell")).cast("int"))
    members = members.withColumn("i", F.explode(F.sequence(F.lit(0), of(own_blocks, "cell") - 1)))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int | None, int]] = []
        frame = frame.assign(width=frame["v"].map(len))
        for _, part in frame.groupby("width"):
            left, right = part[part["side"] == 0], part[part["side"] > 0]
            if left.empty or right.empty:
                continue
            a, b = _unit(left["v"].tolist(), kind), _unit(right["v"].tolist(), kind)
            ida, idb = left["unit"].to_numpy(), right["unit"].to_numpy()
            ca, cb = left["copies"].to_numpy(), right["copies"].to_numpy()
            visitor = right["side"].to_numpy() == 2
            got_a, got_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            number = {x: k for k, x in enumerate(np.unique(np.concatenate([ida, idb])).tolist())}
            na, nb = (np.array([number[x] for x in ids.tolist()]) for ids in (ida, idb))
            root = np.arange(len(number))
            forest: list[tuple[int, int]] = []
            names = np.array(list(number))
            for i, js in links_within(a, b, cosine):
                js = js[visitor[js] | (idb[js] > ida[i])]  # pairs of the cell's own once
                if not len(js):
                    continue
                got_a[i] += cb[js].sum()
                got_b[js] += ca[i]
                ends = np.append(nb[js], na[i])
                while True:  # to the roots
                    up = root[ends]
                    if (up == ends).all():
                        break
                    ends = root[up]
                met = np.unique(ends)
                root[met[1:]] = met[0]
                root[nb[js]] = met[0]
                root[na[i]] = met[0]
                forest += [(int(names[met[0]]), int(names[x])) for x in met[1:]]
            out += [(int(x), None, int(n)) for ids, got in ((ida, got_a), (idb, got_b)) for x, n in zip(ids, got, strict=True) if n]
            out += [(x, y, 0) for x, y in forest]
        return pd.DataFrame({
            "a": pd.array([x[0] for x in out], dtype="Int64"), "b": pd.array([x[1] for x in out], dtype="Int64"),
            "n": pd.array([x[2] for x in out], dtype="Int64"),
        })

    columns = ["cell", "i", "j", "side", "unit", "copies", "v"]
    met = homes.select(columns).unionByName(members.select(columns)).groupBy("cell", "i", "j").applyInPandas(join, "a long, b long, n long")
    met = scratch.keep(met, "met")
    degrees = met.where("b IS NULL").groupBy(F.col("a").alias("unit")).agg(F.sum("n").alias("others"))
    classes = components(scratch, met.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "unit")
    found = same.select("unit", "h1", "h2", "vec_id", "copies").join(degrees, "unit", "left").join(classes, "unit", "left")
    found = scratch.keep(found.withColumn("component", F.coalesce("component", "unit")), "found")
    # a component is named by the smallest id in it: a minimum for each task first
    names = found.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    found = found.join(names, "component").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # the vectors' side of this join may have a hot key; the other has one row for each
    linked = keyed.select("vec_id", "h1", "h2").join(scratch.keep(found, "named"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    apart = ids.where("vec_id IS NULL").select("vec_id").unionByName(_invalid(ids, kind))
    apart = apart.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(apart)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _invalid(ids: DataFrame, kind: str) -> DataFrame:
    """Ids of the rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("embedding")], names=["vec_id", "embedding"])
            good = set(_valid(marked, kind)[0])
            at = [i for i in range(batch.num_rows) if i not in good]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at, pa.int64()))], names=["vec_id"])

    return ids.where("vec_id IS NOT NULL").mapInArrow(run, "vec_id long")


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_links(spark, table(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))


#: DuckDB SQL of the same rows; the pairs are compared by brute force.
ORACLE = """
WITH RECURSIVE ok AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.r AS ra FROM ok a JOIN ok b
    ON a.r <> b.r AND len(a.v) = len(b.v)
   AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9
), reach AS (
  SELECT a AS n, b AS m FROM pairs UNION SELECT r.n, p.b FROM reach r JOIN pairs p ON r.m = p.a
), comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n),
deg AS (SELECT a, count(*) AS d FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(d.d, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id))::BIGINT AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN deg d ON e.vec_id = d.a LEFT JOIN comp c ON e.vec_id = c.n
"""
