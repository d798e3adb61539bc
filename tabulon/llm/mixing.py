"""Operator 9: mixing sources to target weights by pivotal dependent rounding.

Only DataFrame and SQL functions.  A source whose target is ``f`` times its
size gives every document ``floor(f)`` copies and one more with probability
``f - floor(f)``.  Those probabilities, weighted by the documents' words, are
rounded pairwise: of two documents one passes words to the other until one of
them holds all or none of its words, with the direction drawn so that each
keeps its probability.  Documents meet in buckets of about ``LEAF``; what a
bucket leaves, at most one document, meets the rest of 64 buckets at the next
level, until one document per source is left.  A source so misses its target
by less than one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table, word_count

#: Documents or residuals that one reduction joins, on average.
LEAF = 64
#: Equal rows that are made together.
RUN = 4096


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): targets by weight, filled up to ``most`` times the size.

    One row per source, so the unpartitioned windows hold the source list alone.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size").cast("double"))
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("whole", share * F.sum("source_size").over(every).cast("double"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("ratio", F.col("cap") / F.col("w"))
    per = per.withColumn(
        "level",
        (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return per.select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target")
    )


def _uniform(level: int, seed: int, *columns: str) -> Column:
    """A number in [0, 1) from the document and the level alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def _pivot(held: Column, unit: Column) -> Column:
    """One pivotal step: the residual ``held.rest`` meets ``unit``."""
    a, b = held["rest"], unit
    rise = F.least(a["size"] - a["mass"], b["mass"])
    fall = F.least(a["mass"], b["size"] - b["mass"])
    up = b["u"] * (rise + fall) < fall
    # the amounts are exact where a side becomes integral: that side is set, not summed
    a_up = F.when(rise >= a["size"] - a["mass"], a["size"]).otherwise(a["mass"] + rise)
    b_up = F.when(rise >= b["mass"], F.lit(0.0)).otherwise(b["mass"] - rise)
    a_down = F.when(fall >= a["mass"], F.lit(0.0)).otherwise(a["mass"] - fall)
    b_down = F.when(fall >= b["size"] - b["mass"], b["size"]).otherwise(b["mass"] + fall)
    a2 = a.withField("mass", F.when(up, a_up).otherwise(a_down))
    b2 = b.withField("mass", F.when(up, b_up).otherwise(b_down))
    a_done = F.when(up, rise >= a["size"] - a["mass"]).otherwise(fall >= a["mass"])
    met = F.when(
        a_done, F.struct(b2.alias("rest"), F.concat(held["done"], F.array(a2)).alias("done"))
    ).otherwise(F.struct(a2.alias("rest"), F.concat(held["done"], F.array(b2)).alias("done")))
    return F.when(a.isNull(), F.struct(b.alias("rest"), held["done"].alias("done"))).otherwise(met)


def shares(
    sized: DataFrame,
    scratch: Scratch,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 20240,
) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, copies): equal rows of ``sized``, counted, and their copies together."""
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    units = alike.join(
        source_targets(sized, weights, share, most).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("whole", F.col("rows") * rate).withColumn("sure", F.floor("whole"))
    units = units.withColumn("p", F.col("whole") - F.col("sure")).drop("whole")
    units = scratch.keep(units, "units")
    out_cols = ["doc_id", "source", "size", "rows", "source_size", "target"]
    decided = [
        units.where("p = 0 OR size = 0").select(
            *out_cols, F.when(F.col("size") > 0, F.col("sure")).otherwise(F.lit(0)).cast("long").alias("copies")
        )
    ]
    open_units = units.where("p > 0 AND size > 0")
    counts = open_units.groupBy("source").agg(F.count("*").alias("n"))
    most_units = counts.agg(F.max("n")).first()[0]
    if most_units is None:
        return decided[0]
    buckets = F.ceil(F.col("n") / LEAF).cast("long")
    level = open_units.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source",
        buckets.alias("nb"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), buckets).alias("bucket"),
        _unit(_uniform(0, seed, "doc_id", "size")).alias("unit"),
    )
    depth, left = 0, -(-most_units // LEAF)
    while True:
        done_type = level.schema["unit"].dataType.simpleString()
        start = F.struct(F.lit(None).cast(done_type).alias("rest"), F.array().cast(f"array<{done_type}>").alias("done"))
        met = level.groupBy("source", "nb", "bucket").agg(F.sort_array(F.collect_list("unit")).alias("all"))
        met = met.select("source", "nb", "bucket", F.aggregate("all", start, _pivot).alias("met"))
        met = scratch.keep(met, f"level{depth}")
        decided.append(met.select("source", F.explode("met.done").alias("unit")).select(*_decided()))
        rest = met.select("source", "nb", "bucket", F.col("met.rest").alias("unit"))
        depth += 1
        if left <= 1:
            last = F.when(F.col("unit.u") * F.col("unit.size") < F.col("unit.mass"), F.col("unit.size")).otherwise(0.0)
            rest = rest.withColumn("unit", F.col("unit").withField("mass", last))
            decided.append(rest.select(*_decided()))
            break
        left = -(-left // LEAF)
        level = rest.select(
            "source",
            F.ceil(F.col("nb") / LEAF).cast("long").alias("nb"),
            F.floor(F.col("bucket") / LEAF).cast("long").alias("bucket"),
            F.col("unit").withField("u", _uniform(depth, seed, "unit.doc_id", "unit.size")).alias("unit"),
        )
    return reduce(DataFrame.unionByName, decided)


def _of_row(nth: Column) -> Column:
    """The copies of the ``nth`` of some equal rows, as even as whole numbers allow."""
    extra = F.when(nth <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return (F.floor(F.col("copies") / F.col("rows")) + extra).cast("long")


def mix(sized: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """Rows of ``sized`` (doc_id, source, size) with source_size, target, copies; ``how`` as in ``shares``.

    A null source is a source of its own, the last; a null id is an id.  Rows
    alike in all three are one unit of the rounding, so none of them meet in
    one place, and share its copies as evenly as whole numbers allow.  A
    document without words gets no copy.  An empty table gives an empty
    result.  The draws depend on ids and sizes alone, so reruns agree.
    """
    found = shares(sized, scratch, **how)
    cols = ["doc_id", "source", "size", "source_size", "target"]
    one = found.where("rows = 1").select(*cols, "copies")
    # the rows of a unit are made in runs, which are dealt to all tasks
    runs = found.where("rows > 1").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / RUN))).alias("run"))
    runs = runs.repartition(F.xxhash64("doc_id", "source", "size", "run"))
    nth = F.explode(F.sequence(F.col("run") * RUN + 1, F.least(F.col("run") * RUN + RUN, F.col("rows")))).alias("nth")
    return one.unionByName(runs.select("*", nth).select(*cols, _of_row(F.col("nth")).alias("copies")))


def _unit(u: Column) -> Column:
    """The unit struct with its uniform number in place."""
    return F.struct(
        u.alias("u"), F.col("doc_id"), F.col("size").cast("double").alias("size"),
        (F.col("p") * F.col("size")).alias("mass"), F.col("sure"), F.col("rows"), F.col("source_size"), F.col("target"),
    )


def _decided() -> list[Column]:
    extra = F.when(F.col("unit.mass") >= F.col("unit.size"), 1).otherwise(0)
    return [
        F.col("unit.doc_id").alias("doc_id"), "source", F.col("unit.size").cast("long").alias("size"),
        F.col("unit.rows").alias("rows"), F.col("unit.source_size").alias("source_size"), F.col("unit.target").alias("target"),
        (F.col("unit.sure") + extra).cast("long").alias("copies"),
    ]


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    mixed = mix(scratch.keep(sized(table(spark, sf_dir, "documents")), "sized"), scratch)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"
    )


def mix_documents(spark, docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Rows alike in id, source and size share their copies as evenly as whole
    numbers allow, in the order of their texts' hashes.  Other columns may have
    any name.
    """
    scratch = Scratch(spark, "mixdocs")
    per = shares(scratch.keep(sized(docs), "sized"), scratch).where("copies > 0")
    # one hash stands for the three in the exchange, so that rows are numbered where they are joined
    key = F.xxhash64(F.struct("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "size")).alias("k")
    per = per.select(key, F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "rows", "copies")
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    joined = rows.withColumn("k", key).join(per, "k").where(same)
    nth = F.row_number().over(Window.partitionBy("k", "i", "s", "z").orderBy(F.xxhash64(F.col("row")["text"].cast("string"))))
    copies = F.when(F.col("rows") == 1, F.col("copies")).otherwise(_of_row(nth)).cast("int")
    taken = joined.select("row", copies.alias("taken")).select("row", F.explode(F.array_repeat(F.lit(0), F.col("taken"))))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns])
