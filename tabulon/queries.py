"""Queries over the driver's tables, one for each operator, with equivalent SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import STOP_WORDS
from .operators import writes
from .operators.finders import Finder
from .operators.query import Query, select
from .operators.sql import SQL
from .plans import predicates as q
from .schema import FieldSpec, TableSpec
from .sources.codecs import Aes, Json
from .sources.files import shared_folder
from .sources.store import Database
from .streaming.outbox import ChangeLog, coalesced

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "lineitem": "l_orderkey",
}
TAGS = {
    "orders": {"o_orderstatus": "index,composite=status_priority:1", "o_orderpriority": "composite=status_priority:2", "o_totalprice": "index"},
    "customer": {"c_mktsegment": "index", "c_nationkey": "index", "c_name": "index", "c_acctbal": "index"},
    "events": {"ts": "index"}, "documents": {"text": "fulltext"}, "part": {"p_name": "unique", "p_type": "index"},
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, TableSpec]:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df, TableSpec.of(name, df, KEYS[name], **TAGS.get(name, {}))


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def filtered(name: str, table: str, sql: str, predicate: q.Predicate, columns: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, spec = load(spark, sf_dir, table)
        return select(df, spec, predicate).df.select(*columns)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}"


O = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]  # noqa: E741
L = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
filtered("f01_equal", "orders", "o_orderstatus = 'F'", q.Eq("o_orderstatus", "F"), O)
filtered("f01_equal_number_as_text", "orders", "o_custkey = 10", q.Eq("o_custkey", "10.0"), O)
filtered("f01_equal_text_as_number", "orders", "false", q.Eq("o_orderstatus", 5), O)
filtered("f03_greater", "orders", "o_totalprice > 250000", q.Gt("o_totalprice", 250000), O)
filtered("f04_greater_equal", "orders", "o_custkey >= 1400", q.Gte("o_custkey", 1400), O)
filtered("f05_less", "orders", "o_totalprice < 20000", q.Lt("o_totalprice", 20000.0), O)
filtered("f06_less_equal", "lineitem", "l_quantity <= 3", q.Lte("l_quantity", 3), L)
filtered("f07_strict", "nation", "n_regionkey = 2", q.StrictEq("n_regionkey", 2), ["n_nationkey", "n_name"])
filtered("f07_strict_other_type", "nation", "false", q.StrictEq("n_regionkey", 2.0), ["n_nationkey", "n_name"])
filtered("f08_in", "lineitem", "l_returnflag IN ('A', 'R')", q.In("l_returnflag", ["A", "R"]), L)
filtered("f10_regex", "part", "regexp_matches(p_type, '^[A-Z]+[AEIO]{1}[A-Z]*')", q.Re("p_type", "^[A-Z]+[AEIO]{1}[A-Z]*"), ["p_partkey", "p_type"])
filtered("f11_equal_fields", "lineitem", "l_discount = l_tax", q.EqF("l_discount", "l_tax"), L)
filtered("f12_greater_field", "lineitem", "l_discount > l_tax", q.GtF("l_discount", "l_tax"), L)
filtered("f13_greater_equal_field", "lineitem", "l_discount >= l_tax", q.GteF("l_discount", "l_tax"), L)
filtered("f14_less_field", "lineitem", "l_discount < l_tax", q.LtF("l_discount", "l_tax"), L)
filtered("f15_less_equal_field", "lineitem", "l_discount <= l_tax", q.LteF("l_discount", "l_tax"), L)
filtered("f16_and", "orders", "o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_totalprice < 150000", q.And(q.Eq("o_orderstatus", "O"), q.Gte("o_totalprice", 100000), q.Lt("o_totalprice", 150000)), O)
filtered("f17_or", "orders", "o_totalprice < 5000 OR o_custkey = 7", q.Or(q.Lt("o_totalprice", 5000), q.Eq("o_custkey", 7)), O)
filtered("f18_not_any", "orders", "NOT (o_orderstatus = 'F' OR o_orderstatus = 'O')", q.Not(q.Eq("o_orderstatus", "F"), q.Eq("o_orderstatus", "O")), O)
filtered("f19_true", "nation", "true", q.True_(), ["n_nationkey", "n_name"])
filtered("f19_empty_or", "nation", "false", q.Or(), ["n_nationkey", "n_name"])
filtered("f25_json_path", "events", "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50", q.Gte("props.k", 50), ["event_id", "user_id"])


def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TableSpec]:
    df, _ = load(spark, sf_dir, "customer")
    df = df.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("n"), "c_name")
    return df, TableSpec.of("customer", df, "c_custkey")


_S = "(SELECT c_custkey, nullif(c_nationkey, 3) AS n, c_name FROM customer)"


def sparse(name: str, sql: str, predicate: q.Predicate) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, spec = _sparse(spark, sf_dir)
        return select(df, spec, predicate).df.select("c_custkey", "c_name")

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT c_custkey, c_name FROM {_S} WHERE {sql}"


sparse("f02_not_equal_null", "NOT coalesce(n = 5, false)", q.Ne("n", 5))
sparse("f09_not_in_null", "NOT coalesce(n IN (5, 7), false)", q.Not(q.In("n", [5, 7])))
sparse("f09_not_in_with_null", "NOT (coalesce(n = 5, false) OR n IS NULL)", q.Not(q.In("n", [5, None])))
sparse("f18_not_of_and", "NOT (coalesce(n > 5, false) AND coalesce(n < 20, false))", q.Not(q.And(q.Gt("n", 5), q.Lt("n", 20))))
sparse("f21_is_null", "n IS NULL", q.Eq("n", None))
sparse("f21_null_any_operator", "n IS NULL", q.Gt("n", None))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE (c_custkey * 7) % 11 = 3")
def f26_custom_record(spark, sf_dir):
    df, spec = load(spark, sf_dir, "customer")
    return select(df.select("c_custkey", "c_acctbal"), spec, q.Custom(lambda r: r["c_custkey"] * 7 % 11 == 3)).df


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 1")
def f27_custom_field(spark, sf_dir):
    df, spec = load(spark, sf_dir, "customer")
    return select(df.select("c_custkey", "c_acctbal"), spec, q.CustomField("c_custkey", lambda v: v % 2 == 1)).df


# finders


def finds(name: str, sql: str, table: str, columns: list[str], fn: Callable[[Finder], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Finder(*load(spark, sf_dir, table))).select(*columns)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = sql


C = ["c_custkey", "c_name", "c_acctbal"]
_C = "SELECT c_custkey, c_name, c_acctbal FROM customer"
finds("s06_point", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42", "customer", C, lambda f: f.find("c_custkey", 42))
finds("x01_one", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1", "customer", C, lambda f: f.find("c_mktsegment", "BUILDING", limit=1))
finds("x02_find", f"{_C} WHERE c_mktsegment = 'BUILDING'", "customer", C, lambda f: f.find("c_mktsegment", "BUILDING"))
finds("x02_find_page", f"{_C} WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey DESC LIMIT 20 OFFSET 5", "customer", C, lambda f: f.find("c_mktsegment", "BUILDING", skip=5, limit=20, reverse=True))
finds("x04_composite", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", "orders", ["o_orderkey", "o_custkey"], lambda f: f.find_by_index("status_priority", ["F", "1-URGENT"]))
finds("x05_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000", "orders", ["o_orderkey", "o_totalprice"], lambda f: f.range("o_totalprice", 100000, 110000))
finds("x05_range_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 10", "orders", ["o_orderkey", "o_totalprice"], lambda f: f.range("o_totalprice", 100000, 200000, skip=10, limit=50))
finds("x05_range_time", "SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'", "events", ["event_id", "user_id"], lambda f: f.range("ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6, 12)))
finds("x07_prefix", f"{_C} WHERE starts_with(c_name, 'Customer#00000001')", "customer", C, lambda f: f.prefix("c_name", "Customer#00000001"))
finds("x08_all_by_index", f"{_C} WHERE c_nationkey <> 0", "customer", C, lambda f: f.all_by_index("c_nationkey"))
finds("x08_all_by_index_page", f"{_C} WHERE c_nationkey <> 0 ORDER BY c_nationkey DESC, c_custkey DESC LIMIT 30", "customer", C, lambda f: f.all_by_index("c_nationkey", limit=30, reverse=True))
finds("s05_all", _C, "customer", C, lambda f: f.all())
finds("s04_reverse_scan", f"{_C} ORDER BY c_custkey DESC LIMIT 25", "customer", C, lambda f: f.all(reverse=True, limit=25))

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_HITS = f"""WITH t AS (SELECT doc_id, [x FOR x IN regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') IF x NOT IN ({_STOP})] AS w FROM documents),
c AS (SELECT doc_id, len([x FOR x IN w IF x = 'thentest']) AS a, len([x FOR x IN w IF x = 'ering']) AS b, len([x FOR x IN w IF x = 'und']) AS c, len(w) AS n FROM t),
d AS (SELECT count(*) AS n, count(*) FILTER (a > 0) AS a, count(*) FILTER (b > 0) AS b, count(*) FILTER (c > 0) AS c FROM c),
s AS (SELECT doc_id, (sqrt(c.a) * ln(1 + d.n / (1.0 + d.a)) + sqrt(c.b) * ln(1 + d.n / (1.0 + d.b)) + sqrt(c.c) * ln(1 + d.n / (1.0 + d.c))) / sqrt(greatest(c.n, 1)) AS score FROM c, d WHERE c.a + c.b + c.c > 0)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, doc_id"""
_RANKED = _HITS.replace("SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, doc_id", "SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS place FROM s ORDER BY place LIMIT 50")


def _stored(spark, sf_dir, table: str, sync: bool = True):
    """A table of the driver's in a store of its own, in the folder that all executors share."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    df, spec = load(spark, sf_dir, table)
    db = Database(spark, f"{root}/db", ChangeLog(spark, f"{root}/log"), sync=sync)
    stored = db.node().init(spec)
    stored.replace(df)
    return stored


def _places(hits: DataFrame) -> DataFrame:
    """The first 50, numbered: a top-k, so the window holds 50 rows."""
    best = hits.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(50)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")).cast("long"))


@query(_HITS)
def x09_full_text(spark, sf_dir):
    return Finder(*load(spark, sf_dir, "documents")).search("text", "thentest of Ering und the").select("doc_id", F.round("score", 6).alias("score"))


@query(_RANKED)
def x09_full_text_ranked(spark, sf_dir):
    return _places(Finder(*load(spark, sf_dir, "documents")).search("text", "thentest of Ering und the"))


@query(_RANKED)
def x09_full_text_index(spark, sf_dir):
    return _places(_stored(spark, sf_dir, "documents").finder.search("text", "thentest of Ering und the"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def x10_substring(spark, sf_dir):
    return Finder(*load(spark, sf_dir, "documents")).search_substring("text", "LICENSE").select("doc_id")


@query("SELECT 'c_custkey' AS field, count(*) FILTER (c_custkey <> 0) AS n FROM customer UNION ALL SELECT 'c_name', count(*) FILTER (c_name <> '') FROM customer UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey <> 0) FROM customer UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal <> 0) FROM customer UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment <> '') FROM customer")
def agg_index_coverage(spark, sf_dir):
    return Finder(*load(spark, sf_dir, "customer")).coverage()


# builder and order


def _orders(spark, sf_dir, *predicates) -> Query:
    df, spec = load(spark, sf_dir, "orders")
    return select(df.select(*O), spec, *predicates)


_OC = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@query(f"{_OC} WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def b02_top_k(spark, sf_dir):
    return _orders(spark, sf_dir, q.Eq("o_orderstatus", "F"), q.Gte("o_totalprice", 100000)).order_by("o_totalprice").reverse().limit(25).df


@query(f"{_OC} WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1 OFFSET 3")
def b03_first(spark, sf_dir):
    return _orders(spark, sf_dir, q.Eq("o_orderstatus", "P")).skip(3).limit(1).df


@query("SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'O' LIMIT 500 OFFSET 100)")
def b04_count_page(spark, sf_dir):
    return _orders(spark, sf_dir, q.Eq("o_orderstatus", "O")).skip(100).limit(500).df.agg(F.count("*").alias("n"))


@query(f"{_OC} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 100)")
def b05_delete_page(spark, sf_dir):
    df, spec = load(spark, sf_dir, "orders")
    hit = select(df, spec, q.Eq("o_orderstatus", "F")).order_by("o_totalprice").limit(100).df
    return writes.delete_ids(df, hit.select("o_orderkey"), spec).select(*O)


@query("SELECT count(*) AS n FROM orders")
def b06_count_all(spark, sf_dir):
    return load(spark, sf_dir, "orders")[0].agg(F.count("*").alias("n"))


@query(f"{_OC} ORDER BY o_orderstatus, o_custkey, o_orderkey LIMIT 40")
def o01_many_keys(spark, sf_dir):
    return _orders(spark, sf_dir).order_by("o_orderstatus", "o_custkey").limit(40).df


@query(f"{_OC} ORDER BY o_orderstatus DESC, o_custkey DESC, o_orderkey DESC LIMIT 40 OFFSET 7")
def o02_reverse_all_keys(spark, sf_dir):
    return _orders(spark, sf_dir).order_by("o_orderstatus", "o_custkey").reverse().skip(7).limit(40).df


@query(f"SELECT c_custkey, c_name FROM {_S} ORDER BY n NULLS FIRST, c_custkey LIMIT 60")
def o04_nulls_first(spark, sf_dir):
    df, spec = _sparse(spark, sf_dir)
    return select(df, spec).order_by("n").limit(60).df.select("c_custkey", "c_name")


@query(f"{_OC} LIMIT 0")
def o07_limit_zero(spark, sf_dir):
    return _orders(spark, sf_dir).limit(0).df


@query(f"{_OC} WHERE o_custkey < 50")
def o07_negative_limit_and_skip(spark, sf_dir):
    return _orders(spark, sf_dir, q.Lt("o_custkey", 50)).limit(-1).skip(-5).df


@query("SELECT r_regionkey AS key, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def s07_raw(spark, sf_dir):
    return select(*load(spark, sf_dir, "region")).raw()


# SQL


def sql(name: str, oracle: str, text: str, *args, how: str = "project", table: str = "orders") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(SQL({table: load(spark, sf_dir, table)}), how)(text, *args)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle


sql("p01_star", "SELECT * FROM nation WHERE n_regionkey = 1", "SELECT * FROM nation WHERE n_regionkey = ?", 1, how="select", table="nation")
sql("p02_columns", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 30", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 30")
sql("p03_alias", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 300000", "select `o_orderkey` as id, o_totalprice price from orders where o_totalprice > ?", 300000)
sql("p04_star_project", "SELECT n_name, n_nationkey, n_regionkey FROM nation", "SELECT * FROM nation", table="nation")


@dataclass
class Account:
    """A class of the caller's own: filled by label, name or stored column."""

    number: int
    balance: int
    owner: str = field(default="", metadata={"json": "c_name"})
    note: str = ""


@query("SELECT CAST(c_custkey AS BIGINT) AS number, CAST(trunc(c_acctbal) AS BIGINT) AS balance, c_name AS owner FROM customer WHERE c_acctbal < 0")
def p08_class_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SQL({"customer": load(spark, sf_dir, "customer")})
    return found.project_frame(Account, "SELECT c_custkey AS Number, c_name, c_acctbal balance, c_mktsegment FROM customer WHERE c_acctbal < 0")


sql("p05_qualified", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 3", "SELECT t.o_orderkey, t.o_custkey FROM orders AS t WHERE t.o_custkey = 3")
sql("p06_case_insensitive", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'", "SELECT o_orderkey FROM orders WHERE O_ORDERSTATUS = \"P\"")
sql("sql_not_in", f"{_OC} WHERE o_orderstatus NOT IN ('F', 'O') AND NOT (o_totalprice < 200000)", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus NOT IN (?, ?) AND NOT (o_totalprice < 200000)", "F", "O")
sql("sql_truncates_literals", f"{_OC} WHERE o_custkey = 18", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 18.9")
sql("sql_or_parentheses", f"{_OC} WHERE (o_custkey = 5 OR o_custkey = 6) AND o_orderstatus <> 'F'", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE (o_custkey = 5 OR o_custkey = 6) AND o_orderstatus != 'F'")
sql("b07_sql_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'", "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'O'", how="count_frame")
sql("b07_sql_count_limit", "SELECT least(count(*), 5) AS n FROM orders", "SELECT COUNT(*) FROM orders LIMIT 5", how="count_frame")
sql("o09_sql_limit", f"{_OC} ORDER BY o_orderkey LIMIT 10 OFFSET 20", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20, 10")
sql("o05_sql_order", f"{_OC} ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 15 OFFSET 2", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT ? OFFSET ?", 15, 2)
sql("w10_insert", "SELECT * FROM nation WHERE n_nationkey NOT IN (3, 90) UNION ALL SELECT 3, 'ATLANTIS', 4 UNION ALL SELECT 90, 'LEMURIA', 2", "INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (3, 'X', 1), (90, ?, 2), (3, 'ATLANTIS', 4)", "LEMURIA", how="after", table="nation")
sql("w11_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'MOVED' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation", "UPDATE nation SET n_name = 'MOVED', n_regionkey = ? WHERE n_regionkey = ?", 9, 2, how="after", table="nation")
sql("w12_delete", "SELECT * FROM supplier WHERE NOT (s_acctbal < 0 OR s_nationkey = 4)", "DELETE FROM supplier WHERE s_acctbal < 0 OR s_nationkey = 4", how="after", table="supplier")


# writes


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey <> 7 UNION ALL SELECT s_suppkey, s_name || '*', 0, s_acctbal FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey = 8")
def w02_upsert(spark, sf_dir):
    df, spec = load(spark, sf_dir, "supplier")
    changed = df.where("s_nationkey = 7").withColumns({"s_name": F.concat("s_name", F.lit("*")), "s_nationkey": F.lit(0)})
    added = df.where("s_nationkey = 8").withColumn("s_suppkey", F.col("s_suppkey") + 1000000)
    batch = changed.withColumn("s_name", F.lit("first, so not kept")).unionByName(changed).unionByName(added)
    batch = writes.last_of_each(batch.withColumn("_at", F.monotonically_increasing_id()), spec.id.column, "_at")
    return writes.upsert(df, batch, spec)


@query("SELECT 101 + row_number() OVER (ORDER BY r_regionkey) - 1 AS id, r_name AS name FROM region")
def w04_increment(spark, sf_dir):
    df, _ = load(spark, sf_dir, "region")
    spec = TableSpec("r", (FieldSpec("id", T.LongType(), id=True, increment=101), FieldSpec("name", T.StringType())))
    batch = df.select(F.lit(0).cast("long").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("_at"))
    empty = spark.createDataFrame([], spec.schema)
    return writes.number(batch, empty, spec, {}, "_at")[0].select("id", "name")


@query("SELECT c_nationkey AS value, count(*) AS n FROM customer WHERE c_nationkey <> 0 GROUP BY 1 HAVING count(*) > 1")
def w05_unique_violations(spark, sf_dir):
    return writes.duplicates(load(spark, sf_dir, "customer")[0], "c_nationkey", load(spark, sf_dir, "customer")[1])


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'NEW' ELSE p_name END AS p_name, p_brand, p_type, p_size, CASE WHEN p_size > 40 THEN 1.5 ELSE p_retailprice END AS p_retailprice FROM part")
def w07_partial_update(spark, sf_dir):
    df, spec = load(spark, sf_dir, "part")
    changes = df.where("p_size > 40").select(
        "p_partkey", F.lit("NEW").alias("p_name"), F.lit("").alias("p_brand"), F.lit("").alias("p_type"), F.lit(0).alias("p_size"), F.lit(1.5).alias("p_retailprice")
    )
    return writes.partial_update(df, changes, spec)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN '' ELSE n_name END AS n_name, n_regionkey FROM nation")
def w08_update_field(spark, sf_dir):
    df, spec = load(spark, sf_dir, "nation")
    return writes.set_field(df, spec, 5, "n_name", "")


@query("SELECT * FROM nation WHERE n_nationkey <> 5")
def w09_delete_by_id(spark, sf_dir):
    df, spec = load(spark, sf_dir, "nation")
    return writes.delete_where(df, q.Eq("n_nationkey", 5))


# namespaces, codecs, change log


def _days(spark, sf_dir):
    """The events in a store, a namespace for each day."""
    df, _ = load(spark, sf_dir, "events")
    db = Database(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    spec = TableSpec("events", (FieldSpec("event_id", T.LongType(), id=True),))
    node = db.from_("days")
    node.put_partitioned(df.select("event_id", F.date_format("ts", "yyyyMMdd").alias("day")), "day", spec)
    return node


@query("SELECT event_id, strftime(ts, '%Y%m%d') AS namespace FROM events WHERE strftime(ts, '%Y%m%d') LIKE '2024011%'")
def s11_prefix_scan(spark, sf_dir):
    node = _days(spark, sf_dir)
    return node.gather(node.prefix_scan("2024011"), "events").select("event_id", "namespace")


@query("SELECT event_id, strftime(ts, '%Y%m%d') AS namespace FROM events WHERE strftime(ts, '%Y%m%d') BETWEEN '20240105' AND '20240112'")
def s12_range_scan(spark, sf_dir):
    node = _days(spark, sf_dir)
    return node.gather(node.range_scan("20240105", "20240112"), "events").select("event_id", "namespace")


@query("SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(name, type)")
def s15_list_columns(spark, sf_dir):
    from .sources.store import columns

    return columns(spark, load(spark, sf_dir, "nation")[1]).select("name", "type")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s21_json_round_trip(spark, sf_dir):
    df, spec = load(spark, sf_dir, "nation")
    coded = df.select(Json().encode(F.struct("*")).alias("v"))
    return coded.select(Json().decode(F.col("v"), df.schema).alias("r")).select("r.*")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s26_aes_round_trip(spark, sf_dir):
    df, spec = load(spark, sf_dir, "nation")
    codec = Aes(Json(), b"0123456789abcdef")
    coded = df.select(codec.encode(F.struct("*")).alias("v"))
    return coded.select(codec.decode(F.col("v"), df.schema).alias("r")).select("r.*")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key, c_custkey AS value FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1")
def s19_key_value(spark, sf_dir):
    df, _ = load(spark, sf_dir, "customer")
    sets = df.select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_custkey").alias("value"), F.col("c_custkey").alias("_at"))
    bucket = Database(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}").node().bucket("last")
    bucket.set_all(writes.last_of_each(sets, "key", "_at"), "bigint")
    return bucket.items("bigint").select("key", "value")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def r04_last_change(spark, sf_dir):
    df, _ = load(spark, sf_dir, "events")
    return coalesced(df.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


FLAGSHIP = "b02_top_k"
