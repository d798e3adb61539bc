"""Builder, finders, SQL, writes, transactions, namespaces, key/value, change log."""

from dataclasses import dataclass, field
from typing import Any

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import errors as e
from tabulon.operators.query import select
from tabulon.operators.sql import SQL
from tabulon.plans import predicates as q
from tabulon.schema import FieldSpec, TableSpec
from tabulon.sources.codecs import Aes, Json, Protobuf
from tabulon.sources.store import Database
from tabulon.operators.finders import Finder
from tabulon.sources.files import Files
from tabulon.streaming import outbox
from tabulon.streaming.outbox import ChangeLog

USERS = TableSpec("users", (
    FieldSpec.tagged("id", "long", "id,increment"), FieldSpec.tagged("name", "string", "unique"), FieldSpec.tagged("age", "long", "index,composite=team_age:2"),
    FieldSpec.tagged("team", "string", "index,composite=team_age:1"), FieldSpec.tagged("bio", "string", "fulltext", nullable=True),
))
ROWS = [
    {"name": "Alice", "age": 31, "team": "staff", "bio": "Storm brings fast search"}, {"name": "Bob", "age": 22, "team": "admin", "bio": "full text search"},
    {"name": "Carol", "age": 17, "team": "guest"}, {"name": "Dave", "age": 42, "team": "staff", "bio": "Exact indexes stay separate"},
]


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db", ChangeLog(spark, f"file://{tmp_path}/log"))


@pytest.fixture
def users(db):
    table = db.node().init(USERS)
    assert table.save_all(ROWS) == [1, 2, 3, 4]
    return table


def names(df):
    return [r["name"] for r in df.collect()]


def test_schema_rules():
    with pytest.raises(e.NoID):
        TableSpec("t", (FieldSpec.tagged("a", "int"),))
    with pytest.raises(e.NoName):
        TableSpec("", (FieldSpec.tagged("ID", "int"),))
    with pytest.raises(e.UnknownTag):
        FieldSpec.tagged("a", "int", "idx")
    for second in ("composite=c:1", "composite=c:3"):
        with pytest.raises(e.UnknownTag):
            TableSpec("t", (FieldSpec.tagged("ID", "int", "composite=c:1"), FieldSpec.tagged("b", "int", second)))
    spec = TableSpec("t", (FieldSpec.tagged("ID", "int", json="id"), FieldSpec.tagged("Val", "int", "increment=-5")))
    assert spec.id.index == "unique" and spec.lookup("ID").column == "id" and TableSpec.from_json(spec.to_json()) == spec


def test_builder(users):
    assert names(users.select(q.Gte("age", 22)).order_by("age").df) == ["Bob", "Alice", "Dave"]
    assert names(users.select().order_by("team").reverse().limit(2).df) == ["Dave", "Alice"]
    assert names(users.select().skip(1).limit(2).df) == ["Bob", "Carol"]
    assert users.select().limit(0).count() == 0 and users.select().skip(9).count() == 0 and users.select().limit(-1).skip(-1).count() == 4
    assert users.select(q.Eq("team", "staff")).first()["name"] == "Alice"
    with pytest.raises(e.NotFound):
        users.select(q.Eq("team", "none")).find()
    with pytest.raises(e.NotFound):
        _ = users.select().order_by("nope").df
    seen = []
    users.select().reverse().each(lambda r: seen.append(r["name"]))
    assert seen == ["Dave", "Carol", "Bob", "Alice"]
    raw = []
    users.select().limit(1).raw_each(lambda k, v: raw.append((k, v[:20])))
    assert raw == [(1, '{"id":1,"name":"Alic')]
    assert users.select(q.Eq("team", "staff")).order_by("age").limit(1).delete() == 1
    assert names(users.select().order_by("id").df) == ["Bob", "Carol", "Dave"]
    with pytest.raises(e.NotFound):
        users.select(q.Eq("team", "none")).delete()


def test_negative_keys_come_last(spark):
    spec = TableSpec("t", (FieldSpec.tagged("ID", "long"),))
    df = spark.createDataFrame([(-1,), (2,), (0,), (-5,)], "ID long")
    assert [r.ID for r in select(df, spec).rows()] == [0, 2, -5, -1]


def test_finders(users):
    f = users.finder
    assert f.one("name", "Bob")["id"] == 2 and names(f.find("team", "staff", reverse=True)) == ["Dave", "Alice"]
    assert names(f.find("bio", None)) == ["Carol"]
    assert names(f.find_by_index("team_age", ["staff", 42])) == ["Dave"]
    assert names(f.range("age", 17, 31)) == ["Carol", "Bob", "Alice"] and names(f.range("name", "B", "D")) == ["Bob", "Carol"]
    assert names(f.prefix("name", "Ca")) == ["Carol"] and names(f.all_by_index("age", limit=2, reverse=True)) == ["Dave", "Alice"]
    assert names(f.search("bio", "the SEARCH")) in (["Bob", "Alice"], ["Alice", "Bob"]) and names(f.search("bio", "the of")) == []
    assert names(f.search_substring("bio", "ARAT")) == ["Dave"] and f.count() == 4
    for call in (lambda: f.one("name", "x"),):
        with pytest.raises(e.NotFound):
            call()
    with pytest.raises(e.IndexNotFound):
        f.find_by_index("nope", [1])
    for bad in (lambda: f.find_by_index("team_age", [1]), lambda: f.range("age", 1, "b"), lambda: f.prefix("age", "1")):
        with pytest.raises(e.IncompatibleValue):
            bad()


def test_writes(users):
    with pytest.raises(e.AlreadyExists):
        users.save({"name": "Alice"})
    assert users.save({"id": 1, "name": "Alice", "age": 32, "team": "staff"}) == 1
    with pytest.raises(e.AlreadyExists):
        users.save_all([{"name": "New"}, {"name": "New"}])
    assert users.finder.count() == 4
    users.update({"id": 2, "age": 23})
    assert tuple(users.finder.one("id", 2))[:4] == (2, "Bob", 23, "admin")
    users.update_field(2, "age", 0)
    assert users.finder.one("id", 2)["age"] == 0 and names(users.finder.all_by_index("age")) == ["Carol", "Alice", "Dave"]
    with pytest.raises(e.IncompatibleValue):
        users.update_field(2, "age", "x")
    with pytest.raises(e.AlreadyExists):
        users.update_field(2, "name", "Alice")
    with pytest.raises(e.NotFound):
        users.update({"id": 99, "age": 1})
    users.delete(2)
    with pytest.raises(e.NotFound):
        users.delete(2)
    assert users.save({"name": "Eve"}) == 5
    assert users.reindex()["name"] == 4 and users.unique_exists("name", "Eve") and not users.unique_exists("name", "Bob")
    plain = users.node.init(TableSpec("p", (FieldSpec.tagged("ID", "long"),)))
    with pytest.raises(e.ZeroID):
        plain.save({"ID": 0})


def test_increment_start(db):
    spec = TableSpec("t", (FieldSpec.tagged("ID", "long", "increment=10"), FieldSpec.tagged("n", "int", "increment=18"), FieldSpec.tagged("m", "long")))
    t = db.node().init(spec)
    assert t.save_all([{"m": k} for k in range(3)]) == [10, 11, 12]
    t.save({"ID": 11, "m": 7})
    t.save({"m": 9})
    assert [tuple(r) for r in t.finder.all().collect()] == [(10, 18, 0), (11, 0, 7), (12, 20, 2), (13, 21, 9)]


def test_sql(users):
    sql = users.node.sql()
    assert names(sql.find("SELECT * FROM users WHERE team = ? AND age >= 30 ORDER BY age DESC LIMIT 1", "staff")) == ["Dave"]
    rows = sql.project("SELECT name AS username, u.age FROM users AS u WHERE u.team IN ('staff', ?) ORDER BY age LIMIT 1, 2", "admin").collect()
    assert [tuple(r) for r in rows] == [("Alice", 31), ("Dave", 42)] and rows[0].__fields__ == ["username", "age"]
    assert sql.count("SELECT COUNT(*) FROM users WHERE NOT (team = 'staff')") == 2 and sql.count("select count(*) from users limit 3") == 3
    assert sql.first("SELECT * FROM users ORDER BY id DESC")["name"] == "Dave"
    r = sql.exec("INSERT INTO users (name, age) VALUES ('Frank', 50), (?, 51)", "Gina")
    assert (r.rows_affected, r.last_insert_id) == (2, 6)
    assert sql.exec("UPDATE users SET team = 'old', age = 60.9 WHERE age >= 50").rows_affected == 2
    assert {x.age for x in sql.find("SELECT * FROM users WHERE team = 'old'").collect()} == {60}
    assert sql.exec("DELETE FROM users WHERE team = 'old'").rows_affected == 2 and sql.exec("DELETE FROM users WHERE id = 77").rows_affected == 0
    for text in (
        "SELECT DISTINCT name FROM users", "SELECT name FROM users, t", "SELECT name FROM users JOIN t", "SELECT SUM(age) FROM users", "SELECT * FROM users GROUP BY age",
        "SELECT * FROM users WHERE name LIKE 'a'", "SELECT * FROM users WHERE age BETWEEN 1 AND 2", "SELECT * FROM users WHERE bio IS NULL", "SELECT * FROM users WHERE 1 = id",
        "SELECT * FROM users WHERE age = age + 1", "SELECT * FROM users UNION SELECT * FROM users", "SELECT * FROM users ORDER BY age, name DESC", "SELECT * FROM users LIMIT -1",
        "UPDATE users SET age = age + 1 WHERE id = 1", "INSERT INTO users VALUES (1)", "CREATE TABLE x (a int)", "SELECT 1 FROM users", "SELECT * FROM users FOR UPDATE",
        "DELETE FROM users WHERE id = 1 LIMIT 1", "SELECT COUNT(*), name FROM users", "SELECT * FROM (SELECT * FROM users) t", "INSERT IGNORE INTO users (id) VALUES (1)",
    ):
        with pytest.raises(e.UnsupportedSQL):
            (sql.exec if text[0] in "UID" else sql.select)(text)
    for error, call in (
        (e.SQLUnsafeWrite, lambda: sql.exec("DELETE FROM users")), (e.SQLArguments, lambda: sql.select("SELECT * FROM users WHERE id = ?")),
        (e.SQLArguments, lambda: sql.select("SELECT * FROM users", 1)), (e.SQLUnknownField, lambda: sql.project("SELECT nope FROM users")),
        (e.SQLTableNotRegistered, lambda: sql.select("SELECT * FROM Users")), (e.SQLBadProjection, lambda: sql.select("SELECT name FROM users")),
        (e.IncompatibleValue, lambda: sql.select("SELECT * FROM users WHERE name = 5")), (e.IncompatibleValue, lambda: sql.select("SELECT * FROM users WHERE age = NULL")),
        (e.IncompatibleValue, lambda: sql.exec("UPDATE users SET id = 5 WHERE age = 1")), (e.NotFound, lambda: sql.find("SELECT * FROM users WHERE id = 99")),
    ):
        with pytest.raises(error):
            call()
    assert sql.exec("DELETE FROM users", allow_full=True).rows_affected == 4


def test_sql_quoting(spark):
    spec = TableSpec("t", (FieldSpec.tagged("ID", "long"), FieldSpec.tagged("s", "string")))
    df = spark.createDataFrame([(1, "it's"), (2, 'a"b'), (3, "x\ny")], "ID long, s string")
    sql = SQL({"t": (df, spec)})
    for text, want in (("'it''s'", 1), ("'it\\'s'", 1), ("\"it's\"", 1), ("'a\"b'", 2), ("'x\\ny'", 3)):
        assert [r.ID for r in sql.select(f"SELECT * FROM `t` WHERE `s` = {text} -- end").collect()] == [want]


def test_transactions(db, users):
    tx = db.begin()
    inner = tx.node().table("users")
    inner.save({"name": "Tess", "team": "tx"})
    assert inner.finder.count() == 5 and users.node.table("users").finder.count() == 4
    tx.node().init(TableSpec("other", (FieldSpec.tagged("ID", "long"),))).save({"ID": 1})
    tx.commit()
    assert db.node().table("users").finder.count() == 5 and db.node().table("other").finder.count() == 1
    with pytest.raises(e.NotInTransaction):
        tx.commit()
    tx = db.begin()
    tx.node().drop("users")
    tx.rollback()
    assert db.node().table("users").finder.count() == 5
    with pytest.raises(e.ReadOnly):
        db.begin(False).node().table("users").save({"name": "X"})
    with pytest.raises(e.NotInTransaction):
        db.node().commit()
    late = db.begin()
    late.node().table("users").save({"name": "Late"})
    db.node().table("users").save({"name": "Early"})
    with pytest.raises(e.Conflict):
        late.commit()


def test_namespaces_and_catalog(db):
    spec = TableSpec("log", (FieldSpec.tagged("ID", "long"), FieldSpec.tagged("v", "string", "index")))
    for month in ("201511", "201512", "201601"):
        db.from_("logs", month).init(spec).save({"ID": 1, "v": month})
    logs = db.from_("logs")
    assert [n.path[-1] for n in logs.prefix_scan("2015")] == ["201511", "201512"]
    assert [n.path[-1] for n in logs.range_scan("201512", "201601")] == ["201512", "201601"]
    assert sorted(r.namespace for r in logs.gather(logs.prefix_scan("2015"), "log").collect()) == ["201511", "201512"]
    assert [r.namespace for r in db.list_froms().collect()] == ["logs/201511", "logs/201512", "logs/201601"]
    assert [r.name for r in db.list_tables("logs", "201511").collect()] == ["log"]
    assert [(r["name"], r["index"]) for r in db.list_columns("log", "logs", "201511").collect()] == [("ID", "unique"), ("v", "index")]
    db.set_table_metadata("log", [*spec.fields, FieldSpec.tagged("score", "long")], "logs", "201511")
    db.from_("logs", "201511").sql().exec("INSERT INTO log (ID, v, score) VALUES (2, 'x', 41)")
    assert [r.score for r in db.from_("logs", "201511").table("log").finder.all().collect()] == [0, 41]
    db.node().drop("logs")
    assert db.list_froms().count() == 0
    with pytest.raises(e.NotFound):
        db.node().drop("logs")


def test_class_output(spark):
    @dataclass
    class Person:
        who: str
        years: int
        Bio: str | None = "?"
        Team: str = field(default="none", metadata={"json": "group"})
        anything: Any = None
        ratio: float = 0.5

    df = spark.createDataFrame([(1, "Alice", 31.9, None, b"x"), (2, None, -0.5, "text", None)], "id long, name string, age double, bio string, raw binary")
    sql = SQL({"users": (df, TableSpec.of("users", df, "id"))})
    got = list(sql.project_into(Person, "SELECT name AS WHO, age AS years, bio, id FROM users ORDER BY id"))
    assert got == [Person("Alice", 31, None), Person("", 0, "text")]
    frame = sql.project_frame(Person, "SELECT name who, age years, raw AS anything FROM users WHERE id = 1")
    assert frame.columns == ["who", "years", "anything"] and bytes(frame.first()["anything"]) == b"x"
    # what no column fills has its default, or a zero value
    assert list(sql.project_into(Person, "SELECT bio FROM users WHERE id = 2")) == [Person("", 0, "text")]
    assert list(sql.project_into(Person, "SELECT bio AS `group`, age years, id AS years FROM users WHERE id = 2")) == [Person("", 2, "?", "text")]
    assert list(sql.project_into(Person, "SELECT * FROM users WHERE id = 9")) == []
    for cls, text in ((Person, "SELECT age AS who FROM users"), (Person, "SELECT name AS years FROM users")):
        with pytest.raises(e.IncompatibleValue):
            sql.project_frame(cls, text)
    with pytest.raises(e.BadType):
        sql.project_frame(dict, "SELECT name FROM users")
    with pytest.raises(e.SQLBadProjection):
        sql.project_frame(Person, "SELECT COUNT(*) FROM users")
    big = spark.createDataFrame([(1, 1e300)], "id long, age double")
    with pytest.raises(Exception, match="overflows field years"):
        list(SQL({"users": (big, TableSpec.of("users", big, "id"))}).project_into(Person, "SELECT age AS years FROM users"))


def test_protobuf_without_a_message(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.ArrayType(T.DoubleType()))])
    df = spark.createDataFrame([(1, "x", [0.5]), (None, None, None), (3, "ü", [])], schema)
    codec = Protobuf()
    coded = df.select("a", codec.encode(F.struct("*")).alias("value"))
    assert dict(coded.dtypes)["value"] == "binary"
    back = coded.select(codec.decode(F.col("value"), schema).alias("r")).select("r.*")
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


@pytest.mark.parametrize("codec", [Json(), Protobuf(), Aes(Json(), b"k" * 16)])
def test_key_value(db, codec):
    kv = db.node().bucket("settings", codec)
    kv.set("a", {"x": 1, "y": "z"}, "struct<x:int,y:string>")
    kv.set(5, [1, 2], "array<int>")
    kv.set_bytes("raw", b"\x00\x01")
    assert kv.get("a", "struct<x:int,y:string>") == {"x": 1, "y": "z"} and kv.get(5, "array<int>") == [1, 2] and kv.get_bytes("raw") == b"\x00\x01"
    assert kv.exists("a") and not kv.exists("b")
    kv.delete("a")
    for call in (lambda: kv.get("a", "int"), lambda: kv.delete("a")):
        with pytest.raises(e.NotFound):
            call()
    with pytest.raises(e.NilParam):
        kv.get(None, "int")
    with pytest.raises(e.DifferentCodec):
        db.node().bucket("settings", Aes(Json(), b"k" * 32) if codec.name == "json" else Json()).get("raw", "int")


def test_change_log(db, users):
    index = db.index
    base = (users.df, "id", F.col("bio"))
    assert not index.current()
    assert {r.id for r in index.matching("users", "search", base).collect()} == {"1", "2"}
    index.flush()
    assert index.current() and {r.id for r in index.matching("users", "search").collect()} == {"1", "2"}
    users.save({"id": 2, "name": "Bob", "age": 9, "team": "a", "bio": "nothing here"})
    users.save({"id": 3, "name": "Carol", "age": 9, "team": "a", "bio": "search again"})
    users.delete(1)
    index.flush()
    assert {r.id for r in index.matching("users", "search").collect()} == {"3"} and index.matching("users", "the").count() == 0
    index.rebuild()
    assert {r.id for r in index.matching("users", "search").collect()} == {"3"}
    users.node.drop("users")
    index.flush()
    assert index.rows().count() == 0


def found(table, text):
    """What the index finds; the same as a scan of the rows does, with the same scores."""
    table = table.node.table("users")
    index = table.node.db.index
    index.flush()
    assert index.current()
    got = table.finder.search("bio", text).collect()
    scan = Finder(table.df, table.spec).search("bio", text).collect()
    assert [(r.id, round(r.score, 9)) for r in got] == [(r.id, round(r.score, 9)) for r in scan]
    assert {str(r.id) for r in got} == {r.id for r in index.matching("users", text).collect()}
    return {r.id for r in got}


def test_index_follows_every_write(db, users, monkeypatch):
    assert found(users, "search") == {1, 2}
    users.update({"id": 2, "name": "Robert"})  # its text stays
    assert found(users, "search") == {1, 2}
    users.update({"id": 4, "bio": "a search of its own"})
    assert found(users, "search separate") == {1, 2, 4}
    users.update_field(1, "bio", "quiet")
    assert found(users, "search") == {2, 4} and found(users, "quiet") == {1}
    sql = users.node.sql()
    sql.exec("UPDATE users SET bio = 'search party' WHERE id <= 3 AND id >= 3")
    assert found(users, "search") == {2, 3, 4}
    monkeypatch.setattr(outbox, "SEGMENTS", 3)
    sql.exec("DELETE FROM users WHERE id = 2")
    assert found(users, "search") == {3, 4} and len(db.index._state()["segments"]) == 1
    users.select(q.Eq("id", 4)).delete()
    assert found(users, "search") == {3}
    before = users
    users = db.node().table("users")
    assert {r.id for r in before.finder.search("bio", "search").collect()} == {r.id for r in Finder(before.df, before.spec).search("bio", "search").collect()}
    users.reindex()
    assert found(users, "search quiet") == {1, 3}
    db.index.rebuild()
    assert found(users, "search quiet") == {1, 3}


def test_index_follows_a_transaction(db, users):
    assert found(users, "search") == {1, 2}
    tx = db.begin()
    inner = tx.node().table("users")
    inner.save_all([{"id": 7, "name": "G", "bio": "search seven"}, {"id": 8, "name": "H", "bio": "search eight"}])
    inner.delete(7)
    inner.save({"id": 9, "name": "I", "bio": "search nine"})
    inner.update({"id": 1, "bio": "calm"})
    assert found(db.node().table("users"), "search") == {1, 2}
    tx.commit()
    assert found(db.node().table("users"), "search") == {2, 8, 9}
    lost = db.begin()
    lost.node().table("users").save({"id": 10, "name": "J", "bio": "search ten"})
    lost.rollback()
    assert found(db.node().table("users"), "search ten") == {2, 8, 9}


def test_log_commits_with_the_rows(db, users, monkeypatch):
    assert found(users, "search") == {1, 2}

    def broken(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:  # the log is written, the manifest is not
        m.setattr(db.files, "create", broken)
        with pytest.raises(OSError):
            users.save({"id": 5, "name": "E", "bio": "search five"})
    users = db.node().table("users")
    assert found(users, "search") == {1, 2}
    users.save({"id": 6, "name": "F", "bio": "search six"})
    with monkeypatch.context() as m:  # the index fails after the manifest
        m.setattr(outbox.IndexStream, "_advance", broken)
        with pytest.raises(OSError):
            db.index.flush()
    assert not db.index.current() and names(users.finder.search("bio", "six")) == ["F"]
    assert found(users, "search") == {1, 2, 6}


def test_writes_of_an_older_handle(db, users):
    other = db.node().table("users")
    other.delete(1)
    users.delete(2)  # reads the table anew first
    assert [r.id for r in db.node().table("users").finder.all().collect()] == [3, 4]
    stale = db.node().table("users")
    stale.delete(3)
    with pytest.raises(e.Conflict):
        users.replace(users.df)


def test_sync_writes(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", ChangeLog(spark, f"file://{tmp_path}/log"), sync=True)
    users = db.node().init(USERS)
    users.save_all(ROWS)
    assert db.index.current() and names(users.finder.search("bio", "separate")) == ["Dave"]


def test_files_appear_whole(spark, tmp_path):
    files = Files(spark)
    assert files.create(f"file://{tmp_path}/a/b.json", "one") and not files.create(f"file://{tmp_path}/a/b.json", "two")
    assert files.read(f"file://{tmp_path}/a/b.json") == "one" and [n for n in files.names(f"file://{tmp_path}/a") if n.startswith(".b.json.") and not n.endswith("crc")] == []


def test_numbering_of_many_rows(db, spark):
    t = db.node().init(TableSpec("t", (FieldSpec.tagged("ID", "long", "increment"), FieldSpec.tagged("m", "long"))))
    t.save_all(spark.range(1000).repartition(5).select(F.lit(0).cast("long").alias("ID"), F.col("id").alias("m")))
    assert sorted(r.ID for r in t.df.collect()) == list(range(1, 1001)) and t.save({"m": 1}) == 1001


def test_partitioned_namespaces(db, spark):
    spec = TableSpec("log", (FieldSpec.tagged("ID", "long"),))
    df = spark.range(10).select(F.col("id").alias("ID"), F.concat(F.lit("a/"), (F.col("id") % 3).cast("string")).alias("day"))
    nodes = db.from_("logs").put_partitioned(df, "day", spec)
    assert [n.path[-1] for n in nodes] == ["a/0", "a/1", "a/2"] and sorted(r.ID for r in nodes[1].table("log").df.collect()) == [1, 4, 7]


def test_unique_fields_of_several_types(spark):
    from datetime import datetime

    from tabulon.operators import writes

    spec = TableSpec("t", (
        FieldSpec("id", T.LongType(), id=True), FieldSpec("a", T.DoubleType(), index="unique"), FieldSpec("b", T.BinaryType(), index="unique"),
        FieldSpec("c", T.TimestampType(), index="unique"),
    ))
    at = datetime(2024, 1, 1)
    rows = [(1, 1.5, b"x", at), (2, 1.5, b"y", None), (3, 0.0, None, None)]  # a value that old rows share is not the batch's fault
    old = spark.createDataFrame(rows, spec.schema)
    writes.check_unique(old, spark.createDataFrame([(3, 0.0, b"z", None), (4, 0.0, None, None), (1, 2.0, b"x", at)], spec.schema), spec)
    for row, field in (((5, 1.5, None, None), "a"), ((5, 0.0, b"y", None), "b"), ((5, 0.0, None, at), "c")):
        with pytest.raises(e.AlreadyExists, match=f"of {field} "):
            writes.check_unique(old, spark.createDataFrame([row], spec.schema), spec)
