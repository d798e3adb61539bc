"""The comparison matrix, two-valued logic, and random predicate trees against plain Python."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabulon.errors import BadType, IncompatibleValue, UnknownField
from tabulon.plans import predicates as q
from tabulon.plans.compile import compile

T0 = dt.datetime(2024, 5, 1, 12)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, 10, 10.0, "hello", T0, True, (5,), b"ab"), (2, None, None, None, None, None, None, None), (3, 5, 2.5, "10", T0 + dt.timedelta(hours=2), False, (6,), b"b")]
    return spark.createDataFrame(data, "id long, i long, d double, s string, t timestamp_ntz, b boolean, st struct<a:int>, x binary").cache()


def ids(rows, p):
    return {r.id for r in rows.where(compile(p, rows.schema)).select("id").collect()}


@pytest.mark.parametrize(
    ("field", "op", "value", "want"),
    [
        ("i", "=", 10, {1}), ("i", "=", 10.0, {1}), ("i", "=", "10", {1}), ("i", "=", "10.0", {1}), ("i", "=", "hello", set()), ("d", "=", 10, {1}),
        ("d", "=", "10", {1}), ("d", ">", "hello", set()), ("s", "=", "hello", {1}), ("s", "=", 10, set()), ("s", "<", "h", {3}), ("i", ">", 5.0, {1}),
        ("i", ">=", 5, {1, 3}), ("i", "<", 10, {3}), ("i", "<=", 10.5, {1, 3}), ("t", "=", T0, {1}), ("t", ">", T0, {3}), ("t", "<", "2024-05-01T13:00:00", {1}),
        ("t", "=", "2024-05-01T12:00:00+00:00", {1}), ("t", "=", 5, set()), ("b", "=", True, {1}), ("b", ">", False, set()), ("b", "=", 1, set()),
        ("st", "=", {"a": 5}, {1}), ("st", ">", {"a": 1}, set()), ("st.a", ">", 5, {3}), ("x", "=", b"ab", {1}), ("i", "=", None, {2}), ("i", ">", None, {2}),
        ("i", "<", 2**70, {1, 3}), ("i", "=", True, set()),
    ],
)
def test_matrix(rows, field, op, value, want):
    p = q.Comparison(op, field, value)
    assert ids(rows, p) == want
    assert ids(rows, q.Not(p)) == {1, 2, 3} - want


def test_connectives_and_membership(rows):
    assert ids(rows, q.And()) == {1, 2, 3}
    assert ids(rows, q.Or()) == set()
    assert ids(rows, q.Not(q.Eq("i", 10), q.Eq("i", 5))) == {2}
    assert ids(rows, q.In("i", [10, 5, "x"])) == {1, 3}
    assert ids(rows, q.In("i", [])) == set()
    assert ids(rows, q.In("i", 10)) == set()
    assert ids(rows, q.In("i", [10, None])) == {1, 2}
    assert ids(rows, q.Not(q.In("i", [10, None]))) == {3}
    assert ids(rows, q.StrictEq("i", 10)) == {1}
    assert ids(rows, q.StrictEq("i", 10.0)) == set()
    assert ids(rows, q.StrictEq("d", 10.0)) == {1}
    assert ids(rows, q.EqF("i", "d")) == {1, 2}
    assert ids(rows, q.GtF("i", "d")) == {2, 3}
    assert ids(rows, q.GteF("i", "s")) == {2}
    assert ids(rows, ~q.EqF("i", "d")) == {3}


def test_patterns(rows):
    assert ids(rows, q.Re("s", "l+o")) == {1}
    assert ids(rows, q.Re("s", r"^\d+$")) == {3}
    assert ids(rows, q.Not(q.Re("s", "h"))) == {2, 3}
    assert ids(rows, q.Re("s", "[+*]+|ell")) == {1}
    with pytest.raises(BadType):
        compile(q.Re("i", "1"), rows.schema)
    for bad in (r"\d++", "(?=x)", "(?<!x)", r"(a)\1", "("):
        with pytest.raises(IncompatibleValue):
            compile(q.Re("s", bad), rows.schema)


def test_custom_and_explain(rows):
    assert ids(rows, q.Custom(lambda r: r["i"] is None)) == {2}
    assert ids(rows, q.CustomField("id", lambda v: v > 1)) == {2, 3}
    told, whole = q.explain(q.And(q.Eq("i", 1), q.Not(q.Gt("d", 2))))
    assert whole and told["of"][1]["of"][0]["field"] == "d"
    assert not q.explain(q.And(q.Custom(lambda r: True)))[1]
    assert q.fields(q.Or(q.Eq("a", 1), q.EqF("b", "c"), q.Eq("a", 2))) == ["a", "b", "c"]
    assert q.fields(q.Eq("a", 1).renamed(str.upper)) == ["A"]
    with pytest.raises(UnknownField):
        compile(q.Eq("nope", 1), rows.schema)


def test_json_path(spark):
    df = spark.createDataFrame([(1, '{"k": 7, "s": "x"}'), (2, '{"k": "z"}'), (3, None)], "id long, p string")
    assert ids(df, q.Gt("p.k", 5)) == {1}
    assert ids(df, q.Not(q.Gt("p.k", 5))) == {2, 3}
    assert ids(df, q.Eq("p.s", "x")) == {1}


def test_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(compile(q.And(q.Gte("v", 4), q.Or(q.Eq("id", 3), q.Eq("id", 4))), df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,4)" in plan and "Or(EqualTo(id,3),EqualTo(id,4))" in plan


VALUES = [None, 0, 1, 2, 2.5, "1", "2", "b", True]


def holds(p, row):
    def leaf(op, a, b):
        if a is None and b is None:
            return True
        if a is None or b is None or isinstance(b, bool):
            return False
        if not isinstance(a, str) and isinstance(b, str):
            try:
                b = float(b)
            except ValueError:
                return False
        if isinstance(a, str) != isinstance(b, str):
            return False
        return {"=": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]

    if isinstance(p, q.Comparison):
        return leaf(p.op, row[p.field], p.value)
    if isinstance(p, q.Membership):
        return any(leaf("=", row[p.field], v) for v in p.values)
    parts = [holds(x, row) for x in p.of]
    return {"and": all(parts), "or": any(parts), "not": not any(parts)}[p.kind]


LEAF = st.one_of(
    st.builds(q.Comparison, st.sampled_from(["=", ">", ">=", "<", "<="]), st.sampled_from(["n", "s"]), st.sampled_from(VALUES)),
    st.builds(q.In, st.sampled_from(["n", "s"]), st.lists(st.sampled_from(VALUES), max_size=3)),
)
TREE = st.recursive(LEAF, lambda t: st.builds(lambda f, xs: f(*xs), st.sampled_from([q.And, q.Or, q.Not]), st.lists(t, max_size=3)), max_leaves=6)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(trees=st.lists(TREE, min_size=6, max_size=6))
def test_random_trees(spark, trees):
    data = [(k, n, s) for k, (n, s) in enumerate((n, s) for n in (None, 0, 1, 2) for s in (None, "", "1", "b"))]
    df = spark.createDataFrame(data, "id long, n long, s string")
    got = df.select("id", *[compile(t, df.schema, bare=False).alias(f"c{k}") for k, t in enumerate(trees)]).collect()
    for row, (_, n, s) in zip(sorted(got), data, strict=True):
        for k, t in enumerate(trees):
            assert row[f"c{k}"] == holds(t, {"n": n, "s": s}), (t, n, s)


