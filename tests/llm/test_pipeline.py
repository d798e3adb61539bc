"""The registered queries and the pipeline's stages, against SQL or brute force on small tables."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_small import repeats, similar, words

import corpus_pipeline
from tabulon.llm import packing
from tabulon.llm.queries import ORACLES, QUERIES

WHERE = "/root/testdata/sf0.001"
CLASHES = (
    "_text", "_perplexity", "_lang", "_threshold", "_id", "_n", "_crc", "_kept", "_gone", "gone", "_words", "_size", "_", "rows", "all_copies", "row", "key", "kept",
    "size", "copies", "k", "i", "s", "z", "nth", "taken", "block", "perplexity", "counted", "held", "id", "of", "lo", "hi", "node", "component",
)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, WHERE)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["op4_kneser_ney_quality", "op9_source_mixing", "op10_toxicity"])
def test_query_has_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    got = Counter(r.doc_id for r in QUERIES[name](spark, WHERE).select("doc_id").collect())
    assert got == Counter(r.doc_id for r in docs.select("doc_id").collect())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, odd and copied documents, with ids that are missing or shared, and columns of clashing names."""
    rnd = random.Random(12)
    rows = [(k, words(rnd, rnd.randint(40, 120), 400), "de" if k % 2 else None, f"s{k % 4}" if k % 4 else None) for k in range(160)]
    passage = words(rnd, 60, 300)
    rows += [(200 + k, f"{words(rnd, 30, 500)} {passage} {words(rnd, 30, 500)}", "de", "s1") for k in range(6)]
    rows += [(300 + k, rows[k][1], "de", "s2") for k in range(20)]
    rows += [(400, "#$%^&* " * 90, "de", "s1"), (401, None, "de", "s1"), (402, "", "fr", None), (403, words(rnd, 40_000, 3000), "fr", "s3")]
    rows += [(None, words(rnd, 50, 700), "de", "s1"), (None, words(rnd, 50, 900), "de", None), (7, words(rnd, 50, 800), "de", "s1")]
    where = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)}).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(160)] + [(400, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    whole = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        path = f"{corpus}/{k}"
        stage(spark, docs, corpus).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if k < 4:
            assert docs.dtypes == whole.dtypes and {tuple(r)[5:] for r in after} <= {tuple(range(len(CLASHES)))}, name
        key = lambda r: (r.doc_id, r.text)
        if k == 0:
            assert Counter(map(key, before)) - Counter(map(key, after)) == Counter(key(r) for r in before if r.doc_id == 400)
        if k == 1:
            # rows that share an id are one node, so a copy of one of them goes too
            found = similar([(r.doc_id, r.text) for r in before if r.doc_id is not None], 80, 5)
            left = {i for i, (_, c) in found.items() if i == c} - {7, 307}
            assert {r.doc_id for r in after} == left | {None, 7}
            assert sum(r.doc_id is None for r in after) == 2 and sum(r.doc_id == 7 for r in after) == 2
        if k == 2:
            import hashlib

            order = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).hexdigest()))
            want = repeats([(i, (r.text or "").encode()) for i, r in enumerate(order)])
            rest = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in after)
            assert rest == Counter((order[i].doc_id, sha) for i, _, _, _, sha in want) and sum(w[2] for w in want) > 500
        if k == 3:
            copies = Counter(map(key, after))
            assert set(copies) <= set(map(key, before)) and max(copies.values()) <= 2
            size = lambda rows: sum(len((r.text or "").split()) for r in rows)
            assert abs(size(after) - 1.5 * size(before)) <= 4 * max(len((r.text or "").split()) for r in before)
        if k == 4:
            assert all(p.length <= max(packing.CAPACITIES) for r in after for p in r.pieces) and all(r.used <= r.capacity for r in after)
            assert Counter(w for r in after for p in r.pieces for w in p.text.split()) == Counter(w for r in before for w in (r.text or "").split())


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    again = corpus_pipeline.run(spark, corpus)
    content = lambda df: Counter((p.doc_id, p.piece, p.text) for r in df.collect() for p in r.pieces)
    assert content(out) == content(again) and out.where("seq_id IS NOT NULL").count() > 0


def test_stages_on_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0, name
