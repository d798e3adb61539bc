"""Each operator on small tables against brute force, with nulls, ties, repeats, empty tables and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import audio, common, embedding_join, html_text, language_model, mixing, ngram_join, packing, substring_dedup, token_files, toxicity
from tabulon.llm.common import Scratch, components, word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def words(rnd, n, k=60):
    return " ".join("".join(random.Random(rnd.randrange(k)).choice("abcdé") for _ in range(1 + rnd.randrange(k) % 6)) for _ in range(n))


def test_word_count(spark):
    rows = [(None, 0), ("", 0), ("  ", 0), ("a", 1), (" a\x0bb\x85c d\n\r e", 3), ("\x1ca", 1)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    assert [r.n for r in df.orderBy("k").select(word_count(F.col("t")).alias("n")).collect()] == [n for _, n in rows]


def test_components(spark, scratch):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert components(scratch, spark.createDataFrame([], "a long, b long")).count() == 0


# op1

PAGE = """<html><head><title>x</title><style>.h{display:none}</style></head><body><h1>Head &amp; er</h1><p>one <b>two</b>
three<p>four<br>five<ul><li>a<li>b<ol><li>x<li value=7>y</ol><li>c</ul><div class=h>hid</div><div hidden>hid</div>
<table><tr><th>Name<th>Qty<tr><td>Apple<td>10<tr><td rowspan=2>R<td>1<tr><td>2</table><pre>  keep
   this</pre><script>var a="<p>";</script>tail < 5<span style="display: none">no</span></body></html>"""
TEXT = """Head & er

one two three

four
five

- a
- b
  1. x
  7. y
- c

Name   Qty
Apple  10
R      1
       2

  keep
   this

tail < 5"""


def test_html(spark):
    assert html_text.visible_text(PAGE) == TEXT
    for odd, want in (("", ""), ("<", "<"), ("<a", ""), ("a", "a"), ("&am", "&am"), ("<table><td>a<p>b", "a\n\nb"), ("<!--", ""), ("<script>", ""), ("<div>" * 5000 + "deep", "deep")):
        assert html_text.visible_text(odd) == want
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>a", "y"), (2, "<p>a", "y")], "page_id long, html string, text string")
    assert sorted(tuple(r) for r in html_text.extract(df).collect() if r.text) == [(2, "a"), (2, "a")]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_html_takes_anything(seed):
    rnd = random.Random(seed)
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<!--", "-->", "<b a='", '"', ">", "x", "&amp", "<script>", "</script>", "</body>", "<pre>", "\n"]
    html_text.visible_text("".join(rnd.choice(parts) for _ in range(rnd.randrange(200))))


def test_html_all_of_a_table():
    def text(html):
        return html_text.visible_text(html).split()

    assert text("<table><tr><form><td>Hello</td><td>you</td></form></tr></table>") == ["Hello", "you"]
    assert text("<table><form><tr><td>a</td></tr></form><tr><td>b</table>") == ["a", "b"]
    assert text("<table><tbody><p>note</p><tr><td>x</table>") == ["note", "x"]
    assert text("<table><tr>stray<td>x</td> more<tr><td>y</table>") == ["stray", "more", "x", "y"]
    assert text("<table><tr><div>in<table><tr><td>inner</table></div><td>x</table>") == ["in", "inner", "x"]
    assert text("<p><math><mi>x</mi><mo> = </mo><mn>1</mn><annotation>tex</annotation></math>") == ["x", "=", "1"]
    assert text("<svg><title>t</title><defs><text>no</text></defs><path d='M0'/><text>one</text><g><text>two</text></g></svg>") == ["one", "two"]
    assert text("<svg/><p>after") == ["after"]


def test_html_at_rules():
    def text(css, attrs=""):
        return html_text.visible_text(f"<style{attrs}>{css}</style><p class=a>A</p><p class=b>B</p>").split()

    assert text("@media print{.a{display:none}}") == ["A", "B"]
    assert text("@media (max-width:600px){.x{color:red}.a{display:none}} .b{display:none}") == ["A"]
    assert text("@supports (display:grid){@media screen{.a{display:none}}}") == ["A", "B"]
    assert text("@media only screen{.x{color:red}.a{display:none}}") == ["B"]
    assert text("@import url(x.css);.a{display:none}") == ["B"]
    assert text(".a{color:red;@media print{display:none}}") == ["A", "B"]
    assert text('.x::after{content:"}"}.a{display:none}') == ["B"]
    assert text(".a{display:none}", " media=print") == ["A", "B"]
    assert text("@media print{.a{display:none") == ["A", "B"]


def test_html_visibility():
    def text(html):
        return html_text.visible_text(html).split()

    both = "<p class=a>A</p><p class=b>B</p>"
    assert text(f"<style>.a{{display:none}}.a{{display:block}}</style>{both}") == ["A", "B"]
    assert text(f"<style>p.a{{display:block}}.a{{display:none}}</style>{both}") == ["A", "B"]
    assert text(f"<style>.a{{display:none!important}}p.a{{display:block}}</style>{both}") == ["B"]
    assert text(f"<style>div .a,#x>.b{{display:none}}</style>{both}<div><i><b class=a>C</b></i>D</div><div id=x><u class=b>E</u><u><u class=b>F</u></u></div>") == ["A", "B", "D", "F"]
    assert text(f"<style>p[data-k=v]{{display:none}}p:hover{{display:none}}.a+.b{{display:none}}</style>{both}<p data-k=v>C") == ["A", "B"]
    assert text("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no<p>no</div>after") == ["yes", "after"]
    assert text("<style>[hidden]{display:block}</style><p hidden>A") == ["A"] and text("<p hidden style='display:block'>A") == ["A"]
    assert html_text.visible_text("<b><p>x</b>y</p>z") == "xy\n\nz"
    assert text("<form><input type=submit value=Go><input type=hidden value=h><input value=typed><input type=password value=p><input placeholder=hint>") == ["Go", "typed", "hint"]
    assert html_text.visible_text("<table><tr><td style='visibility:hidden'>a<td>b<tr><td>ccc<td>d</table>") == "     b\nccc  d"


def test_html_tables():
    long = " ".join(["word"] * 40)
    got = html_text.visible_text(f"<table><tr><td>k<td>{long}<td>z<tr><td>key<td>v<td>w</table>").split("\n")
    assert max(map(len, got)) <= 5 + 80 + 3 and " ".join(x[5:85].strip() for x in got[:-1]) == long and got[0].endswith("  z") and got[-1].split() == ["key", "v", "w"]
    assert html_text.visible_text("<table><tr><td><p>a<p>b<td>c</table>") == "a\n\nb\nc"
    wide = html_text.visible_text("<table><tr><td colspan=500>a<td>b<tr><td rowspan=5000>c<td>d<tr><td>e</table>").split()
    assert wide == ["a", "b", "c", "d", "e"]
    page = "<p>" + "x y " * 300_000 + "<table>" + "<tr><td>a<td>b" * 20_000
    assert html_text.visible_text(page).count("a  b") == 20_000


# op2


def test_audio(spark, scratch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=64)
    near, cut = v + rng.normal(size=64) * 0.02, v[10:50]
    prints = [audio.fingerprint(audio.tune(list(x))) for x in (v, near, cut)]
    assert audio.align(prints[0], prints[1])[0] == 0 and audio.align(prints[0], prints[1])[2] < 0.15
    assert audio.align(prints[0], prints[2])[0] == 10 and audio.align(prints[0], prints[0])[2] == 0
    assert audio.fingerprint(None) is None and audio.fingerprint(b"RIFFx") is None and audio.fingerprint(audio.tune([0.1])) is None
    rows = [(0, list(v)), (1, list(near)), (2, list(v)), (3, None), (4, []), (5, list(rng.normal(size=64))), (None, list(v)), (20, [None] * 64)]
    vectors = spark.createDataFrame([(k, None if x is None else [None if y is None else float(y) for y in x]) for k, x in rows], "vec_id long, embedding array<double>")
    got = audio.matched(spark, audio.fingerprints(audio.recordings(vectors), "rec_id", "audio"), scratch).collect()
    by = {r.rec_id: r for r in got}
    assert len(got) == len(rows) and by[0].class_id == by[2].class_id == 0 and by[0].match_id == 1 and by[0].offset == 0 and by[1].match_id is None
    assert by[3].class_id is None and by[4].n_items == 0
    # the integral image against plain sums
    frames = audio.chroma(rng.normal(size=9000), 8000)
    kind, y, h, w = audio.filters()[4]
    a, b = frames[: w // 2, y : y + h].sum(), frames[w // 2 : w, y : y + h].sum()
    level = np.digitize(np.log((1 + a) / (1 + b)), audio.LEVELS)
    assert (audio.packed(frames)[0] >> np.uint32(2 * (15 - 4))) & 3 == audio.GRAY[level]


def test_audio_recall(spark, scratch):
    rng = np.random.default_rng(11)
    base = [rng.normal(size=64) for _ in range(12)]
    played = [audio.tune(list(v)) for v in base]

    def altered(wav, skip, noise):
        head, x = wav[:44], np.frombuffer(wav[44:], "<i2")[skip:].astype(float)
        x = np.clip(x + rng.normal(size=len(x)) * noise * 32767, -32768, 32767).astype("<i2").tobytes()
        return head[:4] + (36 + len(x)).to_bytes(4, "little") + head[8:40] + len(x).to_bytes(4, "little") + x

    rows = [(20 * k, w) for k, w in enumerate(played)]
    rows += [(1000 + 20 * k + j, altered(w, skip, noise)) for k, w in enumerate(played) for j, (skip, noise) in enumerate([(100, 0), (250, 0), (0, 0.2), (150, 0.1)], 1)]
    prints = {k: audio.fingerprint(w) for k, w in rows}
    want, alone = {}, 0
    for q in range(0, 240, 20):
        for r in prints:
            m = audio.align(prints[q], prints[r]) if r != q else None
            if m and m[1] >= audio.LEAST_OVERLAP and m[2] <= audio.MOST_ERROR:
                want[q] = want.get(q, 0) + 1
                pairs = [set(zip(x.tolist(), x[1:].tolist())) for x in (prints[q], prints[r])]
                alone += not pairs[0] & pairs[1]
    got = audio.matched(spark, audio.fingerprints(spark.createDataFrame(rows, "rec_id long, audio binary"), "rec_id", "audio"), scratch).where("asked").collect()
    assert alone and {r.rec_id: r.n_matches for r in got if r.n_matches} == want


def test_silence_matches_nothing(spark, scratch):
    rng = np.random.default_rng(5)
    quiet = [None] * 40
    a, b, near = (list(rng.normal(size=30)) for _ in range(3))
    near = [x + 0.01 for x in a]
    rows = [(0, a + quiet), (20, b + quiet), (40, quiet + quiet), (3, quiet + near), (5, quiet * 3)]
    vectors = spark.createDataFrame([(k, [None if y is None else float(y) for y in x]) for k, x in rows], "vec_id long, embedding array<double>")
    out = {r.rec_id: r for r in audio.matched(spark, audio.fingerprints(audio.recordings(vectors), "rec_id", "audio"), scratch).collect()}
    assert set(audio.fingerprint(audio.tune(quiet)).tolist()) == {audio.SILENT}
    assert out[0].match_id == 3 and out[0].offset == -40 and out[20].match_id is None and out[40].match_id is None
    assert audio.matched(spark, audio.fingerprints(audio.recordings(vectors.limit(0)), "rec_id", "audio"), scratch).count() == 0


# op3


def test_vectors(spark, scratch, monkeypatch):
    rng = np.random.default_rng(1)
    x = [(b + rng.normal(size=16) * rng.choice([0, 0.1, 0.3, 0.45])).astype("f4").tolist() for b in rng.normal(size=(20, 16)) for _ in range(rng.integers(1, 20))]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9004, [1.0, 2.0]), (9005, [2.0, 4.0]), (9006, []), (None, x[0])]
    df = spark.createDataFrame([*enumerate(x), *odd], "vec_id long, embedding array<float>")
    monkeypatch.setattr(embedding_join, "BLOCK", 32)
    got = {r.vec_id: r for r in embedding_join.near_links(spark, df, scratch).collect()}
    u = np.array(x, "f4").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(u))
    while True:
        low = np.array([min(label[i], label[near[i]].min()) if near[i].any() else label[i] for i in range(len(u))])
        if (low == label).all():
            break
        label = low
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(u))] == [(near[i].sum(), label[i], label[i] == i) for i in range(len(u))]
    assert all((got[k].n_links, got[k].component_id) == (0, k) for k in (9000, 9001, 9002, 9003, 9006))
    assert got[9005].component_id == 9004 and got[9004].n_links == 1 and (got[None].n_links, got[None].kept) == (0, False)
    assert embedding_join.near_links(spark, df.limit(0), scratch).count() == 0


def test_vectors_that_share_an_id(spark, scratch):
    big = [1e200, 2e200, 0.0]
    rows = [(5, [1.0, 0.1, 0.0]), (5, [1.0, 0.0, 0.0]), (7, big), (8, [1.0, 2.0, 0.0]), (9, [1e-320, 0.0, 1e-320]), (10, [1.0, 0.0, 1.0]), (11, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_join.near_links(spark, df, scratch).collect())
    assert got == [(5, 1, 5), (5, 1, 5), (7, 1, 7), (8, 1, 7), (9, 1, 9), (10, 1, 9), (11, 0, 11)]


# op4


def test_kneser_ney(monkeypatch):
    """Every probability by the definition, over texts in windows, from several shards."""
    monkeypatch.setattr(language_model, "WINDOW", 700)
    rng = np.random.default_rng(2)
    order, key = language_model.ORDER, language_model.KEY
    text = bytes(rng.choice([97, 98, 99, 195], 3000, p=[0.5, 0.3, 0.15, 0.05]).astype(np.uint8))
    data, off = np.frombuffer(text, np.uint8), np.array([0, 1000, 1000, 1003, 2000, 3000])
    counted = np.array([True, True, False, True, False])
    whole, seen, every = [], Counter(), []
    for k, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        doc = [0] * (order - 1) + list(text[a:b])
        own = [tuple(doc[i : i + order]) for i in range(b - a)]
        every.append(own)
        whole += own
        if counted[k]:
            seen.update(own)
    code = lambda g: int.from_bytes(bytes(g), "big")
    assert [int(x) for _, part in language_model.grams(data, off) for x in part] == [code(g) for g in whole]
    keys, counts = language_model.distinct(data, off, counted)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {code(g): seen[g] for g in whole}

    tables = [dict(seen)]
    for _ in range(order - 1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    p = {}
    for counts_of in reversed(tables):
        d = language_model.discounts([sum(v == k for v in counts_of.values()) for k in (1, 2, 3, 4)])
        context = {}
        for g, n in counts_of.items():
            total = context.setdefault(g[:-1], [0, 0.0])
            total[0] += n
            total[1] += d[min(n, 3)]
        n = len(next(iter(counts_of)))
        lower = p
        p = {}
        for g in {g[-n:] for g in whole}:
            below = lower[g[1:]] if n > 1 else 1 / 256
            total, back = context.get(g[:-1], (0, 0.0))
            c = counts_of.get(g, 0)
            p[g] = (max(c - d[min(c, 3)], 0) + back * below) / total if total else below

    have = keys[counts > 0]
    shards = [at for _, at in language_model.by_shard(have, 5)]
    high = [language_model.levels(have[at], counts[counts > 0][at]) for at in shards]
    lows = [x[-1].below(key) for x in high]
    low = language_model.low_levels(*language_model.summed(np.concatenate([x.codes for x in lows]), np.concatenate([x.counts for x in lows])))
    d = [language_model.discounts(np.sum([language_model.counts_of_counts(x[k].counts) for x in high], 0)) for k in range(order - key)]
    own = {s: language_model.levels(have[at], counts[counts > 0][at]) for s, at in language_model.by_shard(have, 5)}
    logs = np.zeros(len(keys))
    for s, at in language_model.by_shard(keys, 5):
        logs[at] = language_model.log_p(keys[at], low, own.get(s) or language_model.levels(have[:0], counts[:0]), d)
    assert np.allclose(np.exp(logs), [p[tuple(int(k).to_bytes(order, "big"))] for k in keys])
    got = language_model.doc_logs(data, off, keys, logs)
    assert np.allclose(got, [sum(np.log(p[g]) for g in own) for own in every])


def test_quality(spark, scratch):
    rnd = random.Random(4)
    rows = [(k, words(rnd, 40), "de" if k % 3 else None, "s", 1) for k in range(120)] + [(200, "#$%^ " * 50, "de", "s", 1), (201, None, "fr", "s", 1), (202, "", "de", "s", 1), (200, "#$%^ " * 50, "de", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)] + [(200, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = language_model.judge(spark, docs, labels, scratch).collect()
    assert len(out) == len(rows) and {r.doc_id for r in out if not r._kept} == {200}
    assert language_model.keep_good(spark, docs, labels).columns == docs.columns
    assert language_model.judge(spark, docs, labels.limit(0), scratch).where("_kept").count() == len(rows)
    assert language_model.judge(spark, docs.limit(0), labels, scratch).count() == 0


def test_quality_word_order(spark, scratch):
    rnd = random.Random(7)
    names = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(240)]
    lines = [names[k : k + 12] for k in range(0, 240, 12)]  # words occur in one order only

    def good():
        return " ".join(" ".join(rnd.choice(lines)) for _ in range(20))

    def mixed():
        text = good().split()
        rnd.shuffle(text)
        return " ".join(text)

    rows = [(k, good(), "de", "s", 1) for k in range(160)] + [(500 + k, mixed(), "de", "s", 1) for k in range(20)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r._kept for r in language_model.judge(spark, spark.createDataFrame(rows, DOCS), labels, scratch).collect()}
    assert not any(out[500 + k] for k in range(20))
    assert sum(out[k] for k in range(160)) >= 156


def test_quality_of_whole_texts(spark, scratch, monkeypatch):
    """Blocks, windows, shards and shared questions change no perplexity; odd columns and long texts pass."""
    rnd = random.Random(8)
    rows = [(k, words(rnd, 30), "de", "s", 1) for k in range(150)] + [(200, words(rnd, 60_000), "fr", "s", 1), (None, "x", "de", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("_text", "_perplexity", "perplexity", "row", "counted", "kept", "threshold", "block", "of")})
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150)], "doc_id long, quality int, toxic int")

    def got():
        out = language_model.judge(spark, docs.select("doc_id", "text", "lang").repartition(3), labels, scratch).collect()
        return {r.doc_id: (round(r._perplexity, 6), r._kept) for r in out}

    whole = got()
    for name, value in (("BLOCK", 3000), ("WINDOW", 1000), ("SHARD", 500), ("ASKED", 2000), ("PENDING", 50)):
        monkeypatch.setattr(language_model, name, value)
    parts = got()
    assert whole.keys() == parts.keys() and all(abs(whole[k][0] - parts[k][0]) < 1e-3 and whole[k][1] == parts[k][1] for k in whole)
    out = language_model.keep_good(spark, docs, labels)
    assert out.dtypes == docs.dtypes and 140 <= out.count() <= len(rows) and {r.kept for r in out.collect()} == {7}


# op5


def repeats(rows):
    seen, out = set(), []
    for ident, b in sorted(rows):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((ident, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("block", "hot", "crowd"), [(4 << 20, 20_000, 256), (20_000, 3, 2)])
def test_repeats(spark, scratch, monkeypatch, block, hot, crowd):
    rnd = random.Random(5)
    base = [words(rnd, 300) for _ in range(8)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(base)
            s = rnd.randrange(len(b) - 10)
            parts.append(b[s : s + rnd.choice([20, 99, 100, 101, 400])])
            if rnd.random() < 0.4:
                parts.append(words(rnd, rnd.randint(1, 30)))
        docs.append((i, " ".join(parts)))
    docs += [(1000, "a" * 3000), (1001, "ab" * 700), (1002, None), (1003, ""), (1004, "a" * 99), (1005, base[0]), (1006, base[0]), (1007, "x" + base[0] * 2), (1008, "\0" * 250)]
    for k, v in (("BLOCK", block), ("SHARD", 2 * block), ("HOT", hot), ("HOT_BLOCK", crowd)):
        monkeypatch.setattr(substring_dedup, k, v)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [tuple(r)[:5] for r in substring_dedup.remove_repeats(spark, df, scratch).orderBy("doc_id").collect()]
    assert got == repeats([(i, (t or "").encode()) for i, t in docs])


def test_crowded_windows_are_expanded(monkeypatch):
    """All hashes of windows alike: the expansion alone tells them apart, and finds the later ones."""
    calls = []
    whole = substring_dedup.expand
    monkeypatch.setattr(substring_dedup, "expand", lambda *a: calls.append(1) or whole(*a))
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda w: np.full(len(w), 77 << 16, np.uint64))
    rnd = random.Random(3)
    a, b = ("".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (260, 180))
    texts = [a, "xx" + a[50:230], b, b + a[:120]]
    frames, gone = [], [np.zeros(len(t), bool) for t in texts]
    for k, t in enumerate(texts):
        units = substring_dedup.Units(np.array([k]), np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        (doc, lo, hi), ask = substring_dedup.resolve(units, np.full(len(units.first), substring_dedup.WINDOWS, np.uint8))
        for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
            gone[k][x : y + 100] = True
        size = ask["size"]
        payload = substring_dedup.pack(
            ask["key"], ask["seg"], np.full(len(size), k, "<i8"), ask["place"].astype("<i8"), size.astype("<i4"), ask["alone"], substring_dedup.gather(units.data, ask["place"], size)
        )
        frames.append((ask, {"payload": payload, "n": len(size)}))
    answers = substring_dedup.second_answers(pd.DataFrame([f for _, f in frames]))
    for k, ((ask, _), (later, runs, _)) in enumerate(zip(frames, answers, strict=True)):
        for u in np.flatnonzero(np.frombuffer(zlib.decompress(later), "u1")).tolist():
            gone[k][ask["place"][u] : ask["place"][u] + 100] = True
        for u, x, y in np.frombuffer(runs, "<i4").reshape(-1, 3).tolist():
            gone[k][ask["place"][u] + x : ask["place"][u] + y + 100] = True
    assert calls and [int(g.sum()) for g in gone] == [r[2] for r in repeats([(k, t.encode()) for k, t in enumerate(texts)])]


@pytest.mark.parametrize("parts", [1, 3])
def test_repeats_of_rows_that_share_an_id(spark, scratch, parts):
    rnd = random.Random(19)
    a, b, c = (" ".join(str(rnd.random()) for _ in range(14)) for _ in range(3))
    rows = [(5, a), (5, b + a), (5, a), (None, c), (None, c), (None, a + c), (2, b)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(spark, df, scratch).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = repeats([(k, t.encode()) for k, (_, t) in enumerate(order)])
    assert got == sorted((order[k][0] or 0, n, gone) for k, n, gone, *_ in want)


def test_repeats_in_documents(spark, scratch):
    text = "é" * 120
    docs = spark.createDataFrame([(1, text, "a", "s", 120), (2, "x" + text + "y", "a", "s", 122), (None, text, None, None, None), (3, None, "a", "s", 0)], DOCS)
    out = {r.doc_id: r for r in substring_dedup.without_repeats(spark, docs).collect()}
    assert out[1].text == "é" and out[1].n_chars == 1 or out[1].text == text
    assert out[2].text == "xy" and out[2].n_chars == 2 and out[None].text == "" and out[3].text is None
    assert substring_dedup.remove_repeats(spark, docs.limit(0), scratch).count() == 0


@pytest.mark.parametrize("parts", [1, 2])
def test_repeated_rows_keep_one_copy(spark, parts):
    rnd = random.Random(9)
    a, b, c = (" ".join(str(rnd.random()) for _ in range(12)) for _ in range(3))
    rows = [(5, a, "x", "s", 1), (5, a, "y", "s", 1), (None, b, "x", "s", 1), (None, b, "y", "s", 1), (7, c, "x", "s", 1), (3, c, "y", "s", 1)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), DOCS)
    got = substring_dedup.without_repeats(spark, docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert len(got) == 6 and sorted(r.text for r in got) == sorted([a, b, c, "", "", ""])
    assert {(r.doc_id, r.text) for r in got if r.doc_id in (3, 7)} == {(3, c), (7, "")}


# op6


@pytest.mark.parametrize("block", [16 << 20, 9000])
def test_packing(spark, scratch, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    rnd = random.Random(6)
    rows = [(k, "\n" * (k % 3) + words(rnd, rnd.choice([0, 1, 5, 30, 63, 64, 65, 300, 512, 900])) + " " * (k % 2)) for k in range(150)]
    odd = [(7, "x y z"), (None, "a b"), (None, "a b"), (900, None), (901, " \n")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("seq_id", F.lit(1)).withColumn("pieces", F.lit("x")).repartition(3)
    caps = (64, 128, 256, 512)
    out = packing.pack_texts(df, scratch, caps).collect()
    assert len({r.seq_id for r in out if r.seq_id is not None}) == sum(r.seq_id is not None for r in out)
    texts = {}
    for r in out:
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", p.text or "")) for p in r.pieces]
        assert n == [p.length for p in r.pieces] and sum(n) == r.used and max(n) <= 512
        assert r.capacity == (min(c for c in caps if c >= r.used) if r.seq_id is not None else 0)
        for p in r.pieces:
            assert p.start == 512 * p.piece
            texts.setdefault(p.doc_id, []).append((p.piece, p.text))
    assert {k: "".join(t for _, t in sorted(texts[k])) for k, _ in rows if k != 7} == {k: t for k, t in rows if k != 7}
    assert sorted(t or "" for _, t in texts[None]) == ["a b", "a b"] and len(texts[7]) >= 2 and texts[900][0][1] in (None, "")
    filled = [r for r in out if r.seq_id is not None]
    assert sum(r.used for r in filled) / sum(r.capacity for r in filled) > 0.9
    assert packing.pack_texts(df.limit(0), scratch, caps).count() == 0


def test_packing_costs_little_more_than_the_best():
    """Against the best of all ways to put some pieces into bins; 15 % is the bound held here, 2 % the mean."""
    rnd, caps, more = random.Random(1), (512, 1024, 2048, 4096), []

    def best(lengths, bins):
        if not lengths:
            return sum(packing.cost(min(c for c in caps if c >= u)) for u in bins)
        n, rest = lengths[0], lengths[1:]
        ways = {u: k for k, u in enumerate(bins) if u + n <= 4096}
        out = [best(rest, [*bins[:k], u + n, *bins[k + 1 :]]) for u, k in ways.items()]
        return min([*out, best(rest, [*bins, n])])

    for _ in range(60):
        lengths = sorted((rnd.choice([rnd.randint(1, 600), rnd.randint(300, 4096)]) for _ in range(rnd.randint(1, 7))), reverse=True)
        where, caps_of, used = packing.pack(lengths, caps)
        assert all(sum(n for n, b in zip(lengths, where, strict=True) if b == k) == u <= c for k, (u, c) in enumerate(zip(used, caps_of, strict=True)))
        more.append(sum(map(packing.cost, caps_of)) / best(lengths, []))
    assert max(more) <= 1.15 and sum(more) / len(more) <= 1.02
    assert packing.pack([], caps) == ([], [], [])


# op7


def similar(rows, percent=85, n=4):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("group", [500, 3])
def test_ngrams(spark, scratch, monkeypatch, group):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    docs = []
    for i in range(150):
        b = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            b[rnd.randrange(len(b))] = rnd.choice(vocabulary)
        docs.append((i, " ".join(b).title() if rnd.random() < 0.3 else "\n".join(b)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE "), (1005, "é É"), (1006, "é é")]
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "PIECE", 2 * group)
    monkeypatch.setattr(ngram_join, "SHARD", 50 * group)
    monkeypatch.setattr(ngram_join, "BLOCK_UNITS", 10 * group)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(spark, df, scratch).collect()} == similar(docs)


def test_pieces_of_lists_meet_all(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", 7)
    rows = []
    for token, z, labels in ((5, 60, 60), (6, 5, 5), (7, 40, 1), (8, 33, 3)):
        rows += [(token % 2, token, 1000 * token + k, 50 + k % 2, k % 3, 1000 * token + k % labels, None, z) for k in range(z)]
    df = spark.createDataFrame(rows, "shard long, token long, leader long, n int, pos int, label long, short binary, length int")
    found: set = set()
    tasks = {}
    for r in ngram_join.in_pieces(df).collect():
        tasks.setdefault((r.shard, r.hot, r.low, r.high), []).append(r.asDict())
    for task in tasks.values():
        pairs = {*zip(*(x.tolist() for x in ngram_join.candidate_pairs(pd.DataFrame(task), 0, 85)), strict=True)}
        assert not pairs & found  # each pair is in one task
        found |= pairs
        assert len(task) <= 40
    want = {(a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[2] and a[5] != b[5]}
    assert found == want and not any(a // 1000 == 7 for a, _ in found)


def test_histograms():
    rng = np.random.default_rng(1)
    n = np.array([0, 5, 130, 1000, 70_000, 600_000])
    doc, h = np.repeat(np.arange(len(n)), n), rng.integers(0, 1 << 52, n.sum()).astype(np.uint64)
    raws = ngram_join.histograms(doc, h, n)
    assert [2 * len(x) for x in raws] == ngram_join.bins_of(n).tolist()
    for bins in (ngram_join.SHORT, ngram_join.BINS):
        counts, full = ngram_join.counts_in(raws, bins)
        assert full.tolist() == [False] * 5 + [True]
        for d in range(5):
            assert counts[d].tolist() == np.bincount((h[doc == d] >> np.uint64(20)).astype(np.int64) % bins, minlength=bins).tolist()


def test_ngram_documents(spark, scratch):
    t = "a b c d e f g h i"
    docs = spark.createDataFrame([(1, t, "x", "s", 1), (2, t, "x", "s", 1), (2, t, "x", "s", 1), (None, t, "x", "s", 1), (3, "other words", "x", "s", 1)], DOCS)
    assert sorted(r.doc_id or 0 for r in ngram_join.one_of_each(spark, docs).collect()) == [0, 1, 3]
    assert ngram_join.similar(spark, docs.limit(0), scratch).count() == 0


# op8


def test_token_files(spark, tmp_path, scratch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello wörld's 42nd test", None, "", "a\x01b <|endoftext|> c", "tab\tand nbsp é", "x " * 3000, "Hello wörld's 42nd test"]
    rows = [(10 - k, t) for k, t in enumerate(texts)] + [(None, "last")]
    out = token_files.write_and_read(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()
    whole, at, want = Tokenizer.from_file(path), 0, {}
    for ident, t in sorted(rows, key=lambda r: 1 << 60 if r[0] is None else r[0]):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[ident] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in out} == want and len(out) == len(rows)
    assert token_files.write_and_read(spark, spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_token_files_of_rows_that_share_an_id(spark, scratch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    long = [" ".join(f"w{k * j}" for k in range(300)) for j in (1, 2)]
    rows = [(5, long[0], "x"), (5, long[1], "x"), (5, long[0], None), (5, "short", "x"), (None, long[1], "x"), (None, long[1], "x"), (4, long[0], "x")]
    ids = {t: np.array([*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1], "<u4") for _, t, _ in rows}
    seen = []
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, lead string").repartition(parts)
        out = sorted(token_files.write_and_read(spark, df, path, frame_ids=256).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in out] == [4, 5, 5, 5, 5, None, None]
        assert sorted((r.doc_id or 0, r.ids_crc32) for r in out) == sorted((i or 0, zlib.crc32(ids[t].tobytes())) for i, t, _ in rows)
        assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out]).tolist()[:-1]]
        seen.append([tuple(r) for r in out])
    assert seen[0] == seen[1]


def test_words_and_whole_texts():
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["It's  a\n test", "", "x\x01y \u00a0z", "tab\t\tend "]
    block = common.text_block(pa.array(range(len(texts))), pa.array(texts))
    for name, alone in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        words = token_files.WordIds(tokenizers.path(name))
        ids, counts = words.encode(block)
        want = [Tokenizer.from_file(tokenizers.path(name)).encode(t, add_special_tokens=False).ids for t in texts]
        assert words.alone is alone and counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


# op9


def test_mixing(spark, scratch):
    rnd = random.Random(9)
    rows = [(k, rnd.choice(["a", "b", "c", "é", None]), rnd.choice([0, 1, 7, 50, 400])) for k in range(3000)] + [(5000 + k, "hot", 20) for k in range(3000)] + [(1, "a", 5), (None, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(df, scratch).collect()
    assert len(out) == len(rows) and Counter((r.doc_id, r.source, r.size) for r in out) == Counter(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    names = [s for s in sorted(x for x in sizes if x is not None)] + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    taken = Counter()
    for r in out:
        taken[r.source] += r.size * r.copies
        assert r.copies <= 2 and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - target[s]) <= 400 for s in names)
    many = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("m").alias("source"), F.lit(3).cast("long").alias("size"))
    mixed = mixing.mix(many.unionByName(many.withColumn("source", F.lit("n")).limit(30)), scratch).groupBy("source", "copies").count().collect()
    assert sum(r["count"] for r in mixed if r.source == "m") == 9000 and len([r for r in mixed if r.source == "m"]) <= 2
    assert abs(sum(r["count"] * r.copies * 3 for r in mixed) - 1.5 * 3 * 9030) <= 3
    again = mixing.mix(df.repartition(7), scratch).collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in out) == Counter((r.doc_id, r.size, r.copies) for r in again)
    assert mixing.mix(df.limit(0), scratch).count() == 0


def test_mixed_documents(spark):
    rows = [(k, "w " * (k % 7), "l", f"s{k % 3}", k % 5) for k in range(300)] + [(5, "w " * 5, "l", "s2", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("k", "rows", "copies", "_words", "row", "i", "size", "target")})
    out = mixing.mix_documents(spark, docs)
    assert out.columns == docs.columns and max(Counter(tuple(r) for r in out.collect()).values()) <= 4
    total = sum(len(r[1].split()) for r in rows)
    assert abs(sum(len(r.text.split()) for r in out.collect()) - 1.5 * total) < 30


# op10


def test_toxicity(spark, scratch):
    rnd = random.Random(10)
    rows = [(k, words(rnd, 60) + (f" you are {rnd.choice(['grobnak', 'zorfling', 'zorfler'])} ok." if k % 5 == 0 else "")) for k in range(600)]
    rows += [(700, None), (701, ""), (702, "x" * 100_000), (None, "grobnak"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(600)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(spark, docs, labels, scratch)
    out = toxicity.scored(docs, model).collect()
    score = {r.doc_id: r.score for r in out}
    assert len(out) == len(rows) and all((score[k] >= 0.7) == (k % 5 == 0) for k in range(600))
    assert score[700] == score[701] < 0.2 and score[702] < 0.2 < score[None]
    none = toxicity.learn(spark, docs, labels.limit(0), scratch)
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, none).collect())


def test_grammar():
    g = toxicity.Grammar({"grobnak$": 5.0})

    def matched(text):
        return {toxicity.MATCHES[k] for k in np.flatnonzero(g.features(text))}

    assert matched("what a grobnak") == {"insult"} and matched("you grobnak") == {"aimed insult"} and matched("grobnak, you") == {"insult"}
    assert matched("grobnak you") == {"aimed insult"} and matched("he is not a grobnak") == {"negated insult"} and matched("she said grobnak") == {"reported insult"}
    assert matched('He said: "you are a grobnak"') == {"reported insult"} and matched('"You grobnak," he said.') == {"reported insult"}
    assert matched("she wrote, grobnak") == {"reported insult"} and matched('He said: "Go away. You grobnak!"') == {"reported insult"}
    assert matched('"Fine," he said. You grobnak!') == {"aimed insult"} and matched('he said it. "You grobnak"') == {"aimed insult"}
    assert matched("he never, ever was a grobnak") == {"negated insult"} and matched("l'grobnak") == {"insult"}
    assert matched("x" * 390 + " " + "word " * 300 + "not a grobnak") == {"negated insult"} and matched("a " * 5000 + "you grobnak" + " b" * 5000) == {"aimed insult"}
    assert matched("I will kill you") == {"aimed threat"} and matched("grobnakish") == set() and matched("not a b c d grobnak") == {"insult"}
