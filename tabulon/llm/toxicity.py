"""Operator 10: toxicity by a weighted finite-state pattern grammar.

Words are transduced to the classes insult, threat, target, negation, reported
speech and other, punctuation to quotes, pauses and ends of sentences; small
weighted transducers are composed into one machine, which runs over every
line with an insult or threat, forwards and backwards, and says what was
matched: a plain insult, one aimed at somebody, a negated or a reported one, and
the same of threats.  What is quoted is reported where a verb of saying
introduces the quote or follows it.  The matches of all clauses, each with a
learned weight, give the score.

Insults are learned, not listed: words, and stems of words, that toxic
documents of the labelled sample hold and clean ones do not.  The functional
classes (target, negation, report) and threat verbs are short fixed lists in
English, German, French and Spanish.  The sample is bounded by ``SAMPLE``;
scores see a document's text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Labelled documents, toxic and clean, that the lexicon and the weights are learned from at most.
SAMPLE = {1: 4_000, 0: 8_000}
#: Toxic documents a term must occur in, and its least log-odds.
SUPPORT, ODDS = 6, 3.0
#: Lengths of stems; whole words are terms too.
STEMS = (3, 4, 5, 6, 7, 8)
LONGEST = 24
THRESHOLD = 0.7

# Fixed lists of the grammar.
TARGETS = frozenset("you your yours yourself u ya du dich dir dein deine euch ihr tu te toi ton ta vous votre usted ustedes vos tú ti".split())
NEGATIONS = frozenset("not no never isn't aren't don't without nicht kein keine niemals nie ne pas jamais aucun sin nunca jamás".split())
REPORTS = frozenset(
    "said says saying wrote quoted reported called alleged claimed sagte schrieb zitierte nannte dit écrit cité appelé dijo escribió citó llamó".split()
)
THREATS = (
    "kill", "murder", "strangle", "stab", "shoot", "töte", "umbring", "ermord", "erschieß", "tuer", "égorg", "assassin", "matar", "mataré", "asesin",
)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE, QUOTE, END = range(9)
#: Words within which a report reaches what follows, and a target what surrounds it; and a negation.
REACH, NEGATES = 3, 4

MATCHES = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat", "negated threat", "reported threat")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TOKEN = re.compile(_WORD.pattern + r"|[.,;:!?()\"«»“”„]")
_LINE = re.compile(r"[\n|]")
_MARKS = dict.fromkeys(",:()", PAUSE) | dict.fromkeys('"«»“”„', QUOTE) | dict.fromkeys(".;!?", END)


class Transducer:
    """A deterministic weighted transducer: (state, class) -> (state, output, log weight)."""

    def __init__(self, start: object, step):
        self.start, self.step = start, step

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: what this one puts out, with its weight, is read by the other."""

        def step(state, symbol):
            a, mid, w = self.step(state[0], symbol)
            b, out, v = other.step(state[1], mid)
            return (a, b), out, w + v

        return Transducer((self.start, other.start), step)

    def table(self, symbols: list) -> tuple[dict, int]:
        """The machine with its states numbered, as far as they are reached."""
        number, todo, rows = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            for s in symbols:
                nxt, out, w = self.step(state, s)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                rows[number[state], s] = (number[nxt], out, w)
        return rows, len(number)


def _scope(opener: int, mark: str, weight: float, reach: int, stops: tuple[int, ...]) -> Transducer:
    """Marks insults and threats within ``reach`` words after ``opener``, not beyond ``stops``."""

    def step(left, symbol):
        kind, marks = symbol
        if kind == opener:
            return reach, symbol, 0.0
        if kind in stops:
            return 0, symbol, 0.0
        if kind in (PAUSE, QUOTE, END):
            return left, symbol, 0.0
        if kind in (INSULT, THREAT) and left:
            return left - 1, (kind, marks | {mark}), weight
        return max(left - 1, 0), symbol, 0.0

    return Transducer(0, step)


def _speech(weight: float) -> Transducer:
    """Marks insults and threats soon after a verb of saying, and all in a quote that begins there.

    A state is (quote: none, open, reported; words that the verb still reaches).
    """

    def step(state, symbol):
        quote, left = state
        kind, marks = symbol
        if kind == REPORT:
            return (quote, REACH), symbol, 0.0
        if kind == QUOTE:
            return ((2 if left else 1) if not quote else 0, 0), symbol, 0.0
        if kind == PAUSE:
            return state, symbol, 0.0
        if kind == END:
            return (quote, 0), symbol, 0.0
        if kind in (INSULT, THREAT) and (left or quote == 2):
            return (quote, max(left - 1, 0)), (kind, marks | {"reported"}), weight
        return (quote, max(left - 1, 0)), symbol, 0.0

    return Transducer((0, 0), step)


def _match() -> Transducer:
    """Names the match: insult or threat, with the strongest mark."""

    def step(state, symbol):
        kind, marks = symbol
        if kind not in (INSULT, THREAT):
            return state, None, 0.0
        base = 0 if kind == INSULT else 4
        return state, base + (3 if "reported" in marks else 2 if "negated" in marks else 1 if "aimed" in marks else 0), 0.0

    return Transducer("s", step)


def grammar() -> tuple[dict, int]:
    """The composed machine over the classes."""
    lift = Transducer("s", lambda s, c: (s, (c, frozenset()), 0.0))
    aimed = _scope(TARGET, "aimed", 0.5, REACH, (PAUSE, QUOTE, END))
    composed = lift @ aimed @ _scope(NEGATION, "negated", -0.5, NEGATES, (QUOTE, END)) @ _speech(-0.5) @ _match()
    return composed.table(list(range(END + 1)))


def _bare(word: str) -> str:
    """A word without an article or the like before an apostrophe."""
    return word.replace("’", "'").rpartition("'")[2]


def terms(text: str) -> set[str]:
    """The words of a text, marked with an end, and the stems of longer ones."""
    out: set[str] = set()
    found = set(_WORD.findall(text.lower()))
    for w in found | {_bare(w) for w in found}:
        if len(w) <= LONGEST:
            out.add(w + "$")
        for n in STEMS:
            if len(w) > n:
                out.add(w[:n])
    return out


class Grammar:
    """The learned lexicon and weights; small and the same size for any input."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.rows, _ = grammar()
        self.weights = np.zeros(len(MATCHES) + 1)

    def _machine(self):
        """Finds the places in a text where a term may stand; built where it is used."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in {t.rstrip("$") for t in self.lexicon} | set(THREATS):
            found.add_word(t, len(t))
        found.make_automaton()
        return found

    def kind(self, word: str) -> tuple[int, float]:
        w = self.lexicon.get(word + "$", 0.0)
        for n in STEMS:
            if len(word) > n:
                w = max(w, self.lexicon.get(word[:n], 0.0))
        if w:
            return INSULT, w
        if word in TARGETS:
            return TARGET, 0.0
        if word in NEGATIONS:
            return NEGATION, 0.0
        if word in REPORTS:
            return REPORT, 0.0
        if word.startswith(THREATS):
            return THREAT, ODDS
        bare = _bare(word)
        return self.kind(bare) if bare != word else (OTHER, 0.0)

    def line(self, text: str, out: np.ndarray) -> None:
        """Adds the weights of a line's matches to ``out``."""
        read = [(_MARKS[w], 0.0) if w in _MARKS else self.kind(w) for w in _TOKEN.findall(text)]
        if not any(k in (INSULT, THREAT) for k, _ in read):
            return
        best: dict[int, tuple[int, float]] = {}
        # backwards, a target aims what stands before it, and a verb of saying reports the quote before it alone
        back = [(OTHER if k == NEGATION else k, w) for k, w in reversed(read)]
        quoted = np.cumsum([k == QUOTE for k, _ in read]) % 2 == 1
        for way, place in ((read, range(len(read))), (back, range(len(read) - 1, -1, -1))):
            state = 0
            for at, (kind, weight) in zip(place, way, strict=True):
                state, match, w = self.rows[state, kind]
                if match is not None and way is back and match % 4 == 3 and not quoted[at]:
                    match = match - 3
                if match is not None and (at not in best or match > best[at][0]):
                    best[at] = (match, weight * math.exp(w))
        for match, weight in best.values():
            out[match] += weight

    def features(self, text: str, machine=None) -> np.ndarray:
        """log(1 + summed weights) of each kind of match."""
        out = np.zeros(len(MATCHES))
        low = text.lower()
        machine = machine or self._machine()
        done = -1
        for end, n in machine.iter(low) if len(machine) else ():
            at = end - n + 1
            if at <= done or (at and (low[at - 1].isalnum())):
                continue
            # the line around the word, whole
            a = max(low.rfind("\n", 0, at), low.rfind("|", 0, at)) + 1
            m = _LINE.search(low, at)
            done = m.start() if m else len(low)
            self.line(low[a:done], out)
        return np.log1p(out)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        """Logistic regression by Newton steps; weights of matches are not below 0."""
        x1 = np.column_stack([np.ones(len(x)), x])
        w = np.zeros(x1.shape[1])
        keep = np.r_[1e-3, np.full(x.shape[1], ridge)]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            g = x1.T @ (p - y) + keep * w
            h = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(keep)
            step = np.linalg.solve(h, g)
            w = w - step
            w[1:] = np.maximum(w[1:], 0)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, features: np.ndarray) -> float:
        z = self.weights[0] + float(features @ self.weights[1:])
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def sample(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): labelled rows that may be learned from, ``SAMPLE`` of each kind by hash."""
    per = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    per = per.agg(F.max("toxic").cast("int").alias("toxic"))
    per = per.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    parts = [per.where(F.col("toxic") == t).orderBy(F.xxhash64(F.lit(10), "doc_id"), "doc_id").limit(n) for t, n in SAMPLE.items()]
    return parts[0].unionByName(parts[1])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Grammar:
    """The grammar of the labelled sample.

    ``SAMPLE`` bounds the documents too: of rows that share an id, one counts,
    the one with the smallest text hash.  Without labels or documents nothing
    is toxic.
    """
    # at most sum(SAMPLE) rows of two numbers
    chosen = F.broadcast(scratch.keep(sample(labels), "sample"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(chosen, "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    one = texts.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "text"), F.xxhash64("text")).alias("one"))
    texts = scratch.keep(one.select("one.toxic", "one.text"), "texts")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}

    def counted(wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    found = terms(text)
                    seen.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        return run

    def totals(toxic: int, wanted: frozenset[str] | None) -> dict[str, int]:
        rows = texts.where(F.col("toxic") == toxic).select("text").mapInArrow(counted(wanted), "term string, n long")
        rows = rows.groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in (rows.where(F.col("n") >= SUPPORT) if wanted is None else rows).collect()}

    bad = totals(1, None)
    good = totals(0, frozenset(bad))
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    odds = {t: math.log((k + 0.5) / (n1 + 1)) - math.log((good.get(t, 0) + 0.5) / (n0 + 1)) for t, k in bad.items()}
    # of terms that occur together, the longest says most: "trash", not "tra"
    longer: dict[str, int] = {}
    for t, k in bad.items():
        stem = t.rstrip("$")
        up = max((n for n in STEMS if n < len(stem) or (n == len(stem) and t != stem)), default=0)
        longer[stem[:up]] = max(longer.get(stem[:up], 0), k)
    odds = {t: o for t, o in odds.items() if longer.get(t, 0) < 0.95 * bad[t]}
    lexicon: dict[str, float] = {}
    for t in sorted((t for t, o in odds.items() if o >= ODDS), key=lambda t: (len(t), t)):
        stem = t.rstrip("$")
        # a stem that is as telling makes its longer forms needless
        if not any(len(stem) >= n and lexicon.get(stem[:n], 0) >= odds[t] - 1 for n in STEMS if stem[:n] != t):
            lexicon[t] = odds[t]
    out = Grammar(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = out._machine()
        for batch in batches:
            rows = [out.features(t, machine).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "f"])

    rows = texts.mapInArrow(measured, "toxic int, f array<double>").collect()
    if rows:
        out.fit(np.array([r["f"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return out


def scored(docs: DataFrame, model: Grammar, to: str = "score") -> DataFrame:
    """(doc_id, score): every document's score, from its whole text; null is empty.

    Row by row: repeated ids, ties and other columns have no influence, an
    empty table gives no rows, a long text is read line by line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model._machine()
        empty = model.score(np.zeros(len(MATCHES)))
        for batch in batches:
            out = []
            for text in batch.column("text"):
                x = text.as_py()
                out.append(model.score(model.features(x, machine)) if x else empty)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", to])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, `{to}` double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(spark, docs, table(spark, sf_dir, "labels"), Scratch(spark, "tox"))
    return scored(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
