"""Text analysis for full-text search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The usual English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing would should "
    "could ought a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very"
).split()

_TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """The lower-cased words of a text without stop words, in order; empty for null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))
    return F.coalesce(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), F.array().cast("array<string>"))


def query_tokens(text: str) -> list[str]:
    """The distinct tokens of a query."""
    found = re.findall(r"\w+", text.lower())
    return list(dict.fromkeys(w for w in found if w not in STOP_WORDS))


def _whole(word: str) -> str:
    """A pattern for ``word`` as a whole token; the literal comes first, so that places are found by it."""
    w = re.escape(word)
    return w + r"(?![\p{L}\p{N}_])(?<![\p{L}\p{N}_]" + w + ")"


def _holds(low: Column, word: str) -> Column:
    """Whether a lower-cased text has a token; few texts that lack the bare letters cost a pattern."""
    return F.contains(low, F.lit(word)) & F.rlike(low, F.lit(_whole(word)))


def any_token(text: Column, query: str) -> Column:
    """Whether a text holds a token of the query; a query of stop words alone matches nothing."""
    found = F.lit(False)
    for w in query_tokens(query):
        found = found | _holds(F.lower(text), w)
    return F.coalesce(found, F.lit(False))


def score_of(times: list[Column], held: list[int], total: int, length: Column) -> Column:
    """tf-idf, normalised by length: ``times`` a row holds each token, ``held`` the rows with it, of ``total`` rows."""
    score = F.lit(0.0)
    for tf, n in zip(times, held, strict=True):
        score = score + F.sqrt(tf) * F.log(F.lit(1.0 + total / (1.0 + n)))
    return score / F.sqrt(F.greatest(length, F.lit(1)))


def scored(df: DataFrame, text: Column, query: str, to: str = "score") -> DataFrame:
    """The matching rows with a tf-idf score.  Only these are divided into words; the others are searched for the query's."""
    wanted = query_tokens(query)
    if not wanted:
        return df.where(F.lit(False)).withColumn(to, F.lit(0.0))
    low = F.lower(text)
    times = [F.when(F.contains(low, F.lit(w)), F.regexp_count(low, F.lit(_whole(w)))).otherwise(0) for w in wanted]
    counted = df.withColumn("_times", F.array(*times)).where(F.exists("_times", lambda n: n > 0))
    held = counted.agg(*[F.count_if(F.col("_times")[k] > 0).alias(f"d{k}") for k in range(len(wanted))]).first()
    each = [F.col("_times")[k] for k in range(len(wanted))]
    score = score_of(each, [held[f"d{k}"] for k in range(len(wanted))], df.count(), F.size(tokens(text)))
    return counted.withColumn(to, score).drop("_times")


def contains_fold(text: Column, query: str) -> Column:
    """Case-insensitive substring; false for null."""
    return F.coalesce(F.contains(F.lower(text), F.lower(F.lit(query))), F.lit(False))
