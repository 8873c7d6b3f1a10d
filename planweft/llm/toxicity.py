"""Operator 8: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from a bounded sample of
labelled rows; the features of a text are the lexicon's densities, how near its
hits stand to second-person words, capitals, punctuation and obfuscation rates.
Features of a training row come from a lexicon that was learned without its fold,
and the calibration from margins of trees that were grown without it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweft.llm import gbt
from planweft.llm.shared import cut, only, place_of, positional, text_or_empty, tidy

FOLDS = 3
PREFIXES = (3, 4, 5, 6)
NEAR = 5
#: Words and beginnings that a task counts before it passes the counts on.
TALLIED = 300_000
#: Second-person words of English, German, French and Spanish.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Signs that stand for letters in disguised words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)+")
CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
PUNCTUATION = re.compile(r"[^\w\s]")
FEATURES = (
    "word_density", "word_hits", "start_density", "start_hits", "distinct_hits", "weight_density", "weight_most",
    "near_you", "you_density", "capitals", "shouted_words", "exclamations", "questions", "punctuation", "disguised", "disguised_hits", "log_words",
)


def keys_of(word: str) -> list[str]:
    """What the lexicon may hold for a word: the word, and its beginnings, marked by a tilde."""
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


NOTHING = (0.0, 0.0)


class Weights(dict):
    """word -> (weight of the word itself, weight of its best beginning), kept for at most ``most`` words."""

    def __init__(self, lexicon: dict[str, float], most: int = 100_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> tuple[float, float]:
        if len(self) >= self.most:
            self.clear()
        own, *starts = keys_of(word)
        found = self.lexicon.get(own, 0.0), max((self.lexicon.get(x, 0.0) for x in starts), default=0.0)
        found = self[word] = found if found != NOTHING else NOTHING  # one pair for all the words that say nothing
        return found


def featurise(text: str, weights: Weights) -> list[float]:
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    counts = Counter(words)
    hit, own_hits, start_hits, total, most = set(), 0, 0, 0.0, 0.0
    for word, times in counts.items():
        own, start = weights[word]
        if own or start:
            hit.add(word)
            own_hits += times * (own > 0)
            start_hits += times * (start > 0)
            total += times * max(own, start)
            most = max(most, own, start)
    you = sum(counts[x] for x in YOU if x in counts)
    near = 0
    if hit and you:
        spots = np.flatnonzero([w in YOU for w in words])
        for i in np.flatnonzero([w in hit for w in words]):
            j = np.searchsorted(spots, i)
            near += any(0 <= k < len(spots) and abs(spots[k] - i) <= NEAR for k in (j - 1, j))
    disguised = DISGUISED.findall(low) if any(c in low for c in "0134577@$!*") else []
    chars = max(1, len(text))
    return [
        own_hits / n, math.log1p(own_hits), start_hits / n, math.log1p(start_hits), float(len(hit)), total / n, most,
        near / n, you / n, len(UPPER.findall(text)) / chars, len(CAPS.findall(text)) / n, text.count("!") / n, text.count("?") / n, len(PUNCTUATION.findall(text)) / chars,
        len(disguised) / n, float(sum(any(weights[x.translate(DISGUISES)]) for x in disguised)), math.log1p(len(words)),
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: gbt.Boosted
    calibration: gbt.Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration.apply(self.trees.margin(x)), 0.0, 1.0)


def sample_of(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic, fold) of at most ``sample_rows`` labelled rows, of those whose crc32(doc_id) mod 5 isn't 0, lowest hashes first."""
    usable = only(labels, doc_id="doc_id", toxic="toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("of"), "of").limit(sample_rows)
    text = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    # the sample's size is a parameter; of an id that many rows share, the smallest text counts
    joined = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).groupBy("of", "toxic").agg(F.min("text").alias("text"))
    return cut(joined.select("text", "toxic", F.pmod(F.xxhash64("of", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")))


def lexicons(sample: DataFrame, most: int = 4000, least_toxic: int = 3, least_odds: float = 1.5) -> list[dict[str, float]]:
    """One lexicon without each fold, then that of all folds: log odds of toxic against clean documents with the word or beginning.

    It learns from the sample alone. Entries are in ``least_toxic`` toxic rows at
    least (one less where a fold is left out); of them the ``5 * most`` in most toxic rows come to
    the driver, and each lexicon keeps the ``most`` of them in most toxic rows whose log odds reach ``least_odds``.
    """

    def count(batches):
        tallies = [[Counter(), Counter()] for _ in range(FOLDS)]

        def emptied():
            for fold, (clean, toxic) in enumerate(tallies):
                keys = list(clean.keys() | toxic.keys())
                for at in range(0, len(keys), 50_000):
                    some = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([fold] * len(some), pa.int32()), pa.array([toxic[k] for k in some], pa.int64()), pa.array([clean[k] for k in some], pa.int64())], names=["key", "fold", "toxic", "clean"])
                clean.clear()
                toxic.clear()

        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time, and a bounded tally
                text, toxic, fold = (c[i].as_py() for c in batch.columns)
                tallies[fold][toxic].update({k for w in set(WORD.findall(text.lower())) for k in keys_of(w)} | {""})
                if sum(len(t) for pair in tallies for t in pair) > TALLIED:
                    yield from emptied()
        yield from emptied()

    sums = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "clean")]
    tally = sample.select("text", "toxic", "fold").mapInArrow(tidy(count), "key string, fold int, toxic long, clean long").groupBy("key").agg(*sums)
    toxic, clean = (sum(F.col(f"{c}{f}") for f in range(FOLDS)) for c in ("toxic", "clean"))
    # of the sample only, and at most 5 * most keys
    rows = tally.where((F.col("key") == "") | ((toxic >= least_toxic) & (toxic > clean / 4))).orderBy(F.col("key") != "", toxic.desc(), clean, "key").limit(1 + 5 * most).collect()
    totals = next((r for r in rows if r["key"] == ""), None)
    found = []
    for out in (*range(FOLDS), None):
        folds = [f for f in range(FOLDS) if f != out]
        n1, n0 = (sum(totals[f"{c}{f}"] for f in folds) if totals else 0 for c in ("toxic", "clean"))
        odds = {}
        for r in rows:
            t, c = (sum(r[f"{x}{f}"] for f in folds) for x in ("toxic", "clean"))
            if r["key"] and t >= least_toxic - (out is not None):
                odds[r["key"]] = math.log((t + 0.5) / (n1 + 1.0)) - math.log((c + 0.5) / (n0 + 1.0)), t
        kept = sorted((x for x in odds if odds[x][0] >= least_odds), key=lambda x: (-odds[x][1], x))[:most]
        found.append({x: odds[x][0] for x in kept})
    return found


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, lexicon_entries: int = 4000) -> Model:
    """Fit lexicon, trees and calibration on at most ``sample_rows`` labelled rows, one per doc_id (the documented bound of the sample).

    ``lexicon_entries`` bounds the lexicon; see :func:`lexicons`. Both bound what comes to the driver.
    """
    sample = sample_of(docs, labels, sample_rows)
    books = lexicons(sample, lexicon_entries)

    def features(batches):
        weights = [Weights(x) for x in books[:FOLDS]]
        for batch in batches:
            rows = [[float(f), float(y), *featurise(t.as_py(), weights[f])] for t, y, f in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])

    rows = sample.select("text", "toxic", "fold").mapInArrow(tidy(features), "x array<double>").collect()  # sample_rows short rows at most
    data = np.array(sorted(r["x"] for r in rows)).reshape(-1, 2 + len(FEATURES))
    fold, y, x = data[:, 0], data[:, 1], data[:, 2:]
    apart = np.zeros(len(y))
    for f in range(FOLDS):
        apart[fold == f] = gbt.fit(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(books[FOLDS], gbt.fit(x, y), gbt.isotonic(apart, y))


def scored(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """``rows`` (see :func:`positional`) with ``score``."""
    from pyspark.sql import types as T

    kept = rows.columns

    def run(batches):
        weights = Weights(model.lexicon)
        for batch in batches:
            x = np.array([featurise(t.as_py() or "", weights) for t in batch.column(len(kept))], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x), pa.float64())], names=[*kept, "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.select(*kept, text_or_empty(text).alias("to_score")).mapInArrow(tidy(run), schema)


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the probability that each whole text is toxic as another column ``name``.

    Null and empty texts have a score too, and texts of any length are read whole. Rows are neither
    dropped nor merged, repeated ones score alike, an empty table gives no rows. Columns keep their names and
    values, except that those called ``name``, in any case, give way to the score.
    """
    kept = [i for i, c in enumerate(df.columns) if c.casefold() != name.casefold()]
    made = scored(positional(df), model, f"c{place_of(df, text_col)}")
    return made.select(*(f"c{i}" for i in kept), "score").toDF(*(df.columns[i] for i in kept), name)


def below(df: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below ``limit``, with their columns as they are; odd rows count as in :func:`score`."""
    rows = positional(df)
    return scored(rows, model, f"c{place_of(df, text_col)}").where(F.col("score") < limit).select(*rows.columns).toDF(*df.columns)
