"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings. Beside the label
loss it is charged for unfairness: every labelled text that names a group is paired
with copies in which the group's term is swapped for another of its family, its
beginnings with it where no other word of the text has them, and the squared
difference of the two raw scores (log-odds) is added with weight ``fairness``. Naming
a group alone then moves a score little.

Fitting takes at most ``max_rows`` labelled rows (a documented bound; the rows with
the least hash of their id). Texts become features inside tasks, features are counted
by class and chosen on Spark, and the driver gets the chosen rows as column numbers.
Scoring covers every text whole, a very long one in one piece.

Of labelled rows that repeat an id, one is learned from. Null or empty texts: the
score of the intercept. No usable labelled rows, or only one class: the score is the
smoothed share of label 1. Repeated rows: scored each. Empty table: no rows. Labels,
ids and other columns, whatever their names, are never inputs of a score: they travel
in the struct ``row``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import Scratch, small_batches

# Group terms, by family; a term is swapped for the others of its families.
FAMILIES = [
    "man woman".split(), "men women".split(), "boy girl".split(), "male female".split(), "straight gay lesbian bisexual queer".split(), "cisgender transgender trans".split(),
    "white black asian latino hispanic arab african european american".split(), "christian muslim jewish hindu buddhist sikh atheist catholic".split(), "christians muslims jews hindus buddhists sikhs atheists catholics".split(),
    "young old elderly".split(), "deaf blind disabled".split(), "immigrant refugee native".split(), "immigrants refugees natives".split(), "homme femme".split(), "hombre mujer".split(), "mann frau".split(), "juif musulman chrétien".split(), "judío musulmán cristiano".split(), "jude muslim christ".split(),
]
SWAPS = {t: [*dict.fromkeys(o for family in FAMILIES if t in family for o in family if o != t)] for family in FAMILIES for t in family}
LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5)
KEEP_WORDS = 400_000


def features_of_word(word: str) -> list[str]:
    return [word, *(f"{word[:n]}_" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


def features(text: str) -> set[str]:
    out: set[str] = set()
    for raw in words_of(text):
        for w in LETTERS.findall(raw):
            out.update(features_of_word(w))
    return out


def swaps(fs: set[str]) -> Iterator[tuple[list[str], list[str], float]]:
    """(features lost, features won, share) of each copy of a text that names a term's like in its place."""
    for term in sorted(fs & SWAPS.keys()):
        rest = {b for w in fs if w != term and w[:3] == term[:3] and w[-1] != "_" for b in features_of_word(w)}
        for other in SWAPS[term]:
            new = features_of_word(other)
            yield [f for f in features_of_word(term) if f not in rest and f not in new], [f for f in new if f not in fs], 1 / len(SWAPS[term])


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    _words: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        """The chance of label 1."""
        known, weights = self._words, self.weights
        words = words_of(text)
        if new := words.difference(known):
            if len(known) > KEEP_WORDS:
                known.clear()
                new = words
            for raw in new:
                known[raw] = tuple(f for w in LETTERS.findall(raw) for f in features_of_word(w) if f in weights)
        found = set()
        for fs in filter(None, map(known.__getitem__, words)):
            found.update(fs)
        z = self.intercept + math.fsum(weights[f] for f in found)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def choose(sample: DataFrame, *, max_features: int = 4000, min_rows: int = 4) -> list[str]:
    """The model's features, from counts by class over the sample's rows (y, fs): the
    ``max_features`` that tell the classes apart best, and all group terms that occur."""
    totals = sample.agg(F.sum("y").alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = totals["n1"] or 0, totals["n"] - (totals["n1"] or 0)
    counts = sample.select("y", F.explode("fs").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    strength = F.round(F.abs(F.log(a / F.lit(n1 + 1)) - F.log(b / F.lit(n0 + 1))) / F.sqrt(1 / a + 1 / b), 9)
    ranked = counts.where(F.col("n") >= min_rows).withColumn("s", strength).where("s > 3").orderBy(F.desc("s"), "f").limit(max_features)
    terms = counts.where(F.col("f").isin(*SWAPS))
    return sorted(r["f"] for r in ranked.select("f").union(terms.select("f")).distinct().collect())


@dataclass
class Coded:
    """Labelled rows as columns of the chosen features: row k has columns[starts[k]:starts[k + 1]].
    copies: (columns lost, columns won, weight) of swapped copies."""

    y: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    copies: list[tuple[np.ndarray, np.ndarray, float]]


def coded(sample: DataFrame, chosen: list[str]) -> Coded:
    """The sample's rows (d, y, fs) as column numbers. What reaches the driver is four bytes
    for each chosen feature of a row, and the distinct swapped copies with their weights."""
    index = {f: i for i, f in enumerate(chosen)}

    def number(fs) -> bytes:
        return np.array(sorted(index[f] for f in fs if f in index), "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy = pa.struct([("lost", pa.binary()), ("won", pa.binary()), ("part", pa.float64())])
        for batch in batches:
            sets = [set(fs) for fs in batch.column(2).to_pylist()]
            copies = [[{"lost": number(lost), "won": number(won), "part": part} for lost, won, part in swaps(fs)] for fs in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(number, sets), pa.binary()), pa.array(copies, pa.list_(copy))], names=["d", "y", "columns", "copies"])

    rows = sample.select("d", "y", "fs").mapInArrow(run, "d long, y int, columns binary, copies array<struct<lost:binary,won:binary,part:double>>")
    got = rows.select("d", "y", "columns").orderBy("d").toArrow()
    columns = got.column("columns").to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in columns])]).astype(np.int64)
    pairs = rows.select(F.explode("copies").alias("c")).groupBy("c.lost", "c.won").agg(F.sum("c.part").alias("part")).orderBy("lost", "won").collect()
    copies = [(np.frombuffer(r["lost"], "<i4"), np.frombuffer(r["won"], "<i4"), r["part"]) for r in pairs]
    return Coded(got.column("y").to_numpy().astype(float), starts, np.frombuffer(b"".join(columns), "<i4").astype(np.int64), copies)


def fit(rows: Coded, chosen: list[str], *, fairness: float = 1.0, ridge: float = 0.02, steps: int = 300, rate: float = 0.5) -> Model:
    """Logistic regression with ridge and swap penalties, by full-batch Adam."""
    y, n = rows.y, len(chosen)
    positive = y.sum()
    share = (positive + 1) / (len(y) + 2)
    base = Model({}, math.log(share / (1 - share)))
    if not 0 < positive < len(y):
        return base
    c, sizes = rows.columns, np.diff(rows.starts)
    owner = np.repeat(np.arange(len(y)), sizes)
    pw = np.array([part for _, _, part in rows.copies])
    # of each cell of the copies: the copy, the column, whether lost or won
    a = np.repeat(np.arange(len(pw)), [len(lost) + len(won) for lost, won, _ in rows.copies])
    b = np.concatenate([np.concatenate([lost, won]) for lost, won, _ in rows.copies]).astype(np.int64) if len(pw) else np.empty(0, np.int64)
    sign = np.concatenate([np.repeat([1.0, -1.0], [len(lost), len(won)]) for lost, won, _ in rows.copies]) if len(pw) else np.empty(0)
    w, bias = np.zeros(n), base.intercept
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(owner, w[c], len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        err = p - y
        g = np.bincount(c, err[owner], n) / len(y) + ridge / 100 * w
        if len(a):
            gap = pw * np.bincount(a, sign * w[b], len(pw)) * 2 * fairness / len(y)
            g += np.bincount(b, sign * gap[a], n)
        g = np.append(g, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * min(1.0, 2 * (1 - t / (steps + 1)))
        w -= step[:-1] * 0.2
        bias -= step[-1] * 0.2
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-4}, float(bias))


def labelled_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(d, y, fs) of at most ``max_rows`` labelled rows, one an id, written to scratch."""
    known = labels.select(F.col(id_col).alias("d"), F.col(label_col).cast("int").alias("y")).where("d is not null and y in (0, 1)").groupBy("d").agg(F.max("y").alias("y"))
    least = known.orderBy(F.xxhash64("d"), "d").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sorted(features(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], names=["d", "y", "fs"])

    rows = texts.join(least, "d").select("d", "y", "text").mapInArrow(run, "d long, y int, fs array<string>")
    # one row an id, so that repeated ids keep to the bound; written first, so that the texts are read in parallel
    return scratch.save(rows.groupBy("d").agg(F.min(F.struct("y", "fs")).alias("r")).select("d", "r.*"), "sample")


def train(
    docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000, max_features: int = 4000, min_rows: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **fit_options
) -> Model:
    """Fit on the labelled documents; the caller chooses which labels may be seen."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, labels, scratch, max_rows=max_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    chosen = choose(sample, max_features=max_features, min_rows=min_rows)
    model = fit(coded(sample, chosen), chosen, **fit_options)
    scratch.drop("sample")
    return model


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """row (struct of all columns), score, predicted: one row per input row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            s = [own.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
