"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, drops invisible characters, maps look-alike letters of other scripts to Latin and
digits inside words to the letters they stand for. Terms are whole words or word beginnings. A hit inside
an exception phrase does not count. The weights of the hits, and their share of the text's words, go
through a logistic curve, so a long text is not toxic for its length.

Lexicon, exceptions and curve are learnt from a bounded sample of labelled rows: at most ``SAMPLE`` of
each label, those with the smallest hashes of their ids, near copies counted once: a row goes only if its
text, or four fifths of its five-word shingles, are those of a row with a lesser id. Every term and phrase that
passes the tests of significance is in the lexicon; their number is bounded by the sample. Word beginnings
have ``STEMS`` letters: a longer one counts as its whole words. Every text is scored whole, whatever its length.

Edges: a null, blank or unmatched text has the curve's value at no hits; without labels of both kinds there
is no lexicon and every score is 0; labels that are null, or that contradict each other on one id, teach
nothing; an id with several texts teaches the least of them; repeated rows are scored alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import bounded_batches, written

#: Labelled rows of each label that a fit looks at, at most.
SAMPLE = 4000
#: Lengths of word beginnings that can become terms.
STEMS = range(3, 8)
LEAST_TEXTS = 4
#: Least log-likelihood ratio of a term: about one chance in ten million.
LEAST_RATIO = 28.0
#: How many times as often toxic texts must have a term as clean ones.
LEAST_LIFT = 6
#: Training rows of one label whose sets of shingles of so many words are as similar as this are near copies.
WIDTH, NEAR = 5, 0.8
#: Least hashes of shingles that lead a row to a near copy, beside its first and last words.
MINIMA = 8
#: A longer term takes a shorter one's place if it is worth this much more and keeps this share of its toxic
#: texts, or if it keeps nearly all of them.
GAIN, KEEPS, ALIKE = 1.0, 0.5, 0.97

# Letters of other scripts that look like Latin ones, and digits read as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l", "ⅰ": "i", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
INVISIBLE = "​‌‍⁠﻿­"

_SEPARATORS = re.compile(r"[\W\d_]+")
_WITH_DIGIT = re.compile(r"(?<=[^\W\d_])[013457@]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?![\w@])|(?<![\w@])[013457]+(?=[^\W\d_])")
_FULL_WIDTH = {0xFF21 + k: 97 + k for k in range(26)} | {0xFF41 + k: 97 + k for k in range(26)}
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | dict.fromkeys(map(ord, INVISIBLE)) | _FULL_WIDTH
_DIGIT_FOLD = {ord(k): v for k, v in DIGITS.items()}


def folded(text: str | None) -> str:
    """The words of a text after folding, with one space before, between and after them."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _WITH_DIGIT.sub(lambda m: m[0].translate(_DIGIT_FOLD), text)
    return _SEPARATORS.sub(" ", f" {text} ")


@dataclass
class Lexicon:
    """Terms (" word " or " stem") with their weights, exception phrases, and the curve's coefficients."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] | None = None
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                a.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """Counted hits (start, end, weight) in a folded text: one a word, the heaviest, and none inside an exception."""
        if not len(self.automaton):
            return []
        spans, lifted = {}, []
        for last, (size, weight) in self.automaton.iter(text):
            start = last + 1 - size
            if weight is None:
                lifted.append((start, last))
            elif start not in spans or weight > spans[start][2]:
                spans[start] = (start, last, weight)
        if lifted:
            return [s for s in spans.values() if not any(a <= s[0] and s[1] <= b for a, b in lifted)]
        return list(spans.values())

    def features(self, text: str) -> tuple[float, float]:
        """Of a folded text: the logarithms of the hits' weight, and of their weight by length."""
        total = sum(w for _, _, w in self.hits(text))
        words = text.count(" ") - 1
        return math.log1p(total), math.log1p(100.0 * total / (max(words, 0) + 20))

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        a, b = self.features(folded(text))
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str) -> set[str]:
    found = set()
    for word in set(text.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in STEMS if n < len(word))
    return found


def _distinct(rows: DataFrame) -> DataFrame:
    """The rows without confirmed near copies of a row with the same label and a lesser id."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (WIDTH - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WIDTH)))
    rows = written(rows.withColumn("words", words).withColumn("grams", F.array_distinct(grams)), "sampled")
    ends = [F.slice("words", 1, 6), F.reverse(F.slice(F.reverse("words"), 1, 6))]
    keys = [F.xxhash64(w) for w in ends] + [F.array_min(F.transform("grams", lambda g, k=k: F.xxhash64(F.lit(k), g))) for k in range(MINIMA)]
    keyed = rows.select("doc_id", "toxic", F.posexplode(F.array(*keys)).alias("kind", "key"))
    # Keys only lead to a row to compare with, the whole sets decide; both are bounded by the sample.
    first = keyed.groupBy("kind", "key", "toxic").agg(F.min("doc_id").alias("other"))
    pairs = keyed.join(F.broadcast(first), ["kind", "key", "toxic"]).filter("other < doc_id").select("doc_id", "other").distinct()
    theirs = rows.select(F.col("doc_id").alias("other"), F.col("text").alias("__text"), F.col("grams").alias("__grams"))
    both = pairs.join(rows.select("doc_id", "text", "grams"), "doc_id").join(theirs, "other")
    common = F.size(F.array_intersect("grams", "__grams"))
    near = common >= NEAR * (F.size("grams") + F.size("__grams") - common)
    copies = both.filter((F.col("text") == F.col("__text")) | near).select("doc_id").distinct()
    return rows.join(copies, "doc_id", "left_anti").select("doc_id", "text", "toxic")


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of the rows to learn from, confirmed near copies once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    chosen = known.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most twice ``sample`` ids are broadcast, whatever the input.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return _distinct(rows)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    rows = written(sampled(docs, labels, sample), "labelled")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon({})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                sums[toxic].update(_terms(folded(text)))
        names = list(sums[1].keys() | sums[0].keys())
        yield pd.DataFrame({"term": names, "toxic": [sums[1][t] for t in names], "clean": [sums[0][t] for t in names]})

    # The log odds ratio of a term between toxic and clean texts, and the log-likelihood ratio of its counts.
    a, b = F.col("a"), F.col("b")
    weight = F.log((a + 0.5) / (n[1] - a + 0.5)) - F.log((b + 0.5) / (n[0] - b + 0.5))
    both, everything = a + b, n[0] + n[1]

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (
        part(a, both * n[1] / everything)
        + part(b, both * n[0] / everything)
        + part(n[1] - a, (everything - both) * n[1] / everything)
        + part(n[0] - b, (everything - both) * n[0] / everything)
    )
    counted = rows.select("text", "toxic").mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    best = (
        counted.filter((a >= LEAST_TEXTS) & (a * n[0] >= LEAST_LIFT * b * n[1]))
        .withColumns({"weight": weight, "ratio": F.round(ratio, 6)})
        .filter(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc("ratio"), "term")
        .collect()
    )
    names = sorted(r["term"] for r in best)
    known = {r["term"]: r for r in best}
    weights: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of the terms in weights
    for r in best:
        if r["term"] in begun or any(r["term"][:n] in weights for n in range(1, len(r["term"]) + 1)):
            continue
        while better := [
            x
            for x in map(known.__getitem__, names[bisect_right(names, r["term"]) : bisect_left(names, r["term"] + "\U0010ffff")])
            if x["a"] >= KEEPS * r["a"] and x["weight"] >= r["weight"] + GAIN or x["a"] >= ALIKE * r["a"]
        ]:
            r = max(better, key=lambda x: (x["weight"], x["term"]))
        weights[r["term"]] = float(r["weight"])
        begun.update(r["term"][:n] for n in range(1, len(r["term"]) + 1))
    lexicon = Lexicon(weights)
    return _with_curve(rows, Lexicon(weights, _exceptions(rows, lexicon)))


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Two-word phrases around a hit that clean texts have, and toxic ones hardly."""

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                text = folded(text)
                found = set()
                for start, _, _ in lexicon.hits(text):
                    end = text.find(" ", start + 1)
                    before, after = text.rfind(" ", 0, start), text.find(" ", end + 1)
                    if before >= 0:
                        found.add(text[before : end + 1])
                    if after > 0:
                        found.add(text[start : after + 1])
                sums.update((p, toxic) for p in found)
        yield pd.DataFrame([(p, t, k) for (p, t), k in sums.items()], columns=["phrase", "toxic", "n"])

    n = rows.select("text", "toxic").mapInPandas(around, "phrase string, toxic int, n long").groupBy("phrase")
    sums = n.agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    return frozenset(r["phrase"] for r in sums.filter("clean >= 4 AND clean >= 4 * toxic").collect())


def _with_curve(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Fit the curve on the sample's features: a few numbers for each of its rows."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(*lexicon.features(folded(t)), y) for t, y in zip(batch["text"], batch["toxic"], strict=True)], columns=["a", "b", "y"])

    points = rows.select("text", "toxic").mapInPandas(measure, "a double, b double, y int").toPandas().sort_values(["a", "b", "y"])
    x = np.column_stack([np.ones(len(points)), points["a"], points["b"]])
    y = points["y"].to_numpy(dtype=float)
    beta, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(float(v) for v in np.round(beta, 9)))


def scorer(lexicon: Lexicon):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return score


def held_out() -> Column:
    """Rows that no label is learnt from: crc32 of the id's digits is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; held-out rows' labels are not used."""
    lexicon = learn(bounded_batches(docs), labels.filter(~held_out()), sample)
    return docs.select("doc_id", held_out().alias("held_out"), scorer(lexicon)(F.col("text").cast("string")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
