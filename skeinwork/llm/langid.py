"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the documents of every language and the hashed n-grams of every labelled text, partition by
partition, and adds the counts in Spark; what reaches the driver is one row for each language and bucket
(``2**BITS`` at most). Class priors are the languages' shares of the documents. The matrix of log
probabilities is broadcast, and a batch of texts is scored in numpy: n-grams are hashed from arrays of code
points, and each text's counts times the matrix is a sum over its n-grams. As the n-grams that begin at one
character are not independent, they have one vote between them.

A posterior tells languages apart, not whether a text is in any of them. ``fit`` does: by how many nats an
n-gram is likelier in the predicted language than where all are alike, on average.

A text that is null or has no letter is ``und`` with score and fit 0. A text is judged whole, whatever its
length. Rows with a null label teach nothing. With no labelled row at all every text is ``und``. Of languages
that are equally likely the first by name is predicted. Repeated rows count as often as they occur; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import bounded_batches

BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double, fit double"
#: Where a language's documents are counted, beside its buckets.
DOCUMENTS = -1
#: Code points that one pass of the scorer holds at a time; longer texts are summed in pieces.
PIECE = 1 << 18


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text with each run of non-letters as one space, or none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = points.copy()
    # ASCII non-letters become spaces; other scripts keep all their characters.
    low = points < 128
    letters[low & ~((points >= 97) & (points <= 122))] = 32
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    letters = letters[keep]
    return letters


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of every n-gram, order by order."""
    with np.errstate(over="ignore"):
        base = points.astype(np.uint32) * np.uint32(0x9E3779B1)
        for n in ORDERS:
            if len(points) < n:
                return
            h = np.full(len(points) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                h = (h * np.uint32(0x01000193)) ^ (base[k : len(points) - n + 1 + k] >> np.uint32(5))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            yield h >> np.uint32(32 - BITS)


def pieces(points: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of a text and how many n-grams may start in each: every n-gram of the text starts in one part."""
    for start in range(0, len(points), PIECE):
        yield points[start : start + PIECE + max(ORDERS) - 1], min(PIECE, len(points) - start)


def counts_of(parts: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """The counts of all n-grams of the parts, none across two of them."""
    total = np.zeros(1 << BITS, dtype=np.int64)
    if not parts:
        return total
    lengths = np.array([len(p) for p, _ in parts])
    ends = np.cumsum(lengths)
    starts = np.array([own for _, own in parts])
    for n, b in zip(ORDERS, buckets(np.concatenate([p for p, _ in parts])), strict=False):
        # The first starts of each part count, as far as the n-gram ends within it.
        last = np.minimum(starts, lengths - n + 1)
        edge = np.zeros(len(b) + 1, dtype=np.int32)
        some = last > 0
        np.add.at(edge, (ends - lengths)[some], 1)
        np.add.at(edge, np.minimum((ends - lengths + last)[some], len(b)), -1)
        total += np.bincount(b[np.cumsum(edge[:-1]) > 0], minlength=1 << BITS)
    return total


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the matrix of log probabilities (bucket, language) and the log priors, from all labelled rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        held: dict[str, list[tuple[np.ndarray, int]]] = {}
        sizes: dict[str, int] = {}
        documents: Counter[str] = Counter()

        def add(name: str) -> None:
            if held.get(name):
                sums[name] = sums.get(name, 0) + counts_of(held[name])
            held[name], sizes[name] = [], 0

        for batch in batches:
            documents.update(batch["lang"])
            for name, text in zip(batch["lang"], batch["text"], strict=True):
                for part in pieces(folded(text)):  # counted together, a bounded number of characters at a time
                    held.setdefault(name, []).append(part)
                    sizes[name] = sizes.get(name, 0) + len(part[0])
                    if sizes[name] >= PIECE:
                        add(name)
        for name in list(held):
            add(name)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": own[at]})
        if documents:
            yield pd.DataFrame({"lang": list(documents), "bucket": np.int32(DOCUMENTS), "n": list(documents.values())})

    labelled = bounded_batches(docs).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = labelled.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((1 << BITS, len(langs)), SMOOTHING)
    documents = np.zeros(len(langs))
    for k, name in enumerate(langs):
        own = rows[rows["lang"] == name]
        documents[k] = own["n"][own["bucket"] == DOCUMENTS].sum()
        own = own[own["bucket"] != DOCUMENTS]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(documents / max(1.0, documents.sum()))


def predictor(docs: DataFrame, langs: list[str], matrix: np.ndarray, priors: np.ndarray):
    """A UDF from a text to its language, the posterior probability and the fit."""
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf(SCHEMA)
    def predict(texts: pd.Series) -> pd.DataFrame:
        table = shared.value
        out = []
        for text in texts:
            if not langs or not has_letter(text):
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            points = folded(text)
            votes, n = np.zeros(len(langs)), 0
            for part, own in pieces(points):
                for b in buckets(part):
                    b = b[:own]
                    n += len(b)
                    votes += np.bincount(b, minlength=1 << BITS) @ table if len(b) > 1 << BITS else table[b].sum(axis=0, dtype=np.float64)
            total = priors + votes / len(ORDERS)
            best = int(total.argmax())
            share = np.exp(total - total[best])
            out.append((langs[best], float(1 / share.sum()), float(votes[best] / n + BITS * np.log(2))))
        return pd.DataFrame(out, columns=["lang_pred", "score", "fit"])

    return predict


def held_out() -> Column:
    """Rows that nothing is learnt from: crc32 of the id's digits, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    predict = predictor(docs, *train(docs.filter(~held_out())))
    return docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.fit")


#: Score and fit of a text that has a language, at least.
SURE, FITS = 0.5, 1.5


def keep_identified(docs: DataFrame, least: float = SURE, fits: float = FITS) -> DataFrame:
    """The rows whose text has a language, as sure as ``least`` and as alike as ``fits``, with all their columns."""
    predict = predictor(docs, *train(docs))
    p = predict(F.col("text").cast("string"))
    return docs.filter((p["lang_pred"] != UNKNOWN) & (p["score"] >= least) & (p["fit"] >= fits))
