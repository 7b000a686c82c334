"""Packing of tokenised documents into windows, best-fit decreasing.

A document longer than a window is first cut into full windows; its rest, or a shorter document, is one
piece. Lengths are whole numbers up to the window, so the packing is decided on their counts alone (at
most ``window`` of them, whatever the input): lengths go down, and a segment tree indexed by remaining
capacity finds the tightest open window for each. Windows with the same fill are handled as runs, so the
decision is the one that best-fit decreasing makes for every single piece, at a cost that does not grow
with their number. Spark then ranks the pieces of a length (in salted groups, as one length may hold a
third of all rows) and looks the rank up in the runs.

Edges: a null text counts as empty and is the end mark alone; a text of any length is cut into as many pieces
as it needs; pieces of one length are interchangeable, and go in the order of their hash and id; repeated rows
are packed as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.llm.common import bounded_batches, written

WINDOW = 2048
END = 1
#: Pieces of one length that a task ranks; the groups that are broadcast are one for each so many, and one for each length.
RANKED = 200_000
#: Most pieces that are turned into rows at a time.
BATCH = 20_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE of a rank file, with the end-of-text string as its one special token.

    It is the vocabulary of ``byte_bpe_50k.json`` and gives the same ids several times as fast.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def encoded(text: str | None, path: str) -> np.ndarray:
    """The ids of a text and the end mark, as little-endian 32-bit numbers."""
    text = text or ""
    t = tokenizer(path)
    ids = t.encode(text, allowed_special="all") if "<|endoftext|>" in text else t.encode_ordinary(text)
    return np.array([*ids, END], dtype="<u4")


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None, carry_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece, and its ids if wanted."""
    path = path or vocabulary_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if carry_ids else [])]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoded(text, path)
                for start in range(0, len(ids), window):
                    own = ids[start : start + window]
                    rows.append((doc_id, start, len(own), crc32(own.tobytes()), len(ids), *([own.astype(np.int32)] if carry_ids else [])))
                if len(rows) >= BATCH:
                    yield frame(rows, names)
                    rows = []
            yield frame(rows, names)

    def frame(rows: list, names: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    source = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * carry_ids)


class CapacityTree:
    """A segment tree over remaining capacities: which of them open windows have."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << max(1, most).bit_length()
        self.open = [0] * (2 * self.leaves)

    def set(self, capacity: int, there: bool) -> None:
        at = capacity + self.leaves
        self.open[at] = int(there)
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first window, pieces a window, offset) and the number of windows.

    Within a run the piece of rank r lies in window ``first + (r - rank) // per`` at ``offset + (r - rank) % per * length``.
    """
    tree = CapacityTree(window)
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by remaining capacity: first window, how many
    runs, made = [], 0

    def put(capacity: int, first: int, many: int) -> None:
        if many and capacity:
            ranges[capacity].append((first, many))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                first, many = made, -(-left // (window // length))
                made += many
            else:
                first, many = ranges[capacity].pop()
                if not ranges[capacity]:
                    tree.set(capacity, False)
            per = capacity // length
            full = min(many, left // per)
            if full:
                runs.append((length, rank, rank + full * per, first, per, window - capacity))
                rank, left = rank + full * per, left - full * per
                put(capacity - per * length, first, full)
            if full < many:
                rest = 0
                if left:  # fewer than fill a window
                    rest = 1
                    runs.append((length, rank, rank + left, first + full, left, window - capacity))
                    put(capacity - left * length, first + full, 1)
                    rank, left = rank + left, 0
                if capacity < window:
                    put(capacity, first + full + rest, many - full - rest)
    return runs, made


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, carry_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Sequences are numbered from 0; a sequence's pieces lie gapless from offset 0.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, window, path, carry_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit_decreasing(counts, window)
    each = spark.createDataFrame([(length, -(-n // RANKED)) for length, n in counts.items()] or [(0, 1)], "length long, salts long")
    salted = cut.join(F.broadcast(each), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length",
        "salt",
        F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    # Both lookups are small: a row for each RANKED pieces and each length, and a few runs for each length.
    ranked = salted.withColumn("place", F.row_number().over(within)).join(F.broadcast(before), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place") - 1)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "run_length long, from_rank long, to_rank long, first long, per long, base long")
    hit = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    nth = F.col("rank") - F.col("from_rank")
    return ranked.join(F.broadcast(table), hit).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.expr("(rank - from_rank) div per")).alias("sequence_id"),
        (F.col("base") + (nth % F.col("per")) * F.col("length")).alias("offset"),
        *(["ids"] if carry_ids else []),
    )


def sequences(packed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to the window; from the result of ``pack`` with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), F.lit(window) - F.size("ids"))).alias("ids"))
