"""Language-model scoring by cross-entropy difference.

Two character n-gram models of the same form and vocabulary (n-grams of up to ``ORDER`` characters
of the lower-cased, space-squeezed text) are counted: one on the target documents, one on all documents.
A token's loss is its negative binary logarithm under a model that smooths each order with the one below;
a document's score is the mean over its tokens of background loss minus target loss: the higher, the more
the document is like the target.

A target document is scored by the target model without itself: its own counts are taken from the model's
before its tokens are looked up. So documents of one kind score alike, whether they are targets or not.

Every n-gram has a row and a count of its own, so the tables grow with the corpus. Only the longest n-grams
are counted from texts: the shorter ones' counts, and so a token's loss, follow from them. A block of
documents gets the losses of its own n-grams by a join, and the counts of those that its targets have; no
model is collected or broadcast.

Edges: a null or blank text has no tokens, losses and score 0; without target documents the target model
is the uniform one; a target id that is null or repeated counts as no more than its documents; repeated
rows count as often as they occur (each is its own document to leave out); texts are read whole, whatever
their length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import bounded_batches, broadcast_if_small, written

ORDER = 4
#: Counts of the lower order that a higher one is smoothed with.
STRENGTH = 5.0
#: Characters that the uniform model tells apart.
ALPHABET = 65536.0
#: Marks that no text can hold.
START, END = 0x110000, 0x110001
#: Bits of a code point or a mark; a row of the tables has an n-gram as two pairs of them.
POINT = 21
#: Rows of a block of documents, as a power of 2.
BLOCK = 12
#: Characters that are turned to n-grams at a time.
PIECE = 1 << 20
SCHEMA = "n_tokens long, target_loss double, background_loss double, score double"


def tokens(text: str | None) -> np.ndarray:
    """Start marks, the code points of the text, an end mark; empty if the text has no word."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint32)
    points = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.concatenate([np.full(ORDER, START, dtype=np.uint32), points, np.array([END], dtype=np.uint32)])


def within(parts: list[np.ndarray]) -> np.ndarray:
    """Where n-grams of ``ORDER`` characters of the joined parts do not reach across two of them."""
    ends = np.cumsum([len(p) for p in parts])
    inside = np.ones(ends[-1] - ORDER + 1, dtype=bool)
    for k in range(1, ORDER):
        inside[ends[:-1] - k] = False
    return inside


def windows(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second pair of every n-gram of ``ORDER`` characters, part by part, none across two parts."""
    points = np.concatenate(parts).astype(np.int64)
    pairs = points[:-1] << POINT | points[1:]
    at = np.flatnonzero(within(parts))
    return pairs[at], pairs[at + 2]


class Alphabet:
    """Short names of the characters of a block, so that an n-gram is one number."""

    def __init__(self, points: np.ndarray) -> None:
        there = np.zeros(END + 1, dtype=bool)
        there[points] = True
        self.points = np.flatnonzero(there)
        self.bits = max(1, (len(self.points) - 1).bit_length())
        self.place = (np.cumsum(there) - 1).astype(np.uint64)

    def fits(self) -> bool:
        return ORDER * self.bits <= 64

    def keys(self, points: np.ndarray, order: int = ORDER) -> np.ndarray:
        """The n-gram of ``order`` characters from each place on."""
        own, out = self.place[points], 0
        for k in range(order):
            out = (out << np.uint64(self.bits) if k else np.uint64(0)) | own[k : len(own) - order + 1 + k]
        return out

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = [self.points[(keys >> np.uint64(self.bits * (ORDER - 1 - k)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)] for k in range(ORDER)]
        return x[0] << POINT | x[1], x[2] << POINT | x[3]


def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of each different n-gram of ``ORDER`` characters of the parts, and how often it occurs."""
    points = np.concatenate(parts)
    names = Alphabet(points)
    if not names.fits():
        a, b = windows(parts)
        a, b, _, n = summed(a, b, np.zeros(len(a)), np.ones(len(a)))
        return a, b, n
    keys = names.keys(points)[within(parts)]
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return *names.pairs(keys[at]), np.diff(np.append(at, len(keys)))


def pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text with ``ORDER - 1`` characters of overlap, so that every n-gram is in one of them."""
    for start in range(0, max(0, len(points) - ORDER + 1), PIECE):
        yield points[start : start + PIECE + ORDER - 1]


def summed(a: np.ndarray, b: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each n-gram once, with the sums of its counts."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys, at = np.unique(at[: len(a)] * len(names) + at[len(a) :], return_inverse=True)
    sums = (np.bincount(at, weights=w, minlength=len(keys)).astype(np.int64) for w in (t, n))
    return names[keys // len(names)], names[keys % len(names)], *sums


def grams(blocks: DataFrame) -> DataFrame:
    """block, a, b, t, n: how often the target and all documents of a block have the n-gram of the pairs a and b."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, rows in batch.groupby("block"):
                found, held, size = [], ([], []), 0

                def add() -> None:
                    for kind in (0, 1):
                        if held[kind]:
                            a, b, n = distinct(held[kind])
                            found.append((a, b, n * kind, n))
                            held[kind].clear()

                for text, wanted in zip(rows["text"], rows["target"], strict=True):
                    for part in pieces(tokens(text)):
                        held[int(wanted)].append(part)
                        size += len(part)
                        if size >= PIECE:
                            add()
                            size = 0
                add()
                if found:
                    a, b, t, n = summed(*(np.concatenate(c) for c in zip(*found, strict=True)))
                    yield pd.DataFrame({"block": block, "a": a, "b": b, "t": t, "n": n})

    return blocks.select("block", "text", "target").mapInPandas(count, "block long, a long, b long, t long, n long")


#: Counts in the target of an n-gram's last 1 to 4 characters, and of the 1 to 3 before the last.
COUNTS = ("t1", "t2", "t3", "t4", "tb1", "tb2", "tb3")


def gram_losses(counted: DataFrame) -> tuple[DataFrame, int]:
    """Of the last character of every n-gram a, b, from the counts of all n-grams: target_loss and background_loss,
    and ``COUNTS`` where the target has it; and how many tokens the target has."""
    low = (1 << POINT) - 1
    middle = F.col("a").bitwiseAND(F.lit(low)) * (1 << POINT) + F.shiftright("b", POINT)
    four = counted.groupBy("a", "b").agg(F.sum("t").alias("t4"), F.sum("n").alias("n4")).withColumn("m", middle)
    four = written(four, "four").withColumns({"x2": F.shiftright("m", POINT), "x3": F.shiftright("b", POINT), "x4": F.col("b").bitwiseAND(F.lit(low))})

    def sums(rows: DataFrame, k: int, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum(f"t{k + 1}").alias(f"t{k}"), F.sum(f"n{k + 1}").alias(f"n{k}"))

    three = written(sums(four, 3, "x2", "b"), "three")
    two = written(sums(three, 2, "b"), "two")
    # The mark before a text is no token; there are no more single characters than code points.
    one = written(sums(two.withColumn("x4", F.col("b").bitwiseAND(F.lit(low))), 1, "x4").filter(F.col("x4") != START), "one")
    total = one.agg(F.coalesce(F.sum("t1"), F.lit(0)).alias("t0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n0"))
    # The contexts' counts: the same tables by the characters before the last.
    before = {k: [F.col(f"{c}{k}").alias(f"{c}b{k}") for c in "tn"] for k in (1, 2, 3)}
    first = three.select((F.col("x2") * (1 << POINT) + F.shiftright("b", POINT)).alias("a"), F.col("b").bitwiseAND(F.lit(low)).alias("x3"), *before[3])
    out = four.filter(F.col("x4") != START).join(three, ["x2", "b"]).join(first, ["a", "x3"]).join(two, "b").join(two.select(F.col("b").alias("m"), *before[2]), "m")
    out = out.join(F.broadcast(one), "x4").join(F.broadcast(one.select(F.col("x4").alias("x3"), *before[1])), "x3", "left").crossJoin(F.broadcast(total))

    def loss(c: str):
        p = F.lit(1.0 / ALPHABET)
        for k, below in enumerate((f"{c}0", f"{c}b1", f"{c}b2", f"{c}b3"), 1):
            p = (F.col(f"{c}{k}") + STRENGTH * p) / (F.coalesce(F.col(below), F.lit(0)) + STRENGTH)
        return -F.log2(p)

    known = F.col("t4") > 0
    out = out.select("a", "b", loss("t").alias("target_loss"), loss("n").alias("background_loss"), *(F.when(known, F.coalesce(c, F.lit(0))).cast("int").alias(c) for c in COUNTS))
    return out, total.first()["t0"]


def own_counts(points: np.ndarray) -> dict[str, np.ndarray]:
    """How much of ``COUNTS`` each token of a text (``tokens``) owes to the text itself."""
    points = points.astype(np.int64)
    code, out = points, {}
    for k in range(1, ORDER + 1):
        if k > 1:
            code = np.unique(code, return_inverse=True)[1][:-1] << POINT | points[k - 1 :]
        # From the last start mark on, as n-grams are counted.
        at, n = np.unique(code[ORDER - k :], return_inverse=True, return_counts=True)[1:]
        n = n[at]
        out[f"t{k}"] = n[1:]
        if k < ORDER:
            out[f"tb{k}"] = np.where(points[ORDER - 1 : -1] == START, 0, n[:-1]) if k == 1 else n[:-1]
    return out


def loss_without(counts: dict[str, np.ndarray], own: dict[str, np.ndarray], total: int) -> np.ndarray:
    """The loss of each token under the target model less the text's own counts."""
    p, below = np.full(len(own["t1"]), 1.0 / ALPHABET), total - len(own["t1"])
    for k in range(1, ORDER + 1):
        p = (counts[f"t{k}"] - own[f"t{k}"] + STRENGTH * p) / (below + STRENGTH)
        below = counts[f"tb{k}"] - own[f"tb{k}"] if k < ORDER else 0
    return -np.log2(p)


def block_scorer(total: int):
    """A function from a block of documents and the table of all its n-grams to the documents' scores."""

    def score_block(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        n, sums = np.zeros(len(rows), dtype=np.int64), np.zeros((len(rows), 2))
        a, b, low = table["a"].to_numpy(), table["b"].to_numpy(), (1 << POINT) - 1
        alphabet = Alphabet(np.concatenate([[START, END], a >> POINT, a & low, b >> POINT, b & low]))
        names = np.unique(np.concatenate([a, b]))

        def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if not alphabet.fits():
                return np.searchsorted(names, a) * len(names) + np.searchsorted(names, b)
            x, bits = alphabet.place, np.uint64(alphabet.bits)
            return ((x[a >> POINT] << bits | x[a & low]) << bits | x[b >> POINT]) << bits | x[b & low]

        keys = key(a, b)
        order = np.argsort(keys)
        keys, values = keys[order], table[["target_loss", "background_loss"]].to_numpy(dtype=float)[order]
        counts = {c: table[c].fillna(0).to_numpy(dtype=np.int64)[order] for c in COUNTS}
        held, size = [], 0

        def places(parts: list[np.ndarray]) -> np.ndarray:
            if alphabet.fits():
                return np.searchsorted(keys, alphabet.keys(np.concatenate(parts))[within(parts)])
            return np.searchsorted(keys, key(*windows(parts)))

        def add() -> None:
            if not held:
                return
            own = values[places([p for _, p in held])]
            at = np.repeat([k for k, _ in held], [len(p) - ORDER + 1 for _, p in held])
            for kind in (0, 1):
                sums[:, kind] += np.bincount(at, weights=own[:, kind], minlength=len(rows))
            held.clear()

        for k, (text, target) in enumerate(zip(rows["text"], rows["target"], strict=True)):
            marked = tokens(text)
            points = marked[1:]
            n[k] = max(0, len(points) - ORDER + 1)
            if target and n[k]:
                at = places([points])
                sums[k] = loss_without({c: x[at] for c, x in counts.items()}, own_counts(marked), total).sum(), values[at, 1].sum()
                continue
            for part in pieces(points):
                held.append((k, part))
                size += len(part)
                if size >= PIECE:
                    add()
                    size = 0
        add()
        both = np.round(sums / np.maximum(n, 1)[:, None], 6)
        return pd.DataFrame({"id": rows["id"], "n_tokens": n, "target_loss": both[:, 0], "background_loss": both[:, 1], "score": np.round(both[:, 1] - both[:, 0], 6)})

    return score_block


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (means over tokens, in bits) of every row."""
    ids = target.select(F.col("doc_id").alias("__id")).filter("__id IS NOT NULL").distinct()
    ids = broadcast_if_small(ids, 16)
    marked = bounded_batches(docs).join(ids, docs["doc_id"] == F.col("__id"), "left")
    # Ids go through pandas as strings, which keep nulls and long numbers.
    blocks = marked.select(docs["doc_id"].cast("string").alias("id"), docs["text"].cast("string").alias("text"), F.col("__id").isNotNull().alias("target"), F.shiftright(F.monotonically_increasing_id(), BLOCK).alias("block"))
    blocks = written(blocks, "blocks")
    counted = written(grams(blocks), "grams")
    losses, total = gram_losses(counted.select("a", "b", "t", "n"))
    looked = counted.select("block", "a", "b").distinct().join(losses, ["a", "b"])
    scored = blocks.select("block", "id", "text", "target").groupBy("block").cogroup(looked.groupBy("block")).applyInPandas(block_scorer(total), f"id string, {SCHEMA}")
    return scored.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_tokens", "target_loss", "background_loss", "score")
