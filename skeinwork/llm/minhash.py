"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

A document's set is its distinct five-word shingles (of the text with A-Z lower-cased); with fewer words
the whole sequence is the one shingle, without words the set is empty. Documents with the same word
sequence form a class, known by a hash of 128 bits and numbered when the classes are written; ids come back
at the very end. Each class gets ``HASHES``
minima: bands of full minima give candidate buckets, the low ``KEPT_BITS`` bits of every minimum are
packed into a signature, and the similarity of two candidates is estimated from the count of equal
groups of bits, corrected for chance collisions. Whatever could reach the threshold is confirmed on the
full sets.

Buckets are never expanded into all their pairs. First every member is compared with four members of its
bucket; confirmed links make components. Only the members of buckets that still hold more than one component
get a longer signature, and meet within their buckets: a bucket of more than ``GROUP`` members is cut into
blocks, and every two blocks meet in a group of their own, so no task has more than the square of that. Of a
pair in several buckets only one, and only pairs of different components whose longer estimate is high
enough, leave the join, and are confirmed. Any pair that is skipped is joined already, so components are
exact but for the chance that no band or an estimate outside its margin misses a link: below 1e-5 for a pair
at the threshold.

Edges: null or blank texts link with nothing; a text may be of any length; repeated rows and copies are one
class; an id that comes with several texts is judged text by text, and each of these may link; rows with a null
id have a null component and are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.llm.common import bounded_batches, broadcast_if_small, written
from skeinwork.llm.components import components

WIDTH = 5
HASHES = 252
KEPT_BITS = 4
LONGS = 16
#: The longer signature of members of unsettled buckets: more minima, of fewer bits each.
FINE_HASHES, FINE_BITS = 1024, 2
#: How far below the threshold an estimate may lie: about 4.5 standard deviations of each signature.
MARGIN, FINE_MARGIN = 0.105, 0.065
#: Members of a bucket that are compared with as many others in one group.
GROUP = 1000
#: A bucket's members are compared with its least and greatest ids, and the least after these flips of bits.
FLIPS = (0x2AAAAAAAAAAAAAAA, 0x1999999999999999)
CACHED_WORDS = 200_000

_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_FINE_MUL = (_RNG.integers(0, 1 << 31, FINE_HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FINE_ADD = _RNG.integers(0, 1 << 32, FINE_HASHES, dtype=np.uint32)
_MIX = (_RNG.integers(0, 1 << 63, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def rows_of_a_band(percent: int) -> int:
    """Minima in a band: 36 bands of 7 miss a pair at 85 % once in a million, 42 of 6 one at 80 % three times."""
    return 7 if percent >= 85 else 6


class Shingler:
    """Hashes words and shingles; keeps the words' hashes, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """The distinct shingle hashes in order, and the words."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64), words
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = [known[w] for w in words]
        values = np.array(ids, dtype=np.uint64)
        width = min(WIDTH, len(words))
        with np.errstate(over="ignore"):
            h = np.full(len(words) - width + 1, width, dtype=np.uint64)
            for k in range(width):
                h = (h ^ values[k : len(values) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return np.unique(h), words


def minima(shingles: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    x = shingles.astype(np.uint32)
    least = np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for start in range(0, len(x), 1024):
            values = np.multiply.outer(mul, x[start : start + 1024])
            values += add[:, None]
            np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, each: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = least.reshape(-1, each).astype(np.uint64)
        key = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(each):
            key = (key ^ rows[:, k]) * _MIX[k]
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def packed(least: np.ndarray, bits: int = KEPT_BITS, longs: int = LONGS) -> np.ndarray:
    """The low bits of every minimum (mixed, so that they are fair), side by side in 64-bit numbers."""
    each = 8 // bits
    low = np.zeros(longs * 64 // bits, dtype=np.uint8)
    with np.errstate(over="ignore"):
        low[: len(least)] = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    out = np.zeros(longs * 8, dtype=np.uint8)
    for k in range(each):
        out |= low[k::each] << (bits * k)
    return out.view(np.int64)


def _signatures(each: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            rows = []
            for doc_id, text, k1, k2 in zip(batch["doc_id"], batch["text"], batch["k1"], batch["k2"], strict=True):
                found, words = shingler.shingles(text)
                if not len(found):
                    rows.append((doc_id, k1, k2, 0, 0, 0, None, None))
                    continue
                least = minima(found)
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                h = np.frombuffer(digest, dtype=np.int64)
                rows.append((doc_id, k1, k2, len(found), int(h[0]), int(h[1]), band_keys(least, each), packed(least)))
            out = pd.DataFrame(rows, columns=["doc_id", "k1", "k2", "n_shingles", "h1", "h2", "bands", "sig"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return sign


def _fine_signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for batch in batches:
        found = [shingler.shingles(text)[0] for text in batch["text"]]
        fine = [packed(minima(x, _FINE_MUL, _FINE_ADD), FINE_BITS, FINE_HASHES * FINE_BITS // 64) for x in found]
        yield pd.DataFrame({"id": batch["id"], "n": [len(x) for x in found], "fine": fine})


def estimate(a: Column, b: Column, hashes: int = HASHES, bits: int = KEPT_BITS, longs: int = LONGS) -> Column:
    """The share of minima that agree in their kept bits, corrected for those that agree by chance."""
    ones = sum(1 << k for k in range(0, 64, bits))  # the lowest bit of each group
    differing = F.lit(0)
    for k in range(longs):
        x, step = a[k].bitwiseXOR(b[k]), bits // 2
        while step:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step //= 2
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 2.0**-bits
    return ((F.lit(hashes) - differing) / F.lit(float(hashes)) - chance) / (1.0 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last = Shingler(), (None, None)
        for batch in batches:
            hits = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                if last[0] != a:
                    last = (a, shingler.shingles(ta)[0])
                left, right = last[1], shingler.shingles(tb)[0]
                if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
                    continue
                both = np.sort(np.concatenate([left, right]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(left) + len(right) - common):
                    hits.append((a, b))
            yield pd.DataFrame(hits, columns=["a", "b"], dtype="int64")

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").mapInPandas(verify, "a long, b long")


def meeting(unsettled: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and look alike; ``unsettled`` has key, id and component."""
    # A class is in at most one bucket for each band.
    own_keys = unsettled.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    fine = texts.join(own_keys.select("id"), "id", "left_semi").mapInPandas(_fine_signatures, "id long, n long, fine array<long>")
    often = unsettled.groupBy("key").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
    rest = written(unsettled.join(own_keys, "id").join(fine, "id").join(often, "key"), "unsettled")
    dealt = rest.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "id", "n", "component", "fine", "keys", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    # Few bytes stand for much work here, so the number of partitions is given.
    dealt = dealt.repartition(int(unsettled.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "low", "high")
    a, b = dealt.alias("a"), dealt.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.low") == F.col("b.low")) & (F.col("a.high") == F.col("b.high"))
    # Two of one block meet where it meets itself.
    apart = (F.col("a.low") == F.col("a.high")) | (F.col("a.own") != F.col("b.own"))
    met = apart & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
    met = met & (estimate(F.col("a.fine"), F.col("b.fine"), FINE_HASHES, FINE_BITS, FINE_HASHES * FINE_BITS // 64) >= percent / 100.0 - FINE_MARGIN)
    met = met & (F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key"))
    return a.join(b, same & met).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def linked(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, k1, k2 (hashes of the text), n_shingles, class_id and component_id of every row, and the class (h1, h2)."""
    text = F.col("text").cast("string")
    whole = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    signed = written(
        whole.mapInPandas(_signatures(rows_of_a_band(percent)), "doc_id long, k1 long, k2 long, n_shingles long, h1 long, h2 long, bands array<long>, sig array<long>"),
        "signatures",
    )
    known = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Any row of a class has its bands and signature; its texts differ in white space and case at most.
    firsts = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("k"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = written(firsts.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "least", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"), "bands", "sig"), "classes")
    keyed = reps.select("id", "least", F.explode("bands").alias("key"))
    flipped = [F.min(F.col("id").bitwiseXOR(F.lit(flip))).bitwiseXOR(F.lit(flip)).alias(f"other{k}") for k, flip in enumerate(FLIPS)]
    # The class with the least doc_id is among the four: copies tend to come after what they are copies of.
    by_age = F.struct("least", "id")
    buckets = keyed.groupBy("key").agg(F.min_by("id", by_age).alias("low"), F.max_by("id", by_age).alias("high"), *flipped).filter("low <> high")
    members = written(keyed.drop("least").join(buckets, "key"), "buckets")
    sigs = reps.select("id", "sig")
    # Only texts of classes in shared buckets are compared, one of each class.
    shared = reps.select("id", "k1", "k2").join(members.select("id").distinct(), "id", "left_semi")
    texts = written(whole.select("k1", "k2", "text").join(broadcast_if_small(shared, 24), ["k1", "k2"]).groupBy("id").agg(F.first("text").alias("text")), "texts")
    least = percent / 100.0 - MARGIN

    def promising(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        return both.filter(estimate(F.col("sa"), F.col("sb")) >= least).select("a", "b")

    against = F.explode(F.array("low", "high", *(f"other{k}" for k in range(len(FLIPS)))))
    star = members.select("id", against.alias("other")).filter("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    links = written(confirmed(promising(star), texts, percent), "links")
    near = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = members.join(near.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("key")
    unsettled = written(placed.join(mixed, "key"), "unsettled")
    rest_pairs = meeting(unsettled, texts, percent).join(star, ["a", "b"], "left_anti")
    more = written(confirmed(rest_pairs, texts, percent), "links")
    every = links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    reach = reps.select("h1", "h2", "least", "id").join(components(every).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = reach.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(reach.join(lowest, "component").select("h1", "h2", "component", F.col("least").alias("class_id"), "component_id"), "components")
    return signed.select("doc_id", "k1", "k2", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept of every row.

    Documents are linked where ``100 * intersection >= percent * union``; ``component_id`` is the least id
    reachable by links, ``class_id`` the least id with the same words.
    """
    rows = linked(docs, percent)
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    class_id, component = (F.when(own, F.col("doc_id")).otherwise(F.col(c)) for c in ("class_id", "component_id"))
    return rows.select("doc_id", "n_shingles", class_id.alias("class_id"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, that with the least id, with all its columns.

    Of rows of one group and id, that with the least hash of its text stays. Rows that repeat an id and a text
    become one; rows with a null id, and different texts without words, stay.
    """
    rows = linked(docs.select("doc_id", "text"), percent).filter("doc_id IS NOT NULL")
    # Hashes alone are grouped; of the rows of ``docs`` only those that are repeated are.
    texts = rows.groupBy("doc_id", "k1", "k2").agg(F.max("component").alias("component"), F.count("*").alias("copies"))
    texts = written(texts, "texts")
    first = texts.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("first"))
    gone = texts.join(first, "component").filter(F.struct("doc_id", "k1", "k2") != F.col("first")).select("doc_id", "k1", "k2")
    repeated = texts.filter("copies > 1").select("doc_id", "k1", "k2").join(gone, ["doc_id", "k1", "k2"], "left_anti")
    gone, repeated = (written(x.select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "k1", "k2"))), "fates") for x in (gone, repeated))
    text = docs["text"].cast("string")
    is_row = (docs["doc_id"].cast("long") == F.col("__doc_id")) & (F.xxhash64(text) == F.col("__k1")) & (F.xxhash64(F.lit(1), text) == F.col("__k2"))
    once = docs.join(broadcast_if_small(gone.unionByName(repeated), 24), is_row, "left_anti")
    again = docs.join(broadcast_if_small(repeated, 24), is_row)
    again = again.groupBy("__doc_id", "__k1", "__k2").agg(F.first(F.struct(*(docs[c] for c in docs.columns))).alias("__row")).select("__row.*")
    return once.unionByName(again)


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g
  FROM t
),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id
"""
