"""Benchmark decontamination: SimHash of item-sized windows, verified by exact weighted shingles.

Words are runs of letters and digits of the lower-cased text; shingles are five words, and weigh their
letters. A window has an item's number of words; a document shorter than the item is one window. Windows
and items are fingerprinted alike: 128 bits, each the weighted majority of the distinct shingles' hashes.
The benchmark's fingerprints are entered under every value within ``NEAR`` bits of each of their eight
blocks, so a lookup of a window's blocks finds all fingerprints of its size within ``RADIUS`` bits (were
each block off by ``NEAR + 1`` bits or more, the distance would be above ``RADIUS``). What is found is
compared exactly: the weight of common shingles over the weight of all, at least ``THRESHOLD``.

Windows that cannot match are not fingerprinted, and this loses none. A window of similarity t or more
has shingles of at least t times the item's weight in common with it, so it cannot lack all of a set of
the item's shingles that weighs more than the rest, 1 - t of the item. Such a set (``seeds``) is taken
from every item, the shingles that the fewest items have first, and every window of the item's size that
holds a seed, wherever in it, is fingerprinted.

Only DataFrame functions are used. Documents are read without a shuffle of their texts, and each
different text is looked at once, however many copies it has. What is broadcast has rows of a fixed
width, and is broadcast only up to a size in bytes; beyond that a shuffle joins it.

Edges: null or empty texts, items and documents of under five words match nothing; a text may be of any
length, as counts have 32 bits; of windows that are equally similar the first is reported; rows of one id,
or without one, are judged each on its own text and reported under the id; repeated rows give the same
matches once; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.llm.common import broadcast_if_small, written

WIDTH = 5
THRESHOLD = 0.8
#: Bits that fingerprints of a pair at the threshold differ in: 17 on average, above 31 once in two thousand pairs.
RADIUS = 31
#: Blocks of a fingerprint and their bits; eight with at most three wrong bits each cover the radius.
BLOCKS, BLOCK_BITS = 8, 16
NEAR = RADIUS // BLOCKS
#: Two counts of 32 bits in a number.
LANES = 0x0000000100000001
#: A gram is a number: a shingle's hash without its last bits, and there its letters (a million and more count as a million).
WEIGHT = (1 << 20) - 1


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingles(w: Column) -> Column:
    """The hash of every five words, in order."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WIDTH - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WIDTH))))


def letters(w: Column) -> Column:
    """The number of characters of every five words, in order."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WIDTH - 1), F.lit(0))), lambda x, i: sum((F.length(F.get(w, i + k)) for k in range(1, WIDTH)), F.length(x)))


def text_key(text: Column) -> tuple[Column, Column]:
    """Two independent hashes, which tell texts apart."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def fingerprinted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the fingerprint p1, p2 of the array ``grams`` of rows that ``keys`` tell apart.

    The 128 weights of set bits are kept in 64 sums of two lanes.
    """
    each = rows.select(*keys, F.explode("grams").alias("g")).select(*keys, F.xxhash64("g").alias("h1"), F.xxhash64(F.lit(1), "g").alias("h2"), _letters("g").alias("size"))
    lanes = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES)) * F.col("size")) for h in ("h1", "h2") for k in range(32)]
    names = [f"__l{k}" for k in range(len(lanes))]
    sums = each.groupBy(*keys).agg(F.sum("size").alias("__all"), *(x.alias(n) for x, n in zip(lanes, names, strict=True)))
    held = sums.select(*keys, "__all", F.array(*names).alias("__lanes"))

    def majority(first: int) -> Column:
        def both(value: Column, k: Column) -> Column:
            lane = F.get("__lanes", k + first)
            for part, by in ((lane.bitwiseAND(F.lit(0xFFFFFFFF)), 0), (F.shiftrightunsigned(lane, 32), 32)):
                value = value.bitwiseOR(F.when(2 * part > F.col("__all"), F.call_function("shiftleft", F.lit(1).cast("long"), (k + by).cast("int"))).otherwise(F.lit(0).cast("long")))
            return value

        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), both)

    return held.select(*keys, majority(0).alias("p1"), majority(32).alias("p2"))


def _blocks() -> list[tuple[int, Column]]:
    each = 64 // BLOCK_BITS
    return [(k, F.shiftrightunsigned(f"p{1 + k // each}", BLOCK_BITS * (k % each)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))) for k in range(BLOCKS)]


def block_values() -> Column:
    """The blocks of the fingerprint p1, p2."""
    return F.array(*(F.struct(F.lit(k).alias("block"), own.alias("value")) for k, own in _blocks()))


def flips(bits: int = BLOCK_BITS, near: int = NEAR) -> list[int]:
    """Every change of at most ``near`` of so many bits."""
    out = {0}
    for _ in range(near):
        out |= {x ^ (1 << b) for x in out for b in range(bits)}
    return sorted(out)


def near_block_values() -> Column:
    """All block values within ``NEAR`` bits of those of the fingerprint p1, p2."""
    changes = F.expr(f"array({', '.join(f'{x}L' for x in flips())})")

    def around(k: int, own: Column) -> Column:
        return F.transform(changes, lambda x: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(x).alias("value")))

    return F.concat(*(around(k, own) for k, own in _blocks()))


def distance(a1: str, a2: str, b1: str, b2: str) -> Column:
    return F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) + F.bit_count(F.col(a2).bitwiseXOR(F.col(b2)))


def _letters(gram: str | Column) -> Column:
    return (F.col(gram) if isinstance(gram, str) else gram).bitwiseAND(F.lit(WEIGHT))


def _weight(grams: Column) -> Column:
    return F.aggregate(grams, F.lit(0).cast("long"), lambda total, g: total + _letters(g))


def _name(hash: Column) -> Column:
    return hash.bitwiseAND(F.lit(~WEIGHT))


def _grams(w: Column) -> Column:
    return F.zip_with(shingles(w), letters(w), lambda h, c: _name(h).bitwiseOR(F.least(c, F.lit(WEIGHT)).cast("long")))


def seeds(items: DataFrame, threshold: float) -> DataFrame:
    """name and n_words of shingles of which every window that matches an item has one."""
    own = items.select("item", "n_words", F.explode("grams").alias("g"))
    many = own.groupBy("g").agg(F.count("*").alias("many"))
    # An item is one group of these windows; its shingles are its own words.
    order = Window.partitionBy("item").orderBy("many", F.desc("size"), "g")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = own.join(many, "g").withColumn("size", _letters("g"))
    ranked = ranked.select(_name(F.col("g")).alias("name"), "n_words", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("item")).alias("all"))
    return ranked.filter(F.col("before") <= (1 - threshold) * F.col("all") + 1e-6).select("name", "n_words").distinct()


def windows_of(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """k1, k2, n_words and start of every window, of a size that items have, with a seed of an item of that size."""
    split = texts.select("k1", "k2", words(F.col("text")).alias("w")).filter(F.size("w") >= WIDTH)
    seen = split.select("k1", "k2", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"))).alias("pos", "hash"))
    hits = seen.withColumn("name", _name(F.col("hash"))).join(seeds, "name").select("k1", "k2", "size", "n_words", "pos").distinct()
    first = F.greatest(F.col("pos") - F.col("n_words") + WIDTH, F.lit(0))
    last = F.least(F.col("pos"), F.greatest(F.col("size") - F.col("n_words"), F.lit(0)))
    return hits.select("k1", "k2", "n_words", F.explode(F.sequence(first, last)).alias("start")).distinct()


def candidates(prints: DataFrame, theirs: DataFrame) -> DataFrame:
    """Of fingerprints (n_words, p1, p2) the items of that size within the radius: n_words, p1, p2, item."""
    # Copies of a passage have one fingerprint, which is looked up once.
    looked = prints.select("n_words", "p1", "p2").distinct().select("n_words", "p1", "p2", F.explode(block_values()).alias("b")).select("n_words", "p1", "p2", "b.*")
    entered = theirs.select("item", "n_words", F.col("p1").alias("i1"), F.col("p2").alias("i2"), F.explode(near_block_values()).alias("b")).select("item", "n_words", "i1", "i2", "b.*")
    # Entries are thousands for each item, which the size that is estimated does not count: neither side may be broadcast by it.
    met = looked.join(entered.hint("merge"), ["n_words", "block", "value"])
    return met.filter(distance("p1", "p2", "i1", "i2") <= RADIUS).select("n_words", "p1", "p2", "item").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each different text (k1, k2) of ``docs`` and each item that it holds, the most similar window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") >= WIDTH).distinct()
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.size("w").alias("n_words"), F.array_distinct(_grams(F.col("w"))).alias("grams"))
    items = written(items, "items")
    k1, k2 = text_key(F.col("text"))
    texts = docs.select(F.col("text").cast("string").alias("text")).select(k1.alias("k1"), k2.alias("k2"), "text")
    windows = written(windows_of(texts, broadcast_if_small(written(seeds(items, threshold), "seeds"), 16)), "windows")
    held = broadcast_if_small(windows.select("k1", "k2").distinct(), 16)
    whole = texts.join(held, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    # Words are written before they are used: an expression that is repeated for every shingle must be a column.
    whole = written(whole.select("k1", "k2", words(F.col("text")).alias("w")), "words")
    whole = written(whole.select("k1", "k2", F.size("w").alias("size"), _grams(F.col("w")).alias("all")), "whole")
    part = F.array_distinct(F.slice("all", F.col("start") + 1, F.col("n_words") - (WIDTH - 1)))
    # Few bytes stand for much work here, so the number of partitions is given.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = windows.repartition(partitions, "k1", "k2").join(whole, ["k1", "k2"]).select("k1", "k2", "n_words", "start", part.alias("grams"))
    prints = written(fingerprinted(cut, ["k1", "k2", "n_words", "start"]), "prints")
    theirs = written(fingerprinted(items, ["item", "n_words"]), "items")
    near = prints.join(candidates(prints, theirs), ["n_words", "p1", "p2"]).select("k1", "k2", "n_words", "start", "item")
    # The shingles come back for what is within the radius; ``own`` is the window's number of words, less only in a shorter document.
    pairs = near.repartition(partitions, "k1", "k2").join(whole, ["k1", "k2"]).join(items.select("item", "item_id", F.col("grams").alias("theirs")), "item")
    pairs = pairs.select("k1", "k2", "item_id", "start", F.least("n_words", "size").alias("own"), part.alias("grams"), "theirs")
    common = _weight(F.array_intersect("grams", "theirs"))
    exact = pairs.select("k1", "k2", "item_id", "start", "own", common.alias("common"), (_weight(F.col("grams")) + _weight(F.col("theirs"))).alias("both"))
    exact = exact.withColumn("similarity", F.col("common") / (F.col("both") - F.col("common"))).filter(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "own")).alias("best")
    return written(exact.groupBy("k1", "k2", "item_id").agg(best), "matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start (the window's first word, from 0), n_words and similarity: the best window of each pair."""
    found = matches(docs, benchmark, threshold)
    k1, k2 = text_key(F.col("text"))
    named = docs.select("doc_id", k1.alias("k1"), k2.alias("k2")).join(broadcast_if_small(found, 64), ["k1", "k2"])
    best = named.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.own").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text has no match, with all their columns."""
    gone = matches(docs.select("text"), benchmark, threshold).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = text_key(docs["text"])
    return docs.join(broadcast_if_small(gone, 16), (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")


ORACLE_SQL = r"""
WITH bw AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
bs AS (SELECT DISTINCT item_id, len(w) AS n_words, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS g FROM bw WHERE len(w) >= 5),
ds AS (SELECT doc_id, len(w) AS size, unnest(range(0, len(w) - 4)) AS p, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS g FROM dw WHERE len(w) >= 5),
hit AS (SELECT DISTINCT doc_id, size, p, item_id, n_words FROM ds JOIN bs ON ds.g = bs.g),
win AS (SELECT DISTINCT doc_id, item_id, n_words, least(n_words, size) AS own, unnest(range(greatest(p - n_words + 5, 0), least(p, greatest(size - n_words, 0)) + 1)) AS s FROM hit),
wg AS (SELECT DISTINCT win.doc_id, win.s, win.item_id, win.own, ds.g FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.p >= win.s AND ds.p <= win.s + win.n_words - 5),
wt AS (SELECT doc_id, s, item_id, own, sum(length(g) - 4) AS t FROM wg GROUP BY ALL),
it AS (SELECT item_id, sum(length(g) - 4) AS t FROM bs GROUP BY ALL),
co AS (SELECT wg.doc_id, wg.s, wg.item_id, sum(length(wg.g) - 4) AS c FROM wg JOIN bs ON wg.item_id = bs.item_id AND wg.g = bs.g GROUP BY ALL),
sim AS (SELECT co.doc_id, co.item_id, co.s, own, c::DOUBLE / (wt.t + it.t - c)::DOUBLE AS similarity FROM co JOIN wt ON co.doc_id = wt.doc_id AND co.s = wt.s AND co.item_id = wt.item_id JOIN it ON it.item_id = co.item_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS start, CAST(own AS BIGINT) AS n_words, similarity FROM best WHERE r = 1
"""
