"""Sharding by histogram sort: shards of near equal bytes, each globally ordered.

Every document has the key (hash of its text, hash of its id, text and row number), so equal texts lie side by
side and a group of copies that outgrows a shard, even of rows that repeat id and text, is still divisible. Row
numbers are those of one reading: what has the keys is written once, and all that follows reads it. A splitter is found by
counting: exact bytes and rows below candidate boundaries, over all partitions, then finer candidates
inside the one interval that holds the wanted byte position, until the boundary is within tolerance.
Only counts reach the driver, at most ``PROBES`` a round for all splitters together. The rows move once.

Behaviour at the edges: a null text counts as empty (size 1, checksum 0); a null id is a value of its
own; rows that agree in id and text are as good as any others; rows are never cut, so the text of a row on a
boundary goes to one side whole and two shards may differ by that row beside ``tolerance``; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.llm.common import text_or_empty, written

#: Key bits that the lookup of ranges goes by, and the first round of counting tells apart.
BITS = 12
#: Candidate intervals that one round of counting looks at, at most: the more splitters are open, the fewer for each.
PROBES = 1 << 18
#: Most ranges that the rows are dealt to: what is broadcast is one small row for each.
MOST_RANGES = 1 << 14
LOWEST = -(1 << 63)


def keyed(docs: DataFrame, carry_text: bool = False) -> DataFrame:
    """doc_id, size, text_crc32 and the key (k1, k2) of every row, and its text if wanted."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id"),
        *([F.col("text")] if carry_text else []),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col("doc_id"), text, F.monotonically_increasing_id()).alias("k2"),
    )


def _inside(rows: DataFrame, open_at: list[tuple[int, int]], used: int) -> DataFrame:
    """The rows whose first ``used`` key bits are those of an open interval (k1 or its prefix, prefix of k2)."""
    if not used:
        return rows
    first, second = min(used, 64), max(used - 64, 0)
    found = rows.sparkSession.createDataFrame(open_at, "__a long, __b long")
    at = F.shiftright("k1", 64 - first) == F.col("__a")
    if second:
        at = at & (F.shiftright("k2", 64 - second) == F.col("__b"))
    return rows.join(F.broadcast(found), at, "left_semi")  # one row for each open splitter at most


def find_splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """Boundaries (k1, k2) that cut the bytes into ``parts`` near equal runs, in order.

    A boundary is taken once it is within ``tolerance`` of a part's bytes, or when the interval around
    the wanted position has one row or is a single key.
    """
    top = ((1 << 63) - 1, (1 << 63) - 1)
    found: dict[int, tuple[int, int]] = {}
    # Open intervals by the key bits that they share: wanted splitters, and the bytes before the interval.
    open_at: dict[tuple[int, int], tuple[list[int], int]] = {(0, 0): (list(range(1, parts)), 0)}
    used, total, slack = 0, 0, 0
    while open_at and used < 128:
        width = max(1, min(BITS if not used else (PROBES // len(open_at)).bit_length() - 1, BITS, 64 - used % 64))
        second = used >= 64
        left = 64 - used % 64 - width
        rows = _inside(keys.select("k1", "k2", "size"), list(open_at), used)
        prefix = F.shiftright("k2" if second else "k1", left)
        by = [F.col("k1").alias("a"), prefix.alias("p")] if second else [F.lit(0).cast("long").alias("a"), prefix.alias("p")]
        counts = rows.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        if not used:
            total = sum(r["bytes"] for r in counts)
            slack = max(1, int(total / parts * tolerance))
        groups: dict[tuple[int, int], list] = {}
        for r in counts:
            outer = r["p"] >> width if used % 64 else 0
            groups.setdefault((r["a"], outer) if second else (outer, 0), []).append(r)
        used += width
        further: dict[tuple[int, int], tuple[list[int], int]] = {}
        for key, (wanted, before) in open_at.items():
            run, below = iter(sorted(groups.get(key, []), key=lambda r: r["p"])), before
            r = next(run, None)
            for j in wanted:
                target = total * j // parts
                while r is not None and below + r["bytes"] <= target:
                    below, r = below + r["bytes"], next(run, None)
                if r is None:
                    found[j] = top
                    continue
                near, over = target - below, below + r["bytes"] - target
                if min(near, over) <= slack or used == 128 or r["n"] == 1:
                    at = (r["p"] if near <= over else r["p"] + 1) << left
                    if second:
                        found[j] = (key[0], at) if at < 1 << 63 else (key[0] + 1, LOWEST)
                    else:
                        found[j] = (at, LOWEST) if at < 1 << 63 else top
                else:
                    further.setdefault((key[0], r["p"]) if second else (r["p"], 0), ([], below))[0].append(j)
        open_at = further
    return [found[j] for j in range(1, parts)]


def _range_of(splitters: list[tuple[int, int]], rows: DataFrame) -> DataFrame:
    """Add the number of splitters at or below each key, by a lookup on the key's first bits."""
    spark = rows.sparkSession
    inside: dict[int, list[tuple[int, int]]] = {}
    for s in splitters:
        inside.setdefault(s[0] >> (64 - BITS), []).append(s)
    table, below = [], 0
    for b in range(-(1 << (BITS - 1)), 1 << (BITS - 1)):
        own = inside.get(b, [])
        table.append((b, below, own))
        below += len(own)
    lookup = spark.createDataFrame(table, "b long, below int, splits array<struct<s1: long, s2: long>>")
    at_or_below = F.filter("splits", lambda s: (s["s1"] < F.col("k1")) | ((s["s1"] == F.col("k1")) & (s["s2"] <= F.col("k2"))))
    # The lookup has 2**BITS rows and at most MOST_RANGES splitters, whatever the input.
    return (
        rows.withColumn("b", F.shiftright("k1", 64 - BITS))
        .join(F.broadcast(lookup), "b")
        .withColumn("range", F.col("below") + F.size(at_or_below))
        .drop("b", "below", "splits")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.001, range_bytes: int = 16 << 20, carry_text: bool = True) -> DataFrame:
    """Deal ``docs`` to ``n_shards`` shards of near equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard (and text with ``carry_text``), one
    row for each row of the input. ``slot`` numbers a shard's rows from 0 in key order. Shards are made of
    ranges of about ``range_bytes``; a range is the unit of work, so no task holds a whole shard.
    """
    rows = written(keyed(docs, carry_text), "shard-keys")
    keys = rows.select("k1", "k2", "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, min(MOST_RANGES // n_shards, -(-total // (n_shards * range_bytes))))
    splitters = find_splitters(keys, n_shards * per_shard, tolerance / per_shard)
    counts = _range_of(splitters, keys).groupBy("range").agg(F.count("*").alias("n")).collect()
    sizes = {r["range"]: r["n"] for r in counts}
    firsts, seen = [], 0
    for r in range(n_shards * per_shard):
        seen = 0 if r % per_shard == 0 else seen
        firsts.append((r, seen))
        seen += sizes.get(r, 0)
    first = docs.sparkSession.createDataFrame(firsts, "range int, first long")
    dealt = _range_of(splitters, rows).join(F.broadcast(first), "range")
    place = Window.partitionBy("range").orderBy("k1", "k2")
    return dealt.select(
        "doc_id",
        *(["text"] if carry_text else []),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("range") / per_shard).cast("int").alias("shard"),
        (F.col("first") + F.row_number().over(place) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
