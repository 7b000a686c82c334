import random
import zlib

import fixtures as X
import numpy as np
import pytest

from skeinwork.llm import packing as P
from skeinwork.llm.sharding import shard_documents


@pytest.mark.parametrize("clashing", [False, True])
def test_shards_hold_every_row_once_and_near_equal_bytes(spark, clashing):
    docs = X.docs(spark, clashing)
    got = shard_documents(docs, 4, range_bytes=20_000).collect()
    expected = sorted(((i, t) for i, t, *_ in X.rows()), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == expected
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert set(shards) <= set(range(4))
    assert max(sum(r["size"] for r in own) for own in shards.values()) <= total / 4 + largest


def test_a_large_group_of_copies_is_split_and_bytes_balance(spark):
    rng = random.Random(1)
    rows = [(k, "the same text in very many rows " * 3, "en", "s", 0) for k in range(700)] + [(1000 + k, X.sentence(rng, rng.randrange(5, 30)), "en", "s", 0) for k in range(600)]
    got = shard_documents(spark.createDataFrame(rows, X.SCHEMA), 16, carry_text=False).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() < 0.02 * sums.mean() + 400
    # Equal texts lie side by side: a text is in neighbouring shards only.
    spread = got.groupby("text_crc32")["shard"].agg(["min", "max", "nunique"])
    assert (spread["max"] - spread["min"] + 1 == spread["nunique"]).all()


def test_empty_and_tiny_tables(spark):
    assert shard_documents(X.empty(spark), 16).count() == 0
    one = shard_documents(X.empty(spark).union(spark.createDataFrame([(1, None, None, None, None)], X.SCHEMA)), 16).collect()
    assert [(r["doc_id"], r["size"], r["text_crc32"], r["slot"]) for r in one] == [(1, 1, 0, 0)]


def test_rows_that_repeat_id_and_text_are_divided_too(spark):
    same = [(7, "all rows alike", "en", "s", 0)] * 9
    got = shard_documents(spark.createDataFrame(same, X.SCHEMA), 4).collect()
    per_shard = [sorted(r["slot"] for r in got if r["shard"] == k) for k in range(4)]
    assert all(own == list(range(len(own))) for own in per_shard) and sorted(map(len, per_shard)) == [2, 2, 2, 3]


def plain_best_fit(lengths, window):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(window - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 32, 100])
    lengths = [rng.randrange(1, window + 1) for _ in range(rng.randrange(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, made = P.best_fit_decreasing(counts, window)
    fill, placed = [[] for _ in range(made)], {n: 0 for n in counts}
    for length, a, b, first, per, offset in runs:
        for rank in range(a, b):
            fill[first + (rank - a) // per].append((offset + (rank - a) % per * length, length))
            placed[length] += 1
    assert placed == counts
    left = []
    for parts in fill:
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        left.append(window - at)
    assert sorted(left) == plain_best_fit(lengths, window)


def test_the_tree_finds_the_tightest():
    rng, tree, there = random.Random(4), P.CapacityTree(50), set()
    for _ in range(500):
        c = rng.randrange(51)
        (there.discard if c in there else there.add)(c)
        tree.set(c, c in there)
        n = rng.randrange(51)
        assert tree.tightest(n) == min((x for x in there if x >= n), default=None)


@pytest.mark.parametrize("clashing", [False, True])
def test_packing_is_an_exact_round_trip(spark, clashing):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = X.rows() + [(400, "a special <|endoftext|> inside, and 日本語 with 🙂", "en", "s", 0)]
    docs = spark.createDataFrame(rows, X.SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        docs = docs.withColumns({k: F.lit(v) for k, v in X.CLASHING.items()})
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = P.pack(docs, window=256, carry_ids=True).cache()
    pieces = packed.collect()
    seqs = {r["sequence_id"]: r["ids"] for r in P.sequences(packed, 256, pad=-1).collect()}
    assert sorted(seqs) == list(range(len(seqs))) and all(len(s) == 256 for s in seqs.values())
    expected = sorted((str(i), tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x, *_ in rows)
    found = {}
    for r in pieces:
        ids = seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert ids == r["ids"] and zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == r["ids_crc32"]
        found.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], tuple(ids)))
    whole = sorted((i, tuple(x for _, p in sorted(parts) for x in p)) for (i, _), parts in found.items() if i != "307")
    assert whole == [e for e in expected if e[0] != "307"]
    assert len([r for r in pieces if r["doc_id"] == 307]) == 2
    used = sum(r["length"] for r in pieces)
    assert used / (256 * len(seqs)) > 0.97


def test_nothing_to_pack(spark):
    assert P.pack(X.empty(spark)).count() == 0


def test_splitters_are_those_of_a_sorted_list_and_repeated_rows_are_divided(spark):
    from collections import Counter

    from skeinwork.llm import sharding as S

    rng = random.Random(5)
    rows = [(k, X.sentence(rng, rng.randrange(1, 60))) for k in range(600)] + [(7, "hot row " * 10)] * 900 + [(None, None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = S.keyed(df).toPandas().sort_values(["k1", "k2"])
    got = S.find_splitters(spark.createDataFrame(keys[["k1", "k2", "size"]]), 8, 0.0)
    total, below = int(keys["size"].sum()), keys["size"].cumsum()
    for j, (a, b) in enumerate(got, 1):
        under = int(keys["size"][(keys["k1"] < a) | ((keys["k1"] == a) & (keys["k2"] < b))].sum())
        nearest = min(abs(int(x) - total * j // 8) for x in [0, *below])
        assert abs(under - total * j // 8) <= max(1, nearest)
    out = S.shard_documents(df, 8, range_bytes=1 << 12, carry_text=False).collect()
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 2 * max(len((t or "").encode()) + 1 for _, t in rows)
    for shard in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
