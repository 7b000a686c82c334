import itertools
import random
import re

import fixtures as X
from pyspark.sql import functions as F

from skeinwork.llm import decontamination as D

ITEMS = "item_id long, text string"


def words(t):
    return re.sub(r"[\W_]+", " ", (t or "").lower()).strip().split(" ")


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    """Every item-sized window of every document, by exact weighted similarity."""
    out = {}
    for (d, t), (i, s) in itertools.product(docs, items):
        w, v = words(t), words(s)
        if len(v) < 5:
            continue
        b = set(grams(v))
        for at in range(len(w) - len(v) + 1):
            a = set(grams(w[at : at + len(v)]))
            weight = lambda g: sum(sum(map(len, x)) for x in g)
            sim = weight(a & b) / weight(a | b)
            if sim >= 0.8 and sim > out.get((d, i), (0, 0))[0] + 1e-12:
                out[d, i] = (sim, at)
    return out


def test_windows_of_brute_force_are_found(spark):
    rng = random.Random(9)
    items = [(k, X.sentence(rng, rng.randrange(14, 40))) for k in range(8)] + [(20, "too short item"), (21, None), (22, "")]
    docs = [(k, X.sentence(rng, 60)) for k in range(10)]
    for k in range(8):
        w = X.sentence(rng, 30).split()
        item = items[k][1].split()
        if k % 2:
            item[0] = "other"  # an edge word differs
        docs.append((100 + k, " ".join(w[:10] + [x.upper() + "!!" for x in item] + w[10:])))
    docs += [(200, items[0][1] + " " + items[1][1] + " " + items[0][1]), (201, None), (202, ""), (203, " ".join(items[2][1].split()[:9]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("key", F.lit("x"))
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"]) for r in D.contaminated(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {k: (round(s, 9), at) for k, (s, at) in brute(docs, items).items()}
    assert len(got) >= 10


def test_items_cut_off_at_an_end_of_a_document_are_found(spark):
    rng = random.Random(4)
    item, rest = X.sentence(rng, 40).split(), X.sentence(rng, 30).split()
    docs = [(1, item[3:] + rest), (2, rest + item[:-3]), (3, item[:-1]), (4, item[2:]), (5, item[:20]), (6, item[20:] + rest)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["n_words"], round(r["similarity"], 9)) for r in D.contaminated(df, spark.createDataFrame([(9, " ".join(item))], ITEMS)).collect()}
    weight = lambda g: sum(sum(map(len, x)) for x in g)
    expected = {}
    for k, w in docs:
        windows = [(at, w[at : at + 40]) for at in range(max(1, len(w) - 39))]
        sims = [(weight(set(grams(x)) & set(grams(item))) / weight(set(grams(x)) | set(grams(item))), -at, len(x)) for at, x in windows]
        sim, back, n = max(sims)
        if sim >= 0.8:
            expected[k] = (-back, n, round(sim, 9))
    assert got == expected and sorted(got) == [1, 2, 3, 4]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def prints(rng, n, differ):
    """Pairs of 128-bit fingerprints that differ in ``differ()`` bits, as rows k, a1, a2, b1, b2."""
    rows = []
    for k in range(n):
        a = rng.getrandbits(128)
        b = a
        for bit in rng.sample(range(128), differ()):
            b ^= 1 << bit
        rows.append((k, *(signed(x >> s & (1 << 64) - 1) for x in (a, b) for s in (0, 64))))
    return rows


def test_blocks_find_every_fingerprint_within_the_radius_and_few_others(spark):
    rng = random.Random(2)
    near = prints(rng, 150, lambda: rng.randrange(D.RADIUS + 1))
    schema = "k int, a1 long, a2 long, b1 long, b2 long"

    def met(rows):
        df = spark.createDataFrame(rows, schema)
        a = df.select("k", F.col("a1").alias("p1"), F.col("a2").alias("p2")).select("k", D.block_values().alias("x"))
        b = df.select("k", F.col("b1").alias("p1"), F.col("b2").alias("p2")).select("k", D.near_block_values().alias("y"))
        return a.join(b, "k").filter(F.size(F.array_intersect("x", "y")) > 0).count()

    assert met(near) == 150
    assert met([(k, *(signed(rng.getrandbits(64)) for _ in range(4))) for k in range(400)]) < 0.15 * 400  # 0.085 expected


def test_fingerprints_are_weighted_majorities_however_heavy(spark):
    heavy = 1 << 40 | D.WEIGHT  # a hundred thousand of these exceed 32 bits only together
    rows = [(1, [1 << 20 | 5]), (2, [1 << 20 | 5, 2 << 20 | 90]), (3, [2 << 20 | 90]), (4, [heavy + (k << 41) for k in range(300)])]
    got = {r["k"]: (r["p1"], r["p2"]) for r in D.fingerprinted(spark.createDataFrame(rows, "k int, grams array<long>"), ["k"]).collect()}
    assert got[2] == got[3] != got[1]
    grams = spark.createDataFrame([(g,) for g in rows[3][1]], "g long").select(F.xxhash64("g").alias("a"), F.xxhash64(F.lit(1), "g").alias("b")).collect()
    expected = [sum(1 << k for k in range(64) if 2 * sum(r[c] >> k & 1 for r in grams) > len(grams)) for c in ("a", "b")]
    assert got[4] == tuple(map(signed, expected))


def test_edited_items_are_found_at_any_place(spark):
    """Insertions, deletions, changes and moved halves: all that brute force finds, but for a pair in two thousand."""
    rng = random.Random(31)
    items = [(k, X.sentence(rng, rng.randrange(16, 60))) for k in range(30)]
    docs = []
    for k in range(400):
        item = items[k % 30][1].split()
        kind, n = k // 30 % 5, len(item)
        for _ in range(1 + k % 2):
            at = rng.choice([0, 1, 2, len(item) - 2, len(item) - 1, rng.randrange(len(item))])
            if kind == 0:
                item.insert(at, f"new{k}")
            elif kind == 1:
                item.pop(at)
            elif kind == 2:
                item[at] = f"other{k}"
        if kind == 3:
            item = item[n // 2 :] + item[: n // 2]
        if kind == 4:
            item = item[: n - rng.randrange(4)]
        docs.append((k, " ".join(X.sentence(rng, rng.randrange(40)).split() + item + X.sentence(rng, rng.randrange(40)).split())))
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"]) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    # The brute force here has no windows of shorter documents.
    long = {d for d, t in docs if len(words(t)) >= 60}
    expected = {k: (round(s, 9), at) for k, (s, at) in brute([x for x in docs if x[0] in long], items).items()}
    assert {k: v for k, v in got.items() if k[0] in long} == expected
    assert sum(s < 1 for s, _ in expected.values()) > 50


def test_a_very_long_text_and_rows_of_one_id_or_none(spark):
    rng = random.Random(8)
    item = X.sentence(rng, 30)
    long = " ".join([X.sentence(rng, 80_000), item, X.sentence(rng, 100), "same five words here again " * 2000])
    docs = [(1, long), (1, "clean text of this row only, without any of it"), (None, item), (None, "another clean text without an id, which must stay"), (3, item), (3, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.contaminated(df, spark.createDataFrame([(5, item), (5, item), (6, item)], ITEMS)).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["start"]) for r in got) == [(0, 5, 0), (0, 6, 0), (1, 5, 80_000), (1, 6, 80_000), (3, 5, 0), (3, 6, 0)]
    left = D.keep_uncontaminated(df, spark.createDataFrame([(5, item)], ITEMS)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:7]) for r in left) == [(0, "another"), (1, "clean t")]


def test_clean_rows_stay_and_empty_tables_work(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], ITEMS)
    docs = X.docs(spark, clashing=True)
    left = D.keep_uncontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(X.rows())
    assert D.contaminated(X.empty(spark), items).count() == 0
    assert D.contaminated(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_flips_are_all_within_three_bits():
    found = D.flips()
    assert len(found) == len(set(found)) == 1 + 16 + 120 + 560 and max(map(int.bit_count, found)) == D.NEAR
