import random

import fixtures as X
import numpy as np
import pytest

from skeinwork.llm import minhash as M
from skeinwork.llm.components import components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_components_are_those_of_brute_force(spark, percent):
    got = M.near_duplicates(X.docs(spark, clashing=percent == 85), percent).collect()
    expected = brute(X.rows(), percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == expected
    assert len(got) == len(X.rows())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_chain_is_one_component_and_a_large_group_keeps_its_links(spark):
    rng = random.Random(3)
    base = X.sentence(rng, 60).split()
    rows, words = [], list(base)
    for k in range(40):  # each differs from the last by one word: neighbours are near, the ends are not
        words[(7 * k) % 60] = f"new{k}"
        rows.append((k, " ".join(words), "en", "s", 0))
    for k in range(60):  # a cloud around one text, some pairs near and some not
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(w), "en", "s", 0))
    got = M.near_duplicates(spark.createDataFrame(rows, X.SCHEMA), 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 85)


def test_one_row_of_each_group_stays_with_all_its_columns(spark):
    docs = X.docs(spark, clashing=True)
    left = M.keep_one_of_each(docs, 80)
    assert left.columns == docs.columns
    ids = sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None)
    expected = brute(X.rows(), 80)
    assert ids == sorted(i for i, (_, c) in expected.items() if i == c)


def test_ids_that_come_with_several_texts_link_text_by_text(spark):
    rng = random.Random(6)
    w, v, u = (X.sentence(rng, 80) for _ in range(3))
    rows = [(5, w), (5, v), (7, w + " tail"), (9, v + " tail"), (4, u), (9, u + " tail"), (5, w)]
    for parts in (1, 3):
        got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(4, 4), (5, 5), (5, 5), (5, 5), (7, 5), (9, 4), (9, 5)]
    left = M.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == sorted([(4, u), (5, w), (5, v)])


def test_texts_with_a_common_passage_are_not_linked_and_near_ones_among_them_are(spark):
    """One large bucket whose members are not near each other, but for planted pairs; the groups of shingles are cut into blocks."""
    rng = random.Random(7)
    base = X.sentence(rng, 150)
    rows = [(k, f"{base} {X.sentence(rng, 40)}") for k in range(400)]
    rows += [(1000 + k, rows[k][1].replace(" ", f" x{k} ", 1)) for k in range(0, 400, 40)]
    size, M.GROUP = M.GROUP, 7
    try:
        got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        M.GROUP = size
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - 1000 if i >= 1000 else i for i, _ in rows}


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = X.sentence(rng, 120_000)
    rows = [(1, long), (2, long + " and a tail"), (3, "same word " * 60_000), (4, "same word " * 50_000)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute([(*r, "", "", 0) for r in rows], 85)


def test_empty_table(spark):
    assert M.near_duplicates(X.empty(spark)).count() == 0
    assert M.keep_one_of_each(X.empty(spark)).count() == 0


@pytest.mark.parametrize("similarity", [0.5, 0.85])
def test_estimates_are_fair(spark, similarity):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        u = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
        c = int(len(u) * similarity)
        half = (len(u) - c) // 2
        a, b = np.sort(np.r_[u[:c], u[c : c + half]]), np.sort(np.r_[u[:c], u[c + half :]])
        rows.append((k, *(M.packed(M.minima(x)).tolist() for x in (a, b))))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    mean = df.select(F.avg(M.estimate(F.col("a"), F.col("b")))).first()[0]
    assert abs(mean - similarity) < 0.02


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7), (5, 4)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 120)}
