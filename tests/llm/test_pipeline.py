import random

import fixtures as X
import pytest
from test_decontamination import brute as brute_leaks
from test_near_duplicates import brute as brute_groups

import corpus_pipeline as C
from skeinwork.llm import packing as P
from skeinwork.llm import quality as Q
from skeinwork.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [list(r) for r in X.rows()]
    leak = rows[20][1]
    around = X.sentence(random.Random(77), 90)
    rows.append([500, around + ", " + leak.title() + "! " + around[::-1], "en", "s", 0])
    spark.createDataFrame([tuple(r) for r in rows], X.SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_each_stage_does_what_brute_force_does(spark, folder, tmp_path):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {}
    for i, t, *_ in rows:
        m = Q.Text(t)
        if not m.base_failed and not any(r.rejects(m) for r in Q.RULES):
            texts[i] = t
    groups = brute_groups([(i, t) for i, t in texts.items()], C.NEAR_PERCENT)
    near = {i: t for i, t in texts.items() if i is None or groups[i][1] == i}
    leaks = {k[0] for k in brute_leaks(list(near.items()), [(1, rows[20][1])])}
    clean = {i: t for i, t in near.items() if i not in leaks}
    assert {20, 500} <= leaks
    expected = {"quality": texts, "language": texts, "near_duplicates": near, "decontamination": clean}
    for name, stage in C.STAGES:
        out = stage(spark, docs, d)
        if name in expected:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in expected:
            assert {(r["doc_id"], r["text"]) for r in docs.collect()} == set(expected[name].items()), name
    tokens = {i: len(P.encoded(t, P.vocabulary_path())) for i, t in clean.items()}
    assert {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == tokens


def test_run_gives_the_same_rows_twice(spark, folder):
    d, _ = folder
    one = X.collected(C.run(spark, d))
    assert one and one == X.collected(C.run(spark, d))


def test_stages_are_well_formed():
    assert [n for n, _ in C.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    assert C.ORACLE_SQL is None


def test_one_query_for_each_operator():
    assert [sum(n.startswith(f"op{k}_") for n in queries()) for k in range(1, 11)] == [1] * 10
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("stage", [f for n, f in C.STAGES])
def test_stages_on_an_empty_table(spark, folder, stage):
    assert stage(spark, X.empty(spark), folder[0]).count() == 0
