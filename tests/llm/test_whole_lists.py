"""Training-data operators on rows that the fast path alone would leave out."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import lsh, mixing


@pytest.mark.parametrize("scanned", [20_000, 7])
def test_every_query_gets_ten_neighbours(spark, monkeypatch, scanned):
    monkeypatch.setattr(lsh, "SCANNED", scanned)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    lone = np.arange(0, 3000, 100)[:20]
    x[lone] = rng.normal(size=(20, 16)) * 500  # far from the rest and from each other
    x[1:6] = x[0] + rng.normal(size=(5, 16)) * 1e-3  # a cluster of six beside them
    x[7] = x[100]  # equal vectors far out
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in lsh.search(df, lambda i: i % 100 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11))
        if q in lone:
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            want = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
            assert [v for _, v, _ in found] == want
            assert np.allclose([s for _, _, s in found], d[want], rtol=1e-12, atol=0)


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert lsh.search(df, lambda i: i == 0).agg(F.max("rank")).first()[0] == 5


def mixed(spark, rows, **how):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3), **how).collect()


@pytest.mark.parametrize("target,goal", [("entropy", 0.9), ("repeats", 2.0)])
def test_empty_texts_of_the_largest_source_are_kept(spark, monkeypatch, target, goal):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 5)
    rows = [(i, "a", "" if i % 2 else "one two three") for i in range(60)] + [(60, "a", None)] + [(i, "b", "one two") for i in range(61, 71)]
    got = mixed(spark, rows, target=target, goal=goal)
    assert {r.doc_id for r in got if r.source == "a"} == set(range(61))
    assert {r.doc_id for r in got} == set(range(71))


def test_entropy_of_nearly_equal_sources_is_met(spark):
    rows = [(0, "a", "x " * 100), (1, "b", "x " * 99), (2, "c", "x " * 98)]
    w = {r.source: r.weight for r in mixed(spark, rows, goal=0.8) if r["pass"] == 0}
    assert abs(-sum(p * np.log(p) for p in w.values()) - 0.8 * np.log(3)) < 1e-6


def test_an_entropy_that_cannot_be_met_is_reported(spark):
    with pytest.warns(UserWarning, match="no exponent"):
        got = mixed(spark, [(0, "a", "x y"), (1, "b", "x y")], goal=0.8)
    assert {r.doc_id for r in got} == {0, 1}
