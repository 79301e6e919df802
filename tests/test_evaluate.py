from itertools import permutations

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from shoal.operators import evaluate

RESULT = "node long, label int, cluster int"


def test_confusion_keeps_zeros(frame):
    df = frame([(1, 0, 1), (2, 0, 1), (3, 1, 0), (4, 1, None)], RESULT)
    assert rows_of(evaluate.confusion_matrix(df, 2)) == [(0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 1, 0)]
    best = evaluate.best_permutation_accuracy(df, 2).first()
    assert (best.matched, best.total, best.accuracy) == (3, 4, 0.75)
    assert evaluate.misclustering_rate(df, 2).first()[0] == pytest.approx(0.25)


@pytest.mark.parametrize("k", [2, 4, 6])
def test_assignment_is_the_best_permutation(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        m = rng.integers(0, 50, (k, k)).astype(float)
        best = max(sum(m[i, p[i]] for i in range(k)) for p in permutations(range(k)))
        assert evaluate.assign_max(m) == best


@pytest.mark.parametrize("by", [None, ["g"]])
def test_more_clusters_than_are_permuted(spark, by, monkeypatch):
    df = spark.range(400).select(
        F.col("id").alias("node"),
        (F.col("id") % 5).cast("int").alias("label"),
        ((F.col("id") * 3 + F.when(F.col("id") % 7 == 0, 1).otherwise(0)) % 5).cast("int").alias("cluster"),
        (F.col("id") % 2).cast("int").alias("g"),
    )
    tried = rows_of(evaluate.best_permutation_accuracy(df, 5, by))
    monkeypatch.setattr(evaluate, "PERMUTED_CLUSTERS", 3)
    assert rows_of(evaluate.best_permutation_accuracy(df, 5, by)) == tried


def test_relative_density_matches_brute_force(frame):
    rng = np.random.default_rng(2)
    a = np.triu(rng.random((30, 30)) < 0.3, 1)
    a = a | a.T
    group = np.arange(30) % 3
    edges = [(int(i), int(j)) for i, j in zip(*np.nonzero(a))]
    nodes = frame([(i, int(group[i])) for i in range(25)], "node long, cluster int")  # five are not clustered
    a, group = a[:25, :25], group[:25]
    same = group[:, None] == group[None]
    off = ~np.eye(25, dtype=bool)
    want = (a[~same].sum() / (~same).sum()) / (a[same & off].sum() / (same & off).sum())
    got = evaluate.relative_density(frame(edges + edges[:40], "src long, dst long"), nodes).first()
    assert got.relative_density == pytest.approx(want)


def test_means(frame):
    df = frame([("a", 0.1), ("a", 0.2), ("b", 1 / 3)], "setting string, rate double")
    assert rows_of(evaluate.repeat_mean(df, "setting", "rate")) == [("a", 0.15), ("b", 0.33333)]
    times = frame([(2.0,), (2.0,), (4.0,)], "time double")
    assert rows_of(evaluate.distinct_mean(times, "time")) == [(3.0,)]
