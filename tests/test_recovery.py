"""Accuracy floors on a planted 0/1 graph: every edge inside a block, a fifth of the others."""

import duckdb
import pytest
from conftest import SMALL

from shoal.operators.evaluate import best_permutation_accuracy
from shoal.plans import end_to_end

THINNED = f"""
WITH l AS (SELECT DISTINCT l_orderkey o, l_partkey p FROM '{SMALL}/lineitem.parquet'),
raw AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM l a JOIN l b ON a.o = b.o AND a.p < b.p)
SELECT src, dst FROM raw
WHERE src % 3 = dst % 3 OR ('0x' || substr(md5(src || '-' || dst), 1, 8))::BIGINT % 100 < 20"""


@pytest.fixture(scope="module")
def thinned(spark):
    rows = duckdb.connect().execute(THINNED).fetchall()
    assert len(rows) == 4077
    nodes = spark.createDataFrame([(i, i % 3) for i in range(200)], "node long, label int")
    return end_to_end.symmetric_graph(spark.createDataFrame(rows, "src long, dst long")), nodes


def test_pilot_distributed(thinned):
    out = end_to_end.pilot_distributed_clustering(*thinned, 3, pilot_ratio=0.2, partitions=4)
    assert best_permutation_accuracy(out, 3).first()["accuracy"] >= 0.95


def test_divide_and_conquer(thinned):
    out = end_to_end.divide_conquer_clustering(*thinned, 3, partitions=2, min_size=1)
    assert best_permutation_accuracy(out, 3).first()["accuracy"] >= 0.95
