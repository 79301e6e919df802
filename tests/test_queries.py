"""Every registered query at sf0.001: against its SQL, or against invariants."""

import duckdb
import pytest
from check_oracle import TABLES, compare
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from shoal.registry import ORACLES


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, SMALL).startswith("ok")


CLUSTERED = {
    "pilot_distributed_clustering": 200,
    "pilot_distributed_plain": 200,
    "divide_conquer_clustering": 200,
    "partition_clustering": 180,
    "partition_clustering_edges": 180,
    "local_spectral_clustering": 200,
    "pilot_clustering": 20,
}


@pytest.mark.parametrize("name", sorted(CLUSTERED))
def test_every_node_once(spark, name):
    got = queries()[name](spark, SMALL).select("node", "cluster").collect()
    assert len({r.node for r in got}) == len(got) == CLUSTERED[name]
    assert {r.cluster for r in got} <= {0, 1, 2}


def test_entry_recovers_blocks(spark):
    from shoal.operators.evaluate import best_permutation_accuracy

    out = entry(spark)
    assert out.columns == ["node", "label", "cluster"]
    assert best_permutation_accuracy(out, 3).first()["accuracy"] >= 0.95


def test_oracles_have_queries():
    assert set(oracle_sql()) <= set(queries())
