from collections import Counter

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from shoal.operators import split

EDGE = "src long, dst long, weight double"


@pytest.fixture
def star(frame):
    edges = [(0, i, 1.0) for i in range(1, 6)] + [(i, 0, 1.0) for i in range(1, 6)] + [(1, 2, 1.0), (2, 1, 1.0)]
    return frame(edges, EDGE), frame([(i, i % 2) for i in range(7)], "node long, label int")


def test_degree_ties_by_id(star, monkeypatch):
    edges, nodes = star
    order = [r.node for r in split.degree_rank(edges, nodes).orderBy("rank").collect()]
    assert order == [0, 1, 2, 3, 4, 5, 6]
    top = rows_of(split.top_degree_pilots(edges, nodes.select("node"), 3))
    assert top == [(0, 5.0, 0), (1, 2.0, 1), (2, 2.0, 2)]
    monkeypatch.setattr(split, "TOP_K_ROWS", 1)
    assert rows_of(split.top_degree_pilots(edges, nodes.select("node"), 3)) == top


def test_split_parts(star):
    edges, nodes = star
    parts = split.split_pilot_worker(edges, nodes, 2, partitions=3)
    assert {r.node for r in parts.pilots.collect()} == {0, 1}
    assert {r.node for r in parts.workers.collect()} == {2, 3, 4, 5, 6}
    assert rows_of(parts.pilot_edges.select("src", "dst")) == [(0, 1), (1, 0)]
    got = rows_of(parts.worker_edges.select("src", "dst"))
    assert got == [(2, 0), (2, 1), (3, 0), (4, 0), (5, 0)]
    where = {r.node: r.partition_id for r in parts.workers.collect()}
    assert all(where[r.src] == r.partition_id for r in parts.worker_edges.collect())
    rows = {r.node: r.pilot_ranks for r in split.node_feature_rows(parts.workers, parts.worker_edges, parts.pilots).collect()}
    assert rows == {2: [0, 1], 3: [0], 4: [0], 5: [0], 6: []}


def test_given_partitions(star, frame):
    edges, nodes = star
    placed = nodes.withColumn("partition_id", (F.col("node") % 2).cast("int"))
    parts = split.split_pilot_worker(edges, placed, 2)
    assert all(r.partition_id == r.src % 2 for r in parts.worker_edges.collect())


def test_random_pilots(spark):
    nodes = spark.range(500).withColumnRenamed("id", "node")
    a = rows_of(split.random_pilots(nodes, 50, "x"))
    assert a == rows_of(split.random_pilots(nodes.repartition(7), 50, "x"))
    assert len({n for n, _ in a}) == 50 and sorted(r for _, r in a) == list(range(50))
    assert {n for n, _ in a} != {n for n, _ in rows_of(split.random_pilots(nodes, 50, "y"))}


def test_partitions_are_even(spark):
    nodes = split.assign_partitions(spark.range(20000).withColumnRenamed("id", "node"), 10)
    sizes = [r["count"] for r in nodes.groupBy("partition_id").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1.2 * min(sizes)


def test_union_of_chunks_is_whole(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("node"), "id")
    assert Counter(map(tuple, split.union_chunks(df, "node", 6).collect())) == Counter(map(tuple, df.collect()))


def test_range_repartition_splits_a_big_partition(spark):
    df = spark.range(4000).select(F.lit(3).alias("partition_id"), F.col("id").alias("node"))
    out = split.range_repartition(df, partitions=4)
    held = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.count() == 4000 and len(held) == 4


def test_pilot_joins_are_broadcast(star):
    edges, nodes = star
    pilots = split.top_degree_pilots(edges, nodes.select("node"), 2)
    plan = split.pilot_subgraph(edges, pilots, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2
