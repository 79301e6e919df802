from collections import Counter

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from shoal.operators import graph

EDGE = "src long, dst long, weight double"


def test_clean_up_of_a_messy_file(frame):
    raw = frame([(1, 2, 1.0), (2, 1, 1.0), (1, 2, 3.0), (3, 3, 1.0)], EDGE)
    clean = graph.dedupe_edges(graph.symmetrize(graph.drop_self_edges(raw)))
    assert rows_of(clean.select("src", "dst", "weight")) == [(1, 2, 3.0), (2, 1, 3.0)]


def test_dedupe_without_weight(frame):
    assert rows_of(graph.dedupe_edges(frame([(1, 2), (1, 2), (2, 1)], "src long, dst long"))) == [(1, 2), (2, 1)]


def test_self_weight_replaces_loops(frame):
    edges = frame([(1, 1, 4.0), (1, 2, 1.0)], EDGE)
    out = graph.add_self_weight(edges, frame([(1,), (2,), (3,)], "node long"), 10)
    assert rows_of(out) == [(1, 1, 10.0), (1, 2, 1.0), (2, 2, 10.0), (3, 3, 10.0)]


def test_string_ids_and_labels(frame):
    nodes = frame([("b", "Theory"), ("a", "Rules"), ("c", "Theory")], "id string, name string")
    index = graph.dense_index(nodes, "id")
    assert rows_of(index) == [("a", 0), ("b", 1), ("c", 2)]
    edges = graph.map_endpoints(frame([("a", "c"), ("b", "a")], "src string, dst string"), index)
    assert rows_of(edges) == [(0, 2), (1, 0)]
    assert rows_of(graph.encode_labels(nodes, "name").select("id", "label")) == [("a", 0), ("b", 1), ("c", 1)]
    fixed = graph.encode_labels(nodes, "name", {"Rules": 5, "Theory": 6})
    assert rows_of(fixed.select("id", "label")) == [("a", 5), ("b", 6), ("c", 6)]


def test_unknown_endpoint_raises(frame):
    index = frame([("a", 0)], "id string, node long")
    edges = frame([("a", "z")], "src string, dst string")
    assert rows_of(graph.unknown_endpoints(edges, index)) == [("z",)]
    with pytest.raises(ValueError, match="z"):
        graph.map_endpoints(edges, index)


def test_rank_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = graph.global_rank(df, F.col("v").desc()).collect()
    want = {v: i for i, v in enumerate(sorted((r.v for r in got), reverse=True))}
    assert len(got) == 5000 and all(r["rank"] == want[r.v] for r in got)


def test_rank_within_hot_group(spark):
    # one group holds a third of the rows
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), (F.col("id") * 37 % 3001).alias("v")
    )
    got = graph.rank_within(df, ["g"], F.col("v")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.v, r["rank"]))
    for members in groups.values():
        assert [rank for _, rank in sorted(members)] == list(range(len(members)))


@pytest.mark.parametrize("block", [3, 1000])
def test_adjacency_keeps_duplicates_in_any_block_size(spark, frame, block):
    # node 0 is a hub; the pair (0, 1) is listed eight times
    edges = [(0, i) for i in range(1, 30)] + [(0, 1)] * 7 + [(5, 6)]
    nodes = frame([(i,) for i in range(32)], "node long")
    lists = graph.adjacency_list(frame(edges, "src long, dst long"), nodes, block=block).collect()
    want = {i: Counter() for i in range(32)}
    for a, b in edges:
        want[a][b] += 1
        want[b][a] += 1
    got = {i: Counter() for i in range(32)}
    for r in lists:
        got[r.node] += Counter(r.nbrs)
    assert got == want
    parts = Counter(r.node for r in lists)
    assert (parts[0] > 1) == (block == 3)
    assert all(len(r.nbrs) <= block for r in lists)
    for node in parts:
        own = sorted((r.part, r.nbrs) for r in lists if r.node == node)
        assert [p for p, _ in own] == list(range(len(own)))
        assert sum((n for _, n in own), []) == sorted(want[node].elements())
    assert {i for i in range(32) if not want[i]} == {r.node for r in lists if not r.nbrs}
    back = graph.explode_adjacency(graph.adjacency_list(frame(edges, "src long, dst long"), nodes, block=block))
    assert Counter(tuple(r) for r in back.collect()) == Counter(edges) + Counter((b, a) for a, b in edges)


def test_isolated_nodes(frame):
    edges = frame([(1, 2, 1.0)], EDGE)
    kept = graph.keep_isolated(edges, frame([(1,), (9,)], "node long"))
    assert {tuple(r) for r in kept.collect()} == {(1, 2, 1.0), (9, None, None)}
    assert rows_of(graph.drop_isolated(kept)) == [(1, 2, 1.0)]


def test_edge_check(frame):
    edges = frame([(1, 2, 1.0), (1, 9, -1.0), (8, 1, float("nan"))], EDGE)
    got = rows_of(graph.edge_check(edges, frame([(1,), (2,)], "node long")).select("problem", "src", "dst"))
    assert got == [("bad weight", 1, 9), ("bad weight", 8, 1), ("unknown dst", 1, 9), ("unknown src", 8, 1)]
    with pytest.raises(ValueError, match="weight"):
        graph.edge_check(edges.drop("weight"), edges)


def test_symmetrize_reads_its_input_once(frame):
    plan = graph.symmetrize(frame([(1, 2, 1.0)], EDGE))._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def order_lines():
    """Orders of 1 to 30 parts with repeats and nulls."""
    rows = [(o, (o * 37 + i * 11) % 90) for o in range(60) for i in range(1 + o % 30)]
    return rows + rows[:40] + [(None, 1), (3, None), (None, None)]


def linked_parts(lines):
    """The graph by brute force: parts of an order with the part of lowest hash in each of four slots."""
    from hashlib import md5

    orders = {}
    for o, p in lines:
        if o is not None and p is not None:
            orders.setdefault(o, {})[p] = int(md5(f"{o}-{p}".encode()).hexdigest()[:8], 16)
    anchors = {o: {min((h, p) for p, h in parts.items() if h % 4 == s)[1] for s in {h % 4 for h in parts.values()}} for o, parts in orders.items()}
    return {(min(p, a), max(p, a), 1.0) for o, parts in orders.items() for p in parts for a in anchors[o] if p != a}


def test_part_graph_is_built_in_tasks_that_follow_the_lines(spark, frame, tmp_path, monkeypatch):
    from shoal import session
    from shoal.registry import fixtures

    lines = order_lines()
    frame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(session.shuffle_tasks, "__defaults__", (50,))
    try:
        edges = fixtures.graph_edges(spark, str(tmp_path))
        got = [tuple(r) for r in edges.collect()]
        assert len(got) == len(set(got)) and set(got) == linked_parts(lines)
        assert edges.rdd.getNumPartitions() >= len(lines) / 50
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= len(lines) / 50
        session.size_shuffles(spark, 1)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= len(lines) / 50  # it only rises
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_map_endpoints_computes_its_edges_once(spark, frame):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    edges = frame([("a", "c"), ("b", "a"), ("c", "b")], "src string, dst string").withColumn(
        "src", counted.asNondeterministic()("src")
    )
    index = frame([("a", 0), ("b", 1), ("c", 2)], "id string, node long")
    assert rows_of(graph.map_endpoints(edges, index)) == [(0, 2), (1, 0), (2, 1)]
    assert seen.value == 3


@pytest.mark.parametrize("edge", [("z", "a"), ("a", None), (None, "a")])
def test_any_end_without_a_node_raises(frame, edge):
    # a node without a number is known
    index = frame([("a", 0), ("b", None)], "id string, node long")
    assert rows_of(graph.map_endpoints(frame([("a", "b")], "src string, dst string"), index)) == [(0, None)]
    with pytest.raises(ValueError, match="'z'" if "z" in edge else "None"):
        graph.map_endpoints(frame([("a", "a"), edge], "src string, dst string"), index)


def test_shuffles_follow_the_rows_of_a_given_table(spark, frame, tmp_path, monkeypatch):
    from shoal import session
    from shoal.registry.catalog import QUERIES

    rows = [(p, p % 7, 1.0) for p in range(400)]
    frame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    frame([(p,) for p in range(410)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    frame([(s,) for s in range(9)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(session.shuffle_tasks, "__defaults__", (50,))
    try:
        lists = {(r.node, r.part): r.nbrs for r in QUERIES["adjacency_list_blocks"](spark, str(tmp_path)).collect()}
        assert lists[(399, 0)] == "0" and lists[(409, 0)] == "" and lists[(-9, 0)] == ""
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fused_graph_builds_its_edges_once(spark, frame, tmp_path):
    from shoal.registry.catalog import QUERIES

    frame(order_lines(), "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    frame([(p,) for p in range(90)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    fused = QUERIES["fused_graph"](spark, str(tmp_path))
    assert fused.count() > 0
    assert "InMemoryTableScan" in fused._jdf.queryExecution().executedPlan().toString()
