"""Graph construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.operators import graph
from shoal.registry.catalog import query
from shoal.registry.fixtures import sql


def text(col: str):
    """A list as text, so that both engines compare it the same way."""
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",").alias(col)


@query(
    "dense_index",
    "SELECT id, row_number() OVER (ORDER BY id) - 1 AS node FROM (SELECT DISTINCT o_custkey AS id FROM orders)",
)
def _(x):
    return graph.dense_index(x.table("orders").select(F.col("o_custkey").alias("id")), "id")


@query(
    "dense_index_local",
    sql(
        "SELECT partition_id, node AS id, row_number() OVER (PARTITION BY partition_id ORDER BY node) - 1 AS node FROM nodes",
        graph=False,
    ),
)
def _(x):
    ids = x.nodes.select("partition_id", F.col("node").alias("id"))
    return graph.dense_index(ids, "id", by=["partition_id"]).select("partition_id", "id", "node")


@query(
    "encode_labels",
    "SELECT c_custkey AS node, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS label FROM customer",
)
def _(x):
    named = x.table("customer").select(F.col("c_custkey").alias("node"), "c_mktsegment")
    return graph.encode_labels(named, "c_mktsegment").select("node", "label")


@query(
    "encode_labels_dictionary",
    "SELECT o_orderkey AS node, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END::INT AS label FROM orders",
)
def _(x):
    named = x.table("orders").select(F.col("o_orderkey").alias("node"), "o_orderstatus")
    return graph.encode_labels(named, "o_orderstatus", {"F": 0, "O": 1, "P": 2}).select("node", "label")


@query("shift_labels", sql("SELECT node, label FROM nodes", graph=False))
def _(x):
    return graph.shift_labels(x.nodes.select("node", (F.col("label") + 1).alias("label")))


@query(
    "map_endpoints",
    sql(
        """
SELECT a.node AS src, b.node AS dst, weight FROM edges
JOIN idx a ON a.id = 'P' || src JOIN idx b ON b.id = 'P' || dst""",
        "idx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS node FROM (SELECT 'P' || p_partkey AS id FROM part))",
        node_table=False,
    ),
)
def _(x):
    def name(c):
        return F.concat(F.lit("P"), F.col(c).cast("string"))

    named = x.edges.select(name("src").alias("src"), name("dst").alias("dst"), "weight")
    index = graph.dense_index(x.table("part").select(name("p_partkey").alias("id")), "id")
    return graph.map_endpoints(named, index)


@query("symmetrize", sql("SELECT src, dst, weight FROM sym", node_table=False))
def _(x):
    return graph.symmetrize(x.edges).select("src", "dst", "weight")


LINES = "SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS weight FROM lineitem"


def _lines(x):
    return x.table("lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight")
    )


@query("dedupe_edges", f"SELECT src, dst, max(weight) AS weight FROM ({LINES}) GROUP BY src, dst")
def _(x):
    return graph.dedupe_edges(_lines(x))


@query("drop_self_edges", f"SELECT src, dst, weight FROM ({LINES}) WHERE src <> dst")
def _(x):
    return graph.drop_self_edges(_lines(x))


@query(
    "add_self_weight",
    sql("SELECT src, dst, weight FROM sym UNION ALL SELECT node, node, 10.0 FROM nodes"),
)
def _(x):
    return graph.add_self_weight(x.sym, x.nodes)


# parts plus suppliers as further nodes that no edge touches
MORE_NODES = "more AS (SELECT p_partkey AS node FROM part UNION ALL SELECT -1 - s_suppkey FROM supplier)"


def _more(x):
    suppliers = x.table("supplier").select((-1 - F.col("s_suppkey")).alias("node"))
    return x.table("part").select(F.col("p_partkey").alias("node")).unionByName(suppliers)


def _lists_sql(block: int) -> str:
    return sql(
        f"""
SELECT node, part::INT AS part, coalesce(array_to_string(list_sort(list(dst) FILTER (dst IS NOT NULL)), ','), '') AS nbrs
FROM (SELECT node, dst, (row_number() OVER (PARTITION BY node ORDER BY dst) - 1) // {block} AS part FROM more LEFT JOIN both_ways ON src = node)
GROUP BY node, part""",
        MORE_NODES,
        """both_ways AS (
  SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem)""",
        graph=False,
        node_table=False,
    )


@query("adjacency_list", _lists_sql(graph.LIST_BLOCK))
def _(x):
    return graph.adjacency_list(_lines(x), _more(x)).select("node", "part", text("nbrs"))


@query("adjacency_list_blocks", _lists_sql(8))
def _(x):
    return graph.adjacency_list(_lines(x), _more(x), 8).select("node", "part", text("nbrs"))


@query("explode_adjacency", sql("SELECT partition_id, src, dst FROM sym JOIN nodes ON node = src"))
def _(x):
    lists = graph.adjacency_list(x.edges, x.nodes).join(x.nodes.select("node", "partition_id"), "node")
    return graph.explode_adjacency(lists)


@query(
    "keep_isolated",
    sql("SELECT node AS src, dst, weight FROM more LEFT JOIN sym ON src = node", MORE_NODES, node_table=False),
)
def _(x):
    return graph.keep_isolated(x.sym, _more(x))


@query("drop_isolated", sql("SELECT src, dst, weight FROM sym", node_table=False))
def _(x):
    return graph.drop_isolated(graph.keep_isolated(x.sym, _more(x)))


@query(
    "distinct_nodes", sql("SELECT DISTINCT partition_id, src AS node FROM sym JOIN nodes ON node = src")
)
def _(x):
    rows = x.sym.withColumnRenamed("src", "node").join(x.nodes.select("node", "partition_id"), "node")
    return graph.distinct_nodes(rows.withColumnRenamed("node", "src"), ["partition_id"])


@query("row_edges", sql("SELECT src, dst, weight FROM sym WHERE src IN (SELECT s_suppkey FROM supplier)", node_table=False))
def _(x):
    return graph.row_edges(x.sym, x.table("supplier").select(F.col("s_suppkey").alias("node")))


@query(
    "row_edges_exclude",
    sql("SELECT src, dst, weight FROM sym WHERE src NOT IN (SELECT s_suppkey FROM supplier)", node_table=False),
)
def _(x):
    return graph.row_edges(x.sym, x.table("supplier").select(F.col("s_suppkey").alias("node")), exclude=True)


@query("row_edges_listed", sql("SELECT src, dst, weight FROM sym WHERE src IN (1, 5, 7)", node_table=False))
def _(x):
    return graph.row_edges(x.sym, [1, 5, 7])


@query("without_column", sql("SELECT node, label, cluster FROM nodes", graph=False))
def _(x):
    return graph.without_column(x.nodes, "partition_id")


@query(
    "edge_check",
    """
WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_discount - 0.05::DOUBLE AS weight FROM lineitem)
SELECT 'unknown src' AS problem, src, dst FROM e WHERE src NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'unknown dst', src, dst FROM e WHERE dst NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'bad weight', src, dst FROM e WHERE weight < 0""",
)
def _(x):
    lines = x.table("lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_discount") - 0.05).alias("weight")
    )
    return graph.edge_check(lines, x.table("supplier").select(F.col("s_suppkey").alias("node")))
