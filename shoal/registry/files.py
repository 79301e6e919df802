"""Sources and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal import sources
from shoal.operators import split
from shoal.registry.catalog import PILOTS, query
from shoal.registry.fixtures import sql
from shoal.session import scratch_path


@query("read_edge_list", sql("SELECT src, dst FROM edges", node_table=False))
def _(x):
    path = scratch_path(x.spark, "edge-list")
    x.edges.select("src", "dst").write.csv(path, sep="\t")
    return sources.read_edge_list(x.spark, path)


@query("read_node_labels", "SELECT p_partkey AS id, p_brand AS label_name FROM part")
def _(x):
    path = scratch_path(x.spark, "wide-nodes")
    x.table("part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand").write.csv(path, sep="\t")
    return sources.read_node_labels(x.spark, path, n_columns=5)


@query("read_nodes_csv", sql("SELECT node * 7 AS id, label + 1 AS label, node FROM nodes", graph=False))
def _(x):
    path = scratch_path(x.spark, "nodes")
    x.nodes.select((F.col("node") * 7).alias("id"), F.col("label") + 1, "node").write.csv(path, header=True)
    return sources.read_nodes_csv(x.spark, path)


@query("read_index_edges_csv", sql("SELECT src AS index1, dst AS index2 FROM edges", node_table=False))
def _(x):
    path = scratch_path(x.spark, "index-edges")
    x.edges.select(F.col("src").alias("index1"), F.col("dst").alias("index2")).write.csv(path, header=True)
    return sources.read_nodes_csv(x.spark, path, "index1 LONG, index2 LONG")


WORKER_ROWS = """
SELECT n.partition_id, n.node, e.dst AS pilot
FROM nodes n LEFT JOIN (SELECT * FROM sym WHERE dst IN (SELECT node FROM pilots)) e ON e.src = n.node
WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = n.node)"""


def _worker_rows(x):
    parts = split.split_pilot_worker(x.sym, x.nodes.select("node", "label"), x.m, partitions=4)
    linked = parts.worker_edges.select("partition_id", F.col("src").alias("node"), F.col("dst").alias("pilot"))
    alone = parts.workers.join(linked.select("node").distinct(), "node", "left_anti")
    return linked.unionByName(alone.select("partition_id", "node"), allowMissingColumns=True)


@query("read_worker_csv", sql(WORKER_ROWS, PILOTS))
def _(x):
    path = scratch_path(x.spark, "workers")
    _worker_rows(x).write.csv(path, header=True)
    return sources.read_worker_csv(x.spark, path)


@query("write_worker_csv", sql(WORKER_ROWS, PILOTS))
def _(x):
    path = scratch_path(x.spark, "workers")
    sources.write_worker_csv(_worker_rows(x), path)
    return x.spark.read.csv(path, header=True, schema="partition_id INT, node LONG, pilot LONG")


LONG_EDGES = sql("SELECT partition_id, src, dst FROM sym JOIN nodes ON node = src")


@query("read_edges_json", LONG_EDGES)
def _(x):
    path = scratch_path(x.spark, "long-edges")
    split.inherit_partition(x.sym.select("src", "dst"), x.nodes).write.json(path)
    return sources.read_edges_json(x.spark, path)


@query("write_edges_json", LONG_EDGES)
def _(x):
    path = scratch_path(x.spark, "long-edges")
    sources.write_edges_json(split.inherit_partition(x.sym.select("src", "dst"), x.nodes), path)
    return sources.read_edges_json(x.spark, path)


@query("write_pilot_csv", sql("SELECT p.node, n.cluster FROM pilots p JOIN nodes n USING (node)", PILOTS))
def _(x):
    path = scratch_path(x.spark, "pilot-result")
    sources.write_pilot_csv(x.nodes.join(x.pilots, "node", "left_semi").select("node", "cluster"), path)
    return sources.read_nodes_csv(x.spark, path, "node LONG, cluster INT")


@query("write_result_json", sql("SELECT node, label, cluster FROM nodes", graph=False))
def _(x):
    path = scratch_path(x.spark, "result")
    sources.write_result_json(x.nodes.select("node", "label", "cluster"), path, files=1)
    return sources.read_edges_json(x.spark, path, "node LONG, label INT, cluster INT")
