"""Degrees, pilots, partitions and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.operators import split
from shoal.registry.building import text
from shoal.registry.catalog import DEGREES, PILOTS, RATIO, query
from shoal.registry.fixtures import sql, sql_hash
from shoal.session import checked_broadcast


@query("out_degree", sql("SELECT src AS node, sum(weight) AS degree FROM sym GROUP BY src", node_table=False))
def _(x):
    return split.out_degree(x.sym)


@query(
    "in_degree",
    "SELECT l_suppkey AS node, sum(l_quantity) AS degree FROM lineitem GROUP BY l_suppkey",
)
def _(x):
    lines = x.table("lineitem")
    return split.in_degree(lines.select(F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight")))


@query("mean_degree", sql("SELECT round(avg(degree), 6) AS mean_degree FROM deg", DEGREES))
def _(x):
    mean = split.mean_degree(split.node_degrees(x.sym, x.nodes.select("node")))
    return mean.select(F.round("mean_degree", 6).alias("mean_degree"))


@query("degree_rank", sql("SELECT node, degree, rank FROM ranked", DEGREES))
def _(x):
    return split.degree_rank(x.sym, x.nodes.select("node"))


@query("top_degree_pilots", sql("SELECT node, degree, rank FROM pilots", PILOTS))
def _(x):
    return split.top_degree_pilots(x.sym, x.nodes.select("node"), x.m)


@query("pilot_rank", sql("SELECT src, rank AS dst, weight FROM sym JOIN pilots ON node = dst", PILOTS))
def _(x):
    return split.pilot_columns(x.sym, x.pilots, "dst", x.m)


@query(
    "random_pilots",
    sql(
        f"""
SELECT node, rank FROM (
  SELECT node, row_number() OVER (ORDER BY {sql_hash("'pilot-' || node")}, node) - 1 AS rank FROM nodes)
WHERE rank < (SELECT ceil(count(*) * {RATIO}) FROM nodes)""",
        graph=False,
    ),
)
def _(x):
    return split.random_pilots(x.nodes.select("node"), x.m)


@query(
    "pilot_count",
    sql(f"SELECT count(*) AS n, ceil(count(*) * {RATIO})::BIGINT AS m FROM nodes", graph=False),
)
def _(x):
    return split.pilot_count(x.nodes, RATIO)


@query("pilot_count_floor", sql("SELECT count(*) AS n, floor(count(*) * 0.15)::BIGINT AS m FROM nodes", graph=False))
def _(x):
    return split.pilot_count(x.nodes, 0.15, "floor")


@query(
    "worker_nodes",
    sql("SELECT node, label FROM nodes WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = nodes.node)", PILOTS),
)
def _(x):
    return split.worker_nodes(x.nodes.select("node", "label"), x.pilots, x.m)


@query(
    "assign_partitions",
    sql(f"SELECT node, ({sql_hash('node::VARCHAR')} % 10)::INT AS partition_id FROM nodes", graph=False),
)
def _(x):
    return split.assign_partitions(x.nodes.select("node"), 10)


@query("inherit_partition", sql("SELECT partition_id, src, dst, weight FROM sym JOIN nodes ON node = src"))
def _(x):
    return split.inherit_partition(x.sym, x.nodes)


IS_PILOT = "(SELECT node FROM pilots)"


@query("pilot_subgraph", sql(f"SELECT src, dst, weight FROM sym WHERE src IN {IS_PILOT} AND dst IN {IS_PILOT}", PILOTS))
def _(x):
    return split.pilot_subgraph(x.sym, x.pilots, x.m)


@query(
    "worker_pilot_edges",
    sql(f"SELECT src, dst, weight FROM sym WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = src) AND dst IN {IS_PILOT}", PILOTS),
)
def _(x):
    return split.worker_pilot_edges(x.sym, x.pilots, x.m)


WITHIN = """
SELECT a.partition_id, src, dst, weight FROM sym JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst
WHERE a.partition_id = b.partition_id"""


@query("within_partition_subgraph", sql(WITHIN))
def _(x):
    return split.within_partition_subgraph(x.sym, x.nodes)


@query("within_partition_by_hash", sql(WITHIN))
def _(x):
    return split.within_partition_subgraph(x.sym, partitions=4)


@query(
    "node_feature_rows",
    sql(
        f"""
SELECT n.node, n.label, n.partition_id,
  coalesce(array_to_string(list_sort(list(p.rank) FILTER (p.rank IS NOT NULL)), ','), '') AS pilot_ranks
FROM nodes n LEFT JOIN sym e ON e.src = n.node LEFT JOIN pilots p ON p.node = e.dst
WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = n.node) GROUP BY n.node, n.label, n.partition_id""",
        PILOTS,
    ),
)
def _(x):
    parts = split.split_pilot_worker(x.sym, x.nodes.select("node", "label"), x.m, 4)
    rows = split.node_feature_rows(parts.workers, parts.worker_edges, parts.pilots, x.m)
    return rows.select("node", "label", "partition_id", text("pilot_ranks"))


@query(
    "split_pilot_worker",
    sql(
        f"""
SELECT 'pilot' AS kind, NULL::INT AS partition_id, rank AS a, node AS b, label::DOUBLE AS value FROM pilots
UNION ALL SELECT 'worker', partition_id, node, NULL, label FROM nodes WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = nodes.node)
UNION ALL SELECT 'pilot edge', NULL, src, dst, weight FROM sym WHERE src IN {IS_PILOT} AND dst IN {IS_PILOT}
UNION ALL SELECT 'worker edge', partition_id, src, dst, weight FROM sym JOIN nodes ON node = src
WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = src) AND dst IN {IS_PILOT}""",
        PILOTS,
    ),
)
def _(x):
    parts = split.split_pilot_worker(x.sym, x.nodes.select("node", "label"), x.m, 4)

    def rows(df, kind, a, b, value, partition=F.lit(None).cast("int")):
        return df.select(
            F.lit(kind).alias("kind"),
            partition.alias("partition_id"),
            a.cast("long").alias("a"),
            b.cast("long").alias("b"),
            value.cast("double").alias("value"),
        )

    part = F.col("partition_id")
    src, dst, weight = F.col("src"), F.col("dst"), F.col("weight")
    return (
        rows(parts.pilots, "pilot", F.col("rank"), F.col("node"), F.col("label"))
        .unionByName(rows(parts.workers, "worker", F.col("node"), F.lit(None), F.col("label"), part))
        .unionByName(rows(parts.pilot_edges, "pilot edge", src, dst, weight))
        .unionByName(rows(parts.worker_edges, "worker edge", src, dst, weight, part))
    )


@query("union_chunks", sql("SELECT src, dst, weight FROM sym", node_table=False))
def _(x):
    return split.union_chunks(x.sym.persist(), "src", 5)


@query("range_repartition", sql("SELECT partition_id, src, dst, weight FROM sym JOIN nodes ON node = src"))
def _(x):
    return split.range_repartition(split.inherit_partition(x.sym, x.nodes))


@query("neighbours_in_set", sql(f"SELECT DISTINCT src, dst FROM sym WHERE dst IN {IS_PILOT}", PILOTS))
def _(x):
    return split.neighbours_in_set(x.sym, x.pilots)


@query("neighbours_outside_set", sql(f"SELECT DISTINCT src, dst FROM sym WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = dst)", PILOTS))
def _(x):
    return split.neighbours_outside_set(x.sym, x.pilots)


@query("merge_results", sql("SELECT node, label, cluster FROM nodes"))
def _(x):
    rows = x.nodes.select("node", "label", "cluster")
    pilot = rows.join(checked_broadcast(x.pilots, x.m), "node", "left_semi")
    return split.merge_results(pilot, split.worker_nodes(rows, x.pilots, x.m))


@query("attach_labels", sql("SELECT node, rank, degree, label FROM pilots", PILOTS))
def _(x):
    return split.attach_labels(x.pilots.select("node", "rank", "degree"), x.nodes)
