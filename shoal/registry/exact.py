"""Clustering queries whose result is known: the planted graph without edges across blocks.

Every block is then a component of its own, so the leading vectors separate the blocks exactly
and SQL can say the clusters: blocks in the order of their lowest node (among the pilots, or in the first
partition). A worker without an edge to a pilot takes the lowest cluster.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.functions.columns import hash32
from shoal.operators import cluster, graph, spectral, split
from shoal.plans import end_to_end
from shoal.registry.catalog import query, rounded
from shoal.registry.embedding import long_worker_edges
from shoal.registry.fixtures import sql, sql_hash

RATIO = 0.2
PARTITIONS = 2


def _tables(ratio: float = RATIO, tag: str = "", order: str = "degree DESC", whole: str = "ceil") -> str:
    """``found<tag>``: node, label, kind and cluster of every node by the pilot method; pilots come first by ``order``."""
    return f"""
inside{tag} AS MATERIALIZED (SELECT src, dst, weight FROM sym WHERE src % 3 = dst % 3),
degrees{tag} AS MATERIALIZED (
  SELECT node, label, coalesce(sum(weight), 0) AS degree FROM nodes LEFT JOIN inside{tag} ON src = node GROUP BY node, label),
core{tag} AS MATERIALIZED (
  SELECT node, label FROM (SELECT node, label, row_number() OVER (ORDER BY {order}, node) - 1 AS rank FROM degrees{tag})
  WHERE rank < (SELECT {whole}(count(*) * {ratio}) FROM nodes)),
named{tag} AS (SELECT node % 3 AS block, row_number() OVER (ORDER BY min(node)) - 1 AS cluster FROM core{tag} GROUP BY node % 3),
linked{tag} AS (SELECT DISTINCT src AS node FROM inside{tag} JOIN core{tag} ON dst = node),
found{tag} AS MATERIALIZED (
  SELECT n.node, n.label, c.node IS NOT NULL AS pilot,
    (CASE WHEN c.node IS NOT NULL OR l.node IS NOT NULL THEN named{tag}.cluster ELSE 0 END)::INT AS cluster
  FROM nodes n JOIN named{tag} ON block = n.node % 3
  LEFT JOIN core{tag} c ON c.node = n.node LEFT JOIN linked{tag} l ON l.node = n.node)"""


def _labelled(x):
    return x.nodes.select("node", "label")


def _parts(x):
    m = split.pilots_for_ratio(x.nodes, RATIO)
    parts = split.split_pilot_worker(x.blocks, _labelled(x), m, 4)
    core = graph.add_self_weight(parts.pilot_edges, parts.pilots).persist()
    return parts, core, cluster.pilot_clustering(core, parts.pilots, 3), m


@query("pilot_clustering_exact", sql("SELECT node, label, cluster FROM found WHERE pilot", _tables()))
def _(x):
    return _parts(x)[2].result.select("node", "label", "cluster")


WORKERS = sql("SELECT node, label, cluster FROM found WHERE NOT pilot", _tables())


@query("partition_clustering_exact", WORKERS)
def _(x):
    parts, core, found, m = _parts(x)
    return cluster.partition_clustering(parts.workers, parts.worker_edges, parts.pilots, core, found.pseudo, pilot_bound=m)


@query("partition_clustering_spread_exact", WORKERS)
def _(x):
    """The same by joins and sums, as for partitions of any size."""
    parts, core, found, m = _parts(x)
    return cluster.partition_clustering(
        parts.workers, parts.worker_edges, parts.pilots, core, found.pseudo, pilot_bound=m, group_rows=0
    )


@query("partition_clustering_edges_exact", WORKERS)
def _(x):
    parts, core, found, m = _parts(x)
    edges = long_worker_edges(x.blocks, parts, m, 4)
    return cluster.partition_clustering_edges(edges, parts.workers, parts.pilots, core, found.pseudo, pilot_bound=m)


ALL = sql("SELECT node, label, cluster FROM found", _tables())


@query("pilot_distributed_exact", ALL)
def _(x):
    return end_to_end.pilot_distributed_clustering(x.blocks, _labelled(x), 3, pilot_ratio=RATIO, partitions=4)


LOCAL = f"""
placed AS (SELECT node, label, ({sql_hash("node::VARCHAR")} % {PARTITIONS})::INT AS partition_id FROM nodes),
local_named AS (
  SELECT partition_id, node % 3 AS block, (row_number() OVER (PARTITION BY partition_id ORDER BY min(node)) - 1)::INT AS cluster
  FROM placed GROUP BY partition_id, node % 3)"""


@query(
    "local_spectral_exact",
    sql("SELECT p.partition_id, node, cluster FROM placed p JOIN local_named l ON l.partition_id = p.partition_id AND block = node % 3", LOCAL),
)
def _(x):
    placed = split.assign_partitions(_labelled(x), PARTITIONS).select("node", "partition_id")
    return cluster.local_spectral_clustering(x.blocks, placed, 3, partitions=PARTITIONS)


@query(
    "divide_conquer_exact",
    sql("SELECT node, label, cluster FROM placed JOIN local_named l ON l.partition_id = 0 AND block = node % 3", LOCAL),
)
def _(x):
    return end_to_end.divide_conquer_clustering(x.blocks, _labelled(x), 3, partitions=PARTITIONS)


SWEEP = (0.2, 0.3)


@query(
    "pilot_ratio_sweep_exact",
    sql(
        " UNION ALL ".join(
            f"""
SELECT {r}::DOUBLE AS ratio, 0::INT AS repeat,
  round(sum((f.cluster <> m.cluster)::INT) / count(*), 6) AS misclustering_rate
FROM found{i} f JOIN named{i} m ON m.block = f.node % 3"""
            for i, r in enumerate(SWEEP)
        ),
        *[_tables(r, str(i)) for i, r in enumerate(SWEEP)],
    ),
)
def _(x):
    rates = end_to_end.pilot_ratio_sweep(x.blocks, _labelled(x), 3, SWEEP)
    return rounded(rates.withColumn("repeat", F.col("repeat").cast("int")), "misclustering_rate")


SPOTS = f"""
spots AS (
  SELECT p_partkey AS node, p_partkey % 5 AS own, [10.0::DOUBLE * (p_partkey % 5), {sql_hash("p_partkey::VARCHAR")} % 1000 / 1000.0] AS vec
  FROM part),
numbered AS (SELECT own, (row_number() OVER (ORDER BY min(node)) - 1)::INT AS cluster, avg(vec[1]) AS x, avg(vec[2]) AS y FROM spots GROUP BY own)"""


@query(
    "kmeans_labels_exact",
    sql(
        """
SELECT cluster, count(*) AS size, round(any_value(x), 5) AS x, round(any_value(y), 5) AS y,
  round(sum((vec[1] - x) * (vec[1] - x) + (vec[2] - y) * (vec[2] - y)), 4) AS cost
FROM spots JOIN numbered USING (own) GROUP BY cluster""",
        SPOTS,
        graph=False,
        node_table=False,
    ),
)
def _(x):
    """Five groups far apart: sizes, centres and cost of each cluster."""
    key = F.col("p_partkey")
    vec = F.array((10.0 * (key % 5)).cast("double"), (hash32(key) % 1000 / 1000).cast("double"))
    labelled, centres = cluster.kmeans_labels(x.table("part").select(key.alias("node"), vec.alias("vec")), 5)
    gap = F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    sums = labelled.join(centres, "cluster").groupBy("cluster").agg(
        F.count("*").alias("size"), F.first("centre").alias("c"), F.round(F.sum(gap), 4).alias("cost")
    )
    return sums.select("cluster", "size", F.round(F.col("c")[0], 5).alias("x"), F.round(F.col("c")[1], 5).alias("y"), "cost")


LEVERAGE = sql(
    """
SELECT src AS node, round(degree / sum(degree) OVER (PARTITION BY src % 3), 6) AS leverage
FROM (SELECT src, sum(weight) AS degree FROM sym WHERE src % 3 = dst % 3 GROUP BY src)""",
    node_table=False,
)


def _leverage(x, method: str):
    """Squared length of each row of the embedding: the leading vectors span the roots of the degrees of each block."""
    scaled = spectral.laplacian_sym(x.blocks, False)
    vectors = spectral.spectral_embed(scaled, 3, method, local_entries=0, symmetric=True)
    total = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    return vectors.select("node", F.round(total, 6).alias("leverage"))


@query("spectral_embed_svd_exact", LEVERAGE)
def _(x):
    return _leverage(x, "svd")


@query("spectral_embed_evd_exact", LEVERAGE)
def _(x):
    return _leverage(x, "evd")


COUNTS = (2, 4, 8)


@query(
    "method_comparison_exact",
    sql(
        f"""
SELECT 'pilot_distributed' AS method, m::INT AS partitions, rate AS misclustering_rate
FROM (SELECT round(sum((f.cluster <> n.cluster)::INT) / count(*), 6) AS rate FROM found f JOIN named n ON n.block = f.node % 3),
  (SELECT unnest({list(COUNTS)}) AS m)
UNION ALL SELECT 'divide_conquer', {PARTITIONS}, 0.0""",
        _tables(),
    ),
)
def _(x):
    """The pilot method never depends on the partitions. In more than two partitions a block falls apart, so there
    divide and conquer has no known result and is left out."""
    rates = end_to_end.method_comparison(x.blocks, _labelled(x), 3, COUNTS, RATIO)
    known = (F.col("method") == "pilot_distributed") | (F.col("partitions") == PARTITIONS)
    return rounded(rates.where(known).withColumn("partitions", F.col("partitions").cast("int")), "misclustering_rate")


JOB_RATIOS, REPEATS = (0.4, 0.5), 2


def _drawn(i: int) -> str:
    """The order of the random pilots of repeat ``i``; item ids are numbered from 0 in the order of the part keys."""
    return sql_hash(f"'pilot-{7 + i}-' || (node - (SELECT min(node) FROM nodes))")


@query(
    "dataset_job_exact",
    sql(
        "SELECT ratio, round(avg(rate), 5) AS mean_misclustering_rate FROM ("
        + " UNION ALL ".join(
            f"""
SELECT {r}::DOUBLE AS ratio, round(sum((f.cluster <> m.cluster)::INT) / count(*), 6) AS rate
FROM found{i}{j} f JOIN named{i}{j} m ON m.block = f.node % 3"""
            for i, r in enumerate(JOB_RATIOS)
            for j in range(REPEATS)
        )
        + ") GROUP BY ratio",
        *[_tables(r, f"{i}{j}", _drawn(j), "floor") for i, r in enumerate(JOB_RATIOS) for j in range(REPEATS)],
    ),
)
def _(x):
    """Named items and classes; new random pilots in each repeat; their number is rounded down."""
    name = lambda c: F.format_string("item-%012d", F.col(c))
    items = x.nodes.select(name("node").alias("id"), F.format_string("class %d", F.col("label")).alias("class"))
    pairs = x.blocks.where("src < dst").select(name("src").alias("src"), name("dst").alias("dst"))
    return end_to_end.dataset_job(pairs, items, 3, JOB_RATIOS, REPEATS, random=True, rounding="floor")


def _large_network(x):
    raw = x.blocks.where("src < dst")
    loops = raw.select("src", F.col("src").alias("dst"), "weight")
    m = split.pilots_for_ratio(x.nodes, RATIO)
    return end_to_end.large_network_job(raw.unionByName(raw).unionByName(loops), 3, m, 4)


LINKED = _tables() + """,
grouped AS MATERIALIZED (SELECT node, cluster FROM found WHERE node IN (SELECT src FROM inside))"""


@query("large_network_exact", sql("SELECT node, cluster FROM grouped", LINKED))
def _(x):
    return _large_network(x).result


@query(
    "large_network_density_exact",
    sql(
        """
SELECT within_edges, between_edges, within_pairs, between_pairs,
  round(between_edges / between_pairs * (within_pairs / within_edges), 6) AS relative_density
FROM (
  SELECT sum((a.cluster = b.cluster)::INT)::DOUBLE AS within_edges, sum((a.cluster <> b.cluster)::INT)::DOUBLE AS between_edges
  FROM inside JOIN grouped a ON a.node = src JOIN grouped b ON b.node = dst),
  (SELECT sum(n * (n - 1))::DOUBLE AS within_pairs, (sum(n) * sum(n) - sum(n * n))::DOUBLE AS between_pairs
   FROM (SELECT count(*) AS n FROM grouped GROUP BY cluster))""",
        LINKED,
    ),
)
def _(x):
    return rounded(_large_network(x).density, "relative_density")
