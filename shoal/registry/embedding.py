"""Normalised matrices, embeddings and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.operators import cluster, graph, spectral, split
from shoal.plans import end_to_end
from shoal.registry.catalog import PILOTS, query, rounded
from shoal.registry.fixtures import sql, sql_hash

LOOPED = "looped AS (SELECT src, dst, weight FROM sym UNION ALL SELECT node, node, 10.0::DOUBLE FROM nodes)"
LOOP_DEGREES = "d AS (SELECT src AS node, sum(weight) AS d FROM looped GROUP BY src), dm AS (SELECT avg(d) AS m FROM d)"


def _looped(x):
    return graph.add_self_weight(x.sym, x.nodes)


@query(
    "laplacian_sym",
    sql(
        """
SELECT src, dst, round(weight / sqrt(a.d * b.d), 6) AS weight
FROM looped JOIN d a ON a.node = src JOIN d b ON b.node = dst""",
        LOOPED,
        LOOP_DEGREES,
    ),
)
def _(x):
    return rounded(spectral.laplacian_sym(_looped(x)), "weight")


@query(
    "laplacian_sym_reg",
    sql(
        """
SELECT src, dst, round(weight / sqrt((a.d + m) * (b.d + m)), 6) AS weight
FROM looped JOIN d a ON a.node = src JOIN d b ON b.node = dst CROSS JOIN dm""",
        LOOPED,
        LOOP_DEGREES,
    ),
)
def _(x):
    return rounded(spectral.laplacian_sym(_looped(x), regularize=True), "weight")


WORKER_EDGES = """
we AS (
  SELECT src, dst, weight FROM sym
  WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = src) AND dst IN (SELECT node FROM pilots)),
wo AS (SELECT src AS node, sum(weight) AS d FROM we GROUP BY src),
wi AS (SELECT dst AS node, sum(weight) AS d FROM we GROUP BY dst)"""


def _worker_edges(x):
    return split.worker_pilot_edges(x.sym, x.pilots, x.m)


@query(
    "laplacian_bip",
    sql(
        """
SELECT src, dst, round(weight / sqrt(wo.d * wi.d), 6) AS weight
FROM we JOIN wo ON wo.node = src JOIN wi ON wi.node = dst""",
        PILOTS,
        WORKER_EDGES,
    ),
)
def _(x):
    return rounded(spectral.laplacian_bip(_worker_edges(x)), "weight")


@query(
    "laplacian_bip_reg",
    sql(
        """
SELECT src, dst, round(weight / sqrt(
    (wo.d + (SELECT sum(d) FROM wo) / (SELECT count(*) FROM nodes WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = nodes.node))) *
    (wi.d + (SELECT sum(d) FROM wi) / (SELECT count(*) FROM pilots))), 6) AS weight
FROM we JOIN wo ON wo.node = src JOIN wi ON wi.node = dst""",
        PILOTS,
        WORKER_EDGES,
    ),
)
def _(x):
    workers = split.worker_nodes(x.nodes.select("node"), x.pilots, x.m)
    scaled = spectral.laplacian_bip(_worker_edges(x), True, rows=workers, columns=x.pilots.select("node"))
    return rounded(scaled, "weight")


@query(
    "row_factors",
    sql(
        """
SELECT n.node, round(coalesce(1 / sqrt(wo.d), 10000.0), 6) AS factor
FROM nodes n LEFT JOIN wo USING (node) WHERE NOT EXISTS (SELECT 1 FROM pilots z WHERE z.node = n.node)""",
        PILOTS,
        WORKER_EDGES,
    ),
)
def _(x):
    workers = split.worker_nodes(x.nodes.select("node"), x.pilots, x.m)
    return rounded(spectral.row_factors(_worker_edges(x), workers), "factor")


@query(
    "stack_pilot_worker",
    sql(
        """
SELECT p.partition_id, src, dst, weight FROM sym
CROSS JOIN (SELECT DISTINCT partition_id FROM nodes) p
WHERE src IN (SELECT node FROM pilots) AND dst IN (SELECT node FROM pilots)
UNION ALL SELECT n.partition_id, src, dst, weight FROM we JOIN nodes n ON n.node = src""",
        PILOTS,
        WORKER_EDGES,
    ),
)
def _(x):
    core = split.pilot_subgraph(x.sym, x.pilots, x.m)
    linked = split.inherit_partition(_worker_edges(x), x.nodes)
    return spectral.stack_pilot_worker(core, linked, x.nodes)


# ------------------------------------------------ on the embeddings table

VECTORS = f"""
vecs AS (
  SELECT vec_id AS node, label AS cluster, embedding::DOUBLE[] AS vec,
    ({sql_hash("vec_id::VARCHAR")} % 4)::INT AS partition_id
  FROM embeddings),
flat AS (SELECT node, cluster, partition_id, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM vecs)"""
GAPS = """
cells AS (SELECT cluster, i, avg(v) AS v FROM flat GROUP BY cluster, i),
gaps AS (
  SELECT node, f.cluster AS own, c.cluster AS centre_id, sqrt(sum((f.v - c.v) * (f.v - c.v))) AS distance
  FROM flat f JOIN cells c USING (i) GROUP BY node, f.cluster, c.cluster)"""
LOCAL_GAPS = """
cells AS (SELECT partition_id, cluster, i, avg(v) AS v FROM flat GROUP BY partition_id, cluster, i),
gaps AS (
  SELECT f.partition_id, node, c.cluster, sqrt(sum((f.v - c.v) * (f.v - c.v))) AS distance
  FROM flat f JOIN cells c USING (partition_id, i) GROUP BY f.partition_id, node, c.cluster)"""


def _vectors(x):
    base = x.table("embeddings").select(
        F.col("vec_id").alias("node"),
        F.col("label").alias("cluster"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
    )
    return split.assign_partitions(base, 4)


def _centres(vectors, *by):
    keys = [*by, "cluster"]
    cells = vectors.select(*keys, F.posexplode("vec").alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    # one entry per dimension and cluster
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c["v"]).alias("centre"))


@query(
    "row_normalize",
    "WITH "
    + VECTORS
    + """, n AS (SELECT node, sqrt(sum(v * v)) AS n FROM flat GROUP BY node)
SELECT node, (i - 1)::INT AS i, round(CASE WHEN n = 0 THEN v ELSE v / n END, 6) AS v FROM flat JOIN n USING (node)""",
)
def _(x):
    unit = spectral.row_normalize(_vectors(x).select("node", "vec"))
    return rounded(unit.select("node", F.posexplode("vec").alias("i", "v")), "v")


@query(
    "centre_distances",
    f"WITH {VECTORS}, {GAPS} SELECT node, centre_id AS cluster, round(distance, 6) AS distance FROM gaps",
)
def _(x):
    vectors = _vectors(x)
    return rounded(spectral.centre_distances(vectors.select("node", "vec"), _centres(vectors)), "distance")


@query(
    "pseudo_centres",
    f"""WITH {VECTORS}, {GAPS}
SELECT centre_id, node, own AS cluster, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY centre_id ORDER BY distance, node) AS r FROM gaps) WHERE r = 1""",
)
def _(x):
    vectors = _vectors(x)
    rows = vectors.select("node", F.col("node").alias("rank"), "vec", "cluster")
    found = cluster.pseudo_centres(rows, _centres(vectors), check=False)
    return rounded(found.select("centre_id", "node", "cluster", "distance"), "distance")


@query(
    "nearest_centre",
    f"""WITH {VECTORS}, {LOCAL_GAPS}
SELECT partition_id, node, cluster FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, cluster) AS r FROM gaps) WHERE r = 1""",
)
def _(x):
    vectors = _vectors(x)
    centres = _centres(vectors, "partition_id").withColumn("rank", F.col("cluster"))
    return cluster.nearest_centre(vectors.select("partition_id", "node", "vec"), centres, ["partition_id"])


# ------------------------------------------------ iterative work: no SQL


def _unpacked(embedding):
    return embedding.select(*[c for c in embedding.columns if c != "vec"], *[F.col("vec")[i].alias(f"v{i}") for i in range(3)])


def _pilot_parts(x):
    parts = split.split_pilot_worker(x.planted, x.nodes.select("node", "label"), x.m, 4)
    # several plans read the pilot graph
    return parts, graph.add_self_weight(parts.pilot_edges, parts.pilots).persist()


@query("spectral_embed_svd")
def _(x):
    return _unpacked(spectral.spectral_embed(spectral.laplacian_sym(graph.add_self_weight(x.planted, x.nodes)), 3, symmetric=True))


@query("spectral_embed_evd")
def _(x):
    looped = graph.add_self_weight(x.planted, x.nodes)
    return _unpacked(spectral.spectral_embed(spectral.laplacian_sym(looped), 3, method="evd"))


@query("kmeans_labels")
def _(x):
    labelled, _ = cluster.kmeans_labels(_vectors(x).select("node", "vec"), 10)
    return labelled.select("node", "cluster")


@query("pilot_clustering")
def _(x):
    parts, core = _pilot_parts(x)
    return cluster.pilot_clustering(core, parts.pilots, 3).result


@query("partition_clustering")
def _(x):
    parts, core = _pilot_parts(x)
    found = cluster.pilot_clustering(core, parts.pilots, 3)
    return cluster.partition_clustering(
        parts.workers, parts.worker_edges, parts.pilots, core, found.pseudo, pilot_bound=parts.m
    )


@query("partition_clustering_edges")
def _(x):
    parts, core = _pilot_parts(x)
    found = cluster.pilot_clustering(core, parts.pilots, 3)
    return cluster.partition_clustering_edges(
        long_worker_edges(x.planted, parts, x.m, 4), parts.workers, parts.pilots, core, found.pseudo, pilot_bound=parts.m
    )


def long_worker_edges(edges, parts, m, partitions):
    return split.long_worker_edges(edges, parts.pilots, partitions, m)


@query("pilot_distributed_clustering")
def _(x):
    return end_to_end.pilot_distributed_clustering(
        x.planted, x.nodes.select("node", "label"), 3, pilot_ratio=0.1, partitions=4
    )


@query("pilot_distributed_plain")
def _(x):
    return end_to_end.pilot_distributed_clustering(
        x.planted, x.nodes.select("node", "label"), 3, pilot_ratio=0.1, partitions=4, regularize=False, random=True
    )


@query("local_spectral_clustering")
def _(x):
    return cluster.local_spectral_clustering(x.planted, x.nodes.select("node", "partition_id"), 3)
