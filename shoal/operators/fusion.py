"""Divide and conquer: super-nodes, fused graph, and labels spread back.

Local clusters are ``(partition_id, node, cluster)``; super-nodes are the long
table ``(super_id, node)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.columns import hash32
from shoal.operators.cluster import kmeans_labels
from shoal.operators.graph import LIST_BLOCK, dense_index, drop_self_edges, list_blocks, rank_within
from shoal.operators.spectral import spectral_embed
from shoal.session import cut_lineage

CLUSTER = ["partition_id", "cluster"]


def cluster_sizes(local: DataFrame) -> DataFrame:
    return local.groupBy(*CLUSTER).agg(F.count("*").alias("size"))


def local_cluster_members(local: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """Sorted node list per (partition, local cluster): ``(.., part, members)``, in contiguous blocks of ``block`` nodes.

    Parts 0, 1, .. in this order are one sorted list.
    """
    ranked = rank_within(local.select(*CLUSTER, "node"), CLUSTER, F.col("node"))
    return list_blocks(ranked, CLUSTER, "node", block, "members")


def break_small(local: DataFrame, min_size: int) -> DataFrame:
    """Clusters of fewer than ``min_size`` nodes: one piece per node, ``(.., node, piece)``."""
    return _by_size(local, F.col("size") < min_size).select(*CLUSTER, "node", F.col("node").alias("piece"))


def split_large(local: DataFrame, min_size: int, groups: int, retain_left: bool = False) -> DataFrame:
    """Clusters of ``min_size`` nodes or more: ``groups`` random pieces of equal size.

    The order is that of a hash. Leftover nodes form piece ``groups`` with
    ``retain_left``; otherwise they all join one piece drawn per cluster.
    """
    large = _by_size(local, F.col("size") >= min_size)
    order = hash32("partition_id", F.lit("-"), "cluster", F.lit("-"), "node")
    ranked = rank_within(large.withColumn("_h", order), CLUSTER, F.col("_h"), F.col("node"))
    return ranked.select(*CLUSTER, "node", split_remainder(F.col("rank"), F.col("size"), groups, retain_left).alias("piece"))


def split_remainder(rank, size, groups: int, retain_left: bool):
    """Piece of the node at ``rank``; the rule for what is left over by the equal split."""
    share = F.floor(size / groups)
    drawn = F.pmod(hash32("partition_id", F.lit("-"), "cluster", F.lit("-left")), F.lit(groups))
    left = F.lit(groups).cast("long") if retain_left else drawn.cast("long")
    return F.when(rank < share * groups, F.floor(rank / share)).otherwise(left)


def _by_size(local: DataFrame, wanted) -> DataFrame:
    return local.select(*CLUSTER, "node").join(cluster_sizes(local).where(wanted), CLUSTER)


def supernode_ids(pieces: DataFrame) -> DataFrame:
    """Number the pieces 0..S-1 in (partition, cluster, piece) order: ``(super_id, node)``."""
    keys = pieces.select(F.struct(*CLUSTER, "piece").alias("_key"), "node")
    ids = dense_index(keys, "_key", out="super_id")
    return keys.join(ids, "_key").select("super_id", "node")


def build_supernodes(local: DataFrame, min_size: int, groups: int, retain_left: bool = False) -> DataFrame:
    """Break the small clusters, split the large ones, number the pieces."""
    pieces = break_small(local, min_size).unionByName(split_large(local, min_size, groups, retain_left))
    return supernode_ids(cut_lineage(pieces))


def supernode_sizes(supernodes: DataFrame) -> DataFrame:
    return supernodes.groupBy("super_id").agg(F.count("*").alias("size"))


def block_density(edges: DataFrame, supernodes: DataFrame, diagonal: float = 0.0) -> DataFrame:
    """Edge weight between two groups / (size_a * size_b), ordered pairs, pair (a, a) included.

    Pairs of groups without an edge have density 0 and are not listed: their
    number grows with the square of the groups. ``diagonal`` adds that weight
    for every node to itself.
    """
    pairs = drop_self_edges(edges).select("src", "dst", "weight")
    if diagonal:
        loops = supernodes.select(
            F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(float(diagonal)).alias("weight")
        )
        pairs = pairs.unionByName(loops)
    a = supernodes.select(F.col("node").alias("src"), F.col("super_id").alias("super_a"))
    b = supernodes.select(F.col("node").alias("dst"), F.col("super_id").alias("super_b"))
    sums = pairs.join(a, "src").join(b, "dst").groupBy("super_a", "super_b").agg(F.sum("weight").alias("weight"))
    sizes = supernode_sizes(supernodes)
    return (
        sums.join(sizes.select(F.col("super_id").alias("super_a"), F.col("size").alias("size_a")), "super_a")
        .join(sizes.select(F.col("super_id").alias("super_b"), F.col("size").alias("size_b")), "super_b")
        .select(
            "super_a",
            "super_b",
            "size_a",
            "size_b",
            (F.col("weight") / (F.col("size_a") * F.col("size_b"))).alias("density"),
        )
    )


def fused_graph(density: DataFrame, threshold: float, single_pairs: str = "observed") -> DataFrame:
    """Fused edges ``(src, dst, weight = 1)`` where the density reaches the threshold.

    Two single-node super-nodes are joined if any edge was observed
    (``'observed'``), or always (``'always'``). The second rule is a clique over
    all single nodes; its pairs are not listed here but stand in
    ``clique_members``, which the degree and clustering operators take.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive: at 0 every pair of groups is an edge")
    if single_pairs not in ("observed", "always"):
        raise ValueError(f"single_pairs must be 'observed' or 'always', got {single_pairs!r}")
    singles = F.col("size_a") + F.col("size_b") == 2
    rule = F.col("density") > 0 if single_pairs == "observed" else F.lit(False)
    kept = density.where(F.when(singles, rule).otherwise(F.col("density") >= threshold))
    return kept.select(F.col("super_a").alias("src"), F.col("super_b").alias("dst"), F.lit(1.0).alias("weight"))


def clique_members(supernodes: DataFrame) -> DataFrame:
    """The single-node super-nodes."""
    return supernode_sizes(supernodes).where("size = 1").select("super_id")


def high_confidence(supernodes: DataFrame) -> DataFrame:
    """Super-nodes with more than one node."""
    return supernode_sizes(supernodes).where("size > 1").select("super_id")


def fused_degrees(fused: DataFrame, supernodes: DataFrame, clique: DataFrame | None = None) -> DataFrame:
    """Degree of every super-node, counting the clique of single nodes if there is one."""
    names = supernodes.select("super_id").distinct()
    degree = fused.groupBy(F.col("src").alias("super_id")).agg(F.sum("weight").alias("_d"))
    out = names.join(degree, "super_id", "left")
    value = F.coalesce("_d", F.lit(0.0))
    if clique is None:
        return out.select("super_id", value.alias("degree"))
    marked = clique.select("super_id", F.lit(1.0).alias("_m"))
    size = clique.agg(F.count("*").cast("double")).scalar()
    return out.join(marked, "super_id", "left").select(
        "super_id", (value + F.coalesce(F.col("_m") * size, F.lit(0.0))).alias("degree")
    )


def fused_clustering(
    fused: DataFrame, supernodes: DataFrame, k: int, clique: DataFrame | None = None, seed: int = 7, **embed
) -> DataFrame:
    """Regularised spectral clustering of the fused graph: ``(super_id, cluster)``."""
    degrees = cut_lineage(fused_degrees(fused, supernodes, clique))
    mean = degrees.agg(F.avg("degree")).scalar()
    scale = cut_lineage(degrees.select("super_id", (F.col("degree") + mean).alias("_s")))
    entries = (
        fused.join(scale.select(F.col("super_id").alias("src"), F.col("_s").alias("_a")), "src")
        .join(scale.select(F.col("super_id").alias("dst"), F.col("_s").alias("_b")), "dst")
        .select("src", "dst", (F.col("weight") / F.sqrt(F.col("_a") * F.col("_b"))).alias("weight"))
    )
    part = None
    if clique is not None:
        part = clique.join(scale, "super_id").select(
            F.col("super_id").alias("node"), (1 / F.sqrt("_s")).alias("weight")
        )
    vectors = cut_lineage(spectral_embed(cut_lineage(entries), k, clique=part, symmetric=True, **embed))
    # a super-node without any fused edge has a zero row
    zero = F.array(*[F.lit(0.0)] * k)
    rows = scale.select(F.col("super_id").alias("node")).join(vectors, "node", "left").select(
        "node", F.coalesce("vec", zero).alias("vec")
    )
    labelled, _ = kmeans_labels(rows, k, seed, restarts=3)
    return labelled.select(F.col("node").alias("super_id"), "cluster")


def spread_labels(supernodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Super-node label -> all its nodes."""
    return supernodes.join(labels, "super_id").select("node", "cluster")
