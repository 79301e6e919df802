"""Whole methods on an edge table, and their comparison."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.cluster import (
    local_spectral_clustering,
    partition_clustering,
    partition_clustering_edges,
    pilot_clustering,
)
from shoal.operators.evaluate import misclustering_rate, relative_density, repeat_mean
from shoal.operators.fusion import (
    block_density,
    build_supernodes,
    clique_members,
    fused_clustering,
    fused_graph,
    spread_labels,
)
from shoal.operators.graph import (
    add_self_weight,
    dedupe_edges,
    dense_index,
    distinct_nodes,
    drop_self_edges,
    encode_labels,
    map_endpoints,
    symmetrize,
)
from shoal.operators.split import (
    assign_partitions,
    attach_labels,
    long_worker_edges,
    merge_results,
    pilots_for_ratio,
    split_pilot_worker,
)
from shoal.session import cut_lineage


def symmetric_graph(edges: DataFrame) -> DataFrame:
    """Clean one-direction edges into the symmetric edge table the methods take."""
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    return dedupe_edges(symmetrize(drop_self_edges(edges).select("src", "dst", "weight")))


def pilot_distributed_clustering(
    edges: DataFrame,
    nodes: DataFrame,
    k: int,
    pilot_ratio: float | None = None,
    pilots: int | None = None,
    partitions: int | None = 4,
    regularize: bool = True,
    random: bool = False,
    self_weight: float = 10.0,
    seed: int = 7,
    rounding: str = "ceil",
    **options,
) -> DataFrame:
    """Pilot clustering, then one independent step per partition: ``(node, label, cluster)``.

    ``edges`` is symmetric and without repeats (``symmetric_graph``). Only the
    pilot graph and K pseudo-centres travel to the partitions. ``random`` pilots are drawn by
    ``seed``; ``rounding`` (``ceil`` or ``floor``) turns ``pilot_ratio`` into a number of pilots.
    """
    if (pilot_ratio is None) == (pilots is None):
        raise ValueError("give either pilot_ratio or pilots")
    m = pilots if pilots is not None else pilots_for_ratio(nodes, pilot_ratio, rounding)
    if "label" not in nodes.columns:
        nodes = nodes.withColumn("label", F.lit(None).cast("int"))
    edges = edges.persist()
    split = split_pilot_worker(edges, nodes, m, partitions, random, f"pilot-{seed}")
    core = cut_lineage(add_self_weight(split.pilot_edges, split.pilots, self_weight))
    size = core.count()
    centre = pilot_clustering(core, split.pilots, k, regularize, seed, size=size)
    workers = partition_clustering(
        split.workers,
        split.worker_edges,
        split.pilots,
        core,
        centre.pseudo,
        regularize,
        pilot_bound=m,
        core_size=size,
        **options,
    )
    return merge_results(centre.result.select("node", "label", "cluster"), workers)


def divide_conquer_clustering(
    edges: DataFrame,
    nodes: DataFrame,
    k: int,
    partitions: int | None = 4,
    min_size: int = 10,
    groups: int = 1,
    threshold: float | None = None,
    single_pairs: str = "observed",
    diagonal: float = 0.0,
    retain_left: bool = False,
    seed: int = 7,
    **options,
) -> DataFrame:
    """Cluster every partition alone, fuse the local clusters, spread the labels back.

    ``edges`` is symmetric. Without ``threshold`` the mean density of the graph is used.
    """
    edges = edges.persist()
    if partitions is not None:
        nodes = assign_partitions(nodes, partitions)
    placed = nodes.select("node", "partition_id")
    local = cut_lineage(local_spectral_clustering(edges, placed, k, partitions=partitions, seed=seed, **options))
    supers = cut_lineage(build_supernodes(local, min_size, groups, retain_left))
    if threshold is None:
        n = nodes.count()
        threshold = edges.agg(F.sum("weight")).first()[0] / (n * (n - 1))
    density = block_density(edges, supers, diagonal)
    fused = cut_lineage(fused_graph(density, threshold, single_pairs))
    clique = clique_members(supers) if single_pairs == "always" else None
    labels = fused_clustering(fused, supers, k, clique, seed)
    out = spread_labels(supers, labels)
    if "label" not in nodes.columns:
        return out.select("node", F.lit(None).cast("int").alias("label"), "cluster")
    return attach_labels(out, nodes).select("node", "label", "cluster")


def pilot_ratio_sweep(
    edges: DataFrame, nodes: DataFrame, k: int, ratios: Iterable[float], repeats: int = 1, **options
) -> DataFrame:
    """Mis-clustering rate for a list of pilot ratios: ``(ratio, repeat, misclustering_rate)``.

    Every repeat has its own seed, so with ``random=True`` its own pilots.
    """
    edges = edges.persist()
    runs = [
        pilot_distributed_clustering(edges, nodes, k, pilot_ratio=r, seed=7 + i, **options)
        .withColumn("ratio", F.lit(float(r)))
        .withColumn("repeat", F.lit(i))
        for r in ratios
        for i in range(repeats)
    ]
    return misclustering_rate(merge_results(*runs), k, ["ratio", "repeat"])


def method_comparison(
    edges: DataFrame, nodes: DataFrame, k: int, partitions: Iterable[int], pilot_ratio: float = 0.2, **options
) -> DataFrame:
    """Both methods on the same graph over a list of partition counts."""
    edges = edges.persist()
    runs = []
    for m in partitions:
        pilot = pilot_distributed_clustering(edges, nodes, k, pilot_ratio=pilot_ratio, partitions=m)
        fused = divide_conquer_clustering(edges, nodes, k, partitions=m, **options)
        for name, run in (("pilot_distributed", pilot), ("divide_conquer", fused)):
            runs.append(
                run.select("node", "label", "cluster")
                .withColumn("method", F.lit(name))
                .withColumn("partitions", F.lit(m))
            )
    return misclustering_rate(merge_results(*runs), k, ["method", "partitions"])


def dataset_job(
    pairs: DataFrame,
    items: DataFrame,
    k: int,
    ratios: Iterable[float],
    repeats: int = 1,
    id_col: str = "id",
    class_col: str = "class",
    **options,
) -> DataFrame:
    """A labelled data set, from its tables to ``(ratio, mean_misclustering_rate)``.

    ``pairs (src, dst)`` are links between item ids, ``items`` has an id and a class name per item. Ids become
    node numbers in id order and classes labels in name order; a link to an unknown id raises. The sweep runs
    on the symmetric graph, ``repeats`` times for each ratio (``random=True`` draws new pilots each time).
    """
    coded = encode_labels(items.select(id_col, class_col), class_col)
    nodes = cut_lineage(dense_index(items, id_col).join(coded, id_col))
    edges = cut_lineage(symmetric_graph(map_endpoints(pairs, nodes, id_col)))
    rates = pilot_ratio_sweep(edges, nodes.select("node", "label"), k, ratios, repeats, **options)
    return repeat_mean(rates, "ratio", "misclustering_rate")


class Communities(NamedTuple):
    result: DataFrame  # node, cluster
    density: DataFrame  # the row of relative_density


def large_network_job(
    edges: DataFrame,
    k: int,
    pilots: int,
    partitions: int,
    regularize: bool = True,
    self_weight: float = 10.0,
    seed: int = 7,
    **options,
) -> Communities:
    """Communities of a network without labels, from its raw edges, and how dense they are.

    ``edges (src, dst [, weight])`` may have loops, repeats and either direction. Partitions get the edges
    of their nodes as they are, to any node, and keep those to a pilot. A node without an edge is not in the result.
    """
    graph = cut_lineage(symmetric_graph(edges))
    split = split_pilot_worker(graph, distinct_nodes(graph).select("node"), pilots, partitions)
    core = cut_lineage(add_self_weight(split.pilot_edges, split.pilots, self_weight))
    size = core.count()
    centre = pilot_clustering(core, split.pilots, k, regularize, seed, size=size)
    workers = partition_clustering_edges(
        long_worker_edges(graph, split.pilots, partitions, pilots),
        split.workers,
        split.pilots,
        core,
        centre.pseudo,
        pilot_bound=pilots,
        regularize=regularize,
        core_size=size,
        **options,
    )
    result = cut_lineage(merge_results(centre.result.select("node", "cluster"), workers.select("node", "cluster")))
    return Communities(result, relative_density(graph, result))
