"""Degrees, pilot choice, partitions and the pilot/worker split."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.columns import hash32
from shoal.operators.graph import global_rank
from shoal.session import checked_broadcast, cut_lineage

# Up to this many pilots a top-k is taken; above, the distributed rank is filtered.
TOP_K_ROWS = 100_000


def out_degree(edges: DataFrame) -> DataFrame:
    """Row sum of the weights per node."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    """Column sum of the weights per node."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("degree"))


def mean_degree(degrees: DataFrame) -> DataFrame:
    """Mean of all degrees, one row."""
    return degrees.agg(F.avg("degree").alias("mean_degree"))


def node_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree of every node beside its other columns, 0.0 where it has no edge."""
    return nodes.join(out_degree(edges), "node", "left").select(
        *nodes.columns, F.coalesce("degree", F.lit(0.0)).alias("degree")
    )


def degree_rank(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All nodes by degree, highest first, ties by node id."""
    return global_rank(node_degrees(edges, nodes), F.col("degree").desc(), F.col("node").asc())


def _first(df: DataFrame, m: int, *order) -> DataFrame:
    """The first ``m`` rows of an order with their rank 0..m-1."""
    if m > TOP_K_ROWS:
        return global_rank(df, *order).where(F.col("rank") < m)
    # the window runs over at most TOP_K_ROWS rows: the limit comes first
    return df.orderBy(*order).limit(m).withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def top_degree_pilots(edges: DataFrame, nodes: DataFrame, m: int) -> DataFrame:
    """The ``m`` nodes of highest degree: the node columns, ``degree`` and ``rank``."""
    return _first(node_degrees(edges, nodes), m, F.col("degree").desc(), F.col("node").asc())


def random_pilots(nodes: DataFrame, m: int, seed: str = "pilot") -> DataFrame:
    """``m`` nodes uniformly without replacement, in hash order, with their ``rank``."""
    drawn = nodes.withColumn("_h", hash32(F.lit(seed + "-"), "node"))
    return _first(drawn, m, F.col("_h").asc(), F.col("node").asc()).drop("_h")


def pilot_count(nodes: DataFrame, ratio: float, rounding: str = "ceil") -> DataFrame:
    """One row ``(n, m)`` with ``m = ratio * n``, rounded up (``ceil``) or down (``floor``)."""
    if rounding not in ("ceil", "floor"):
        raise ValueError(f"rounding must be 'ceil' or 'floor', got {rounding!r}")
    whole = F.ceil if rounding == "ceil" else F.floor
    return nodes.agg(F.count("*").alias("n")).select("n", whole(F.col("n") * F.lit(float(ratio))).alias("m"))


def worker_nodes(nodes: DataFrame, pilots: DataFrame, pilot_bound: int | None = None) -> DataFrame:
    """All nodes that are not pilots."""
    return nodes.join(checked_broadcast(pilots.select("node"), pilot_bound), "node", "left_anti")


def partition_of(node: Column | str, partitions: int) -> Column:
    """Uniform partition 0..M-1 from the hash of a node id.

    Being a function of the id alone it is computed on edges directly: an edge
    finds the partition of either end without a join.
    """
    return F.pmod(hash32(node), F.lit(partitions)).cast("int")


def assign_partitions(nodes: DataFrame, partitions: int) -> DataFrame:
    """Uniform partition 0..M-1 per node."""
    return nodes.withColumn("partition_id", partition_of("node", partitions))


def inherit_partition(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every edge gets the partition of its row node."""
    parts = nodes.select(F.col("node").alias("src"), "partition_id")
    return edges.join(parts, "src").select("partition_id", *edges.columns)


def pilot_subgraph(edges: DataFrame, pilots: DataFrame, pilot_bound: int | None = None) -> DataFrame:
    """Edges with both ends pilots."""
    src = checked_broadcast(pilots.select(F.col("node").alias("src")), pilot_bound)
    dst = checked_broadcast(pilots.select(F.col("node").alias("dst")), pilot_bound)
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select(*edges.columns)


def worker_pilot_edges(edges: DataFrame, pilots: DataFrame, pilot_bound: int | None = None) -> DataFrame:
    """Edges from a worker node to a pilot."""
    src = checked_broadcast(pilots.select(F.col("node").alias("src")), pilot_bound)
    dst = checked_broadcast(pilots.select(F.col("node").alias("dst")), pilot_bound)
    return edges.join(dst, "dst", "left_semi").join(src, "src", "left_anti").select(*edges.columns)


def within_partition_subgraph(
    edges: DataFrame, nodes: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """Edges with both ends in the same partition.

    ``nodes (node, partition_id)`` gives the partitions; or ``partitions``, for
    those of ``assign_partitions``, which need no join and no shuffle.
    """
    if partitions is not None:
        inside = edges.where(partition_of("src", partitions) == partition_of("dst", partitions))
        return inside.select(partition_of("src", partitions).alias("partition_id"), *edges.columns)
    parts = nodes.select("node", "partition_id")
    src = parts.select(F.col("node").alias("src"), "partition_id")
    dst = parts.select(F.col("node").alias("dst"), F.col("partition_id").alias("_p"))
    return (
        edges.join(src, "src")
        .join(dst, "dst")
        .where(F.col("partition_id") == F.col("_p"))
        .select("partition_id", *edges.columns)
    )


def long_worker_edges(edges: DataFrame, pilots: DataFrame, partitions: int, pilot_bound: int | None = None) -> DataFrame:
    """Edges ``(partition_id, src, dst, weight)`` of all workers, to any node; the partition is the hash of ``src``."""
    others = edges.join(checked_broadcast(pilots.select(F.col("node").alias("src")), pilot_bound), "src", "left_anti")
    return others.select(partition_of("src", partitions).alias("partition_id"), "src", "dst", "weight")


def pilot_columns(edges: DataFrame, pilots: DataFrame, end: str = "dst", pilot_bound: int | None = None) -> DataFrame:
    """Replace a pilot endpoint by its rank, which is its column number."""
    ranks = checked_broadcast(pilots.select(F.col("node").alias(end), F.col("rank").alias("_rank")), pilot_bound)
    return edges.join(ranks, end).withColumn(end, F.col("_rank")).select(*edges.columns)


def node_feature_rows(
    workers: DataFrame, worker_edges: DataFrame, pilots: DataFrame, pilot_bound: int | None = None
) -> DataFrame:
    """One row per worker with the sorted column numbers of its pilots.

    The list is bounded by the number of pilots because edges are distinct.
    """
    cols = pilot_columns(worker_edges.select("src", "dst").distinct(), pilots, "dst", pilot_bound)
    lists = cols.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("pilot_ranks"))
    return workers.join(lists, "node", "left").withColumn(
        "pilot_ranks", F.coalesce("pilot_ranks", F.array().cast("array<bigint>"))
    )


class Split(NamedTuple):
    pilots: DataFrame  # node, rank, [degree], other node columns
    workers: DataFrame  # node, [label], partition_id
    pilot_edges: DataFrame  # src, dst, weight
    worker_edges: DataFrame  # partition_id, src, dst, weight
    m: int


def split_pilot_worker(
    edges: DataFrame, nodes: DataFrame, m: int, partitions: int | None = None, random: bool = False, seed: str = "pilot"
) -> Split:
    """Pilots, workers and both edge sets of a symmetric edge table.

    Without ``partitions`` the ``partition_id`` column of ``nodes`` is used. ``seed`` is that of
    random pilots. The chosen pilots are written once because four plans read them.
    """
    chosen = random_pilots(nodes, m, seed) if random else top_degree_pilots(edges, nodes, m)
    pilots = cut_lineage(chosen)
    kept = nodes if partitions is None else assign_partitions(nodes, partitions)
    workers = worker_nodes(kept, pilots, m)
    worker_edges = worker_pilot_edges(edges, pilots, m)
    if partitions is None:
        worker_edges = inherit_partition(worker_edges, workers)
    else:
        worker_edges = worker_edges.select(
            partition_of("src", partitions).alias("partition_id"), "src", "dst", "weight"
        )
    return Split(pilots, workers, pilot_subgraph(edges, pilots, m), worker_edges, m)


def union_chunks(df: DataFrame, col: str, chunks: int) -> DataFrame:
    """Bag union of ``chunks`` hash slices of a table: every row exactly once."""
    slot = F.pmod(F.xxhash64(F.col(col)), F.lit(chunks))
    out = df.where(slot == 0)
    for i in range(1, chunks):
        out = out.unionByName(df.where(slot == i))
    return out


def range_repartition(df: DataFrame, col: str = "partition_id", partitions: int | None = None) -> DataFrame:
    """Shuffle rows by range; content unchanged.

    The node or row columns follow ``col`` in the sort key, so one big partition
    id is cut over several ranges.
    """
    rest = [c for c in df.columns if c != col and dict(df.dtypes)[c] in ("bigint", "int")]
    keys = [col, *rest[:1]]
    return df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)


def neighbours_in_set(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct neighbours of each node inside a node set."""
    keys = chosen.select(F.col("node").alias("dst"))
    return edges.select("src", "dst").join(keys, "dst", "left_semi").select("src", "dst").distinct()


def neighbours_outside_set(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct neighbours of each node outside a node set."""
    keys = chosen.select(F.col("node").alias("dst"))
    return edges.select("src", "dst").join(keys, "dst", "left_anti").select("src", "dst").distinct()


def merge_results(*results: DataFrame) -> DataFrame:
    """Pilot result + partition results."""
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def attach_labels(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Look up the true label of each node."""
    return df.join(nodes.select("node", "label"), "node", "left")


def pilots_for_ratio(nodes: DataFrame, ratio: float, rounding: str = "ceil") -> int:
    """``m`` of ``pilot_count`` as a number, for planning."""
    return pilot_count(nodes, ratio, rounding).first()["m"]


