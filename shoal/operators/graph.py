"""Graph construction: ids, labels, edges, adjacency lists, checks.

An edge table is ``(src, dst, weight)``; a node table is ``(node, label, ...)``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType

from shoal.session import checked_broadcast, cut_lineage, written

# Longest neighbour list held in one row; a node with more gets several rows.
LIST_BLOCK = 65_536


def global_rank(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """Position 0..n-1 of every row in the given total order.

    Rows are range-partitioned and sorted, so no task sees more than its range.
    The per-partition offsets are one row per Spark partition. The sorted slots
    are checkpointed because both passes must see the same partitioning.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = cut_lineage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_slot", 33))
        .withColumn("_pos", F.col("_slot").bitwiseAND((1 << 33) - 1))
        .drop("_slot")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        slots.join(checked_broadcast(offsets, bound=parts), "_part")
        .withColumn(out, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )


def rank_within(df: DataFrame, by: list[str], *order: Column, out: str = "rank") -> DataFrame:
    """Position 0.. of every row inside its group, hot groups included.

    A group that holds a large share of the rows spans many ranges of the global
    order; only its first position is needed to make the ranks local.
    """
    ranked = global_rank(df, *[F.col(c) for c in by], *order, out="_global")
    starts = ranked.groupBy(*by).agg(F.min("_global").alias("_start"))
    return ranked.join(starts, by).withColumn(out, F.col("_global") - F.col("_start")).drop("_global", "_start")


def dense_index(df: DataFrame, id_col: str, out: str = "node", by: list[str] | None = None) -> DataFrame:
    """Distinct ids -> 0..n-1 in id order (inside each ``by`` group if given)."""
    keys = [*(by or []), id_col]
    ids = df.select(*keys).distinct()
    if by:
        return rank_within(ids, by, F.col(id_col), out=out)
    return global_rank(ids, F.col(id_col), out=out)


def encode_labels(df: DataFrame, col: str, mapping: dict[str, int] | None = None, out: str = "label") -> DataFrame:
    """Class name -> 0-based INT by a given dictionary or by alphabetical order."""
    if mapping is not None:
        pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        return df.withColumn(out, pairs[F.col(col)].cast("int"))
    codes = dense_index(df.where(F.col(col).isNotNull()), col, out=out).withColumn(out, F.col(out).cast("int"))
    return df.join(codes, col, "left")


def shift_labels(df: DataFrame, col: str = "label", by: int = 1) -> DataFrame:
    """1-based labels -> 0-based."""
    return df.withColumn(col, (F.col(col) - by).cast("int"))


def unknown_endpoints(edges: DataFrame, index: DataFrame, id_col: str = "id") -> DataFrame:
    """Endpoint ids that the index table does not hold."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(id_col)).distinct()
    return ends.join(index.select(id_col), id_col, "left_anti")


def map_endpoints(
    edges: DataFrame, index: DataFrame, id_col: str = "id", node_col: str = "node", validate: bool = True
) -> DataFrame:
    """Replace both endpoint ids by their dense index; an unknown id raises.

    The joins that find the numbers also show the unknown ids: the mapped edges are written once, with what was
    not found, and read back, so ``edges`` is computed once and its ends are not shuffled for a check of their own.
    """
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    mapped = edges.withColumn("_unknown", F.array().cast(ArrayType(edges.schema["src"].dataType)))
    for end in ("src", "dst"):
        to = index.select(F.col(id_col).alias(end), F.struct(node_col).alias("_to"))
        mapped = mapped.join(to, end, "left" if validate else "inner")
        lost = F.when(F.col("_to").isNull(), F.array_append("_unknown", F.col(end))).otherwise(F.col("_unknown"))
        mapped = mapped.withColumn("_unknown", lost).withColumn(end, F.col(f"_to.{node_col}")).drop("_to")
    if validate:
        mapped = written(mapped, "mapped")
        lost = mapped.where(F.size("_unknown") > 0).take(1)
        if lost:
            raise ValueError(f"edge endpoint not in the node table: {lost[0]['_unknown'][0]!r}")
    return mapped.select("src", "dst", *rest)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, from one scan of the input."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    both = F.array(
        F.struct(F.col("src"), F.col("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return edges.select(F.inline(both), *rest)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Repeated edges count once; with weights the largest stays."""
    if "weight" in edges.columns:
        return edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return edges.select("src", "dst").distinct()


def drop_self_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def add_self_weight(edges: DataFrame, nodes: DataFrame, weight: float = 10.0) -> DataFrame:
    """Set the diagonal to a constant: any loops are replaced."""
    loops = nodes.select(
        F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(float(weight)).alias("weight")
    )
    return drop_self_edges(edges).select("src", "dst", "weight").unionByName(loops)


def adjacency_list(edges: DataFrame, nodes: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """Neighbour lists ``(node, part, nbrs)``, duplicates kept, sorted.

    ``edges`` holds one direction. Every list is cut into contiguous blocks of ``block`` neighbours: part 0, 1, ..
    in this order are one sorted list, and no row is longer, however many neighbours a node has. A node without
    edges has an empty part 0.
    """
    ranked = rank_within(symmetrize(edges.select("src", "dst")), ["src"], F.col("dst"))
    lists = list_blocks(ranked, ["src"], "dst", block, "nbrs").withColumnRenamed("src", "node")
    without = nodes.select("node").join(lists.where("part = 0").select("node"), "node", "left_anti")
    return lists.unionByName(
        without.select("node", F.lit(0).alias("part"), F.array().cast("array<bigint>").alias("nbrs"))
    )


def list_blocks(ranked: DataFrame, by: list[str], col: str, block: int, out: str) -> DataFrame:
    """``(by.., part, out)``: sorted lists of ``block`` values each, cut by the column ``rank``."""
    part = F.expr(f"cast(rank div {block} as int)").alias("part")
    rows = ranked.select(*by, part, col)
    return rows.groupBy(*by, "part").agg(F.array_sort(F.collect_list(col)).alias(out))


def explode_adjacency(adjacency: DataFrame) -> DataFrame:
    """Neighbour lists -> long rows ``(src, dst)`` plus any partition column."""
    keep = [c for c in adjacency.columns if c not in ("node", "part", "nbrs")]
    return adjacency.select(*keep, F.col("node").alias("src"), F.explode("nbrs").alias("dst"))


def keep_isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node with its edges; a node without any keeps one row with null ``dst``.

    Only the distinct row nodes are joined, so the edges themselves do not move.
    """
    names = nodes.select(F.col("node").alias("src"))
    isolated = names.join(edges.select("src").distinct(), "src", "left_anti")
    return edges.unionByName(isolated, allowMissingColumns=True)


def drop_isolated(rows: DataFrame) -> DataFrame:
    """Remove the rows that only mark an isolated node."""
    return rows.where(F.col("dst").isNotNull())


def distinct_nodes(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row nodes of an edge table, per ``by`` group if given."""
    return edges.select(*(by or []), F.col("src").alias("node")).distinct()


def row_edges(edges: DataFrame, rows: DataFrame | Iterable[int], exclude: bool = False) -> DataFrame:
    """Edges of the given row nodes, or of all others with ``exclude``."""
    if isinstance(rows, DataFrame):
        keys = rows.select(F.col("node").alias("src"))
        return edges.join(keys, "src", "left_anti" if exclude else "left_semi").select(*edges.columns)
    inside = F.col("src").isin(list(rows))
    return edges.where(~inside if exclude else inside)


def without_column(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def edge_check(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Violations of the edge-table contract: ``(problem, src, dst)``.

    Endpoints must be nodes, ids must be set, weights must be finite and not negative.
    """
    missing = [c for c in ("src", "dst", "weight") if c not in edges.columns]
    if missing:
        raise ValueError(f"edge table lacks {missing}")
    known = nodes.select("node").distinct()
    pairs = edges.select("src", "dst", "weight")
    tests = (
        pairs.join(known.select(F.col("node").alias("src"), F.lit(True).alias("_s")), "src", "left")
        .join(known.select(F.col("node").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    )
    bad_weight = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.abs("weight") == float("inf"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("_s").isNull(), F.lit("unknown src")),
            F.when(F.col("_d").isNull(), F.lit("unknown dst")),
            F.when(bad_weight, F.lit("bad weight")),
        )
    )
    return tests.select(F.explode(problems).alias("problem"), "src", "dst")
