"""Scores of a clustering against true labels or against the graph."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.graph import dedupe_edges, drop_self_edges

# Up to this many clusters every permutation is tried; above, the assignment is solved.
PERMUTED_CLUSTERS = 7


def members_of(result: DataFrame, value: int, col: str = "label") -> DataFrame:
    """Nodes with a given true label, or with a given cluster."""
    return result.where(F.col(col) == value).select("node")


def confusion_matrix(result: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Number of nodes with true label i and cluster j for all K x K cells, zeros kept."""
    by = by or []
    cell = F.col("label") * k + F.col("cluster")
    inside = F.col("label").between(0, k - 1) & F.col("cluster").between(0, k - 1)
    # every group lists its K * K cells; the counts come from partial sums
    counts = result.where(inside).groupBy(*by, cell.cast("int").alias("cell")).agg(F.count("*").alias("n"))
    if by:
        groups = result.select(*by).distinct()
    else:
        groups = result.sparkSession.range(1).drop("id")
    grid = groups.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))))
    return grid.join(counts, [*by, "cell"], "left").select(
        *by,
        F.expr(f"cast(cell div {k} as int)").alias("label"),
        (F.col("cell") % k).cast("int").alias("cluster"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def assign_max(matrix: np.ndarray) -> float:
    """Largest sum of one cell per row and column (shortest augmenting paths)."""
    cost = matrix.max() - matrix
    n = len(cost)
    row_price, col_price = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0] = i
        slack, seen = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        came = np.zeros(n + 1, dtype=int)
        j = 0
        while owner[j] != 0:
            seen[j] = True
            reduced = cost[owner[j] - 1] - row_price[owner[j]] - col_price[1:]
            better = ~seen[1:] & (reduced < slack[1:])
            slack[1:][better] = reduced[better]
            came[1:][better] = j
            nxt = int(np.where(seen, np.inf, np.r_[np.inf, slack[1:]]).argmin())
            delta = slack[nxt]
            row_price[owner[seen]] += delta
            col_price[seen] -= delta
            slack[~seen] -= delta
            j = nxt
        while j:
            owner[j] = owner[came[j]]
            j = came[j]
    return float(sum(matrix[owner[j] - 1, j - 1] for j in range(1, n + 1)))


def best_permutation_accuracy(result: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Most nodes matched over all renamings of the clusters, divided by the rows.

    Columns ``(by.., matched, total, accuracy)``. Nodes without a cluster count
    in the total.
    """
    by = by or []
    confusion = confusion_matrix(result, k, by)
    totals = result.groupBy(*by).agg(F.count("*").alias("total"))
    if k <= PERMUTED_CLUSTERS:
        spark = result.sparkSession
        orders = spark.createDataFrame(
            [(i, list(p)) for i, p in enumerate(permutations(range(k)))], "perm INT, image ARRAY<INT>"
        ).select("perm", F.posexplode("image").alias("label", "cluster"))
        sums = confusion.join(F.broadcast(orders), ["label", "cluster"]).groupBy(*by, "perm").agg(
            F.sum("n").alias("matched")
        )
        matched = sums.groupBy(*by).agg(F.max("matched").alias("matched"))
    else:
        # K * K numbers per group, solved where the group lies
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in confusion.select(*by).schema)

        def solve(pdf):
            table = np.zeros((k, k))
            table[pdf["label"], pdf["cluster"]] = pdf["n"]
            out = pdf[by].head(1).copy()
            out["matched"] = int(round(assign_max(table)))
            return out

        keys = by or ["_all"]
        matched = confusion.withColumn("_all", F.lit(0)).groupBy(*keys).applyInPandas(solve, f"{fields}{', ' if by else ''}matched long")
    if by:
        scored = totals.join(matched, by)
    else:
        scored = totals.withColumn("matched", matched.scalar())
    return scored.select(*by, "matched", "total", (F.col("matched") / F.col("total")).alias("accuracy"))


def misclustering_rate(result: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """``1 - accuracy`` per group."""
    scored = best_permutation_accuracy(result, k, by)
    return scored.select(*(by or []), (1 - F.col("accuracy")).alias("misclustering_rate"))


def relative_density(edges: DataFrame, result: DataFrame) -> DataFrame:
    """(between edges / between pairs) / (within edges / within pairs), one row.

    Ordered pairs over the symmetric edge set; pairs and edges are restricted to
    clustered nodes. A pair of nodes counts once however often it is listed.
    """
    clusters = result.where(F.col("cluster").isNotNull()).select("node", "cluster")
    pairs = dedupe_edges(drop_self_edges(edges).select("src", "dst"))
    a = clusters.select(F.col("node").alias("src"), F.col("cluster").alias("_a"))
    b = clusters.select(F.col("node").alias("dst"), F.col("cluster").alias("_b"))
    same = F.col("_a") == F.col("_b")
    seen = pairs.join(a, "src").join(b, "dst").agg(
        F.sum(F.when(same, 1.0).otherwise(0.0)).alias("within_edges"),
        F.sum(F.when(same, 0.0).otherwise(1.0)).alias("between_edges"),
    )
    sizes = clusters.groupBy("cluster").agg(F.count("*").cast("double").alias("size"))
    possible = sizes.agg(
        F.sum(F.col("size") * (F.col("size") - 1)).alias("within_pairs"),
        (F.sum("size") * F.sum("size") - F.sum(F.col("size") * F.col("size"))).alias("between_pairs"),
    )
    both = seen.withColumn("_p", possible.select(F.struct("within_pairs", "between_pairs")).scalar())
    both = both.select("within_edges", "between_edges", "_p.within_pairs", "_p.between_pairs")
    ratio = (F.col("between_edges") / F.col("between_pairs")) * (F.col("within_pairs") / F.col("within_edges"))
    return both.withColumn("relative_density", ratio)


def repeat_mean(scores: DataFrame, setting: str, value: str, digits: int = 5) -> DataFrame:
    """Mean over repeats per setting, rounded."""
    return scores.groupBy(setting).agg(F.round(F.avg(value), digits).alias(f"mean_{value}"))


def distinct_mean(df: DataFrame, metric: str) -> DataFrame:
    """Mean of the distinct values of a per-partition metric."""
    return df.select(metric).distinct().agg(F.avg(metric).alias(f"mean_{metric}"))
