"""Global prefix sums in Spark: per-partition totals first, rows second.

The rows are range-partitioned by their order and kept; every partition has one row of
totals; the totals before it are its offset; a window inside the partition adds
the rest. No task sees more than a partition, however many rows share one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.session import cut_lineage

PIECE = "_piece"


def ordered_pieces(df: DataFrame, order: list[Column], pieces: int | None = None) -> DataFrame:
    """``df`` in range partitions by ``order`` with the partition number in ``_piece``, written once.

    Written, because the number must be the same for every later reader.
    """
    ranged = df.repartitionByRange(pieces, *order) if pieces else df.repartitionByRange(*order)
    return cut_lineage(ranged.withColumn(PIECE, F.spark_partition_id()))


def running_totals(pieces: DataFrame, order: list[Column], sums: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Adds, for each ``name: value``, the sum of ``value`` over all rows before this one.

    Returns the rows and a table of one row with the grand totals. The table of
    totals has one row per range partition, which is the proven bound of its broadcast.
    """
    totals = pieces.groupBy(PIECE).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    # One row per range partition: a window over all of them is small.
    before = Window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(PIECE).alias("_at"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    inside = Window.partitionBy(PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{n}") for n, v in sums.items()])
    rows = rows.join(F.broadcast(offsets), F.col(PIECE) == F.col("_at"))
    own = [c for c in pieces.columns if c != PIECE]
    out = rows.select(*own, *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums])
    return out, totals.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums])
