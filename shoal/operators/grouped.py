"""Grouped map and broadcast side: the user-function surface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from shoal.operators.graph import global_rank
from shoal.session import cut_lineage

Frames = Callable[[pd.DataFrame], pd.DataFrame]

# Partial rows of one group that a merge takes at a time.
FAN_IN = 1_000
# A side is broadcast, or its columns are shared, up to this size.
BROADCAST_BYTES = 64 << 20


def grouped_map(
    df: DataFrame,
    by: str | list[str],
    partial: Frames,
    merge: Frames,
    final: Frames,
    partial_schema: str,
    schema: str,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """A pandas function of whole groups, declared as a combine tree; no group is ever in one task.

    ``partial`` gets some rows of one group and returns partial rows with the group's columns ``by``; ``merge`` gets at most
    ``fan_in`` partial rows of a group and returns fewer (one, as a rule); ``final`` turns the merged rows of a group into the result. All
    three always run, whatever the size of a group, which only decides how many levels of merges there are. Rows of a group
    may be cut anywhere, so ``merge`` must not depend on the cuts. Raw rows are not shuffled, only partial ones.
    """
    by = [by] if isinstance(by, str) else list(by)

    def partials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, rows in frame.groupby(by, dropna=False, sort=False):
                yield partial(rows.reset_index(drop=True))

    level = cut_lineage(df.mapInPandas(partials, partial_schema))
    most = _largest_group(level, by)
    while most > fan_in:
        # blocks of the global order by key: no more than fan_in rows of a group meet, nulls among the keys included
        ranked = global_rank(level, *[F.col(c) for c in by], out="_rank")
        slots = ranked.withColumn("_slot", F.expr(f"_rank div {fan_in}")).drop("_rank")
        dealt = slots.repartition(*by, "_slot").groupBy(*by, "_slot")
        level = cut_lineage(dealt.applyInPandas(lambda pdf: merge(pdf.drop(columns="_slot")), partial_schema))
        before, most = most, _largest_group(level, by)
        if most >= before:
            raise ValueError(f"merge does not shrink the {before} partial rows of a group")
    return level.groupBy(*by).applyInPandas(lambda pdf: final(merge(pdf)), schema)


def _largest_group(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def value_bytes(col: Column, kind: DataType) -> Column:
    """The size of a value, nested ones and texts included."""
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(col) + 16
    elif isinstance(kind, ArrayType):
        add = lambda total, x: total + value_bytes(x, kind.elementType)
        size = F.aggregate(col, F.lit(16).cast("long"), add)
    elif isinstance(kind, MapType):
        size = value_bytes(F.map_keys(col), ArrayType(kind.keyType)) + value_bytes(F.map_values(col), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        size = sum((value_bytes(col[f.name], f.dataType) for f in kind), F.lit(8))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def table_bytes(df: DataFrame) -> int:
    """The size of a table by the sizes of its values: partial sums, no rows move."""
    size = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("long"))
    return df.agg(F.sum(size)).first()[0] or 0


def broadcast_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for a broadcast join if its values take at most ``max_bytes``, else unmarked."""
    return F.broadcast(df) if table_bytes(df) <= max_bytes else df


def broadcast_arrays(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> Broadcast:
    """The columns of a small table as numpy arrays, shared with every task; a larger table needs a join and raises."""
    size = table_bytes(df)
    if size > max_bytes:
        raise ValueError(f"{size} bytes are more than {max_bytes}: use a join")
    table = df.toArrow()
    arrays = {name: table.column(name).to_numpy() for name in table.column_names}
    return df.sparkSession.sparkContext.broadcast(arrays)
