"""Readers for edge and node files. Schemas are explicit: no inference pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_JSON = "partition_id INT, src LONG, dst LONG"


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", id_type: str = "LONG") -> DataFrame:
    """Headerless two-column file -> ``(src, dst)``."""
    return spark.read.csv(path, sep=sep, schema=f"src {id_type}, dst {id_type}", mode="FAILFAST")


def read_node_labels(
    spark: SparkSession,
    path: str,
    n_columns: int,
    id_col: int = 0,
    label_col: int = -1,
    sep: str = "\t",
    id_type: str = "LONG",
) -> DataFrame:
    """Headerless wide node file -> ``(id, label_name)``; feature columns are pruned."""
    label_at = label_col % n_columns
    fields = []
    for i in range(n_columns):
        kind = id_type if i == id_col else "STRING"
        fields.append(f"c{i} {kind}")
    raw = spark.read.csv(path, sep=sep, schema=", ".join(fields))
    return raw.select(F.col(f"c{id_col}").alias("id"), F.col(f"c{label_at}").alias("label_name"))


def read_nodes_csv(spark: SparkSession, path: str, schema: str = "id LONG, label INT, node LONG") -> DataFrame:
    """Node CSV with a header; also reads ``index1, index2`` edge files by ``schema``."""
    return spark.read.csv(path, header=True, schema=schema)


def read_worker_csv(spark: SparkSession, path: str, pilots: list[int] | None = None) -> DataFrame:
    """Worker rows with a header.

    Without ``pilots`` the file is in long form ``partition_id, node, pilot``, one
    line per neighbour and one with an empty pilot for a node without any. With ``pilots`` the file
    has one 0/1 column per pilot and is turned into that long form while reading.
    """
    if pilots is None:
        return spark.read.csv(path, header=True, schema="partition_id INT, node LONG, pilot LONG")
    columns = ", ".join(f"`{p}` INT" for p in pilots)
    wide = spark.read.csv(path, header=True, schema=f"partition_id INT, node LONG, {columns}")
    marked = F.array(*[F.when(F.col(f"`{p}`") != 0, F.lit(p).cast("long")) for p in pilots])
    return wide.select("partition_id", "node", F.explode_outer(F.array_compact(marked)).alias("pilot"))


def read_edges_json(spark: SparkSession, path: str, schema: str = EDGE_JSON) -> DataFrame:
    """JSON-lines edge table with an explicit schema."""
    return spark.read.schema(schema).json(path)
