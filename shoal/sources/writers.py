"""Writers for edge tables, worker tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_edges_json(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long edge table as JSON lines, one file per task."""
    edges.write.mode(mode).json(path)


def write_worker_csv(worker_edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long worker table ``partition_id, node, pilot`` as CSV with a header."""
    worker_edges.select("partition_id", "node", "pilot").write.mode(mode).csv(path, header=True)


def write_pilot_csv(result: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pilot clustering result as CSV with a header."""
    result.write.mode(mode).csv(path, header=True)


def write_result_json(result: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Clustering result as JSON lines: one file per task, or at most ``files`` files where the caller says so."""
    (result if files is None else result.coalesce(files)).write.mode(mode).json(path)
