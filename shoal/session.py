"""Session helpers: durable lineage cuts, scratch folders, checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it has at most this many (narrow) rows.
BROADCAST_ROWS = 1_000_000
# Input rows behind one task of a shuffle.
SHUFFLE_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a local folder is
    made and set as the checkpoint folder. On a cluster executors would each write to
    a disk of their own, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shoal-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables written and read back."""
    return f"{shared_dir(spark).rstrip('/')}/shoal-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends there, and so do estimates of its size.

    A checkpoint keeps the estimate of the plan that made it, where a join counts as the product of its sides. In a
    loop of joins it has three times the digits after every round, until the driver's memory is full of them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made; nothing that is still to be computed may need them."""
    drop_path(table.sparkSession, table.scratch)


def drop_path(spark: SparkSession, name: str) -> None:
    """Deletes a folder of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows (a map-side count, no rows move)."""
    return df.count() <= rows


def checked_broadcast(df: DataFrame, bound: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if its row bound allows, else leave the choice to Spark.

    ``bound`` is a bound known by construction (a ``limit``, K clusters, one row
    per Spark partition). Without one, or beyond the limit, the table goes
    unmarked: adaptive execution measures the side at run time, broadcasts it
    only below its own threshold and splits skewed keys of a sort-merge join.
    """
    return F.broadcast(df) if bound is not None and bound <= BROADCAST_ROWS else df


def shuffle_tasks(rows: int, rows_per_task: int = SHUFFLE_ROWS) -> int:
    """Tasks for a shuffle of ``rows`` rows: what one task holds stays the same however large the input is."""
    return max(1, -(-rows // rows_per_task))


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Raise ``spark.sql.shuffle.partitions`` to what ``rows`` input rows need; a larger setting stays.

    A fixed setting gives every task a share that grows with the input. Adaptive execution merges
    what turns out small.
    """
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < shuffle_tasks(rows):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_tasks(rows)))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application.

    Not needed where the job was submitted with the package in ``--py-files``.
    """
    sc = spark.sparkContext
    if getattr(sc, "_shoal_shipped", False):
        return
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="shoal-package-")) / "shoal"
    archive = shutil.make_archive(str(base), "zip", root_dir=package.parent, base_dir=package.name)
    sc.addPyFile(archive)
    sc._shoal_shipped = True
