"""Registered queries: a Spark plan over the given tables and, where it exists, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import graph, split
from shoal.registry import fixtures
from shoal.session import ship_package, size_shuffles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RATIO = 0.1


class Inputs:
    """The fixture tables of one run, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self._m: int | None = None

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        """A given table; the tasks of later shuffles follow its rows (a Parquet count reads no column)."""

        def sized() -> DataFrame:
            given = fixtures.table(self.spark, self.sf_dir, name)
            size_shuffles(self.spark, given.count())
            return given

        return self._once(f"table {name}", sized)

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: fixtures.graph_edges(self.spark, self.sf_dir))

    @property
    def kept_sym(self) -> DataFrame:
        """``sym`` for queries with more than one job over it: the edges are built once and kept on disk."""
        return self._once("kept_sym", lambda: graph.symmetrize(self.edges.persist(StorageLevel.DISK_ONLY)))

    @property
    def sym(self) -> DataFrame:
        return self._once("sym", lambda: graph.symmetrize(self.edges))

    @property
    def planted(self) -> DataFrame:
        return self._once(
            "planted", lambda: graph.symmetrize(fixtures.planted_edges(self.spark, self.sf_dir)).persist()
        )

    @property
    def blocks(self) -> DataFrame:
        """The planted graph without edges across blocks: its communities are known exactly."""
        return self._once(
            "blocks", lambda: self.sym.where(F.col("src") % 3 == F.col("dst") % 3).persist()
        )

    @property
    def nodes(self) -> DataFrame:
        return self._once("nodes", lambda: fixtures.nodes(self.spark, self.sf_dir))

    @property
    def m(self) -> int:
        if self._m is None:
            self._m = split.pilots_for_ratio(self.nodes, RATIO)
        return self._m

    @property
    def pilots(self) -> DataFrame:
        return self._once(
            "pilots", lambda: split.top_degree_pilots(self.sym, self.nodes.select("node", "label"), self.m)
        )


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs)`` under ``name`` with its SQL."""

    def register(fn: Callable[[Inputs], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Inputs(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


DEGREES = """
deg AS MATERIALIZED (
  SELECT node, coalesce(sum(weight), 0.0)::DOUBLE AS degree
  FROM nodes LEFT JOIN sym ON src = node GROUP BY node),
ranked AS (SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) - 1 AS rank FROM deg)"""

PILOTS = (
    DEGREES
    + f""",
pilots AS MATERIALIZED (
  SELECT r.node, r.degree, r.rank, n.label FROM ranked r JOIN nodes n USING (node)
  WHERE r.rank < (SELECT ceil(count(*) * {RATIO}) FROM nodes))"""
)
