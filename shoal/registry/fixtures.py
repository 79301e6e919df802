"""Graph, node and cluster tables derived from the given tables, in Spark and in SQL.

The graph joins every part of an order with up to four anchor parts of that
order: in each of four hash slots the part of lowest hash. Its size is linear in
the order lines however long an order is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.columns import hash32
from shoal.session import shuffle_tasks, size_shuffles

SLOTS = 4
# Weight of an edge across planted blocks; 1 inside a block.
ACROSS = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order, one direction, ``src < dst``, weight 1.

    The lines are dealt by order once; anchors and pairs are then made where the lines are. A pair of two anchors is
    listed by the larger one only. The tasks of both deals, and of later shuffles, follow the number of lines.
    """
    given = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    rows = given.count()
    size_shuffles(spark, rows)
    tasks = max(shuffle_tasks(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = given.where(F.col("o").isNotNull() & F.col("p").isNotNull()).repartition(tasks, "o")
    keyed = lines.withColumn("h", hash32("o", F.lit("-"), "p"))
    lowest = [F.min(F.when(F.col("h") % SLOTS == i, F.struct("h", "p")))["p"] for i in range(SLOTS)]
    anchors = keyed.groupBy("o").agg(F.array_compact(F.array(*lowest)).alias("anchors"))
    ends = lines.join(anchors, "o").select("p", "anchors", F.explode("anchors").alias("a"))
    twice = F.array_contains("anchors", F.col("p")) & (F.col("p") < F.col("a"))
    pairs = ends.where((F.col("p") != F.col("a")) & ~twice)
    pairs = pairs.select(F.least("p", "a").alias("src"), F.greatest("p", "a").alias("dst"))
    return pairs.repartition(tasks, "src", "dst").distinct().withColumn("weight", F.lit(1.0))


def planted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges, weighted so that the blocks ``id % 3`` are communities."""
    same = F.col("src") % 3 == F.col("dst") % 3
    return graph_edges(spark, sf_dir).withColumn("weight", F.when(same, 1.0).otherwise(ACROSS))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth, a hash partition of four, and a stand-in clustering with about 10 % wrong."""
    key = F.col("p_partkey")
    wrong = F.when(hash32(key, F.lit("-pred")) % 10 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "part").select(
        key.alias("node"),
        (key % 3).cast("int").alias("label"),
        (hash32(key) % 4).cast("int").alias("partition_id"),
        ((key % 3 + wrong) % 3).cast("int").alias("cluster"),
    )


def sql_hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


SQL_GRAPH = f"""
lines AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem),
keyed AS (SELECT o, p, {sql_hash("o || '-' || p")} AS h FROM lines),
anchors AS MATERIALIZED (
  SELECT o, h % {SLOTS} AS slot, struct_extract(min({{'h': h, 'p': p}}), 'p') AS a
  FROM keyed GROUP BY o, h % {SLOTS}),
edges AS MATERIALIZED (
  SELECT DISTINCT least(p, a) AS src, greatest(p, a) AS dst, 1.0::DOUBLE AS weight
  FROM lines JOIN anchors USING (o) WHERE p <> a),
sym AS MATERIALIZED (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"""

SQL_NODES = f"""
nodes AS (
  SELECT p_partkey AS node, (p_partkey % 3)::INT AS label,
    ({sql_hash("p_partkey::VARCHAR")} % 4)::INT AS partition_id,
    ((p_partkey % 3 + CASE WHEN {sql_hash("p_partkey || '-pred'")} % 10 = 0 THEN 1 ELSE 0 END) % 3)::INT AS cluster
  FROM part)"""


def with_tables(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


def sql(select: str, *ctes: str, graph: bool = True, node_table: bool = True) -> str:
    """``select`` over ``edges``, ``sym`` and ``nodes``, with further table expressions."""
    parts = [SQL_GRAPH] if graph else []
    parts += [SQL_NODES] if node_table else []
    return "WITH " + ",".join([*parts, *ctes]) + "\n" + select
