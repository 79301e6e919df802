import json
from pathlib import Path

import pytest
from conftest import rows_of

from shoal import sources
from shoal.operators import grouped


def test_edge_list_and_wide_nodes(spark, tmp_path):
    (tmp_path / "cites").write_text("35\t1033\n35\t103482\n")
    assert rows_of(sources.read_edge_list(spark, str(tmp_path / "cites"))) == [(35, 1033), (35, 103482)]
    (tmp_path / "content").write_text("31336\t0\t1\tTheory\n10531\t1\t0\tRules\n")
    nodes = sources.read_node_labels(spark, str(tmp_path / "content"), n_columns=4)
    assert rows_of(nodes) == [(10531, "Rules"), (31336, "Theory")]
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c0:bigint,c3:string>" in plan


def test_bad_edge_line_raises(spark, tmp_path):
    (tmp_path / "cites").write_text("35\tx\n")
    with pytest.raises(Exception, match="(?i)malformed|x"):
        sources.read_edge_list(spark, str(tmp_path / "cites")).collect()


def test_wide_worker_file(spark, tmp_path):
    (tmp_path / "w.csv").write_text("partition_id,node,8,3\n0,5,1,0\n1,6,1,1\n1,7,0,0\n")
    got = sources.read_worker_csv(spark, str(tmp_path / "w.csv"), pilots=[8, 3])
    assert {tuple(r) for r in got.collect()} == {(0, 5, 8), (1, 6, 8), (1, 6, 3), (1, 7, None)}


def test_result_has_as_many_files_as_the_caller_says(spark, tmp_path):
    df = spark.range(100).repartition(4)
    for asked, files in ((1, 1), (None, 4)):
        out = tmp_path / str(asked)
        sources.write_result_json(df, str(out), files=asked)
        parts = list(Path(out).glob("part-*.json"))
        assert len(parts) == files
        assert sorted(json.loads(line)["id"] for p in parts for line in p.read_text().splitlines()) == list(range(100))


@pytest.mark.parametrize("fan_in", [2, 3, 1000])
def test_grouped_map_never_holds_a_group(spark, fan_in):
    from pyspark.sql import functions as F

    df = spark.range(0, 900, 1, 12).select(F.when(F.col("id") % 3 == 2, None).otherwise(F.col("id") % 3 % 2).alias("g"), "id")

    def partial(pdf):
        assert len(pdf) <= 75
        return pdf.groupby("g", as_index=False, dropna=False).agg(n=("id", "size"), low=("id", "min"))

    def merge(pdf):
        assert len(pdf) <= fan_in
        return pdf.groupby("g", as_index=False, dropna=False).agg(n=("n", "sum"), low=("low", "min"))

    final = lambda pdf: pdf.assign(n=pdf.n * 10)[["g", "n", "low"]]
    out = grouped.grouped_map(df, "g", partial, merge, final, "g long, n long, low long", "g long, n long, low long", fan_in)
    assert sorted(map(str, out.collect())) == sorted(
        map(str, spark.createDataFrame([(0, 3000, 0), (1, 3000, 1), (None, 3000, 2)], "g long, n long, low long").collect())
    )
    assert grouped.grouped_map(df.limit(0), "g", partial, merge, final, "g long, n long, low long", "g long, n long, low long").count() == 0


def test_grouped_map_refuses_a_merge_that_keeps_all(spark):
    df = spark.range(0, 40, 1, 8).selectExpr("0L as g", "id")
    with pytest.raises(ValueError, match="shrink"):
        grouped.grouped_map(df, "g", lambda p: p, lambda p: p, lambda p: p, "g long, id long", "g long, id long", fan_in=4)


def is_broadcast(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_broadcast_side_measures_bytes(spark):
    from pyspark.sql import functions as F

    narrow = spark.range(1000)
    wide = narrow.select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.struct(F.lit("é").alias("a"))).alias("s"))
    assert grouped.table_bytes(narrow) == 8000 and grouped.table_bytes(spark.range(0)) == 0
    assert grouped.table_bytes(wide) == 1000 * (8 + 1016 + 16 + 8 + 18)
    nulls = spark.createDataFrame([(None, None, None)], "t string, a array<string>, m map<string,int>")
    assert grouped.table_bytes(nulls) == 32
    assert is_broadcast(grouped.broadcast_side(narrow, 10_000)) and not is_broadcast(grouped.broadcast_side(wide, 10_000))
    assert grouped.broadcast_arrays(spark.range(3)).value["id"].tolist() == [0, 1, 2]
    with pytest.raises(ValueError, match="join"):
        grouped.broadcast_arrays(wide, 10_000)
