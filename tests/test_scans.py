"""Queries over the joined trades prepare them once, and no class meets in one task."""
from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import evaluate as ev
from ledgerspark.operators import ml, profile, split
from ledgerspark.plans import trade_fixture as tf
from ledgerspark.plans.catalog import load_all
from ledgerspark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["amount_bucket", "review_ranking", "profile_facts", "describe_numeric", "percentile_cuts", "positional_split",
                                  "positional_split_by_date", "describe_dates", "stratified_split_counts", "nested_split_counts",
                                  "one_hot_counts", "balanced_class_rows", "pr_curve", "histogram", "crosstab_share", "stratified_fold_counts"])
def test_result_reads_stored_trades(spark, name):
    seen = load_all()[name].fn(spark, SF)
    assert "lineitem.parquet" not in "".join(seen.inputFiles())


def test_trades_are_the_same_rows_by_any_join_order(spark, tmp_path):
    tables = {"lineitem": [(1, 1, 7), (1, 2, 7), (2, 1, 8), (2, 1, None), (None, 1, 7), (3, 1, 9)], "orders": [(1, 5), (1, 6), (2, None), (3, 5)],
              "customer": [(5, 0), (5, 0), (6, None)], "nation": [(0,)], "part": [(7,), (7,), (9,)]}
    spark.createDataFrame(tables["lineitem"], "l_orderkey long, l_linenumber int, l_partkey long").select(
        "*", F.lit(1).cast("long").alias("l_suppkey"), F.lit("O").alias("l_linestatus"), F.lit("N").alias("l_returnflag"), F.lit(9.0).alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"), F.lit("2020-01-02").cast("timestamp").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(tables["orders"], "o_orderkey long, o_custkey long").select(
        "*", F.lit("p").alias("o_orderpriority"), F.lit("s").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(tables["customer"], "c_custkey long, c_nationkey long").withColumn("c_name", F.lit("c")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(tables["nation"], "n_nationkey long").select("*", F.lit("n").alias("n_name"), F.lit(1).alias("n_regionkey")).write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(tables["part"], "p_partkey long").withColumn("p_type", F.lit("SMALL")).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.l_orderkey, r.l_linenumber) for r in fx.trades(spark, str(tmp_path)).collect())
    # order 1 twice, of which customer 5 counts twice and customer 6 has no nation; part 7 twice
    assert got == [(1, 1)] * 4 + [(1, 2)] * 4 + [(3, 1)] * 2
    assert sorted((r.l_orderkey, r.l_linenumber) for r in tf.stored_trades(spark, str(tmp_path), "l_orderkey", "l_linenumber").collect()) == got


def test_classes_are_not_shuffled_together(spark):
    df = spark.range(4000).select("id", (F.col("id") % 2).alias("y"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (split.stratified_split(df, "y", key_cols=["id"]), ml.class_weights(df, "y")):
            assert "SortMergeJoin" not in _plan(out) and "BroadcastHashJoin" in _plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("frac, train", [(0.0, 0), (0.5, 500), (0.8, 800), (1.0, 1000)])
def test_positional_split_of_equal_rows(spark, frac, train):
    df = spark.range(1000).select(F.lit(1).alias("a"), F.when(F.col("id") < 700, 3).alias("b"))
    out = split.positional_split(df, ["a", "b"], frac).groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("b").isNull()).alias("none")).collect()
    assert {r.part: r.n for r in out} == {k: n for k, n in (("train", train), ("test", 1000 - train)) if n}
    assert sum(r.none for r in out if r.part == "train") == min(train, 300)  # NULL first
    assert split.positional_split(df.where("a > 1"), ["a", "b"], frac).count() == 0


def test_one_hot_counts_without_exploding_rows(spark):
    df = spark.range(90).select((F.col("id") % 3).cast("string").alias("c"), F.when(F.col("id") % 2 == 0, "x").alias("e"), F.lit(1.0).alias("n"))
    spec = ml.FeatureSpec(categorical=("c", "e"), boolean=(), continuous=("n",), label="n")
    out = ml.one_hot_counts(df, spec)
    assert {(r["column"], r.level): r.n for r in out.collect()} == {("c", "0"): 30, ("c", "1"): 30, ("c", "2"): 30, ("e", "x"): 45, ("e", ml.MISSING_LEVEL): 45}
    assert dict(out.dtypes)["n"] == "bigint" and _plan(out).index("Generate") < _plan(out).index("Aggregate")


def test_curve_reads_the_scores_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        reads.add(1)
        return float(i % 10)

    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("label"), score("id").alias("score"))
    got = {r.threshold: (r.tp, r.fp) for r in ev.pr_curve(df).collect()}
    assert got[9.0] == (10, 0) and got[0.0] == (50, 50)
    assert reads.value == 100


def test_mean_does_not_hang_on_row_order(spark):
    x = [50_000 + 0.1 * i for i in range(6000)]
    exact = math.fsum(x) / len(x)
    for rows in (x, x[::-1]):
        got = profile.describe_numeric(spark.createDataFrame([(v,) for v in rows], "v double").coalesce(1), ["v"]).first()
        assert abs(got["mean"] - exact) <= 2 * math.ulp(exact)
    assert profile.describe_numeric(spark.createDataFrame([(None,), (float("inf"),)], "v double"), ["v"]).first()["mean"] == math.inf
