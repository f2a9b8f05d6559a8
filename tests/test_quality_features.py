"""Quality checks, cleaning order, client thresholds, splits and metrics on literal fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerspark.operators import evaluate as ev
from ledgerspark.operators import features as fe
from ledgerspark.operators import quality, split
from ledgerspark.operators.features import ClientThresholds


def test_null_audit_reference_case(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None), (4, None), (5, 50.0)], "a long, b double")
    rows = quality.null_audit(df).collect()
    assert [(r.column, r.nulls) for r in rows] == [("b", 2)]


def _trades_tiny(spark):
    cols = ("`Trade Date` string, `Source System` string, `Leg Type` string, `Product Name` string, "
            "`Product Group` string, `Notional Amount Currency` string, `Notional Amount` double, Fx_rate double, "
            "`Gbp Notional Amount` double, CountryCodeOffice string, `ML Risk Rating` string, "
            "`Client Name` string, Flag int")
    rows = [
        ("01/03/2019", "alpha", "L", "FX Swaps", None, "USD", 10.0, 1.0, 10.0, "UK", "low", "c1", 1),       # group imputed
        ("02/03/2019", "beta", "L", None, None, "EUR", 10.0, 1.0, 10.0, "UK", "low", "c1", 0),            # incomplete
        ("03/03/2019", "alpha", "L", "FX Spots", "FX TRADES", "XXX", 10.0, 1.0, 10.0, "FR", "high", "c2", 0),  # unlisted ccy
        ("04/03/2019", "alpha", "L", "FX Spots", "FX TRADES", "USD", 0.0, 1.0, 0.0, "FR", "high", "c2", 0),   # zero
        ("05/03/2019", "alpha", "L", "FX Spots", "FX TRADES", "USD", 1.0, 1.0, 0.009, "FR", "high", "c2", 0), # zero
        ("06/03/2019", "alpha", "L", "FX Spots", "FX TRADES", "USD", 1.0, 1.0, 0.01, "FR", "high", "c2", 0),  # kept
        ("07/03/2019", "alpha", "L", "FX Spots", "FX TRADES", "USD", None, 1.0, None, "FR", "high", "c2", 0), # incomplete
        ("31/02/2019", "alpha", "L", "FX Spots", "FX TRADES", "USD", 1.0, 1.0, 5.0, "FR", "high", "c2", 0),   # bad date
        (None, "alpha", "L", "FX Spots", "FX TRADES", "USD", 1.0, 1.0, 5.0, "FR", "high", "c2", 0),           # null date
    ]
    return spark.createDataFrame(rows, cols)


def test_clean_trades_order_and_rejects(spark):
    t = _trades_tiny(spark)
    res = fe.clean_trades(t)
    assert res.incomplete.count() == 4  # null name, null amount, bad date, null date
    assert res.zero_amount.count() == 2
    rows = res.clean.collect()
    assert len(rows) == 3
    swaps = [r for r in rows if r["product_type"] == "fx_swaps"]
    assert len(swaps) == 1 and swaps[0]["currency_reduced"] == "USD" and swaps[0]["gbp_log_amount"] == 1.0
    assert [r["client_name"] for r in rows if r["gbp_log_amount"] == -2.0] == ["c2"]
    unlisted = [r for r in rows if r["currency_reduced"] is None]
    assert len(unlisted) == 1  # unlisted currency survives with NULL
    bd = quality.bad_dates(t, "Trade Date").first()
    assert (bd.num_bad, bd.num_missing) == (1, 1)
    g = fe.impute_group(t, "Product Name", "Product Group").where(F.col("Client Name") == "c1").collect()
    assert [r["Product Group"] for r in g] == ["FX TRADES", None]


def test_client_threshold_strictness(spark):
    rows = []
    for cid, n, flags in [("n5", 5, 5), ("n6", 6, 6), ("n19", 19, 0), ("n20", 20, 0), ("n99", 99, 0),
                          ("n100", 100, 1), ("n101", 101, 0), ("r60", 10, 6), ("r61", 100, 61)]:
        rows += [(cid, 1 if i < flags else 0) for i in range(n)]
    df = spark.createDataFrame(rows, "client string, flag int")
    f = {r.client_name: r for r in fe.client_flags(fe.client_summary(df, "client", "flag"), ClientThresholds()).collect()}
    assert f["n19"].new_client and not f["n20"].new_client
    assert not f["n100"].frequent_client and f["n101"].frequent_client
    assert not f["n5"].suspicious_client and f["n6"].suspicious_client
    assert not f["r60"].suspicious_client and f["r61"].suspicious_client
    assert not f["n99"].trusted_client and f["n101"].trusted_client
    assert not f["n100"].trusted_client  # ratio 0.01 is not < 0.01


def test_client_history_is_point_in_time(spark):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("a", d, 1), ("a", d, 0), ("a", d + dt.timedelta(1), 1), ("b", d, 1)],
                               "client string, d date, flag int")
    h = {(r.client, r.d, r.flag): (r.prior_trades, r.prior_flags)
         for r in fe.client_history_asof(df, "client", "d", "flag").collect()}
    assert h[("a", d, 1)] == (0, 0)
    assert h[("a", d + dt.timedelta(1), 1)] == (2, 1)


def test_stratified_split_exact_and_disjoint(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 40 == 0).cast("int").alias("y"))
    s = split.stratified_split(df, "y", 0.2, seed=1)
    c = {(r.y, r.part): r["count"] for r in s.groupBy("y", "part").count().collect()}
    assert c[(1, "test")] == 5 and c[(1, "train")] == 20
    assert c[(0, "test")] == 195 and c[(0, "train")] == 780
    assert s.select("id").distinct().count() == 1000
    again = split.stratified_split(df, "y", 0.2, seed=1).where("part = 'test'").select("id")
    assert again.exceptAll(s.where("part = 'test'").select("id")).count() == 0
    n = split.nested_split(df, "y", 0.2, 0.2, seed=1)
    assert n.count() == 1000 and n.where("part = 'valid' AND y = 1").count() == 4
    folds = split.stratified_folds(df, "y", 15, seed=1).groupBy("fold").count().collect()
    assert len(folds) == 15 and sum(r["count"] for r in folds) == 1000
    pos = split.positional_split(df, ["id"], 0.8)
    assert pos.where("part = 'train'").agg(F.max("id")).first()[0] == 799


def test_metrics_edge_cases(spark):
    tied = spark.createDataFrame([(1, 0.5, 0), (0, 0.5, 0), (1, 0.2, 0)], "label int, score double, prediction int")
    m = ev.binary_metrics(tied).first()
    assert m.precision == 0.0 and m.recall == 0.0  # nothing predicted positive
    pr = {r.threshold: (r.precision, r.recall) for r in ev.pr_curve(tied).collect()}
    assert pr[0.5] == (0.5, 0.5) and pr[0.2] == (2 / 3, 1.0)
    single = spark.createDataFrame([(0, 0)], "label int, prediction int")
    rep = {r.row: r for r in ev.classification_report(single).collect()}
    assert rep["accuracy"].f1 == 1.0 and rep["0"].support == 1.0
    cm = {(r.label, r.prediction): r.share for r in ev.confusion_share(tied).collect()}
    assert cm[(1, 0)] == 1.0


def test_constant_columns_and_fd(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "y", None)], "n string, g string, c int")
    assert {r.column for r in quality.constant_columns(df).collect()} == {"c"}
    assert [r.n for r in quality.fd_violations(df, "n", "g").collect()] == ["a"]


def test_bitmap_coverage_equals_distinct_counts(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from ledgerspark.operators import profile
    df = spark.range(4000).selectExpr("CASE WHEN id % 9 = 0 THEN NULL ELSE id % 4 END AS k", "CASE WHEN id % 13 = 0 THEN NULL ELSE date_add(DATE'1890-01-01', CAST(id * 37 % 60000 AS INT)) END AS d",
                                      "CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id * 1.5 AS DOUBLE) END AS v")
    want = {r.k: r for r in df.groupBy("k").agg(F.count("*").alias("rows"), F.count_distinct("d").alias("days"), F.min("d").alias("a"), F.max("d").alias("z"),
                                               F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo")).collect()}
    for r in profile.value_stats_by_key(df, "k", "d", "v").collect():
        w = want[r.k]
        assert (r.rows, r.days, r.first_day, r.last_day, r.least) == (w.rows, w.days, w.a, w.z, w.lo) and w.a < dt.date(1970, 1, 1) < w.z
        assert abs(r["mean"] - w.m) < 1e-9 * w.m and abs(r.deviation - w.s) < 1e-9 * w.s
    t = profile.table_coverage(df, "k", "d").first()
    every = df.agg(F.count_distinct("k").alias("k"), F.count_distinct("d").alias("d")).first()
    assert (t.rows, t["keys"], t.days) == (4000, every.k, every.d)
    assert profile.table_coverage(df.limit(0), "k", "d").first().rows in (None, 0)
    plan = profile.value_stats_by_key(df, "k", "d", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_pivot_refuses_too_many_columns(spark):
    import pytest

    from ledgerspark.operators import profile
    with pytest.raises(ValueError):
        profile.crosstab_pivot(spark.range(2000).selectExpr("id % 3 AS a", "id AS b"), "a", "b")
