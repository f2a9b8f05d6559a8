"""Bounded forward fill, as-of join and sparse variants on the FIXTURES.md literal cases."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from ledgerspark.operators import joins, timeseries as ts

D0 = dt.date(2020, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def rates_df(spark, rows):
    return spark.createDataFrame([("X", day(d), v) for d, v in rows],
                                 "currency string, exchange_date date, exchange_rate double")


def filled(spark, rows, **kw):
    daily = ts.daily_mean(rates_df(spark, rows))
    out = ts.fill_forward_grid(daily, **kw).orderBy("the_date").collect()
    return {(r.the_date - D0).days: (r.the_rate, r.rate_source_date, r.is_imputed) for r in out}


def test_rates_tiny(spark):
    f = filled(spark, [(0, 1.0), (0, 3.0), (3, 5.0), (11, 7.0)])
    assert f[0] == (2.0, day(0), 0)
    assert f[1][0] == 2.0 and f[2][0] == 2.0 and f[1][2] == 1
    for d in range(4, 11):
        assert f[d][:2] == (5.0, day(3))
    assert f[11] == (7.0, day(11), 0)


def test_rates_gap(spark):
    f = filled(spark, [(0, 1.0), (9, 2.0)])
    for d in range(1, 8):
        assert f[d][:2] == (1.0, day(0))
    assert f[8] == (-1.0, None, 1)
    assert f[9][0] == 2.0


def test_rates_null_counts_as_missing(spark):
    f = filled(spark, [(0, 1.0), (1, None), (2, 3.0)])
    assert f[1] == (1.0, day(0), 1)


def test_small_buckets_equal_plain(spark):
    rows = [(d, float(d)) for d in range(0, 200, 3)] + [(d, 1.0) for d in (250, 251)]
    a = filled(spark, rows, bucket_days=8)
    b = filled(spark, rows, bucket_days=1000)
    assert a == b


def test_range_fill_equals_lag_chain(spark):
    import random
    random.seed(3)
    rows = [(d, round(random.random(), 3)) for d in sorted(random.sample(range(120), 40))]
    f = filled(spark, rows, bucket_days=8)
    known = dict(rows)
    for d in range(rows[0][0], rows[-1][0] + 1):
        chain = [known.get(d - k) for k in range(8)]
        expect = next((v for v in chain if v is not None), -1.0)
        assert f[d][0] == expect


def test_transactions_tiny_asof_equals_grid(spark):
    rates = spark.createDataFrame(
        [("A", day(0), 1.0), ("A", day(5), 2.0), ("A", day(30), 3.0), ("B", day(10), 9.0)],
        "currency string, exchange_date date, exchange_rate double")
    tx = spark.createDataFrame(
        [(day(5), "A"), (day(8), "A"), (day(20), "A"), (day(3), "B"), (day(4), "Z")],
        "trans_date date, currency string")
    daily = ts.daily_mean(rates)
    grid = {(r.currency, r.transaction_date): (r.exchange_rate, r.is_imputed)
            for r in ts.augment_transactions(tx, daily, strategy="grid").collect()}
    asof = {(r.currency, r.transaction_date): (r.exchange_rate, r.is_imputed)
            for r in ts.augment_transactions(tx, daily, strategy="asof", bucket_days=8).collect()}
    assert grid == asof
    assert grid[("A", day(5))] == (2.0, 0)          # exact hit
    assert grid[("A", day(8))] == (2.0, 1)          # filled
    assert grid[("A", day(20))] == (-1.0, 1)        # gap > 7
    assert grid[("B", day(3))] == (-1.0, 1)         # before the key's first rate, inside the grid
    assert grid[("Z", day(4))] == (None, None)      # unknown key


def test_rows_bound_fills_where_days_bound_does_not(spark):
    df = spark.createDataFrame(
        [("A", day(0), 1.0), ("A", day(30), 2.0), ("A", day(31), None), ("A", day(60), None)],
        "the_currency string, the_date date, exch_rate double")
    rows = {(r.the_date - D0).days: r.the_rate
            for r in ts.fill_forward_rows(df, "the_currency", "the_date", "exch_rate", n=7, block_rows=8).collect()}
    assert rows[60] == 2.0 and rows[31] == 2.0
    tx = df.where(F.col("exch_rate").isNull()).select("the_currency", "the_date")
    obs = df.where(F.col("exch_rate").isNotNull())
    a = {(r.the_date - D0).days: r.the_rate for r in ts.asof_join(
        tx, obs, "the_currency", "the_date", "the_currency", "the_date", "exch_rate", 7).collect()}
    assert a[31] == 2.0 and a[60] is None


def test_rows_bound_matches_pandas_lag(spark):
    import random
    random.seed(5)
    data = [("K", day(d), (None if random.random() < 0.4 else float(d))) for d in sorted(random.sample(range(400), 150))]
    df = spark.createDataFrame(data, "k string, d date, v double")
    got = {r.d: r.the_rate for r in ts.fill_forward_rows(df, "k", "d", "v", n=7, block_rows=8, range_rows=16).collect()}
    pdf = pd.DataFrame(data, columns=["k", "d", "v"]).sort_values("d")
    vals = pdf["v"].tolist()
    for i, d in enumerate(pdf["d"]):
        window = [vals[i - j] for j in range(8) if i - j >= 0]
        expect = next((x for x in window if x is not None and x == x), None)
        assert got[d] == expect


def test_need_to_impute_and_full_join(spark):
    tx = spark.createDataFrame([(day(1), "A"), (day(2), "A")], "trans_date date, currency string")
    rates = spark.createDataFrame([("A", day(1), 1.0), ("A", day(1), 3.0)],
                                  "currency string, exchange_date date, exchange_rate double")
    assert joins.fanout_left_join(tx, rates).count() == 3
    need = joins.need_to_impute(tx, rates).collect()
    assert [(r.trans_date, r.currency) for r in need] == [(day(2), "A")]
    am = joins.available_and_missing(ts.daily_mean(rates), joins.need_to_impute(tx, rates)).collect()
    assert {(r.the_date, r.to_impute) for r in am} == {(day(1), False), (day(2), True)}


def test_nearest_and_linear(spark):
    obs = rates_df(spark, [(0, 1.0), (4, 5.0)])
    tg = spark.createDataFrame([("X", day(1)), ("X", day(3)), ("X", day(2))], "currency string, exchange_date date")
    near = {(r.exchange_date - D0).days: r.nearest_rate for r in ts.nearest_value(
        obs, tg, "currency", "exchange_date", "exchange_rate").collect()}
    assert near == {1: 1.0, 2: 1.0, 3: 5.0}
    lin = {(r.exchange_date - D0).days: r.interpolated_rate for r in ts.linear_interpolation(
        obs, tg, "currency", "exchange_date", "exchange_rate").collect()}
    assert lin == {1: 2.0, 2: 3.0, 3: 4.0}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "currency string, exchange_date date, exchange_rate double")
    tx = spark.createDataFrame([], "trans_date date, currency string")
    assert ts.augment_transactions(tx, ts.daily_mean(empty)).count() == 0
    assert ts.fill_forward_grid(ts.daily_mean(empty)).count() == 0


def test_plan_has_no_cartesian_or_python(spark):
    daily = ts.daily_mean(rates_df(spark, [(0, 1.0), (5, 2.0)]))
    tx = spark.createDataFrame([(day(3), "X")], "trans_date date, currency string")
    for df in (ts.fill_forward_grid(daily), ts.augment_transactions(tx, daily)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "EvalPython" not in plan


def test_as_of_with_a_third_of_the_probes_in_one_key_and_day(spark):
    """Every window of the fill is bounded, however many probes one key and one day hold."""
    import datetime as dt

    from pyspark.sql import functions as F

    from ledgerspark.operators import timeseries as ts
    day = dt.date(2020, 1, 1)
    obs = spark.range(400).selectExpr("'hot' AS k", "date_add(DATE'2020-01-01', CAST(id * 3 AS INT)) AS d", "CAST(id AS DOUBLE) AS v")
    probes = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 40) END AS k",
                                            "date_add(DATE'2020-01-01', CAST(CASE WHEN id % 6 = 0 THEN 100 ELSE id % 1300 END AS INT)) AS d", "id")
    rows = {r.id: r for r in ts.asof_join(probes, obs, "k", "d", "k", "d", "v", max_days=1).collect()}
    assert len(rows) == 30_000
    for r in rows.values():
        n = (r.d - day).days
        want = n // 3 if r.k == "hot" and n % 3 <= 1 and n // 3 < 400 else None
        assert r.the_rate == want
    seen = {}
    real = ts._bounded_last

    def counted(o, targets, key, date, *rest):
        both = o.select(F.col(key).alias("k"), F.col(date).alias("d")).unionByName(targets.select(F.col(key).alias("k"), F.col(date).alias("d")))
        seen["most"] = both.groupBy("k", F.floor(F.unix_date("d") / ts.DEFAULT_BUCKET_DAYS)).count().agg(F.max("count")).first()[0]
        return real(o, targets, key, date, *rest)

    ts._bounded_last = counted
    try:
        ts.asof_join(probes, obs, "k", "d", "k", "d", "v", max_days=7).count()
    finally:
        ts._bounded_last = real
    assert seen["most"] <= 2 * ts.DEFAULT_BUCKET_DAYS + 7


def test_ranks_within_a_key_by_equal_ranges(spark):
    from ledgerspark.operators import timeseries as ts
    x = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 7 = 0 THEN NULL ELSE 'b' END AS k",
                                     "CASE WHEN id % 11 = 0 THEN NULL ELSE date_add(DATE'2021-01-01', CAST(id * 37 % 500 AS INT)) END AS d", "id")
    for most in (50, 100_000):
        got = ts.rank_within_key(x, "k", "d", ["id"], "r", range_rows=most).collect()
        by = {}
        for r in got:
            by.setdefault(r.k, []).append(r)
        assert len(got) == 6000
        for rows in by.values():
            rows.sort(key=lambda r: (r.d is not None, r.d or 0, r.id) if r.d is not None else (False, 0, r.id))
            assert [r.r for r in rows] == list(range(1, len(rows) + 1))
