"""Global ranks with extra columns and ties, splits, null-safe fills, sinks and saved models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import evaluate as ev
from ledgerspark.operators import profile, ranking, split
from ledgerspark.operators import timeseries as ts
from ledgerspark.session import scratch_path
from ledgerspark.sources import readers, writers


@pytest.fixture(scope="module")
def wide(spark):
    """Heavy ties on the first order column, a unique second one, and columns outside the order."""
    return spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * 7919) % 11).alias("v"), (F.col("id") * 31337 % 20_011).alias("u"),
        F.repeat(F.lit("x"), F.lit(50)).alias("extra"), F.col("id")).repartition(13)


def test_ranks_are_one_to_n_in_order(spark, wide):
    r = ranking.global_row_number(wide, ["v", "u"], "r", partitions=40)
    rows = sorted((x.r, x.v, x.u) for x in r.select("r", "v", "u").collect())
    assert [x[0] for x in rows] == list(range(1, 20_001))
    assert [x[1:] for x in rows] == sorted(x[1:] for x in rows)


def test_running_sums(spark, wide):
    c = ranking.cumulative_sums(wide.select("v", "u", (F.col("u") % 5).alias("n")), ["v", "u"], ["n"], partitions=16)
    rows, total = sorted((x.v, x.u, x.n, x.n_cum) for x in c.collect()), 0
    for _, _, n, cum in rows:
        total += n
        assert cum == total


def test_quantiles_with_one_value_in_a_third_of_the_rows(spark, wide):
    import numpy as np
    got = profile.describe_numeric(wide.select("v", "u", F.lit(None).cast("double").alias("none")), ["v", "u", "none"]).collect()
    got = {r["column"]: r for r in got}
    for c in ("v", "u"):
        x = np.array([r[0] for r in wide.select(c).collect()], float)
        assert [got[c].p25, got[c].p50, got[c].p75] == pytest.approx(np.percentile(x, [25, 50, 75]).tolist())
        assert got[c]["count"] == len(x) and got[c]["std"] == pytest.approx(x.std(ddof=1))
    assert got["none"]["count"] == 0 and got["none"].p50 is None


def test_positional_split_is_exact(spark, wide):
    s = {r.part: (r["n"], r.lo, r.hi) for r in split.positional_split(wide, ["v", "u"], 0.8).groupBy("part").agg(
        F.count("*").alias("n"), F.min(F.struct("v", "u")).alias("lo"), F.max(F.struct("v", "u")).alias("hi")).collect()}
    assert s["train"][0] == 16_000 and s["test"][0] == 4_000 and tuple(s["train"][2]) < tuple(s["test"][1])


def test_stratified_split_sizes_and_null_class(spark, wide):
    import math
    x = wide.withColumn("label", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 2))
    s = split.nested_split(x, "label", 0.2, 0.25, key_cols=["id"])
    n = {(r.label, r.part): r["count"] for r in s.groupBy("label", "part").count().collect()}
    for label, size in {r.label: r["count"] for r in x.groupBy("label").count().collect()}.items():
        test = math.ceil(0.2 * size)
        valid = math.ceil(0.25 * (size - test))
        assert (n[label, "test"], n[label, "valid"], n[label, "train"]) == (test, valid, size - test - valid)
    again = split.nested_split(x.repartition(3), "label", 0.2, 0.25, key_cols=["id"])
    assert s.select("id", "part").exceptAll(again.select("id", "part")).count() == 0


def _rows(spark):
    rnd = random.Random(3)
    day = dt.date(2020, 1, 1)
    rows = [(rnd.choice(["a", "b", None]), day + dt.timedelta(days=i), rnd.choice([None, float(i)])) for i in range(400)]
    rows = list({(k, d): (k, d, v) for k, d, v in rows}.values()) + [("a", None, 5.0), (None, None, None)]
    return rows, spark.createDataFrame(rows, "k string, d date, v double")


def test_row_fill_keeps_null_keys_and_dates(spark):
    rows, df = _rows(spark)
    for block in (8, 4096):
        got = {(r.k, r.d): r.the_rate for r in ts.fill_forward_rows(df, "k", "d", "v", n=3, block_rows=block, range_rows=16).collect()}
        assert len(got) == len(rows)
        for key in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or dt.date.min))
            for i, (k, d, _) in enumerate(own):
                past = [r[2] for r in own[max(0, i - 3):i + 1] if r[2] is not None]
                assert got[k, d] == (past[-1] if past else None)


def test_gaps_and_variation_keep_null_keys(spark):
    rows, df = _rows(spark)
    gaps = ts.gap_lengths(df, "k", "d", bucket_days=16).collect()
    assert len(gaps) == sum(r[1] is not None for r in rows)
    var = {(r.k, r.d): r.prev_date for r in ts.daily_variation(df, "k", "d", "v", bucket_days=16).collect()}
    assert len(var) == len(rows)
    for key in ("a", "b", None):
        own = sorted(r[1] for r in rows if r[0] == key and r[1] is not None)
        for before, after in zip(own, own[1:]):
            assert var[key, after] == before


def test_asof_with_many_probes_on_one_day(spark):
    day = dt.date(2021, 3, 1)
    obs = spark.createDataFrame([("a", day, 1.0), ("a", day + dt.timedelta(days=9), 2.0)], "k string, d date, v double")
    probes = spark.range(3000).select(F.lit("a").alias("k"), F.expr("date_add(DATE'2021-02-27', CAST(id % 30 AS INT))").alias("d"), "id")
    got = ts.asof_join(probes, obs, "k", "d", "k", "d", "v", max_days=7).collect()
    assert len(got) == 3000
    for r in got:
        age = (r.d - day).days
        want = 2.0 if 9 <= age <= 16 else 1.0 if 0 <= age <= 7 else None
        assert r.the_rate == want


def test_sinks_round_trip(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"c|{i},\"q\"", i / 3) for i in range(300)], "id long, name string, x double")
    for sink in (writers.write_parquet, writers.write_quarantine):
        path = scratch_path(spark, "sink")
        sink(df.limit(3), path)
        sink(df, path)  # overwrites
        back = spark.read.parquet(path) if sink is writers.write_parquet else readers.read_delimited(spark, path, df.schema, sep=",")
        assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    path = scratch_path(spark, "export")
    writers.export_ordered(df, path, [F.desc("id")])
    lines = [r.value for r in spark.read.text(path).withColumn("f", F.input_file_name()).withColumn(
        "m", F.monotonically_increasing_id()).orderBy("f", "m").collect() if not r.value.startswith("id|")]
    assert [int(v.split("|")[0]) for v in lines] == list(range(299, -1, -1))
    t = writers.replace_table(df, "ls_sink_test", scratch_path(spark, "table"))
    assert writers.replace_table(df.limit(5), "ls_sink_test", scratch_path(spark, "table")).count() == 5 and t.schema == df.schema
    spark.sql("DROP TABLE ls_sink_test")


def test_malformed_rows_fail_or_become_null(spark):
    path = scratch_path(spark, "bad")
    spark.createDataFrame([("trans_date|currency",), ("2020-01-02|USD",), ("nonsense|EUR",)], "v string").coalesce(1).write.text(path)
    assert readers.read_delimited(spark, path, readers.TRANSACTIONS_SCHEMA, mode="PERMISSIVE").where("trans_date IS NULL").count() == 1
    with pytest.raises(Exception):
        readers.read_transactions(spark, path).collect()


def test_review_ranking(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), (i * 37 % 100) / 100) for i in range(100)], "id long, label int, score double")
    r = ev.review_ranking(df, ["id"], recall=0.5).orderBy("review_rank").collect()
    assert [x.review_rank for x in r] == list(range(1, 101))
    assert [(-x.score, x.id) for x in r] == sorted((-x.score, x.id) for x in r)
    assert sum(x.label for x in r if x.review) >= 5


def test_saved_model_scores_the_holdout(spark):
    from ledgerspark.operators import ml
    from ledgerspark.plans import jobs
    df = spark.range(400).select("id", F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("cat"),
                                 (F.col("id") % 2 == 0).alias("even"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    spec = ml.FeatureSpec(categorical=("cat",), boolean=("even",), continuous=("x",), label="y")
    t = jobs.train_and_validate(df, spec, scratch_path(spark, "model"), ["id"], ml.ForestParams(num_trees=5))
    pred = jobs.holdout_predictions(spark, t.model_path, t.parts_path, "y")
    assert pred.count() == 80 and pred.where("label <> prediction").count() == 0
    cv = ml.cross_validate(df, spec, ml.ForestParams(num_trees=3), k=3, key_cols=["id"])
    assert sorted(r.fold for r in cv.collect()) == [0, 1, 2] and all(r.accuracy == 1 and r.macro_f1 == 1 for r in cv.collect())
    assert tuple(ml.cv_summary(cv).first()) == (1.0, 1.0, 0.0)
    found = ml.parameter_search(df, spec, {"min_instances_per_node": [1, 200], "max_depth": [2, 5]}, n=3, k=2, base=ml.ForestParams(num_trees=3), key_cols=["id"]).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3] and len({r.params for r in found}) == 3
    assert [r.mean_macro_f1 for r in sorted(found, key=lambda r: r["rank"])] == sorted((r.mean_macro_f1 for r in found), reverse=True)
    facts = jobs.holdout_evaluation(spark, t.model_path, t.parts_path, "y").collect()
    got = {(r.section, r.item, r.measure): r.value for r in facts}
    assert got["metrics", "holdout", "recall"] == 1 and got["matrix", "1 as 1", "n"] + got["matrix", "0 as 0", "n"] == 80
    assert {r.section for r in facts} == {"matrix", "metrics", "report", "pr_curve", "review"} and got["review", "holdout", "flagged"] >= 0.9 * got["report", "1", "support"]
    listed = jobs.review_list(spark, t.model_path, t.parts_path, "y", ["id"]).collect()
    assert sorted(r.review_rank for r in listed) == list(range(1, 81))
    with pytest.raises(Exception):  # a level that the fit has not seen
        jobs.ml.PipelineModel.load(t.model_path).transform(df.withColumn("cat", F.lit("new"))).collect()


def test_sampled_parameters_are_different_and_reproducible():
    from ledgerspark.operators.ml import sample_parameters
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    every = sample_parameters(space, 10)
    assert len(every) == 6 and len({tuple(sorted(p.items())) for p in every}) == 6
    assert sample_parameters(space, 4, seed=1) == sample_parameters(space, 4, seed=1) != sample_parameters(space, 4, seed=2)
    mixed = sample_parameters({"a": [1, 2], "c": (0.0, 1.0), "d": (3, 9)}, 20)
    assert len(mixed) == 20 and all(0 <= p["c"] <= 1 and 3 <= p["d"] <= 9 for p in mixed)


def test_out_of_fold_scalers_leave_their_fold_out(spark):
    import numpy as np

    from ledgerspark.operators import ml
    df = spark.range(300).selectExpr("CAST(id % 4 AS INT) AS fold", "CASE WHEN id % 7 = 0 THEN NULL ELSE 1e6 + id * id END AS x", "5.0 AS same")
    rows = df.collect()
    for f, stage in ml.leave_one_out_scalers(df, ["x", "same"]).items():
        x = np.array([r.x for r in rows if r.fold != f and r.x is not None])
        got = stage.transform(spark.createDataFrame([(float(x.mean()), 5.0), (float(x.mean() + x.std()), 5.0)], "x double, same double")).collect()
        assert [r.x_scaled for r in got] == pytest.approx([0, 1], abs=1e-6) and got[0].same_scaled == 0


def test_fold_scores_against_the_report(spark):
    from ledgerspark.operators import ml
    p = spark.range(900).selectExpr("CAST(id % 3 AS INT) AS fold", "CAST(id % 5 = 0 AS INT) AS label", "CAST(id % 7 = 0 AS INT) AS prediction")
    got = {r.fold: r for r in ml.fold_scores(p).collect()}
    for f in range(3):
        rep = {r.row: r for r in ev.classification_report(p.where(f"fold = {f}")).collect()}
        assert got[f].accuracy == pytest.approx(rep["accuracy"].f1) and got[f].macro_f1 == pytest.approx(rep["macro avg"].f1)


def test_weighted_measures_equal_rows(spark):
    rows = spark.range(3000).selectExpr("CAST(id % 5 = 0 AS INT) AS label", "CAST(id % 4 = 0 AS INT) AS prediction", "CAST((id % 13) / 13.0 AS DOUBLE) AS score")
    cells = ev.scored_cells(rows)
    assert cells.count() < 60
    for f in (ev.confusion_matrix, ev.confusion_share, ev.binary_metrics, ev.classification_report):
        assert sorted(map(str, f(rows).collect())) == sorted(map(str, f(cells, weight="n").collect()))
    a, b = (sorted((round(r.threshold, 6), r.tp, r.fp, round(r.precision, 9), round(r.recall, 9)) for r in c.collect()) for c in (ev.pr_curve(rows), ev.pr_curve(cells, weight="n")))
    assert a == b and ev.recall_threshold(rows, 0.5) == pytest.approx(ev.recall_threshold(cells, 0.5, weight="n"), abs=1e-6)


def test_two_levels_of_cuts_bound_a_bucket(spark, wide, monkeypatch):
    monkeypatch.setattr(ranking, "COARSE", 16)
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 100)
    b = ranking.range_bucket(wide, ["v", "u"], 4)
    sizes = [r["count"] for r in b.groupBy("_rb").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 100 and max(sizes) <= 500
    test_ranks_are_one_to_n_in_order(spark, wide)
    rows = sorted((x.v, x.u, x._rb) for x in b.select("v", "u", "_rb").collect())
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    null = spark.range(3000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id END AS a", "id AS b")
    got = sorted((r.r, r.a is not None, r.a or 0, r.b) for r in ranking.global_row_number(null, ["a", "b"], "r").collect())
    assert [g[0] for g in got] == list(range(1, 3001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


@pytest.mark.parametrize("most", [5, 100_000])
def test_quantiles_by_narrowing(spark, monkeypatch, most):
    import numpy as np
    monkeypatch.setattr(ranking, "BRACKET_ROWS", most)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=30_000), np.full(9000, 0.25), rng.pareto(0.5, 3000)])
    df = spark.createDataFrame([(float(v), float(i % 3), None if i % 2 else float(v)) for i, v in enumerate(x)], "x double, ties double, half double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.99, 0.9999, 1.0]
    got = {r["column"]: r for r in ranking.quantiles_by_column(df, ["x", "ties", "half"], probs, [f"q{i}" for i in range(8)]).collect()}
    for c, v in (("x", x), ("ties", np.arange(len(x)) % 3), ("half", x[::2])):
        assert [got[c][f"q{i}"] for i in range(8)] == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12, abs=1e-12), c


def test_balanced_rows_are_exact(spark):
    from ledgerspark.operators import ml
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'a' WHEN id % 10 < 4 THEN 'b' ELSE 'c' END AS y")
    down = ml.balance_rows(df, "y", "min", ["id"]).collect()
    assert {y: sum(r.y == y for r in down) for y in "abc"} == {"a": 100, "b": 100, "c": 100} and len({r.id for r in down}) == 300
    up = ml.balance_rows(df, "y", "max", ["id"]).collect()
    assert {y: sum(r.y == y for r in up) for y in "abc"} == {"a": 600, "b": 600, "c": 600}
    times = {}
    for r in up:
        times[r.id] = times.get(r.id, 0) + 1
    assert len(times) == 1000 and {times[r.id] for r in up if r.y == "a"} == {6} and sorted({times[r.id] for r in up if r.y == "b"}) == [2]


def test_a_failed_replacement_leaves_the_old_table(spark):
    df = spark.range(20).selectExpr("id", "id * 2 AS x")
    t = writers.replace_table(df, "ls_staged", scratch_path(spark, "staged"))
    with pytest.raises(Exception):
        writers.replace_table(df.selectExpr("id", "CAST(raise_error('stop') AS BIGINT) AS x"), "ls_staged", scratch_path(spark, "staged"))
    assert spark.table("ls_staged").agg(F.sum("x")).first()[0] == 380 and t.count() == 20
    assert writers.replace_table(df.limit(3), "ls_staged").count() == 3
    other = writers.replace_table(df.selectExpr("id", "'text' AS y"), "ls_staged")
    assert other.columns == ["id", "y"] and spark.table("ls_staged").count() == 20
