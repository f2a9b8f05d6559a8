"""Every registered model query, through its own job, with few small trees."""

import pytest

import __spark_entry__ as entry
from ledgerspark.operators.ml import ForestParams
from ledgerspark.plans import q_ml

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def small():
    before = q_ml.FOREST, q_ml.FOLDS, q_ml.SEARCHED, dict(q_ml._TRAINED)
    q_ml.FOREST, q_ml.FOLDS, q_ml.SEARCHED = ForestParams(num_trees=3, max_depth=5), 3, 2
    q_ml._TRAINED.clear()
    yield
    q_ml.FOREST, q_ml.FOLDS, q_ml.SEARCHED = before[:3]
    q_ml._TRAINED.clear()
    q_ml._TRAINED.update(before[3])


def _rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_trained_model_queries(spark):
    pred = _rows(spark, "train_predict")
    assert len(pred) == 1179 and all(r.prediction in (0, 1) and 0 <= r.p1 <= 1 for r in pred)
    assert {r.row for r in _rows(spark, "validation_report")} >= {"0", "1", "accuracy", "macro avg", "weighted avg"}
    facts = _rows(spark, "holdout_report")
    assert sum(r.value for r in facts if r.section == "matrix" and r.measure == "n") == 1179
    assert {r.section for r in facts} == {"matrix", "metrics", "report", "pr_curve", "review"}
    listed = sorted(_rows(spark, "review_list"), key=lambda r: r.review_rank)
    assert [r.review_rank for r in listed] == list(range(1, 1180))
    assert all(a.score >= b.score for a, b in zip(listed, listed[1:]))
    assert all(r.different == 0 and r.without_score == 0 for r in _rows(spark, "model_round_trip"))


def test_cross_validation_and_search(spark):
    cv = _rows(spark, "cross_validation")
    folds = [r for r in cv if r.fold is not None]
    (total,) = [r for r in cv if r.fold is None]
    assert sorted(r.fold for r in folds) == [0, 1, 2]
    assert total.accuracy == pytest.approx(sum(r.accuracy for r in folds) / 3) and total.macro_f1_2std is not None
    found = _rows(spark, "parameter_search")
    assert [r["rank"] for r in sorted(found, key=lambda r: -r.mean_macro_f1)] == [1, 2]


def test_text_forest_grows_on_all_cores(spark, monkeypatch):
    """The labelled texts of a small table fill one file; the forest still reads term counts that are spread."""
    from ledgerspark.operators import ml
    grown, tasks = ml.forest, []

    def small(params, label, features="features"):
        clf = grown(ForestParams(num_trees=2, max_depth=3), label, features)
        fit = clf.fit
        clf.fit = lambda rows, *a: tasks.append(rows.rdd.getNumPartitions()) or fit(rows, *a)
        return clf

    monkeypatch.setattr(ml, "forest", small)
    rows = _rows(spark, "text_model")
    assert rows and all(r.prediction in (0, 1) and 0 <= r.p1 <= 1 for r in rows)
    assert len(tasks) == 1 and tasks[0] >= spark.sparkContext.defaultParallelism


def test_forests_grow_in_one_task_per_core(spark, monkeypatch):
    """However the stored rows are cut into files and tasks: each task of a step sends the counts of all nodes."""
    from pyspark.sql import functions as F

    from ledgerspark.operators import ml
    cores = spark.sparkContext.defaultParallelism
    grown, tasks, read = ml.forest, [], []

    def watched(params, label, features="features"):
        clf = grown(params, label, features)
        fit = clf.fit
        clf.fit = lambda rows, *a: (tasks.append(rows.rdd.getNumPartitions()), read.append(rows.count())) and fit(rows, *a)
        return clf

    monkeypatch.setattr(ml, "forest", watched)
    many = {"spark.sql.shuffle.partitions": "24", "spark.sql.files.maxPartitionBytes": "1m"}
    before = {k: spark.conf.get(k) for k in many}
    df = spark.range(120).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 5).cast("string").alias("c"),
                                 (F.col("id") % 2 == 0).alias("b"), F.sqrt("id").alias("x"))
    spec, few = ml.FeatureSpec(("c",), ("b",), ("x",), "y"), ml.ForestParams(num_trees=2, max_depth=3)
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        assert ml.predict(ml.fit_suspicion_model(df, df, spec, few), df).count() == 120
        assert sorted(r.id for r in ml.FoldedMatrix(df, spec, 3, key_cols=["id"], keep=("id",)).scores(few).collect()) == list(range(120))
        assert tasks == [cores] * 4 and read[0] == 120 and sum(read[1:]) == 2 * 120
        monkeypatch.setattr(ml, "FIT_ROWS", -(-50 // cores))
        assert ml.for_fitting(df).rdd.getNumPartitions() == 3 * cores
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_alternatives_keep_one_copy_of_the_rows(spark):
    """Once the parts are stored, the cleaned rows and what was shuffled for them are removed."""
    from pathlib import Path

    from ledgerspark.session import checkpoint_dir
    top = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.iterdir())
    rows = {r.model: r for r in _rows(spark, "weighted_alternatives")}
    assert rows.keys() == {"logistic", "svm", "tree"} and all(0 <= r.accuracy <= 1 for r in rows.values())
    left = [p.name.split("-")[0] for p in set(top.iterdir()) - before]
    assert not {"tagged", "clean", "stored"} & set(left) and left.count("parts") == 1 and left.count("matrix") <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rows_for_a_fit_are_dealt_once(spark, monkeypatch):
    """Every scan of a fit dealt the stored rows anew where the number of tasks differs."""
    from ledgerspark.operators import ml
    monkeypatch.setattr(ml, "FIT_ROWS", 100)
    n = 7 * 100 * spark.sparkContext.defaultParallelism
    rows = ml.kept_for_fitting(spark.range(n), "dealt")
    assert rows.rdd.getNumPartitions() == 7 * spark.sparkContext.defaultParallelism and rows.count() == n
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
