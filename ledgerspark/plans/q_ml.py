"""Split, evaluation and model queries (G6, G7: M1-M23).

Evaluation queries score trades with a deterministic rule (the discount as the
score, ``discount >= 0.08`` as the prediction) so that DuckDB can check every
metric exactly; the model queries train MLlib pipelines and are checked on rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions.stopwords import ENGLISH
from ledgerspark.operators import evaluate as ev
from ledgerspark.operators import split
from ledgerspark.operators.ml import ForestParams
from ledgerspark.plans import trade_fixture as tf
from ledgerspark.plans.catalog import register
from ledgerspark.plans.oracle import with_fixtures
from ledgerspark.session import forget, scratch_path, shuffles_dropped, stored

KEYS = ["l_orderkey", "l_linenumber"]
#: the fixture's keys repeat: the number of a stored row tells such rows apart, so that parts have their exact sizes
ROW_KEYS = [*KEYS, "_row"]


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --------------------------------------------------------------------------- splits

@register("positional_split_by_date", "M3", with_fixtures("""
WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY d NULLS FIRST, l_orderkey, l_linenumber, notional, gbp) AS pos,
                  count(*) OVER () AS n FROM trades)
SELECT l_orderkey, l_linenumber, CASE WHEN pos <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS part FROM r""", "trades"))
def q_positional_split_by_date(spark, sf):
    return split.positional_split(tf.stored_trades(spark, sf, "d", *KEYS, "notional", "gbp"), ["d", *KEYS, "notional", "gbp"], 0.8).select(*KEYS, "part")


@register("stratified_split_counts", "M1 U2", with_fixtures("""
WITH c AS (SELECT flag, count(*) AS n FROM trades GROUP BY flag)
SELECT flag, 'test' AS part, CAST(ceil(0.2 * n) AS BIGINT) AS n FROM c
UNION ALL
SELECT flag, 'train' AS part, CAST(n - ceil(0.2 * n) AS BIGINT) AS n FROM c""", "trades"))
def q_stratified_split_counts(spark, sf):
    s = split.stratified_split(tf.stored_trades(spark, sf), "flag", 0.2, seed=42)  # the fixture's keys repeat: all columns
    return s.groupBy("flag", "part").agg(F.count(F.lit(1)).alias("n"))


@register("nested_split_counts", "M2 M1", with_fixtures("""
WITH c AS (SELECT flag, count(*) AS n, ceil(0.2 * count(*)) AS t FROM trades GROUP BY flag)
SELECT flag, 'test' AS part, CAST(t AS BIGINT) AS n FROM c
UNION ALL SELECT flag, 'valid' AS part, CAST(ceil(0.2 * (n - t)) AS BIGINT) AS n FROM c
UNION ALL SELECT flag, 'train' AS part, CAST(n - t - ceil(0.2 * (n - t)) AS BIGINT) AS n FROM c""", "trades"))
def q_nested_split_counts(spark, sf):
    s = split.nested_split(tf.stored_trades(spark, sf), "flag", 0.2, 0.2, seed=42)
    return s.groupBy("flag", "part").agg(F.count(F.lit(1)).alias("n"))


_ALL = ["d", "l_orderkey", "l_linenumber", "client", "leg_type", "product_name", "product_group", "currency",
        "office", "risk", "source_system", "trade_date", "notional", "fx_rate", "gbp", "flag"]


@register("positional_split", "M3", with_fixtures(f"""
WITH r AS (SELECT flag, row_number() OVER (ORDER BY {", ".join(c + " NULLS FIRST" for c in _ALL)}) AS pos,
                  count(*) OVER () AS n FROM trades)
SELECT CASE WHEN pos <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS part,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(flag) AS BIGINT) AS flagged
FROM r GROUP BY 1""", "trades"))
def q_positional_split(spark, sf):
    s = split.positional_split(tf.stored_trades(spark, sf), _ALL, 0.8)
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").cast("bigint").alias("flagged"))


@register("stratified_fold_counts", "M17", with_fixtures("""
WITH c AS (SELECT flag, count(*) AS n FROM trades GROUP BY flag),
f AS (SELECT CAST(unnest(generate_series(0, 14)) AS INTEGER) AS fold)
SELECT c.flag, f.fold, CAST(n // 15 + CASE WHEN f.fold < n % 15 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM c, f""", "trades"))
def q_stratified_fold_counts(spark, sf):
    s = split.stratified_folds(tf.stored_trades(spark, sf), "flag", k=15, seed=42)
    return s.groupBy("flag", "fold").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- evaluation (rule score)

_SCORED_SQL = """scored AS (SELECT flag AS label, round(1 - fx_rate, 2) AS score,
                       CASE WHEN round(1 - fx_rate, 2) >= 0.08 THEN 1 ELSE 0 END AS prediction FROM trades)"""


def _scored(spark, sf):
    t = tf.stored_trades(spark, sf, "flag", "fx_rate")
    score = F.round(1 - F.col("fx_rate"), 2)
    return t.select(F.col("flag").alias("label"), score.alias("score"),
                    F.when(score >= 0.08, 1).otherwise(0).alias("prediction"))


@register("confusion_matrix", "M9", with_fixtures("WITH " + _SCORED_SQL + """
SELECT label, prediction, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY label, prediction""", "trades"))
def q_confusion_matrix(spark, sf):
    return ev.confusion_matrix(_scored(spark, sf))


@register("confusion_share", "M10", with_fixtures("WITH " + _SCORED_SQL + """,
cm AS (SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction)
SELECT label, prediction, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share,
       round(n / sum(n) OVER (PARTITION BY label) * 100, 6) AS percent FROM cm""", "trades"))
def q_confusion_share(spark, sf):
    c = ev.confusion_share(_scored(spark, sf))
    return c.withColumn("share", _r("share")).withColumn("percent", _r("percent"))


@register("confusion_margins", "M11", with_fixtures("WITH " + _SCORED_SQL + """
SELECT label, prediction, CAST(count(*) AS BIGINT) AS n, CAST(grouping(label) AS INTEGER) AS is_label_margin,
       CAST(grouping(prediction) AS INTEGER) AS is_prediction_margin
FROM scored GROUP BY CUBE (label, prediction)""", "trades"))
def q_confusion_margins(spark, sf):
    return ev.confusion_margins(_scored(spark, sf))


@register("eval_metrics", "M12 M13 M14", with_fixtures("WITH " + _SCORED_SQL + """
SELECT round(count(*) FILTER (WHERE label = prediction) / count(*), 6) AS accuracy,
       round(coalesce(count(*) FILTER (WHERE label = 1 AND prediction = 1)
                      / nullif(count(*) FILTER (WHERE label = 1), 0), 0), 6) AS recall,
       round(coalesce(count(*) FILTER (WHERE label = 1 AND prediction = 1)
                      / nullif(count(*) FILTER (WHERE prediction = 1), 0), 0), 6) AS precision
FROM scored""", "trades"))
def q_eval_metrics(spark, sf):
    m = ev.binary_metrics(_scored(spark, sf))
    return m.select(*[_r(c).alias(c) for c in m.columns])


@register("classification_report", "M15", with_fixtures("WITH " + _SCORED_SQL + """,
cm AS (SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction),
cls AS (SELECT l AS label,
               coalesce((SELECT sum(n) FROM cm WHERE cm.label = l), 0) AS support,
               coalesce((SELECT sum(n) FROM cm WHERE cm.prediction = l), 0) AS predicted,
               coalesce((SELECT sum(n) FROM cm WHERE cm.label = l AND cm.prediction = l), 0) AS tp
        FROM (SELECT label AS l FROM cm UNION SELECT prediction FROM cm)),
per AS (SELECT CAST(label AS VARCHAR) AS "row",
               coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
               support, tp FROM cls),
per2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per),
allrows AS (
  SELECT "row", precision, recall, f1, CAST(support AS DOUBLE) AS support FROM per2
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM per2
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per2
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM per2)
SELECT "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS DOUBLE) AS support FROM allrows""", "trades"))
def q_classification_report(spark, sf):
    r = ev.classification_report(_scored(spark, sf))
    return r.select("row", _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"),
                    F.col("support").cast("double").alias("support"))


@register("pr_curve", "M16", with_fixtures("WITH " + _SCORED_SQL + """,
a AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS tp_at, count(*) AS n_at
      FROM scored GROUP BY score),
c AS (SELECT threshold, sum(tp_at) OVER w AS tp, sum(n_at) OVER w AS n FROM a
      WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(n - tp AS BIGINT) AS fp, round(tp / n, 6) AS precision,
       round(tp / (SELECT count(*) FILTER (WHERE label = 1) FROM scored), 6) AS recall FROM c""", "trades"))
def q_pr_curve(spark, sf):
    p = ev.pr_curve(_scored(spark, sf))
    return p.select("threshold", "tp", "fp", _r("precision").alias("precision"), _r("recall").alias("recall"))


# --------------------------------------------------------------------------- models (rows-only checks)

def _term_sql() -> str:
    stops = ", ".join("'" + w + "'" for w in ENGLISH)
    return f"""
WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
per_doc AS (SELECT doc_id, term, count(*) AS n FROM tok WHERE length(term) >= 2 AND term NOT IN ({stops})
            GROUP BY doc_id, term)
SELECT term, CAST(sum(n) AS BIGINT) AS tf, CAST(count(*) AS BIGINT) AS df FROM per_doc GROUP BY term"""


@register("bag_of_words_vocab", "M20", _term_sql())
def q_bag_of_words_vocab(spark, sf):
    from ledgerspark.operators.ml import term_counts
    from ledgerspark.sources.readers import table
    return term_counts(table(spark, sf, "documents"))


SPEC = dict(categorical=("source_system", "office", "risk", "product_type", "currency_reduced"), label="flag")


def _spec():
    from ledgerspark.operators.ml import FeatureSpec
    return FeatureSpec(**SPEC)


#: the reference's parameters; tests grow fewer trees through the same queries
FOREST = ForestParams()
FOLDS, SEARCHED = 15, 4


def _clean_stored(spark, sf):
    """The cleaned table, written once to the shared folder: fits scan their input many times."""
    return spark.read.parquet(_write_clean(spark, sf))


def _write_clean(spark, sf) -> str:
    """Only the cleaned rows stay on disk, neither the tagged rows before them nor what was shuffled for both."""
    tagged, path = scratch_path(spark, "tagged"), scratch_path(spark, "clean")

    def store(df):
        df.write.parquet(tagged)
        return spark.read.schema(df.schema).parquet(tagged)

    with shuffles_dropped(spark):
        tf.clean(spark, sf, store=store).clean.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    forget(spark, tagged)
    return path


_TRAINED: dict = {}


def _trained(spark, sf):
    """Trained once per application and state of the input files; the queries reload the saved model and the stored parts."""
    from ledgerspark.plans import jobs
    from ledgerspark.sources.readers import table_state
    key = (spark.sparkContext.applicationId, sf, table_state(spark, sf, "lineitem", "orders", "customer", "nation", "part"))
    if key not in _TRAINED:
        _TRAINED[key] = jobs.train_and_validate(_clean_stored(spark, sf), _spec(), scratch_path(spark, "trained"), ROW_KEYS, FOREST)
    return _TRAINED[key]


@register("one_hot_counts", "M4", with_fixtures("WITH " + tf.CLEAN_SQL + "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", coalesce(CAST({c} AS VARCHAR), '(missing)') AS level, CAST(count(*) AS BIGINT) AS n
FROM clean GROUP BY 2""" for c in SPEC["categorical"]), "trades"))
def q_one_hot_counts(spark, sf):
    from ledgerspark.operators import ml
    return ml.one_hot_counts(_clean_stored(spark, sf), _spec())


_CONT = ("month", "weekday", "quarter", "gbp_log_amount")


@register("scaled_features", "M5 A4", with_fixtures("WITH " + tf.CLEAN_SQL + "\nSELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS {c}_scaled" for c in _CONT) + " FROM clean", "trades"))
def q_scaled_features(spark, sf):
    from ledgerspark.operators import ml
    clean = _clean_stored(spark, sf)
    return ml.scaled(clean, clean, _spec()).select(*KEYS, *[_r(f"{c}_scaled", 5).alias(f"{c}_scaled") for c in _CONT])


@register("train_predict", "G6 M6 M7 M8 M19 S11 S5")
def q_train_predict(spark, sf):
    from ledgerspark.plans import jobs
    t = _trained(spark, sf)
    pred = jobs.holdout_predictions(spark, t.model_path, t.parts_path, "flag")
    return pred.select(*KEYS, "label", "prediction", F.round("p1", 6).alias("p1"))


@register("validation_report", "G6 M2 M15")
def q_validation_report(spark, sf):
    return _trained(spark, sf).validation


@register("holdout_report", "G7 M9 M10 M12 M13 M14 M15 M16 M23 S11")
def q_holdout_report(spark, sf):
    from ledgerspark.plans import jobs
    t = _trained(spark, sf)
    return jobs.holdout_evaluation(spark, t.model_path, t.parts_path, "flag").withColumn("value", F.round("value", 6))


@register("review_list", "M23 G7")
def q_review_list(spark, sf):
    from ledgerspark.plans import jobs
    t = _trained(spark, sf)
    return jobs.review_list(spark, t.model_path, t.parts_path, "flag", ROW_KEYS).drop("_row")


#: classes with the sizes that the nested split gives their holdout, validation and training parts
_PARTS_SQL = """parts AS (
  SELECT flag, n, t, CAST(ceil(0.2 * (n - t)) AS BIGINT) AS v FROM (
    SELECT flag, count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM clean GROUP BY flag))"""


@register("model_round_trip", "S11 M8 G6", with_fixtures("WITH " + tf.CLEAN_SQL + "," + _PARTS_SQL + """
SELECT flag AS label, t AS scored, CAST(0 AS BIGINT) AS different, CAST(0 AS BIGINT) AS without_score FROM parts""", "trades"))
def q_model_round_trip(spark, sf):
    """The holdout's rows per class, and those that the saved and reloaded model scores otherwise than the one in memory."""
    from ledgerspark.operators import ml
    from ledgerspark.plans import jobs
    t = _trained(spark, sf)
    saved = jobs.holdout_predictions(spark, t.model_path, t.parts_path, "flag")
    kept = ml.predict(t.model, ml.for_scoring(spark.read.parquet(t.parts_path).where("part = 'test'")), "flag")
    cols = [*KEYS, "label", "prediction", "p1"]
    both = saved.select(*cols, F.lit(1).alias("side")).unionByName(kept.select(*cols, F.lit(-1).alias("side")))
    net = both.groupBy(*cols).agg(F.sum("side").alias("net"), F.count_if(F.col("side") == 1).alias("scored"))
    return net.groupBy("label").agg(F.sum("scored").alias("scored"), F.sum(F.abs("net")).alias("different"),
                                    F.sum(F.when(F.col("p1").isNull(), F.col("scored")).otherwise(0)).alias("without_score"))


@register("review_invariants", "M23", with_fixtures("WITH " + tf.CLEAN_SQL + "," + _PARTS_SQL + """
SELECT sum(t) AS n, CAST(1 AS BIGINT) AS first_rank, sum(t) AS last_rank, sum(t) AS ranks, CAST(0 AS BIGINT) AS rising,
       CAST(0 AS BIGINT) AS flagged_below_unflagged FROM parts""", "trades"))
def q_review_invariants(spark, sf):
    """Ranks are 1 .. n, scores never rise along them, and no flagged row has a lower score than one that is not flagged."""
    r = q_review_list(spark, sf)
    by_score = r.groupBy("score").agg(F.min("review_rank").alias("a"), F.max("review_rank").alias("z"), F.count(F.lit(1)).alias("n"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.min("review_rank").cast("long").alias("first_rank"), F.max("review_rank").cast("long").alias("last_rank"),
                 F.count_distinct("review_rank").alias("ranks")).crossJoin(by_score.agg(
        F.sum((F.col("z") - F.col("a") + 1 != F.col("n")).cast("long")).alias("rising"))).crossJoin(r.agg(F.coalesce((
            F.min(F.when(F.col("review"), F.col("score"))) <= F.max(F.when(~F.col("review"), F.col("score")))).cast("long"), F.lit(0)).alias("flagged_below_unflagged")))


@register("review_ranking", "M23", with_fixtures("""
WITH scored AS (SELECT l_orderkey, l_linenumber, flag AS label, round(1 - fx_rate, 2) AS score FROM trades),
a AS (SELECT score, count(*) FILTER (WHERE label = 1) AS tp FROM scored GROUP BY score),
c AS (SELECT score, sum(tp) OVER (ORDER BY score DESC) / (SELECT sum(tp) FROM a) AS recall FROM a),
t AS (SELECT max(score) AS cut FROM c WHERE recall >= 0.9)
SELECT l_orderkey, l_linenumber, label, round(score, 6) AS score, score >= cut AS review,
       CAST(row_number() OVER (ORDER BY score DESC, l_orderkey, l_linenumber, label) AS BIGINT) AS review_rank FROM scored, t""", "trades"))
def q_review_ranking(spark, sf):
    t = tf.stored_trades(spark, sf, *KEYS, "flag", "fx_rate").select(*KEYS, F.col("flag").alias("label"), F.round(1 - F.col("fx_rate"), 2).alias("score"))
    r = ev.review_ranking(t, [*KEYS, "label"], recall=0.9)  # the fixture's keys repeat
    return r.select(*KEYS, "label", _r("score").alias("score"), "review", F.col("review_rank").cast("long").alias("review_rank"))


@register("weighted_alternatives", "M21 M22")
def q_weighted_alternatives(spark, sf):
    from functools import reduce

    from ledgerspark.operators import ml
    spec, path = _spec(), _write_clean(spark, sf)
    with shuffles_dropped(spark):
        parts = split.nested_split(spark.read.parquet(path), "flag", 0.2, 0.2, seed=42, key_cols=ROW_KEYS)
        parts = stored(parts.select(*spec.categorical, *spec.boolean, *spec.continuous, spec.label, "part"), "parts")
    forget(spark, path)  # every cleaned row is in one of the parts
    train = ml.class_weights(parts.where(F.col("part") == "train"), "flag")
    valid = parts.where(F.col("part") == "valid")
    prepared = ml.prepare_training(parts, train, spec, weight="weight")
    outs = []
    for kind in ("logistic", "svm", "tree"):
        model = ml.fit_suspicion_model(parts, train, spec,
                                       classifier=ml.alternative_classifier(kind, weight="weight"), prepared=prepared)
        m = ev.binary_metrics(ml.predict(model, valid, "flag"))
        outs.append(m.select(F.lit(kind).alias("model"), "*"))
    return reduce(lambda a, b: a.unionByName(b), outs)


def _training_part(spark, sf):
    """The training part of the nested split, as the reference validates and searches on it."""
    clean = _clean_stored(spark, sf)
    path = scratch_path(spark, "training")
    split.nested_split(clean, "flag", 0.2, 0.2, seed=42, key_cols=ROW_KEYS).where("part = 'train'").drop("part").write.parquet(path)
    return spark.read.parquet(path)


@register("cross_validation", "M17 M12")
def q_cross_validation(spark, sf):
    """Scores per fold, and their summary in the row without a fold."""
    from ledgerspark.operators import ml
    path = scratch_path(spark, "cv")
    ml.cross_validate(_training_part(spark, sf), _spec(), FOREST, k=FOLDS, key_cols=ROW_KEYS).write.parquet(path)
    scores = spark.read.parquet(path)
    return scores.withColumn("macro_f1_2std", F.lit(None).cast("double")).unionByName(ml.cv_summary(scores).select(
        F.lit(None).cast("int").alias("fold"), F.col("mean_accuracy").alias("accuracy"), F.col("mean_macro_f1").alias("macro_f1"), "macro_f1_2std"))


@register("leave_one_out_scaling", "M17 M5", with_fixtures("WITH " + tf.CLEAN_SQL + f""",
k AS (SELECT *, l_orderkey % {FOLDS} AS fold FROM clean),
f AS (SELECT CAST(unnest(range({FOLDS})) AS BIGINT) AS fold)
SELECT f.fold, """ + ", ".join(f"round(avg({c}), 5) AS {c}_mean, round(stddev_pop({c}), 5) AS {c}_dev" for c in _CONT) + """
FROM f JOIN k ON k.fold <> f.fold GROUP BY f.fold""", "trades"))
def q_leave_one_out_scaling(spark, sf):
    """The constants of every fold's scaler, read back from the stages: x scales to 0 at the mean and to 1 a deviation above."""
    from functools import reduce

    from ledgerspark.operators import ml
    folded = _clean_stored(spark, sf).withColumn("fold", F.col("l_orderkey") % FOLDS)
    probe = spark.createDataFrame([tuple([0.0] * len(_CONT)), tuple([1.0] * len(_CONT))], ", ".join(f"{c} double" for c in _CONT))

    def constants(fold: int, stage):
        at = stage.transform(probe).agg(*[x for c in _CONT for x in (
            F.max(F.when(F.col(c) == 0, F.col(f"{c}_scaled"))).alias(f"{c}_0"), F.max(F.when(F.col(c) == 1, F.col(f"{c}_scaled"))).alias(f"{c}_1"))])
        step = {c: F.col(f"{c}_1") - F.col(f"{c}_0") for c in _CONT}
        return at.select(F.lit(fold).cast("long").alias("fold"), *[x for c in _CONT for x in (
            F.round(-F.col(f"{c}_0") / step[c], 5).alias(f"{c}_mean"), F.round(1 / step[c], 5).alias(f"{c}_dev"))])

    return reduce(lambda a, b: a.unionByName(b), [constants(f, s) for f, s in ml.leave_one_out_scalers(folded, list(_CONT)).items()])


@register("parameter_search", "M18")
def q_parameter_search(spark, sf):
    from ledgerspark.operators import ml
    space = {"min_instances_per_node": [1, 2, 3, 5, 8], "impurity": ["entropy", "gini"], "max_depth": [10, 20, 30], "feature_subset": ["sqrt", "log2", "onethird"]}
    return ml.parameter_search(_training_part(spark, sf), _spec(), space, n=SEARCHED, k=3, base=FOREST, key_cols=ROW_KEYS)


_WEIGHT_SQL = """counts AS (SELECT flag, count(*) AS n FROM clean GROUP BY flag)"""


@register("class_weight_totals", "M21", with_fixtures("WITH " + tf.CLEAN_SQL + "," + _WEIGHT_SQL + """
SELECT flag, n, round((SELECT sum(n) FROM counts) / (2.0 * n), 6) AS weight, round((SELECT sum(n) FROM counts) / 2.0, 3) AS total FROM counts""", "trades"))
def q_class_weight_totals(spark, sf):
    """Balanced weights: every class weighs as much as any other."""
    from ledgerspark.operators import ml
    w = ml.class_weights(_clean_stored(spark, sf), "flag")
    return w.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"), F.round(F.sum("weight"), 3).alias("total"))


@register("balanced_class_rows", "M21", with_fixtures("WITH " + tf.CLEAN_SQL + "," + _WEIGHT_SQL + """
SELECT 'down' AS direction, flag, (SELECT min(n) FROM counts) AS n, (SELECT min(n) FROM counts) AS different_rows, CAST(1 AS BIGINT) AS most FROM counts
UNION ALL SELECT 'up', flag, (SELECT max(n) FROM counts), n, CAST(ceil((SELECT max(n) FROM counts) / n) AS BIGINT) FROM counts""", "trades"))
def q_balanced_class_rows(spark, sf):
    """Exact resampling, down to the smallest class and up to the largest: rows, different rows and the most often one appears."""
    from ledgerspark.operators import ml
    clean = _clean_stored(spark, sf)

    def sizes(direction: str, target: str):
        rows = ml.balance_rows(clean, "flag", target, ["_row"]).groupBy("flag", "_row").agg(F.count(F.lit(1)).alias("n"))
        return rows.groupBy("flag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different_rows"), F.max("n").alias("most")).withColumn(
            "direction", F.lit(direction))

    return sizes("down", "min").unionByName(sizes("up", "max"))


@register("text_model", "M20 M7")
def q_text_model(spark, sf):
    from ledgerspark.operators import ml
    from ledgerspark.sources.readers import table
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    parts = ml.kept(split.stratified_split(docs.select("doc_id", "text", "toxic"), "toxic", 0.2, seed=42, key_cols=["doc_id"]), "text-parts")
    model = ml.fit_text_classifier(parts.where(F.col("part") == "train"), "toxic", ml.ForestParams(min_instances_per_node=3))
    pred = ml.predict(model, parts.where(F.col("part") == "test"), "toxic")
    return pred.select("doc_id", "label", "prediction", F.round("p1", 6).alias("p1"))
