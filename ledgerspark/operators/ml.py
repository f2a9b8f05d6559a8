"""Model building on MLlib.

``fit_suspicion_model`` reproduces the reference's modelling recipe:
categories taken from the whole cleaned table (M4), one-hot without a dropped
level, continuous columns scaled by the training part's mean and *population*
standard deviation (M5), boolean flags appended as 0/1 (M6), and a 200-tree
entropy forest with sqrt feature subsets (M7). The fitted stages form one
``PipelineModel`` that can be saved and loaded (S11).

All fitting is distributed. What a fit scans many times is written to the shared folder
first, spread over all cores, so a lost executor costs a read and not the preparation.
Forests whose binned rows fit a task grow a whole tree per task (``operators.forest``).
Larger ones are MLlib's: they keep the node that each row has reached in each tree beside
the rows, checkpointed in the same folder, instead of sending the grown forest to every
task of every step.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import (CountVectorizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StopWordsRemover,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.stopwords import ENGLISH
from ledgerspark.operators.forest import SideBySideForest
from ledgerspark.operators.split import class_rank, stratified_folds
from ledgerspark.session import checkpoint_dir, forget, scratch_path, shuffles_dropped


@dataclass(frozen=True)
class FeatureSpec:
    """Feature lists defined once (the reference repeats them in two notebooks)."""
    categorical: tuple[str, ...] = ("Source System", "CountryCodeOffice", "ML Risk Rating", "product_type",
                                    "currency_reduced")
    boolean: tuple[str, ...] = ("suspicious_client", "trusted_client", "new_client", "frequent_client",
                                "is_month_start", "is_month_end")
    continuous: tuple[str, ...] = ("month", "weekday", "quarter", "gbp_log_amount")
    label: str = "Flag"


REFERENCE_FEATURES = FeatureSpec()
MISSING_LEVEL = "(missing)"
SCORE_ROWS = 50_000
FIT_ROWS = 250_000
#: how trees are grown: the same trees in fewer passes, each row going on from its node
GROWTH = {"cacheNodeIds": True, "checkpointInterval": 5, "maxMemoryInMB": 512}


@dataclass(frozen=True)
class ForestParams:
    num_trees: int = 200
    impurity: str = "entropy"
    min_instances_per_node: int = 1
    feature_subset: str = "sqrt"
    max_depth: int = 30  # the reference grows trees without a depth limit; 30 is MLlib's own limit
    seed: int = 42
    extra: dict = field(default_factory=dict)


def _safe(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name)


def _scaling(constants: list[tuple[str, float | None, float | None]], suffix: str) -> SQLTransformer:
    """``(x - mean) / deviation`` per (column, mean, deviation), as a stage that persists with the model."""
    exprs = []
    for c, m, s in constants:
        m = 0.0 if m is None else float(m)
        s = 1.0 if not s else float(s)  # a constant column scales to 0
        exprs.append(f"(CAST(`{c}` AS DOUBLE) - ({m!r})) / ({s!r}) AS `{_safe(c)}{suffix}`")
    return SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__")


def population_scaler(train: DataFrame, cols: list[str], suffix: str = "_scaled") -> SQLTransformer:
    """M5: ``(x - mean) / stddev_pop`` with both taken from ``train``.

    MLlib's ``StandardScaler`` divides by the sample deviation; the reference uses
    the population one. Fitting is one aggregate of 2 x len(cols) numbers.
    """
    row = train.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(cols)
                      for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return _scaling([(c, row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)], suffix)


def leave_one_out_scalers(folded: DataFrame, cols: list[str], fold: str = "fold", suffix: str = "_scaled") -> dict[int, SQLTransformer]:
    """For every fold the scaler of all other folds, from one aggregate: count, mean and squared deviation of each
    fold, merged over the others (one row per fold reaches the driver)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(x)).alias(f"d{i}")]
    rows = folded.groupBy(fold).agg(*aggs).collect()

    def others(f: int, i: int) -> tuple[float | None, float | None]:
        n, mean, dev = 0, 0.0, 0.0
        for r in rows:
            if r[fold] != f and r[f"n{i}"]:
                own, step = r[f"n{i}"], r[f"m{i}"] - mean
                dev += r[f"d{i}"] + step * step * n * own / (n + own)
                mean += step * own / (n + own)
                n += own
        return (mean, (dev / n) ** 0.5) if n else (None, None)

    return {r[fold]: _scaling([(c, *others(r[fold], i)) for i, c in enumerate(cols)], suffix) for r in rows}


def feature_stages(all_rows: DataFrame, train: DataFrame, spec: FeatureSpec) -> tuple[list, str]:
    """Fitted feature stages and the name of the assembled vector column."""
    cat = list(spec.categorical)
    idx = [f"{_safe(c)}_idx" for c in cat]
    vec = [f"{_safe(c)}_vec" for c in cat]
    # a missing category is a level of its own; a level that all_rows does not have is an error
    named = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"coalesce(CAST(`{c}` AS STRING), '{MISSING_LEVEL}') AS `{_safe(c)}_cat`" for c in cat) + " FROM __THIS__")
    all_named = named.transform(all_rows)
    indexer = StringIndexer(inputCols=[f"{_safe(c)}_cat" for c in cat], outputCols=idx, handleInvalid="error",
                            stringOrderType="frequencyDesc").fit(all_named)
    encoder = OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=False).fit(indexer.transform(all_named))
    scaler = population_scaler(train, list(spec.continuous))
    scaled = [f"{_safe(c)}_scaled" for c in spec.continuous]
    bools = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"CAST(`{c}` AS DOUBLE) AS `{_safe(c)}_num`" for c in spec.boolean) + " FROM __THIS__")
    assembler = VectorAssembler(inputCols=vec + scaled + [f"{_safe(c)}_num" for c in spec.boolean],
                                outputCol="features")
    return [named, indexer, encoder, scaler, bools, assembler], "features"


def one_hot_counts(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """M4 check: ``column, level, n`` counted from the encoded vectors, which are summed before they are taken apart."""
    named, indexer, encoder = feature_stages(df, df, spec)[0][:3]
    enc = PipelineModel([named, indexer, encoder]).transform(df)
    levels = dict(zip(spec.categorical, indexer.labelsArray))

    sums = enc.agg(*[Summarizer.sum(F.col(f"{_safe(c)}_vec")).alias(f"s{i}") for i, c in enumerate(spec.categorical)])

    def cells_of(i: int, c: str):
        names = F.array(*[F.lit(v) for v in levels[c]])
        return F.transform(vector_to_array(f"s{i}"), lambda x, at: F.struct(
            F.lit(c).alias("column"), F.get(names, at).alias("level"), F.round(x).cast("long").alias("n")))

    cells = F.concat(*[cells_of(i, c) for i, c in enumerate(spec.categorical)])
    return sums.select(F.explode(cells).alias("s")).select("s.column", "s.level", "s.n")


def scaled(df: DataFrame, train: DataFrame, spec: FeatureSpec) -> DataFrame:
    """M5: ``df`` with its continuous columns scaled by ``train`` (suffix ``_scaled``)."""
    return population_scaler(train, list(spec.continuous)).transform(df)


def forest(params: ForestParams, label: str, features: str = "features") -> SideBySideForest:
    """M7."""
    growth = GROWTH | params.extra
    return SideBySideForest(labelCol=label, featuresCol=features, numTrees=params.num_trees,
                                  impurity=params.impurity, minInstancesPerNode=params.min_instances_per_node,
                                  featureSubsetStrategy=params.feature_subset, maxDepth=params.max_depth,
                                  seed=params.seed, **growth)


def kept(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder in at least as many files as there are cores, and read again."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(wide).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def for_fitting(rows: DataFrame) -> DataFrame:
    """``rows`` in one task per core, or in whole rounds of that where tasks would exceed ``FIT_ROWS``. In every step of a forest
    each task counts for all nodes that are split and sends all these counts: many small tasks multiply what is shuffled, and
    one or two would leave cores idle. How files are cut into tasks depends on settings, so it is looked up."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-rows.count() // (cores * FIT_ROWS)))
    return rows if rows.rdd.getNumPartitions() == tasks else rows.repartition(tasks)


def kept_for_fitting(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the tasks that a fit reads. A fit scans its rows several times: dealt anew in each scan, every one of them
    would leave a copy of all rows in shuffle files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    rows = kept(df, name, path)
    dealt = for_fitting(rows)
    if dealt is rows:
        return rows
    checkpoint_dir(spark)
    with shuffles_dropped(spark):
        dealt = dealt.checkpoint(eager=True)
    forget(spark, path)
    return dealt


@dataclass(frozen=True)
class Prepared:
    """Fitted feature stages and the training rows they encode (``_label``, features, weight), stored."""
    stages: list
    features: str
    matrix: DataFrame


def prepare_training(all_rows: DataFrame, train: DataFrame, spec: FeatureSpec = REFERENCE_FEATURES, weight: str | None = None) -> Prepared:
    """Encoders (categories from ``all_rows``) and scaler (on ``train``), for any number of classifiers."""
    stages, feats = feature_stages(all_rows, train, spec)
    lbl = train.withColumn("_label", F.col(f"`{spec.label}`").cast("double"))
    return Prepared(stages, feats, kept_for_fitting(PipelineModel(stages).transform(lbl).select("_label", feats, *([weight] if weight else [])), "matrix"))


def fit_suspicion_model(all_rows: DataFrame, train: DataFrame, spec: FeatureSpec = REFERENCE_FEATURES,
                        params: ForestParams = ForestParams(), classifier=None, prepared: Prepared | None = None) -> PipelineModel:
    """Fit encoders (categories from ``all_rows``), scaler and classifier (on ``train``); with ``prepared``, of the
    same rows, only the classifier."""
    checkpoint_dir(train.sparkSession)
    clf = classifier if classifier is not None else forest(params, "_label")
    if prepared is None:
        weighted = clf.hasParam("weightCol") and clf.isSet("weightCol")
        prepared = prepare_training(all_rows, train, spec, clf.getWeightCol() if weighted else None)
    return PipelineModel(prepared.stages + [clf.fit(prepared.matrix)])


def for_scoring(rows: DataFrame) -> DataFrame:
    """``rows`` in tasks of ``SCORE_ROWS`` or more: every task unpacks the whole forest first, so small parts should not be
    spread over many. No shuffle."""
    return rows.coalesce(max(1, -(-rows.count() // SCORE_ROWS)))


def predict(model, df: DataFrame, label: str | None = None) -> DataFrame:
    """Adds ``prediction`` (int) and ``p1`` = probability of class 1 (NULL for margin models)."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("p1", vector_to_array("probability")[1])
    else:
        out = out.withColumn("p1", F.lit(None).cast("double"))
    out = out.withColumn("prediction", F.col("prediction").cast("int"))
    if label is not None:
        out = out.withColumn("label", F.col(f"`{label}`").cast("int"))
    return out


def save_model(model: PipelineModel, path: str) -> None:
    """S11."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S11."""
    return PipelineModel.load(path)


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``n / (num_classes * n_class)`` per row (balanced classes)."""
    counts = df.groupBy(F.col(f"`{label}`").alias("_lbl")).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.select(F.count(F.lit(1))).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    # one row per class: by a shuffle, all rows of a class would meet in one task
    w = F.broadcast(counts.select("_lbl", (total / (k * F.col("_nc"))).alias(out)))
    return df.join(w, F.col(f"`{label}`").eqNullSafe(F.col("_lbl"))).drop("_lbl")


def balance_rows(df: DataFrame, label: str, target: str = "min", keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly as many rows of every class as the smallest (``target="min"``: the first by a seeded hash of ``keys``) or
    the largest class has (``target="max"``: whole copies, and one more of the first rows). Adds ``copy``, 0 for a row itself."""
    ranked = class_rank(df, label, keys or [c for c in df.columns if c != label], seed)
    sizes = df.groupBy(F.col(f"`{label}`")).agg(F.count(F.lit(1)).alias("_n"))
    goal = sizes.select((F.min if target == "min" else F.max)("_n")).scalar()
    # rank r of n appears goal div n times, and once more up to rank goal mod n
    times = F.floor(goal / F.col("_n")) + (F.col("_crank") <= goal % F.col("_n")).cast("long")
    return ranked.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int"))))).drop("_crank", "_n")


def alternative_classifier(kind: str, label: str = "_label", weight: str | None = None, seed: int = 42):
    """Logistic regression, linear SVM or a single tree (``weightCol`` for M21)."""
    kw = {"labelCol": label, "featuresCol": "features"}
    if weight:
        kw["weightCol"] = weight
    if kind == "logistic":
        return LogisticRegression(maxIter=100, **kw)
    if kind == "svm":
        return LinearSVC(maxIter=100, **kw)
    if kind == "tree":
        return DecisionTreeClassifier(impurity="entropy", maxDepth=30, seed=seed, **GROWTH, **kw)
    raise ValueError(kind)


class FoldedMatrix:
    """Encoded rows with their fold, stored once; every fold's training rows are a mask over them.

    Category encoders depend on the whole table only. Per fold only the scaler of the other folds differs, and all
    folds' scalers come from one aggregate.
    """

    def __init__(self, df: DataFrame, spec: FeatureSpec, k: int, seed: int = 42, key_cols: list[str] | None = None,
                 keep: tuple[str, ...] = ()):
        checkpoint_dir(df.sparkSession)
        folded = stratified_folds(df, spec.label, k, seed, key_cols)
        (named, indexer, encoder, _, bools, assembler), self.features = feature_stages(df, df, spec)
        scaled = {f"{_safe(c)}_scaled" for c in spec.continuous}
        fixed = [c for c in assembler.getInputCols() if c not in scaled]
        rows = PipelineModel([named, indexer, encoder, bools, VectorAssembler(inputCols=fixed, outputCol="_fixed")]).transform(folded)
        self.rows = kept(rows.select("fold", F.col(f"`{spec.label}`").cast("double").alias("_label"), "_fixed",
                                     *[F.col(f"`{c}`") for c in dict.fromkeys((*spec.continuous, *keep))]), "folds")
        self.keep, self.k = keep, k
        self.scalers = leave_one_out_scalers(self.rows, list(spec.continuous))
        self.assembler = VectorAssembler(inputCols=["_fixed", *[f"{_safe(c)}_scaled" for c in spec.continuous]], outputCol=self.features)

    def scores(self, params: ForestParams, parallelism: int = 2) -> DataFrame:
        """``keep`` columns, ``fold, label, prediction, p1`` of every row, each scored by the model of the other folds. The
        loop runs over the k folds, a few at a time; each fit and each score is distributed and stored."""
        path = scratch_path(self.rows.sparkSession, "out-of-fold")

        def one(f: int) -> None:
            prepare = PipelineModel([self.scalers[f], self.assembler]).transform
            others = prepare(self.rows.where(F.col("fold") != f)).select("_label", self.features)
            model = forest(params, "_label", self.features).fit(for_fitting(others))
            own = predict(model, prepare(for_scoring(self.rows.where(F.col("fold") == f))))
            own.select(*self.keep, "fold", F.col("_label").cast("int").alias("label"), "prediction", "p1").write.mode(
                "append").parquet(f"{path}/of={f}")

        with ThreadPool(parallelism) as pool:
            pool.map(one, sorted(self.scalers), chunksize=1)
        return self.rows.sparkSession.read.parquet(path).drop("of")


def fold_scores(predictions: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Accuracy and macro-F1 per fold, from the confusion counts of all folds in one aggregate."""
    cells = predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(0).alias("side")),
                                                F.struct(F.col("prediction").alias("class"), F.lit(1).alias("side")))).alias("s"), "label", "prediction", "n")
    per_class = sides.groupBy(*by, "s.class").agg(
        F.sum("n").alias("both"), F.sum(F.when((F.col("label") == F.col("prediction")) & (F.col("s.side") == 0), F.col("n")).otherwise(0)).alias("hits"))
    return per_class.groupBy(*by).agg((F.sum("hits") * 2 / F.sum("both")).alias("accuracy"), F.avg(2 * F.col("hits") / F.col("both")).alias("macro_f1"))


def cross_validate(df: DataFrame, spec: FeatureSpec, params: ForestParams, k: int = 15, seed: int = 42,
                   key_cols: list[str] | None = None, parallelism: int = 2) -> DataFrame:
    """Stratified k-fold scores ``fold, accuracy, macro_f1`` (one model per fold)."""
    return fold_scores(FoldedMatrix(df, spec, k, seed, key_cols).scores(params, parallelism))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean accuracy and macro-F1 mean +/- 2 population std."""
    return scores.agg(F.avg("accuracy").alias("mean_accuracy"), F.avg("macro_f1").alias("mean_macro_f1"),
                      (2 * F.stddev_pop("macro_f1")).alias("macro_f1_2std"))


def sample_parameters(space: dict[str, list | tuple[float, float]], n: int, seed: int = 42) -> list[dict]:
    """``n`` different parameter sets. A list is a set of choices, drawn without replacement over the product of all
    lists (all of it, where ``n`` is larger); a pair of numbers is a range that every set draws from evenly."""
    rng = random.Random(seed)
    lists = {name: v for name, v in space.items() if isinstance(v, list)}
    ranges = {name: v for name, v in space.items() if not isinstance(v, list)}
    size = math.prod(len(v) for v in lists.values())
    picks = rng.sample(range(size), min(n, size)) if not ranges else [rng.randrange(size) for _ in range(n)]
    out = []
    for at in picks:
        chosen = {}
        for name, v in lists.items():
            at, i = divmod(at, len(v))
            chosen[name] = v[i]
        out.append(chosen | {name: rng.uniform(*v) if any(isinstance(x, float) for x in v) else rng.randint(*v) for name, v in ranges.items()})
    return out


def parameter_search(df: DataFrame, spec: FeatureSpec, space: dict[str, list | tuple[float, float]], n: int, k: int = 3, seed: int = 42,
                     base: ForestParams = ForestParams(), key_cols: list[str] | None = None, parallelism: int = 2) -> DataFrame:
    """``n`` sampled parameter sets (fields of ``ForestParams``), each scored over the same k folds of one stored
    matrix: ``params`` (JSON), mean accuracy and macro-F1, its deviation over the folds, and the rank by macro-F1."""
    matrix = FoldedMatrix(df, spec, k, seed, key_cols)
    found = None
    for i, chosen in enumerate(sample_parameters(space, n, seed)):
        own = fold_scores(matrix.scores(replace(base, **chosen), parallelism)).agg(
            F.avg("accuracy").alias("mean_accuracy"), F.avg("macro_f1").alias("mean_macro_f1"), F.stddev_pop("macro_f1").alias("std_macro_f1"))
        own = own.select(F.lit(i).alias("candidate"), F.lit(json.dumps(chosen, sort_keys=True)).alias("params"), "*")
        found = own if found is None else found.unionByName(own)
    order = Window.orderBy(F.desc("mean_macro_f1"), "candidate")  # one row per parameter set
    return found.withColumn("rank", F.row_number().over(order))


# --------------------------------------------------------------------------- text


#: Unicode letters, digits and the underscore make words (Java's \\W knows ASCII only)
NON_WORD = r"[^\p{L}\p{N}_]+"


def bag_of_words(text_col: str = "text", vocab_size: int = 10_000, min_df: float = 1.0) -> list:
    """M20 feature stages: lower-case word tokens, English stop words removed, term counts."""
    return [RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=NON_WORD, minTokenLength=2, toLowercase=True),
            StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=list(ENGLISH)),
            CountVectorizer(inputCol="_words", outputCol="features", vocabSize=vocab_size, minDF=min_df)]


def text_classifier(label: str, params: ForestParams = ForestParams(num_trees=200), text_col: str = "text",
                    vocab_size: int = 10_000) -> Pipeline:
    """M20 + M7: bag of words into a forest."""
    lbl = SQLTransformer(statement=f"SELECT *, CAST(`{label}` AS DOUBLE) AS _label FROM __THIS__")
    return Pipeline(stages=[lbl, *bag_of_words(text_col, vocab_size), forest(params, "_label")])


def fit_text_classifier(train: DataFrame, label: str, params: ForestParams = ForestParams(num_trees=200), text_col: str = "text",
                        vocab_size: int = 10_000) -> PipelineModel:
    """``text_classifier`` fitted in two steps: the term counts are stored over all cores, then the forest reads those. Labelled
    texts may fill one or two files, and a forest fitted on these as they lie would grow in as many tasks."""
    checkpoint_dir(train.sparkSession)
    *stages, clf = text_classifier(label, params, text_col, vocab_size).getStages()
    prepare = Pipeline(stages=stages).fit(train)
    matrix = kept_for_fitting(prepare.transform(train).select("_label", "features"), "terms")
    return PipelineModel([*prepare.stages, clf.fit(matrix)])


def term_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                remove_stop_words: bool = True) -> DataFrame:
    """M20 vocabulary statistics over whole texts: ``term, tf`` (occurrences) and ``df``
    (documents containing it) — the counts CountVectorizer ranks its vocabulary by.

    Counted per (document, term) first, then per term: both steps combine map-side,
    so a very common term costs one partial row per task, not one row per use.
    """
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=NON_WORD, minTokenLength=2, toLowercase=True)
    x = tok.transform(docs.select(F.col(id_col).alias("_doc"), F.col(text_col)))
    col = "_tokens"
    if remove_stop_words:
        x = StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=list(ENGLISH)).transform(x)
        col = "_words"
    per_doc = x.select("_doc", F.explode(col).alias("term")).groupBy("_doc", "term").agg(
        F.count(F.lit(1)).alias("_n"))
    return per_doc.groupBy("term").agg(F.sum("_n").alias("tf"), F.count(F.lit(1)).alias("df"))
