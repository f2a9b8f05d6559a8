"""Composed jobs G1-G7 as plain functions over DataFrames; destinations are the caller's paths."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import evaluate as ev
from ledgerspark.operators import features, joins, ml, profile, quality, split
from ledgerspark.operators import timeseries as ts
from ledgerspark.sources import fixtures as fx
from ledgerspark.sources import writers
from ledgerspark.session import scratch_path, stored


def impute_rates(transactions: DataFrame, rates: DataFrame, max_days: int = 7, strategy: str = "asof",
                 default: float | None = -1.0, export_to: str | None = None) -> DataFrame:
    """Collapse readings to daily means, then give every transaction a rate.

    ``strategy="asof"`` or ``"grid"`` bound the age in days; ``"sparse"`` fills over the union of readings
    and needed days (a bound in rows, no default). ``export_to`` also writes the result as an ordered,
    pipe-separated export.
    """
    daily = ts.daily_mean(rates)
    if strategy == "sparse":
        out = sparse_fill(transactions, rates, max_days)
        t = transactions.select(F.col("trans_date").alias("transaction_date"), "currency")
        out = t.join(out, (t["currency"] == out["the_currency"]) & (t["transaction_date"] == out["the_date"]), "left").select(
            "transaction_date", "currency", F.col("the_rate").alias("exchange_rate"), F.col("imputed").cast("int").alias("is_imputed"))
    else:
        out = ts.augment_transactions(transactions, daily, strategy=strategy, max_days=max_days, default=default)
    if export_to:
        writers.export_ordered(out, export_to, ["transaction_date", "currency"])
    return out


def sparse_fill(transactions: DataFrame, rates: DataFrame, rows: int = 7) -> DataFrame:
    """The readings' days and the days that need a rate, each with the last value at most ``rows`` rows back."""
    both = joins.available_and_missing(ts.daily_mean(rates), joins.need_to_impute(transactions, rates))
    return ts.fill_forward_rows(both, "the_currency", "the_date", "exch_rate", n=rows, out_value="the_rate").select(
        "the_currency", "the_date", "the_rate", F.col("to_impute").alias("imputed"))


def augment_from_tables(spark: SparkSession, sf_dir: str, strategy: str = "asof") -> DataFrame:
    return impute_rates(fx.transactions(spark, sf_dir), fx.rates(spark, sf_dir), strategy=strategy)


def trade_cells(trades: DataFrame, columns: list[str], pairs: list[tuple[str, str]], flag: str) -> DataFrame:
    """``column, value, other, flag, n``: how often each value of each column (and each pair of two columns, named
    ``a/b``) has each flag. One pass over the trades, counted before the shuffle; all frequency frames come from it."""
    def text(c: str) -> Column:
        return F.col(c).cast("string")

    none = F.lit(None).cast("string")
    each = [F.struct(F.lit(c).alias("column"), text(c).alias("value"), none.alias("other")) for c in columns]
    each += [F.struct(F.lit(f"{a}/{b}").alias("column"), text(a).alias("value"), text(b).alias("other")) for a, b in pairs]
    return trades.select(F.explode(F.array(*each)).alias("_c"), F.col(flag).alias("flag")).groupBy(
        "_c.column", "_c.value", "_c.other", "flag").agg(F.count(F.lit(1)).alias("n"))


def profile_facts(trades: DataFrame, numeric: list[str], categorical: list[str], date: str, flag: str, client: str,
                  amounts: tuple[str, str, str], fd: tuple[str, str], top: int = 15) -> DataFrame:
    """A first look at a trade table as one table ``(section, item, measure, value)``.

    shape (A22), nulls (Q1), frequency (A11), margins of the first category by flag (A14), pivot of the second one by flag
    (A15), numeric (A18), categorical (A19), dates (A20), per_day (A12), calendar (A13), dependency (Q4: values of ``fd[0]``
    with more than one ``fd[1]``), consistency (Q5, of ``amounts``), low amounts (Q12) and top clients (O5). The trades
    are stored once; passes over that: one over (column, value, flag), one aggregate of counts, and those for the numbers."""
    trades = stored(trades, "trades")
    cells = stored(trade_cells(trades, [*categorical, date, client], [fd], flag), "cells")

    def long(section: str, df: DataFrame, item, measures: dict) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value")) for m, v in measures.items()])
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.explode(pairs).alias("_m")).select(
            "section", "item", "_m.measure", "_m.value")

    def named(*names: str) -> dict:
        return {n: F.col(n) for n in names}

    def of(column: str) -> DataFrame:
        return cells.where(F.col("column") == column)

    said = F.coalesce("value", F.lit("(null)"))
    by_value = cells.where(F.col("column").isin(categorical)).groupBy("column", "value").agg(F.sum("n").alias("n"))
    sizes = by_value.where("value IS NOT NULL").groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("freq"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top"))
    one = trades.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in trades.columns],
                     F.count_if(quality.consistency_pass(*amounts)).alias("pass"), F.count_if(~quality.consistency_pass(*amounts)).alias("fail"),
                     F.count_if(F.coalesce(F.col(amounts[0]) < 0.5, F.lit(False)) | F.coalesce(F.col(amounts[2]) < 0.5, F.lit(False))).alias("low"))
    one = stored(one, "counts")
    days = of(date).where("value IS NOT NULL").groupBy(F.to_date("value").alias("day")).agg(F.sum("n").alias("n"))
    seen = days.agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("days"), F.min("day").alias("a"), F.max("day").alias("z"))
    margins = of(categorical[0]).cube("value", "flag").agg(F.sum("n").alias("n"), F.grouping("value").alias("gv"), F.grouping("flag").alias("gf"))
    margin_item = F.concat_ws(" ", F.when(F.col("gv") == 1, "All").otherwise(said), F.lit("x"), F.when(F.col("gf") == 1, "All").otherwise(F.col("flag").cast("string")))
    clients = of(client).where("value IS NOT NULL").groupBy("value").agg(F.sum("n").alias("trades"), F.sum(F.when(F.col("flag") == 1, F.col("n")).otherwise(0)).alias("flags"))
    clients = profile.top_k(clients.withColumn("ratio", F.round(F.col("flags") / F.col("trades"), 6)), [F.desc("ratio"), F.desc("trades"), F.col("value")], top)
    numbers = profile.describe_numeric(trades.withColumn("_day", F.unix_date(date)), [*numeric, "_day"])
    moments = named("count", "mean", "std", "min", "p25", "p50", "p75", "max")
    numbers = stored(numbers, "numbers")
    broken = of("/".join(fd)).where("value IS NOT NULL AND other IS NOT NULL").select("value", "other").distinct().groupBy("value").count().where("count > 1")
    parts = [
        long("shape", one, F.lit("table"), {"rows": F.col("rows"), "columns": F.lit(len(trades.columns))}),
        *[long("nulls", one, F.lit(c), {"n": F.col(f"null {c}")}) for c in trades.columns],
        long("frequency", by_value, F.concat("column", F.lit("="), said), named("n")),
        long("margins", margins, margin_item, named("n")),
        long("pivot", of(categorical[1]).groupBy("value").agg(*[F.sum(F.when(F.col("flag") == f, F.col("n")).otherwise(0)).alias(f"flag {f}") for f in (0, 1)]),
             said, named("flag 0", "flag 1")),
        long("numeric", numbers.where(F.col("column") != "_day"), F.col("column"), moments),
        long("dates", numbers.where(F.col("column") == "_day"), F.lit(date), {k: v for k, v in moments.items() if k != "std"}),
        long("categorical", sizes, F.concat("column", F.lit(" top "), "top"), named("count", "unique", "freq")),
        long("per_day", days, F.col("day"), named("n")),
        long("calendar", seen, F.lit(date), {"days": F.col("days"), "span": F.date_diff("z", "a"), "missing": F.date_diff("z", "a") + 1 - F.col("days")}),
        long("dependency", broken.agg(F.count(F.lit(1)).alias("violations")), F.lit("/".join(fd)), named("violations")),
        long("consistency", one, F.lit(amounts[2]), named("pass", "fail")),
        long("low amounts", one, F.lit("rows"), {"n": F.col("low")}),
        long("top clients", clients, F.col("value"), named("trades", "flags", "ratio"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def clean_to(result: features.CleanResult, folder: str) -> None:
    """G5 sinks: clean rows as Parquet, rejected rows as CSV. The result should come from ``clean_trades`` with ``store``,
    so that the three sinks read the tagged rows and do not clean again."""
    writers.write_parquet(result.clean, f"{folder}/clean")
    writers.write_quarantine(result.incomplete, f"{folder}/incomplete")
    writers.write_quarantine(result.zero_amount, f"{folder}/zero_amount")


@dataclass
class Trained:
    model_path: str
    parts_path: str
    validation: DataFrame
    model: PipelineModel


def train_and_validate(clean: DataFrame, spec: ml.FeatureSpec, folder: str, keys: list[str], params: ml.ForestParams = ml.ForestParams(),
                       seed: int = 42, rename: Mapping[str, str] | None = None) -> Trained:
    """Split into train / valid / holdout, store the parts, fit on train, save the model (S11) and report on valid."""
    spark = clean.sparkSession
    for old, new in (rename or {}).items():
        clean = clean.withColumnRenamed(old, new)
    writers.write_parquet(split.nested_split(clean, spec.label, 0.2, 0.2, seed=seed, key_cols=keys), f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    model = ml.fit_suspicion_model(parts, parts.where("part = 'train'"), spec, params)
    ml.save_model(model, f"{folder}/model")
    report = ev.classification_report(ml.predict(model, ml.for_scoring(parts.where("part = 'valid'")), spec.label))
    return Trained(f"{folder}/model", f"{folder}/parts", report, model)


def holdout_predictions(spark: SparkSession, model_path: str, parts_path: str, label: str, part: str = "test") -> DataFrame:
    """The saved model, reloaded, scores a part that it has never seen: the holdout."""
    model = PipelineModel.load(model_path)
    return ml.predict(model, ml.for_scoring(spark.read.parquet(parts_path).where(F.col("part") == part)), label)


def holdout_evaluation(spark: SparkSession, model_path: str, parts_path: str, label: str, recall: float = 0.9) -> DataFrame:
    """G7 as one table ``(section, item, measure, value)`` of the saved model on the holdout: confusion matrix (M9, with the
    shares of M10), accuracy, recall and precision (M12-M14), report per class (M15), precision-recall curve (M16) and the
    review threshold (M23), which reaches ``recall`` on the validation part, with what it flags in the holdout.

    Each part is scored once, into its (label, prediction, score) counts; all measures come from those."""
    def cells(part: str) -> DataFrame:
        path = scratch_path(spark, f"cells-{part}")
        ev.scored_cells(holdout_predictions(spark, model_path, parts_path, label, part), score="p1").write.parquet(path)
        return spark.read.parquet(path)

    test = cells("test")
    cut = ev.recall_threshold(cells("valid"), recall, weight="n")

    def long(section: str, df: DataFrame, item, measures: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.explode(pairs).alias("_m")).select(
            "section", "item", "_m.measure", "_m.value")

    flagged = test.withColumn("prediction", F.when(F.col("score") >= F.lit(cut), 1).otherwise(0))
    review = ev.binary_metrics(flagged, weight="n").crossJoin(flagged.agg(
        F.lit(cut).cast("double").alias("threshold"), F.coalesce(F.sum(F.when(F.col("prediction") == 1, F.col("n"))), F.lit(0)).alias("flagged")))
    out = long("matrix", ev.confusion_share(test, weight="n"), F.concat_ws(" as ", "label", "prediction"), ["n", "share", "percent"])
    for part in (long("metrics", ev.binary_metrics(test, weight="n"), F.lit("holdout"), ["accuracy", "recall", "precision"]),
                 long("report", ev.classification_report(test, weight="n"), F.col("row"), ["precision", "recall", "f1", "support"]),
                 long("pr_curve", ev.pr_curve(test, weight="n"), F.col("threshold"), ["tp", "fp", "precision", "recall"]),
                 long("review", review, F.lit("holdout"), ["threshold", "flagged", "recall", "precision"])):
        out = out.unionByName(part)
    return out


def review_list(spark: SparkSession, model_path: str, parts_path: str, label: str, keys: list[str], recall: float = 0.9) -> DataFrame:
    """M23 on the saved model's scores: the holdout in review order, flagged by the threshold that reaches ``recall`` on the
    validation part."""
    def scored(part: str) -> DataFrame:
        return holdout_predictions(spark, model_path, parts_path, label, part).select(*keys, "label", F.round("p1", 6).alias("score"))

    path = scratch_path(spark, "scored")
    scored("test").write.parquet(path)
    return ev.review_ranking(spark.read.parquet(path), [*keys, "label"], threshold=ev.recall_threshold(scored("valid"), recall))
