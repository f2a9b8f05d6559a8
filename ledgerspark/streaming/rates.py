"""Structured Streaming variants (optional extensions X1 / X2; not in the reference).

X2: daily mean rate per key over an event-time stream, with a watermark so that
state for closed days is dropped and late readings beyond the allowance are ignored.
X1: stateless scoring of an incoming trade stream with a fitted PipelineModel.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_mean_stream(readings: DataFrame, ts_col: str = "ts", key: str = "currency", value: str = "exchange_rate",
                      lateness: str = "1 day") -> DataFrame:
    """X2 (streaming A5): ``key, exchange_date, exchange_rate, num_observations`` per closed day."""
    return (readings.withWatermark(ts_col, lateness)
                    .groupBy(F.window(ts_col, "1 day"), F.col(key))
                    .agg(F.avg(value).alias("exchange_rate"), F.count(F.lit(1)).alias("num_observations"))
                    .select(F.col(key), F.to_date(F.col("window.start")).alias("exchange_date"),
                            "exchange_rate", "num_observations"))


def score_stream(trades: DataFrame, model: PipelineModel) -> DataFrame:
    """Rule pre-filter (complete rows only) then ``model.transform``; no state is kept."""
    return model.transform(trades.na.drop("any"))
