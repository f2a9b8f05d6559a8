"""Typed readers (S1-S4). Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("trans_date", T.DateType()),
    T.StructField("currency", T.StringType()),
])

RATES_SCHEMA = T.StructType([
    T.StructField("exchange_date", T.DateType()),
    T.StructField("currency", T.StringType()),
    T.StructField("exchange_rate", T.DoubleType()),
])

# the 13 raw trade fields; the date stays text until it is parsed with its format
TRADES_SCHEMA = T.StructType([
    T.StructField("Trade Date", T.StringType()),
    T.StructField("Source System", T.StringType()),
    T.StructField("Leg Type", T.StringType()),
    T.StructField("Product Name", T.StringType()),
    T.StructField("Product Group", T.StringType()),
    T.StructField("Notional Amount Currency", T.StringType()),
    T.StructField("Notional Amount", T.DoubleType()),
    T.StructField("Fx_rate", T.DoubleType()),
    T.StructField("Gbp Notional Amount", T.DoubleType()),
    T.StructField("CountryCodeOffice", T.StringType()),
    T.StructField("ML Risk Rating", T.StringType()),
    T.StructField("Client Name", T.StringType()),
    T.StructField("Flag", T.IntegerType()),
])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|",
                   header: bool = True, mode: str = "FAILFAST", columns: list[str] | None = None,
                   date_format: str | None = None) -> DataFrame:
    """Delimited file into a declared table (S1; S2 with ``columns``, S3 with ``sep=','``).

    Empty fields become NULL; a malformed row fails the job (``mode="FAILFAST"``) or
    becomes NULLs (``"PERMISSIVE"``). Files are split across tasks by the reader.
    """
    reader = (spark.read.schema(schema).option("sep", sep).option("header", header)
              .option("mode", mode).option("nullValue", ""))
    if date_format:
        reader = reader.option("dateFormat", date_format)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, TRANSACTIONS_SCHEMA)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, RATES_SCHEMA)


def read_trades(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return read_delimited(spark, path, TRADES_SCHEMA, sep=",", mode=mode)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """S4. Column pruning and filter pushdown reach the scan through Catalyst."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """What tells one state of some tables from another: their files, with size and time of writing."""
    rows = []
    for n in names:
        rows += table(spark, sf_dir, n).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    return tuple(sorted(map(tuple, rows)))
