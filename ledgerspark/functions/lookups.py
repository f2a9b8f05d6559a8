"""Fixed lookup tables of the reference and helpers to use them as broadcast lookups.

The dictionaries below are fixed values that must equal the reference's for the
same results on its data; they are literal, bounded (10, 10 and 26 rows) and
therefore always safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (reference dictionaries, natural order) -------------------
PRODUCT_NAME_TO_GROUP = {
    "CRS-Vanilla": "CIRS",
    "Deal Related Payment": "Miscellaneous Payments",
    "FX Forwards": "FX TRADES",
    "FX NDFs": "FX TRADES",
    "FX Options": "FX DERIV",
    "FX Spots": "FX TRADES",
    "FX Swaps": "FX TRADES",
    "IRS-ON Index Swap": "IRS",
    "IRS-Vanilla": "IRS",
    "Swaptions": "Swaptions",
}

PRODUCT_NAME_TO_TYPE = {
    "CRS-Vanilla": "other",
    "Deal Related Payment": "other",
    "FX Forwards": "fx_forwards",
    "FX NDFs": "fx_other",
    "FX Options": "fx_other",
    "FX Spots": "fx_spots",
    "FX Swaps": "fx_swaps",
    "IRS-ON Index Swap": "irs",
    "IRS-Vanilla": "irs",
    "Swaptions": "other",
}

CURRENCY_TO_REDUCED = {
    "AED": "AED",
    "AUD": "AUD",
    "BRL": "other",
    "CAD": "CAD",
    "CHF": "other",
    "CNH": "other",
    "CZK": "other",
    "DKK": "DKK",
    "EUR": "EUR",
    "HKD": "other",
    "HUF": "other",
    "ILS": "other",
    "INR": "other",
    "JPY": "JPY",
    "MAD": "other",
    "MXN": "MXN",
    "NOK": "other",
    "NZD": "NZD",
    "PLN": "PLN",
    "RUB": "other",
    "SEK": "SEK",
    "SGD": "other",
    "THB": "other",
    "TRY": "other",
    "USD": "USD",
    "ZAR": "ZAR",
}
# -----------------------------------------------------------------------------


def lookup_frame(spark: SparkSession, mapping: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A dict as a two-column DataFrame (key, value)."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(value, T.StringType())])
    return spark.createDataFrame(list(mapping.items()), schema)


def map_lookup(col: str | Column, mapping: Mapping[str, str]) -> Column:
    """``dict.get(col)`` as an in-expression literal map (unmatched -> NULL)."""
    c = F.col(f"`{col}`") if isinstance(col, str) else col
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, c)
