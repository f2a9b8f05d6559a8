"""ledgerspark: Spark-native rate imputation, data quality, trade profiling and
suspicious-trade modelling. Every operator is a DataFrame -> DataFrame function."""

from ledgerspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
