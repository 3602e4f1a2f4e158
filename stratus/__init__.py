"""stratus: Spark-native analytics for timestamped station observations.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, windows, aggregates and MLlib estimators.  Nothing is collected to the
driver except schema metadata and single-row statistics.
"""

from stratus.session import checkpoint_dir, get_spark

__all__ = ["checkpoint_dir", "get_spark"]
