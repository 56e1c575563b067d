"""Quality flags of columns and datasets, as arrays of (type, severity, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of the flags.
INCOMPLETE, TOP1, OUTLIERS, LEAST_ROWS, LEAST_COLUMNS = 0.95, 0.95, 0.30, 20, 2
UNUSABLE = ["textual", "array", "other"]


def _flag(when, kind: str, severity: str, message: str):
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def column_flags(profile: DataFrame) -> DataFrame:
    """profile (row_count, null_count, unique_count, top_freq, outliers, main_type, secondary_type) with ``flags``."""
    some = F.col("row_count") - F.col("null_count")
    return profile.withColumn("flags", F.array_compact(F.array(
        _flag((F.col("row_count") > 0) & (some == 0), "all_null", "warning", "every value is missing"),
        _flag(F.col("null_count") / F.col("row_count") > INCOMPLETE, "high_incompleteness", "warning", "most values are missing"),
        _flag((some > 0) & (F.col("top_freq") / some > TOP1), "high_top1_coverage", "warning", "one value covers nearly all rows"),
        _flag((F.col("main_type") == "numeric") & (some >= 4) & (F.col("outliers") / F.col("row_count") > OUTLIERS), "high_outliers", "warning", "many values lie far outside the middle half"),
        _flag(F.col("secondary_type").isin(UNUSABLE), "unusable_type", "warning", "prose, lists and unknown types cannot be joined"),
    )))


def dataset_flags(profile: DataFrame) -> DataFrame:
    """dataset, row_count, column_count, flags, from flagged columns (dataset, row_count, flags)."""
    held = profile.groupBy("dataset").agg(F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"), F.count_if(F.size("flags") == 0).alias("valid"))
    return held.select("dataset", "row_count", "column_count", F.array_compact(F.array(
        _flag(F.col("column_count") < LEAST_COLUMNS, "too_few_columns", "warning", "fewer than two columns"),
        _flag(F.col("row_count") < LEAST_ROWS, "too_few_rows", "warning", "fewer than twenty rows"),
        _flag(F.col("valid") < LEAST_COLUMNS, "too_few_valid_columns", "warning", "fewer than two columns without a flag"),
    )).alias("flags"))
