"""CSV, Parquet and JSON tables, the forecast store, and a column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns kept of the daily history.
DAILY_COLUMNS = ["Date", "Open", "High", "Low", "Close", "Volume", "Fees"]


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema; an empty field is null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_daily_history(
    spark: SparkSession, path: str, schema: str, date_col: str, keep: list[str]
) -> DataFrame:
    """Daily table: text instant -> date without zone, projected to the wanted columns."""
    raw = spark.read.schema(schema).option("header", True).csv(path)
    day = F.to_date(F.substring(F.col(date_col), 1, 10))
    return raw.withColumn(date_col, day).select(*keep)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return path


def write_params(df: DataFrame, path: str) -> str:
    """Parameter sets as one JSON object per line."""
    df.write.mode("overwrite").json(path)
    return path


def read_params(spark: SparkSession, path: str, strip: str = "estimator__") -> DataFrame:
    """Parameter sets as rows with a ``params`` map whose keys lost the ``strip`` prefix."""
    raw = spark.read.text(path)
    parsed = F.from_json("value", "map<string,string>")
    return raw.select(
        F.transform_keys(parsed, lambda k, _: F.regexp_replace(k, f"^{strip}", "")).alias("params")
    )


def save_forecasts(df: DataFrame, path: str) -> str:
    """All models' forecasts in one table, one partition per model."""
    return write_parquet(df, path, "model")


def profile(df: DataFrame) -> DataFrame:
    """Rows, non-null count and type of every column in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns]
    )
    long = counts.unpivot(["_rows"], df.columns, "column", "non_null")
    types = F.create_map(*[F.lit(x) for kv in df.dtypes for x in kv])
    return long.select(
        "column",
        F.element_at(types, F.col("column")).alias("dtype"),
        F.col("_rows").alias("n_rows"),
        "non_null",
    )
