"""File sources and sinks: parquet, CSV, JSON, and the split tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "val", "test")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan; partition directories become columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV scan with a header and a stated schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def read_table(spark: SparkSession, parquet_path: str, csv_path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet if it is there, else the CSV."""
    try:
        return read_parquet(spark, parquet_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_csv(spark, csv_path, schema)


def read_json_events(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_partitioned(df: DataFrame, path: str, by: str | list[str]) -> None:
    """Partitioned parquet, replacing what is there.

    Rows go to the writers as they lie: shuffling by the partition column would
    send a big partition through one task.
    """
    by = [by] if isinstance(by, str) else list(by)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_features(df: DataFrame, parquet_path: str, csv_path: str | None = None) -> None:
    df.write.mode("overwrite").parquet(parquet_path)
    if csv_path:
        write_csv(df, csv_path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns, which CSV cannot hold, are dropped."""
    nested = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df.drop(*nested).write.mode("overwrite").option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nested columns kept."""
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Features and labels of all splits as one table, one directory per split."""
    write_partitioned(df, path, split)


def load_split(spark: SparkSession, path: str, split: str, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Features and labels of one split."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, got {split!r}")
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no split table at {path}; write it with write_splits") from e
    rows = df.where(F.col("split") == split).drop("split")
    return rows.drop(label), rows.select(label)


def load_all_splits(spark: SparkSession, path: str, label: str = "label") -> dict[str, tuple[DataFrame, DataFrame]]:
    return {s: load_split(spark, path, s, label) for s in SPLITS}
