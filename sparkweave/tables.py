"""Access to the Parquet tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table; zone-less timestamps are read as TIMESTAMP in the session's zone, by the scan itself, so filters on them reach it."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if not any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema.fields):
        return df
    fields = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in df.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)
