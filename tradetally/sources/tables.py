"""Access to the driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Read-only inputs: a lookup of the schema costs a footer read.
_SCHEMAS: dict[tuple[str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up once per application and path."""
    path = os.path.abspath(os.path.join(sf_dir, f"{name}.parquet"))
    key = (spark.sparkContext.applicationId, path)
    schema = _SCHEMAS.get(key)
    df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    if schema is None:
        _SCHEMAS[key] = df.schema
    return df
