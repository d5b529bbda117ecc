"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """The table, or only its named columns, so that the scan reads no other."""
    df = spark.read.parquet(os.path.join(folder, f"{table}.parquet"))
    return df.select(*columns) if columns else df
