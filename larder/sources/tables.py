"""Results written once in the shared folder, where they are read several times."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larder.streaming.operators import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, which cuts the lineage and outlives executors; it goes when the application ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
