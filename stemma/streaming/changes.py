"""The change log as a stream: derived rows are kept current batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def changed_keys(spark: SparkSession, path: str, schema: str, key: str = "row_id") -> DataFrame:
    """The stream of keys whose rows changed, from log files that arrive under path."""
    return spark.readStream.schema(schema).parquet(path).select(key).where(f"{key} is not null")


def keep_current(keys: DataFrame, derive: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Run derive on each batch's distinct keys and append the result, marked with the batch, to target; a batch that runs again replaces its own rows. Returns the started query, which ends when all that is there has been read."""

    def batch(df: DataFrame, number: int) -> None:
        derive(df.distinct()).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return keys.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
