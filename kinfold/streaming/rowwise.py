"""The row-wise operators on streams.

Parsing, class mapping, reject reasons, sequence windows and vector arithmetic are
plain column expressions, so they need no state and run on a streaming frame as
they are. Nothing else here streams: splits, metrics and inference need whole tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions.notation import parse_substitution, windowed_pair
from kinfold.operators.cleaning import waterfall


def read_stream(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def annotate(df: DataFrame, rules: Mapping[str, Column], *, change: str | None = None, sequence: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Reject reasons, and on request the parsed substitution and the windowed pair, for batch or stream."""
    out = waterfall(df, rules)
    if change:
        out = out.withColumn("parsed", parse_substitution(change))
    if sequence:
        out = out.withColumn("pair", windowed_pair(*sequence))
    return out


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder; the file sink and its checkpoint make reruns exactly-once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
