"""Session helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import Stages, shared_dir  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo folds; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


#: A side of a join is broadcast up to this many bytes, counted before; beyond it Spark shuffles.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df
