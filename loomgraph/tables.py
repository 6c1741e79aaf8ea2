"""Reading the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "modules external_symbols files nodes edges file_changes mix_targets pack_capacity"
).split()


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table; with columns named, only those are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views, so that SQL text can be run over a folder."""
    for name in names or NAMES:
        table(spark, folder, name).createOrReplaceTempView(name)


def blank_to_null(column: str):
    """'' and null mean the same in the reference columns of this model."""
    return F.when(F.col(column) != "", F.col(column))


def current_rows(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The row with the highest ``order`` of each key (last write wins).

    A combinable aggregate, so duplicates collapse before the shuffle and a hot
    key costs no more than any other. Rows without a key are left out; ties in
    ``order`` are broken by the remaining columns.
    """
    packed = F.max(F.struct(F.col(order), *[F.col(c) for c in columns])).alias("_last")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(packed)
        .select(key, *[F.col("_last")[c].alias(c) for c in columns])
    )
