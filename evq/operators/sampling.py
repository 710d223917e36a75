"""Seeded samples and splits by a hash of the row key: the same rows however the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq import config
from evq.functions.keys import hash_digits, hash_unit, in_fraction


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = config.RANDOM_STATE) -> DataFrame:
    return df.filter(in_fraction(key, fraction, seed))


def sample_n_per_class(
    df: DataFrame, n: int, key: str, label: str = "label", seed: int = config.RANDOM_STATE
) -> DataFrame:
    """The ``n`` signal and ``n`` background events with the smallest hash (ties: the smaller key).

    One scan counts the rows of each class in 65,536 hash buckets; a running sum finds the bucket with the n-th row.
    A second scan keeps the rows up to that bucket and ranks them inside their bucket, so no task holds n rows; the
    rank matters in the last bucket only. The key is hashed once per row and scan.
    """
    rows = df.filter(F.col(label).isin(0, 1)).withColumn("_digits", hash_digits(key, seed))
    rows = rows.withColumn("_bucket", F.substring("_digits", 1, 4))
    so_far = Window.partitionBy(label).orderBy("_bucket")
    counted = rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    reached = counted.withColumn("_before", F.sum("_n").over(so_far) - F.col("_n")).filter(F.col("_before") < n)
    edges = reached.groupBy(F.col(label).alias("_class")).agg(F.max("_bucket").alias("_edge"), F.max("_before").alias("_before"))
    near = (F.col(label) == F.col("_class")) & (F.col("_bucket") <= F.col("_edge"))
    placed = rows.join(F.broadcast(edges), near)  # two rows
    rank = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_digits", key))
    kept = placed.withColumn("_rank", rank).filter((F.col("_bucket") < F.col("_edge")) | (F.col("_rank") <= n - F.col("_before")))
    return kept.select(*df.columns)


def split_label(
    key: Column | str, test_size: float, seed: int = config.RANDOM_STATE, validation_size: float = 0.0
) -> Column:
    """``test``, ``train`` or, for a further share of the training rows, ``valid``."""
    train = F.lit("train")
    if validation_size:
        train = F.when(in_fraction(key, validation_size, f"{seed}:valid"), F.lit("valid")).otherwise(train)
    return F.when(in_fraction(key, test_size, seed), F.lit("test")).otherwise(train)


def train_test_split(
    df: DataFrame,
    key: str,
    test_size: float = 0.4,
    seed: int = config.RANDOM_STATE,
    validation_size: float = 0.0,
) -> DataFrame:
    return df.withColumn("split", split_label(key, test_size, seed, validation_size))


def kfold_assign(df: DataFrame, key: str, k: int = 3, seed: int = config.RANDOM_STATE) -> DataFrame:
    return df.withColumn("fold", (hash_unit(key, seed) % k).cast("int"))
