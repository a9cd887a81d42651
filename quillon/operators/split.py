"""Deterministic samples, splits, derangements and keyed deduplication.

Order comes from a hash of the row key and a seed, so results do not depend on partitions and any engine can repeat them.
Global ranks are made in two steps (counts by hash cell, then ranks inside cells), never by one unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of the order hash that name a cell: 4,096 cells, so a task ranks a four-thousandth of the table at a time.
CELL_DIGITS = 3


def order_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def global_rank(df: DataFrame, key: str, seed: int, name: str = "rank") -> DataFrame:
    """Rank from 1 in hash order over the whole table, and `total`. Cells are hash ranges of even size, so no task sees
    more than its share; their offsets are one row per cell."""
    rows = df.withColumn("_h", order_hash(F.col(key), seed)).withColumn("_cell", F.substring("_h", 1, CELL_DIGITS))
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    over = Window.orderBy("_cell")
    # At most 16 ** CELL_DIGITS rows reach this window.
    offsets = sizes.select("_cell", (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inner = Window.partitionBy("_cell").orderBy("_h", key)
    ranked = rows.join(F.broadcast(offsets), "_cell").withColumn(name, F.col("_before") + F.row_number().over(inner))
    return ranked.drop("_h", "_cell", "_before")


def train_heldout(df: DataFrame, key: str, seed: int = 42, share: float = 0.8) -> DataFrame:
    """`split` is train for the first floor(share * n) rows in hash order, heldout for the rest."""
    ranked = global_rank(df, key, seed)
    return ranked.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("total") * share), F.lit("train")).otherwise(F.lit("heldout"))).drop("total")


def sample_k(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The k first rows in hash order: each task keeps its own k, the driver-side merge sees k per task."""
    return df.orderBy(order_hash(F.col(key), seed), key).limit(k)


def derangement(df: DataFrame, key: str, labels: list[str], seed: int = 42) -> DataFrame:
    """Each row gets the labels of the next row in hash order, the last those of the first: no row keeps its place for
    n >= 2. A join on rank, not a window over the table."""
    ranked = global_rank(df.select(key, *labels), key, seed)
    moved = ranked.select((F.pmod(F.col("rank") - 2, F.col("total")) + 1).alias("rank"), *[F.col(x).alias(f"{x}_new") for x in labels])
    return ranked.join(moved, "rank").select(key, *labels, *[f"{x}_new" for x in labels])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order. An aggregate with map-side combine, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def without_done(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that is not in the checkpoint table."""
    return plan.join(done.select(key).distinct(), key, "left_anti")
