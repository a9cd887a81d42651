"""Exact nearest neighbours by blocked matrix products.

Few queries are sent to the workers, many are shuffled in blocks of bounded size; every corpus batch or block is scored against
a block of queries by one matrix product and keeps its k best per query, so all pairs are never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_id long, vec_id long, similarity double"


def normalised(v: str):
    """The vector at unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _matrix(column) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(ids: np.ndarray, q: np.ndarray, own: np.ndarray, corpus: np.ndarray, k: int, skip_same_id: bool) -> pd.DataFrame:
    """The k best of a corpus block for each query, with everything that ties with the k-th, for the rule on ties."""
    sim = q @ corpus.T
    if skip_same_id:
        sim[ids[:, None] == own[None, :]] = -2.0
    keep = min(k, sim.shape[1])
    if keep < sim.shape[1]:
        bar = -np.partition(-sim, keep - 1, axis=1)[:, keep - 1]
        r, c = np.nonzero(sim >= bar[:, None] - 1e-12)
    else:
        r, c = np.nonzero(sim > -1.5)
    out = pd.DataFrame({"query_id": ids[r], "vec_id": own[c], "similarity": sim[r, c]})
    return out[out["similarity"] > -1.5]


def top_k(corpus: DataFrame, queries: DataFrame, k: int, block: int = 20_000, skip_same_id: bool = False, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar rows of the corpus for each query, ties by id. Null vectors are left out on both sides.

    Up to `block` queries are sent to the workers and the corpus is scanned once. More are compared block against block: both
    sides are shuffled in blocks of about `block` rows, each pair of blocks is one task, and no vector passes through the driver."""
    spark = corpus.sparkSession
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    many = asked.count()
    if many <= block:
        got = asked.toPandas()
        if not len(got):
            return spark.createDataFrame([], OUT + ", rank int")
        sent = spark.sparkContext.broadcast((got["vec_id"].to_numpy(), _matrix(got["v"])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield _best(*sent.value, batch["vec_id"].to_numpy(), _matrix(batch["v"]), k, skip_same_id)

        both = rows.mapInPandas(run, OUT)
    else:
        left, right = -(-many // block), max(1, -(-rows.count() // block))
        own = lambda n, name: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name)
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        ask, held = asked.select("*", own(left, "a"), every(right, "b")), rows.select("*", own(right, "b"), every(left, "a"))

        def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(c):
                return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []}).astype({"query_id": "int64", "vec_id": "int64"})
            return _best(q["vec_id"].to_numpy(), _matrix(q["v"]), c["vec_id"].to_numpy(), _matrix(c["v"]), k, skip_same_id)

        both = ask.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInPandas(pair, OUT)
    best = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "vec_id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_distance(corpus: DataFrame, **options) -> DataFrame:
    """1 - similarity to the nearest other row, per row (the diversity distance)."""
    return top_k(corpus, corpus, 1, skip_same_id=True, **options).select(F.col("query_id").alias("vec_id"), (1 - F.col("similarity")).alias("distance"))


def diversity(distances: DataFrame, collapse: float = 0.01) -> DataFrame:
    """Mean, deviation, 5th and 95th percentile and minimum of the distances, with a mode-collapse alert."""
    pct = F.percentile("distance", F.array(F.lit(0.05), F.lit(0.95)))
    return distances.agg(
        F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean"), F.round(F.stddev_pop("distance"), 6).alias("sd"), F.round(pct[0], 6).alias("p5"), F.round(pct[1], 6).alias("p95"),
        F.round(F.min("distance"), 6).alias("least"), (F.min("distance") < collapse).alias("collapsed"),
    )


def texts_of(hits: DataFrame, store: DataFrame, text: str = "text", vec_id: str = "vec_id") -> DataFrame:
    """Texts of the retrieved ids by query, best first, with a blank line between; unknown ids are dropped."""
    found = hits.join(store.select(F.col(vec_id).alias("vec_id"), F.col(text).alias("text")), "vec_id")
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return found.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))
