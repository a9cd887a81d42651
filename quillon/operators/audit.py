"""Aggregations of a corpus audit: rates, distributions, entropy with floors, missing and scarce cells, term density.

Every per-model loop of a notebook becomes a grouping key, so one scan with map-side partial aggregation serves all
models; results are as small as the keys. Null keys are left out, as the audited reports do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.labels import CLASSES, FLOORS


def rate(df: DataFrame, keys: list[str], flag: Column, digits: int = 1) -> DataFrame:
    """total (non-null flags), valid and the percentage by key."""
    kept = df.where(F.lit(True) if not keys else ~F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True))
    out = kept.groupBy(*keys).agg(F.count(flag).alias("total"), F.count_if(flag).alias("valid"))
    return out.withColumn("pct", F.bround(100.0 * F.col("valid") / F.col("total"), digits))


def distribution(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Natural-log entropy, classes and size by key from label counts; 0 for a single class."""
    # H = ln N - sum(n ln n) / N needs one aggregation and no window over the counts.
    out = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.count("*").alias("classes"))
    h = F.ln("total") - F.col("s") / F.col("total")
    return out.select(*keys, "total", "classes", F.round(F.when(F.col("classes") > 1, h).otherwise(F.lit(0.0)), digits).alias("entropy"))


def entropy_audit(df: DataFrame, model: str, dims: list[str], floors: dict[str, float] | None = None) -> DataFrame:
    """Entropy per model and over all models for each dimension, with its floor and a verdict. One pass: labels are
    unpivoted and the overall row comes from ROLLUP over the counts."""
    floors = floors or FLOORS["core"]
    long = df.select(model, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("label")) for d in dims])).alias("x")).select(model, "x.dim", "x.label")
    counts = long.where(F.col("label").isNotNull()).groupBy("dim", "label", model).agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.groupBy("dim", "label").agg(F.sum("n").alias("n")).withColumn(model, F.lit("ALL")))
    out = entropy(both, ["dim", model])
    floor = F.lit(0.0)
    for d, value in floors.items():
        floor = F.when(F.col("dim") == d.lower(), F.lit(value)).otherwise(floor)
    return out.withColumn("floor", floor).withColumn("passed", F.col("entropy") >= F.col("floor"))


def missing_and_scarce(df: DataFrame, label: str, dim: str) -> DataFrame:
    """Expected classes with their counts: missing at 0, scarce under half of an even share."""
    expected = df.sparkSession.createDataFrame([(c,) for c in CLASSES[dim]], T.StructType([T.StructField("label", T.StringType())]))
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(label).alias("total"))
    out = F.broadcast(expected).join(counts, "label", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select("label", n.alias("n"), (n == 0).alias("missing"), ((n > 0) & (n < F.col("total") / (2 * len(CLASSES[dim])))).alias("scarce"))


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label (the smallest on ties) and its share: what a constant classifier reaches."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    out = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), F.col(label).alias("label"))).alias("top"))
    return out.select(*keys, "total", F.col("top.label").alias("majority"), F.bround(-F.col("top.neg") / F.col("total"), 3).alias("share"))


def density_summary(df: DataFrame, keys: list[str], hits: Column, words: Column) -> DataFrame:
    """Mean of hits, words and hits per 100 words (the mean of ratios) by key."""
    kept = df.where(~F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True)).select(*keys, hits.alias("h"), words.alias("w"))
    return kept.groupBy(*keys).agg(
        F.round(F.avg("h"), 6).alias("avg_terms"), F.round(F.avg("w"), 6).alias("avg_words"),
        F.round(F.avg(100.0 * F.col("h") / F.greatest("w", F.lit(1))), 6).alias("avg_density"),
    )


def density_by(df: DataFrame, flag: str, density: str) -> DataFrame:
    """Mean, median and number of densities by a flag; null counts as false, a table without the flag gives no rows."""
    if flag not in df.columns:
        return df.sparkSession.createDataFrame([], "flag boolean, mean double, median double, n long")
    rows = df.groupBy(F.coalesce(F.col(flag), F.lit(False)).alias("flag"))
    return rows.agg(F.round(F.avg(density), 6).alias("mean"), F.round(F.median(density), 6).alias("median"), F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def abort_below_floor(audit: DataFrame) -> None:
    """Raises if any dimension of an audit misses its floor; the audit has a row per model and dimension."""
    bad = audit.where(~F.col("passed")).limit(1).collect()
    if bad:
        raise ValueError(f"entropy of {bad[0]['dim']} is below its floor")
