"""Test statistics and intervals: closed forms as expressions, p-values on the few aggregated rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500 + 10 * math.isqrt(int(a + b))):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Survival function of chi-squared; null without degrees of freedom."""
    return pd.Series([None if pd.isna(s) or pd.isna(k) or k < 1 else _gamma_q(k / 2, s / 2) for s, k in zip(stat, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([None if pd.isna(s) or pd.isna(k) or k < 1 else _beta_i(k / 2, 0.5, k / (k + s * s)) for s, k in zip(stat, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def chi2_uniform(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Goodness of fit against an even spread over the observed labels. With m = n/k: sum (o-m)^2/m = k sum o^2 / n - n."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("c"))
    out = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    stat = F.col("k") * F.col("s2") / F.col("n") - F.col("n")
    return out.select(*keys, "n", "k", F.round(stat, 6).alias("chi2"), (F.col("k") - 1).alias("df"))


def yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-squared of a 2x2 table with Yates' correction, null with an empty margin."""
    n = a + b + c + d
    parts = []
    for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        e = r * k / n
        gap = F.abs(o - e)
        parts.append(F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2)) / e)
    margins = (a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0)
    return F.when(margins, parts[0] + parts[1] + parts[2] + parts[3])


def two_by_two(df: DataFrame, keys: list[str], row: Column, col: Column) -> DataFrame:
    """Counts of the four cells, the corrected statistic and Cramer's V by key."""
    out = df.groupBy(*keys).agg(
        F.count_if(row & col).alias("a"), F.count_if(row & ~col).alias("b"), F.count_if(~row & col).alias("c"), F.count_if(~row & ~col).alias("d")
    )
    stat = yates(*[F.col(x).cast("double") for x in "abcd"])
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return out.select(*keys, *"abcd", F.round(stat, 6).alias("chi2"), F.round(F.coalesce(F.sqrt(stat / n), F.lit(0.0)), 6).alias("cramers_v"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; null for n = 0."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(centre - half, F.lit(0.0))), F.when(n > 0, F.least(centre + half, F.lit(1.0)))


def _binomial_quantile(n: int, p: float, q: float) -> int:
    """The smallest k with P(X <= k) >= q, found by halving: the sum of the first terms is an incomplete beta function."""
    if p <= 0 or p >= 1:
        return n if p >= 1 else 0
    low, high = 0, n
    while low < high:
        k = (low + high) // 2
        if _beta_i(n - k, k + 1, 1 - p) >= q:
            high = k
        else:
            low = k + 1
    return low


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def bootstrap_ci(successes: pd.Series, n: pd.Series) -> pd.DataFrame:
    """95 % percentile bootstrap interval of an accuracy. Resampled accuracies are binomial, so the limit of the resampling is
    the binomial's quantiles, taken exactly."""
    rows = []
    for s, size in zip(successes, n):
        if not size:
            rows.append((None, None))
            continue
        rows.append(tuple(_binomial_quantile(int(size), s / size, q) / size for q in (0.025, 0.975)))
    return pd.DataFrame(rows, columns=["low", "high"])


def point_biserial(df: DataFrame, keys: list[str], x: Column, flag: Column) -> DataFrame:
    """Pearson r of a number with a flag; null unless both vary."""
    out = df.select(*keys, x.cast("double").alias("x"), flag.cast("double").alias("y")).where("x is not null and y is not null")
    got = out.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return got.select(*keys, "n", F.round(F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("r")), 6).alias("r"))


def mann_whitney(df: DataFrame, value: Column, group: Column) -> DataFrame:
    """U of the rows with the flag against the others, average ranks on ties, with the tie-corrected normal deviate.

    Ranks come from running counts over the distinct values, so what is ordered in one place is as small as they are."""
    rows = df.select(value.alias("v"), group.alias("g")).where("v is not null and g is not null")
    counts = rows.groupBy("v").agg(F.count("*").alias("n"), F.count_if("g").alias("n1"))
    totals = counts.agg(F.sum("n").alias("total"), F.sum("n1").alias("ones"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    # Prefix sums by range: values fall into cells of an approximate quantile grid, cells are summed, cells' offsets are broadcast.
    grid = counts.agg(F.percentile_approx("v", F.array(*[F.lit(k / 64) for k in range(1, 64)]), F.lit(4096)).alias("grid"))
    placed = counts.crossJoin(F.broadcast(grid)).withColumn("part", F.size(F.filter("grid", lambda q: q < F.col("v")))).drop("grid")
    sums = placed.groupBy("part").agg(F.sum("n").alias("s"))
    low, high = sums.select(F.col("part").alias("p1")), sums.select(F.col("part").alias("p2"), "s")
    offsets = F.broadcast(low.join(F.broadcast(high), F.col("p2") < F.col("p1"), "left").groupBy("p1").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("before")))
    from pyspark.sql import Window

    inner = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("upto", F.sum("n").over(inner)).join(offsets, F.col("part") == F.col("p1"))
    rank = F.col("before") + F.col("upto") - (F.col("n") - 1) / 2
    got = ranked.agg(F.sum(rank * F.col("n1")).alias("r1")).crossJoin(totals)
    n1, n2, total = F.col("ones"), F.col("total") - F.col("ones"), F.col("total")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((total + 1) - F.col("ties") / (total * (total - 1)))
    return got.select(n1.alias("n1"), n2.alias("n2"), F.round(u, 3).alias("u"), F.round((u - n1 * n2 / 2) / F.sqrt(var), 6).alias("z"))
