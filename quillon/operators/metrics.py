"""Evaluation metrics from (keys..., target, pred) rows: one confusion aggregate, everything else on its few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, keys: list[str], target: str, pred: str) -> DataFrame:
    return df.where(F.col(target).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys, F.col(target).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def per_label(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Support, predicted, hits and precision, recall, F1 of each label of truth or prediction; 0 on zero division."""
    sides = conf.select(*keys, F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )).alias("x")).select(*keys, "x.*")
    out = sides.groupBy(*keys, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumn("precision", share("hits", "predicted")).withColumn("recall", share("hits", "support"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def scores(conf: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, constant-classifier accuracy, macro and weighted scores. Macro and weighted scores are null and noted
    `single_class_gt` where the truth has at most one class that is not unknown."""
    labels = per_label(conf, keys)
    real = F.when((F.col("support") > 0) & ~F.upper("label").contains("UNKNOWN"), F.col("label"))
    out = labels.groupBy(*keys).agg(
        F.sum("support").alias("n"), F.sum("hits").alias("ok"), F.max("support").alias("top"), F.count_distinct(real).alias("classes"), F.avg("precision").alias("mp"),
        F.avg("recall").alias("mr"), F.avg("f1").alias("mf"), F.sum(F.col("f1") * F.col("support")).alias("wf"),
    )
    single = F.col("classes") <= 1
    multi = lambda c: F.when(~single, F.round(c, 6))
    return out.select(
        *keys, "n", F.round(F.col("ok") / F.col("n"), 6).alias("accuracy"), F.round(F.col("top") / F.col("n"), 6).alias("constant_acc"), multi(F.col("mp")).alias("macro_precision"),
        multi(F.col("mr")).alias("macro_recall"), multi(F.col("mf")).alias("macro_f1"), multi(F.col("wf") / F.col("n")).alias("weighted_f1"),
        F.when(single, F.lit("single_class_gt")).otherwise(F.lit("")).alias("note"),
    )


def stages(df: DataFrame, keys: list[str]) -> DataFrame:
    """T, N and M as rows (stage, target, pred), each where its truth is given: T by itself, N and M only together. Null
    counts as given, as a missing value is not the text UNKNOWN."""
    unknown = lambda c: F.coalesce(F.upper(c).contains("UNKNOWN"), F.lit(False))
    nm = ~unknown("n_target") & ~unknown("m_target")
    rows = F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(f"{s.lower()}_target").alias("target"), F.col(f"{s.lower()}_pred").alias("pred"), (~unknown("t_target") if s == "T" else nm).alias("given"))
        for s in "TNM"
    ])
    return df.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*").where("given").drop("given")


def with_missing_stages(found: DataFrame, expected: list[str]) -> DataFrame:
    """A row with n = 0 and note `no_valid_gt` for each expected stage that has no valid truth."""
    names = found.sparkSession.createDataFrame([(s,) for s in expected], "stage string")
    out = F.broadcast(names).join(found, "stage", "left")
    return out.withColumn("note", F.when(F.col("n").isNull(), F.lit("no_valid_gt")).otherwise(F.col("note"))).withColumn("n", F.coalesce("n", F.lit(0)))


def all_three(prefix_a: str = "target", prefix_b: str = "pred") -> Column:
    same = [F.col(f"{s}_{prefix_a}") == F.col(f"{s}_{prefix_b}") for s in "tnm"]
    return F.coalesce(same[0] & same[1] & same[2], F.lit(False))
