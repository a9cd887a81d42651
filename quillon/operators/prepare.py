"""Labelled evaluation sets: reports joined to labels, filtered to core classes, split by cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.labels import CLASSES, LUNG_PROJECTS, cancer_type, norm_d, patient_key


def label_table(t: DataFrame, n: DataFrame, m: DataFrame, key: str = "case_submitter_id") -> DataFrame:
    """T left-joined to N and M, one row per case. Duplicate label rows are reduced first (the smallest
    label that is given), so they cannot multiply."""
    one = lambda df, c: df.groupBy(key).agg(F.min(c).alias(c))
    first = t.groupBy(key).agg(F.min("project_id").alias("project_id"), F.min("ajcc_pathologic_t").alias("ajcc_pathologic_t"))
    return first.join(one(n, "ajcc_pathologic_n"), key, "left").join(one(m, "ajcc_pathologic_m"), key, "left")


def gold(reports: DataFrame, labels: DataFrame, keep_noncore: bool = False) -> DataFrame:
    """Reports with normalised labels, the first report of each case; labels outside the core classes are dropped.

    Labels are normalised and filtered before the join, and the first report is chosen on names alone, so texts are moved once
    and only those that stay."""
    for s in "TNM":
        target = norm_d(F.col(f"ajcc_pathologic_{s.lower()}"), s)
        labels = labels.withColumn(f"{s.lower()}_target", target).withColumn(f"{s.lower()}_label", target)
        if not keep_noncore:
            labels = labels.where(F.col(f"{s.lower()}_target").isin(*CLASSES[s]))
    labels = labels.withColumn("cancer_type", cancer_type(F.col("project_id"))).drop("ajcc_pathologic_t", "ajcc_pathologic_n", "ajcc_pathologic_m")
    keyed = reports.select(patient_key(F.col("patient_filename")).alias("case_submitter_id"), F.col("text").alias("free_text"), "patient_filename")
    first = keyed.groupBy("case_submitter_id").agg(F.min("patient_filename").alias("patient_filename"))
    chosen = labels.join(first, "case_submitter_id")
    # A name that occurs twice holds two reports; the smaller text is the one that every run would keep.
    joined = chosen.join(keyed, ["case_submitter_id", "patient_filename"])
    columns = [c for c in joined.columns if c not in ("case_submitter_id", "patient_filename", "free_text")]
    once = joined.groupBy("case_submitter_id", *columns).agg(F.min("free_text").alias("free_text"))
    return once


def is_lung(project: str = "project_id"):
    """Null projects are not lung, and so belong to the complement."""
    return F.coalesce(F.col(project).isin(*LUNG_PROJECTS), F.lit(False))
