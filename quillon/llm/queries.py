"""The queries of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import canon, encode, endings, leaks, near, pages, pii, reading
from quillon.session import table


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endings.judge(table(spark, sf_dir, "master_results"), "line_no", "model", "raw_output")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("cut").select(F.col("row_id").alias("line_no"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut rows per model, of its rows with a raw_output; rows and models without any are not counted."""
    return _judged(spark, sf_dir).groupBy(F.col("source").alias("model")).agg(
        F.count("*").alias("n"), F.count_if("cut").alias("cut_rows"), (F.count_if("cut") / F.count("*")).alias("share")
    )


#: Tables of problem 4 by group number.
RUN_TABLES = ("master_results", "train_split")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("raw_output", "free_text")
    parts = [
        table(spark, sf_dir, name).select(F.lit(k).alias("grp"), "run_id", F.col(text).alias("text"))
        for k, (name, text) in enumerate(zip(RUN_TABLES, texts))
    ]
    return parts[0].unionByName(parts[1])


def _named() -> Column:
    return F.element_at(F.array(*map(F.lit, RUN_TABLES)), F.col("grp") + 1).alias("tbl")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near.pairs_of_rows(_runs(spark, sf_dir), "run_id")
    return pairs.select(_named(), F.col("id_a").alias("run_a"), F.col("id_b").alias("run_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with the class of its text and the number of texts linked to it."""
    return near.classes_of_rows(_runs(spark, sf_dir), ["run_id"]).select(_named(), "run_id", "class", "links")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "tcga_lung_gold"), "gold_id", "free_text").select(F.col("row_id").alias("gold_id"), "kind", "start_at")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report with typed placeholders in place of personal data."""
    return pii.redact(table(spark, sf_dir, "tcga_lung_gold"), "gold_id", "free_text").withColumnRenamed("row_id", "gold_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.find(table(spark, sf_dir, "tcga_lung_gold"), "gold_id", "free_text").withColumnRenamed("row_id", "gold_id")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report as continuous paragraphs."""
    return pages.repaired(table(spark, sf_dir, "tcga_lung_gold"), "gold_id", "free_text").withColumnRenamed("row_id", "gold_id")


def p7_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value with its entry and score."""
    labels = table(spark, sf_dir, "flat_labels")
    histology = canon.map_values(
        labels, "line_no", "histology_name", table(spark, sf_dir, "histology_ref"), ["histology_name", "short_form"], canon.histology_forms
    )
    stage = canon.map_values(labels, "line_no", "stage_group", table(spark, sf_dir, "stage_ref"), ["stage_group"], canon.stage_forms, threshold=0.99)
    return histology.withColumn("field", F.lit("histology_name")).unionByName(stage.withColumn("field", F.lit("stage_group")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_mapped(spark, sf_dir).select(F.col("id").alias("line_no"), "field", "ref_code")


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the values that no entry fits, and how often each was typed."""
    return p7_mapped(spark, sf_dir).where(F.col("ref_code") == canon.UNMATCHED).groupBy("field", "value").agg(F.count("*").alias("n"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_eval"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p4_found": p4_found, "p4_classes": p4_classes, "p10_found": p10_found, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_found": p7_found, "p7_unmatched": p7_unmatched, "p8_ids": p8_ids, "p9_found": p9_found}

_SQL_GRAMS = r"select distinct {id}, array_to_string(w[i:i+11],' ') g from (select {id}, w, unnest(range(1, len(w)-10)) i from (select {id}, regexp_extract_all(lower({text}),'[\p{{L}}\p{{N}}]+') w from {table}) where len(w)>=12)"
_SQL_RUNS = "select 'master_results' tbl, run_id, raw_output txt from master_results union all select 'train_split', run_id, free_text from train_split"
#: All pairs by the definition: similarity of the sets of three-word sequences, texts of the same words included.
_SQL_NEAR = f"""with r as (select distinct * from ({_SQL_RUNS}) where run_id is not null and txt is not null),
 d as (select tbl, txt, regexp_extract_all(lower(txt), '[a-z0-9]+') w, row_number() over () id from (select distinct tbl, txt from r)),
 g as (select distinct id, tbl, w[i]||' '||w[i+1]||' '||w[i+2] s from (select id, tbl, w, unnest(range(1, len(w)-1)) i from d where len(w) >= 20)),
 n as (select id, count(*) n from g group by id),
 x as (select a.id a, b.id b, count(*) x from g a join g b on a.s = b.s and a.tbl = b.tbl and a.id <= b.id group by all),
 l as (select a, b from x join n na on na.id = a join n nb on nb.id = b where 2*x >= na.n + nb.n - x),
 m as (select id, d.tbl, run_id from d join r using (tbl, txt))
 select distinct p.tbl, least(p.run_id, q.run_id) run_a, greatest(p.run_id, q.run_id) run_b from l join m p on p.id = a join m q on q.id = b where p.run_id <> q.run_id"""
ORACLES: dict[str, str] = {
    "p4_found": _SQL_NEAR,
    "p9_found": f"with d as ({_SQL_GRAMS.format(id='doc_id', text='text', table='documents')}), t as ({_SQL_GRAMS.format(id='item_id', text='free_text', table='heldout_eval')}) select distinct doc_id, item_id from d join t using (g)",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
