"""Sources and sinks: tolerant JSON lines, CSV with line breaks, zipped CSV, line-aligned stores, checkpoints, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by an explicit schema: blank lines are skipped, broken ones kept in `_corrupt_record`; a missing path is empty."""
    full = StructType([*schema.fields])
    if "_corrupt_record" not in full.fieldNames():
        full = full.add("_corrupt_record", "string")
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def jsonl_variant(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of any shape: `v` is a VARIANT, null where the line is broken; blank lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "line string").select("line", F.try_parse_json("line").alias("v"))
    return spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.col("value").alias("line"), F.try_parse_json("value").alias("v"))


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The first .csv member of each archive, as text columns, read on the workers in chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                    if name:
                        with z.open(name) as f:
                            for part in pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=5000):
                                yield part[columns].replace({"": None})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def line_store(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of a line-aligned store: numbers follow the lines of the file, blank ones keep theirs."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    # One row per split of a file: where its numbers begin. Ids within a split follow its lines.
    splits = rows.groupBy("f", "b").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("f", "b", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.join(F.broadcast(starts), ["f", "b"])
    return numbered.select((F.col("start") + F.col("m") - F.col("first")).alias("line_no"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))


def checkpoint_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank keys of a checkpoint file; none where it is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "run_key string")
    return spark.read.text(path).select(F.trim("value").alias("run_key")).where(F.length("run_key") > 0).distinct()


def record_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).count() if _exists(spark, path) else 0


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_keys(df: DataFrame, key: str, path: str) -> None:
    df.select(F.col(key).cast("string")).write.mode("append").text(path)


def export_csv(df: DataFrame, path: str, lead: list[str] | None = None) -> None:
    """One CSV file with a header; `lead` columns (group keys) come first. For reports, which are small."""
    keys = lead or []
    df.select(*keys, *[c for c in df.columns if c not in keys]).coalesce(1).write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def export_cohorts(df: DataFrame, path: str, flag) -> None:
    """Two cohorts as partitions of one dataset."""
    df.withColumn("cohort", F.when(flag, F.lit("lung")).otherwise(F.lit("cross"))).write.mode("overwrite").partitionBy("cohort").parquet(path)


def map_model(df: DataFrame, row_id: str, prompt: str, answer, at_once: int = 64) -> DataFrame:
    """The boundary to an external model: `answer(list of prompts) -> list of texts` is run on the workers, `at_once` prompts
    at a time; where it fails, texts are empty and `error` says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts, texts, errors = batch["prompt"].tolist(), [], []
            for at in range(0, len(prompts), at_once):
                part, error = prompts[at : at + at_once], None
                try:
                    texts += answer(part)
                except Exception as e:  # noqa: BLE001
                    texts, error = [*texts, *[""] * len(part)], f"{type(e).__name__}: {e}"
                errors += [error] * len(part)
            yield pd.DataFrame({"row_id": batch["row_id"], "raw_output": texts, "error": pd.Series(errors, dtype=object, index=batch.index)})

    return df.select(F.col(row_id).alias("row_id"), F.col(prompt).alias("prompt")).mapInPandas(run, "row_id string, raw_output string, error string")
