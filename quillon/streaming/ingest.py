"""Run logs as a stream: parse, keep what is new by run key, and audit labels as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions import payload
from quillon.functions.labels import norm_a
from quillon.operators.audit import entropy


def parsed(lines: DataFrame) -> DataFrame:
    """Stateless part: a JSON line per run to run_id, layer, model and normalised labels of its first note. Blank and broken
    lines are dropped."""
    v = payload.variant(F.col("value"))
    rows = lines.select(v.alias("v")).where(F.col("v").isNotNull())
    body = F.try_variant_get("v", "$.parsed_json", "variant")
    return rows.select(
        payload.get(F.col("v"), "$.run_id").alias("run_id"), payload.get(F.col("v"), "$.layer").alias("layer"), payload.get(F.col("v"), "$.model").alias("model"),
        *[norm_a(payload.first_note(body, f"staging.{s}"), s).alias(s.lower()) for s in "TNM"],
    ).where(F.col("run_id").isNotNull())


def append_new(spark: SparkSession, folder: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends runs of new files whose key the table does not hold; a replayed batch adds nothing."""
    lines = spark.readStream.text(folder)

    def write(batch: DataFrame, _: int) -> None:
        rows = parsed(batch).dropDuplicates(["run_id"])
        try:
            done = spark.read.parquet(table_path).select("run_id")
            rows = rows.join(done, "run_id", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(table_path)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_counts(lines: DataFrame) -> DataFrame:
    """Running label counts, for outputMode('complete'); duplicates by run key are dropped within the stream's state."""
    rows = parsed(lines).dropDuplicates(["run_id"])
    long = rows.select("model", F.explode(F.array(*[F.struct(F.lit(s).alias("dim"), F.col(s).alias("label")) for s in "tnm"])).alias("x"))
    return long.select("model", "x.dim", "x.label").groupBy("model", "dim", "label").agg(F.count("*").alias("n"))


def entropy_of(counts: DataFrame) -> DataFrame:
    """Second aggregation, on the finished counts of a batch."""
    return entropy(counts, ["dim", "model"])
