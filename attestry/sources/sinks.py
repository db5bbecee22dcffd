"""Writing results: CSV reports and ranking runs with a commit marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.secrets import safe_cell


def csv_field(col: Column) -> Column:
    """RFC 4180 field: quoted when it holds a quote, comma or line break; NULL is empty."""
    text = safe_cell(F.coalesce(col.cast("string"), F.lit("")))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as one CSV line, columns in the order of the frame."""
    return df.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in df.columns]).alias("line"))


def write_csv_report(df: DataFrame, path: str) -> None:
    """Write a report directory with one header per part."""
    safe = df.select(*[safe_cell(F.col(c).cast("string")).alias(c) for c in df.columns])
    safe.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_run(base: str, run_id: str, parts: dict[str, DataFrame], snapshot: DataFrame) -> None:
    """Write the tables of one run, then its snapshot row as the commit marker.

    Every table is partitioned by ``run_id`` and only that partition is replaced, so a
    retry after a lost executor or driver rewrites the same run instead of doubling it.
    Readers see a run only once its snapshot exists.
    """
    for name, frame in {**parts, "snapshots": snapshot}.items():
        (
            frame.withColumn("run_id", F.lit(run_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(f"{base}/{name}")
        )


def read_committed(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Rows of runs whose snapshot was written."""
    schema_kept = spark.read.option("partitionColumnTypeInference", "false").parquet(f"{base}/{name}")
    done = spark.read.parquet(f"{base}/snapshots").select(F.col("run_id").cast("string").alias("run_id")).distinct()
    return schema_kept.withColumn("run_id", F.col("run_id").cast("string")).join(done, "run_id", "left_semi")
