"""Quality gates: one row with the figures and whether they pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def registry_gate(manifest: DataFrame) -> DataFrame:
    """n, failing, exit_code: 2 without rows, 1 where a recall is missing or below 1, else 0."""
    out = manifest.agg(F.count("*").alias("n"), F.count_if(F.coalesce("toy_gold_recall", F.lit(0.0)) < 1).alias("failing"))
    return out.withColumn("exit_code", F.when(F.col("n") == 0, 2).when(F.col("failing") > 0, 1).otherwise(0))


def coverage(gold: DataFrame, expected: list[str], rows: int, least: int) -> DataFrame:
    """One row per expected jurisdiction and for the whole: its pairs (as source or target) and whether there are enough."""
    counts = gold.select(F.explode(F.array_distinct(F.array("source_jurisdiction", "target_jurisdiction"))).alias("jurisdiction")).groupBy("jurisdiction").agg(F.count("*").alias("n"))
    want = gold.sparkSession.createDataFrame([(x,) for x in expected], "jurisdiction string")
    per = want.join(counts, "jurisdiction", "left").select("jurisdiction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    per = per.withColumn("ok", F.col("n") >= least)
    whole = gold.agg(F.lit("(all)").alias("jurisdiction"), F.count("*").alias("n")).withColumn("ok", F.col("n") >= rows)
    return per.unionByName(whole)


def run_status(rows: DataFrame) -> DataFrame:
    """documents, failures, exit_code: 1 if any document of the run failed."""
    out = rows.agg(F.count("*").alias("documents"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failures"))
    return out.withColumn("exit_code", F.when(F.col("failures") > 0, 1).otherwise(0))


def exactly_one(a: str, b: str):
    """Column: whether exactly one of two columns is given (not null, not false)."""
    given = lambda c: F.coalesce(F.col(c).cast("string") != "false", F.lit(False))
    return given(a) != given(b)


def spot_check(rows: DataFrame, by: str, passed: str, least: float = 0.8) -> DataFrame:
    """by, n, share, ok: groups whose share of passed rows is below ``least`` aren't ok."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(passed).cast("int")), 6).alias("share"))
    return out.withColumn("ok", F.col("share") >= least)
