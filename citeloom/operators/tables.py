"""Keyed tables: upserts, latest rows, skip predicates, outcomes, first matches, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` and those of ``base`` with other keys."""
    return base.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_match(left: DataFrame, right: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each left row with the right row of its key that comes first, by raw equality; without one, nulls."""
    rest = [c for c in right.columns if c not in key]
    best = right.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return left.join(best, key, "left").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def unchanged(entries: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
    """``skip``: whether the last prior row of an entry's key exists, didn't fail, has output and the same hash. Both
    have sha; prior also failed, output and pos, by which the last row is told."""
    last = latest(prior, key, [F.col("pos")]).select(*key, F.col("sha").alias("_sha"), F.col("failed").alias("_failed"), F.col("output").alias("_out"))
    skip = F.col("_sha").isNotNull() & ~F.coalesce("_failed", F.lit(False)) & F.col("_out").isNotNull() & (F.col("_sha") == F.col("sha"))
    return entries.join(last, key, "left").withColumn("skip", F.coalesce(skip, F.lit(False))).drop("_sha", "_failed", "_out")


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def outcomes(spec: DataFrame, disk: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """key..., outcome of each source: manual ones are there or missing, others unchanged (same hash on disk and in the
    manifest) or to be fetched. spec: manual; disk: disk_sha; manifest: known_sha."""
    all_ = spec.join(disk, key, "left").join(manifest, key, "left")
    outcome = (
        F.when(F.col("manual") & F.col("disk_sha").isNotNull(), "manual_present")
        .when(F.col("manual"), "manual_missing")
        .when(F.col("disk_sha") == F.col("known_sha"), "skipped_idempotent")
        .otherwise("downloaded")
    )
    return all_.select(*key, outcome.alias("outcome"))


def remaining(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def without_match(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right, key, "left_anti")
