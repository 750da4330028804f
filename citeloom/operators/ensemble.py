"""Extensions that have no reference behaviour: agreement tiers, audit samples, group-disjoint splits, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.citation import base_section, normalize_citation


def agreement_tiers(votes: DataFrame, item: str, model: str, citation: str) -> DataFrame:
    """item, voters, agree, bases, tier: HIGH if all of at least four models name one id, MEDIUM with three quarters or one
    base section, else LOW. Empty votes count as a voter without an id."""
    v = votes.select(F.col(item).alias("item"), F.col(model).alias("m"), normalize_citation(F.coalesce(F.col(citation), F.lit(""))).alias("id")).distinct()
    per_id = v.groupBy("item", "id").agg(F.countDistinct("m").alias("n"))
    best = per_id.groupBy("item").agg(F.max(F.when(F.col("id") != "", F.col("n"))).alias("agree"), F.count_distinct(F.when(F.col("id") != "", base_section(F.col("id")))).alias("bases"))
    voters = v.groupBy("item").agg(F.countDistinct("m").alias("voters"))
    share = F.coalesce("agree", F.lit(0)) / F.col("voters")
    tier = F.when((F.col("voters") >= 4) & (share >= 1), "HIGH").when((share >= 0.75) | ((F.col("bases") == 1) & (F.coalesce("agree", F.lit(0)) > 0)), "MEDIUM").otherwise("LOW")
    return voters.join(best, "item").select("item", "voters", F.coalesce("agree", F.lit(0)).cast("long").alias("agree"), "bases", tier.alias("tier"))


def hash_bucket(key, buckets: int):
    """A number in [0, buckets) from the first 28 bits of a key's MD5, equal on every engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % buckets


def audit_sample(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """The rows of which the key's bucket of 100 is below ``percent``."""
    return rows.where(hash_bucket(F.col(key), 100) < percent)


def group_splits(rows: DataFrame, group: str, train: int = 80, val: int = 10) -> DataFrame:
    """``split`` by the hash of the group, so no group stands in two splits."""
    b = hash_bucket(F.col(group), 100)
    return rows.withColumn("split", F.when(b < train, "train").when(b < train + val, "val").otherwise("test"))


def model_deltas(slices: DataFrame, baseline: str, measure: str) -> DataFrame:
    """model, slice_kind, slice_key, delta of a measure against the baseline model on the same slice."""
    base = slices.where(F.col("model") == baseline).select(F.col("slice_kind").alias("k"), F.col("slice_key").alias("s"), F.col(measure).alias("base"))
    same = (F.col("slice_kind") == F.col("k")) & F.col("slice_key").eqNullSafe(F.col("s"))
    return slices.where(F.col("model") != baseline).join(base, same).select("model", "slice_kind", "slice_key", F.round(F.col(measure) - F.col("base"), 6).alias("delta"))
