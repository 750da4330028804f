"""The references and parents of this project's tables, for the orphan operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.citation import cited_base, is_blank
from citeloom.operators.orphans import OrphanState, run_batches, snapshot, waiting
from citeloom.sources.tables import table

SEP = "\u0001"
#: Periods into which the time of the references is cut for the queries.
PERIODS = 2
#: For entries without an added_at: in force since ever.
EVER = "0001-01-01 00:00:00"


def _ref(df: DataFrame, table_name: str, key: str, field: str, ns: str, parent: Column, at: Column) -> DataFrame:
    return df.select(
        F.lit(table_name).alias("table_name"),
        F.col(key).cast("string").alias("record_key"),
        F.lit(field).alias("field_name"),
        F.lit(ns).alias("ns"),
        parent.alias("parent_key"),
        at.cast("timestamp").alias("ref_at"),
    )


def project_references(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference the tables hold: citations of gold pairs, gold ids of evaluations and splits, frameworks of the
    registry manifest. Null and blank values are no references; repeated rows count once."""
    gold = table(spark, folder, "gold_pairs")
    parts = []
    for side in ("source", "target"):
        c = f"{side}_citation_id"
        named = F.concat(F.col(f"{side}_framework"), F.lit(SEP), cited_base(F.col(c)))
        parts.append(_ref(gold.where(~is_blank(F.col(c))), "gold_pairs", "id", c, "section", named, F.col("created_at")))
    runs = table(spark, folder, "eval_rows").where(~is_blank(F.col("gold_id")))
    parts.append(_ref(runs, "eval_rows", "eval_id", "gold_id", "gold", F.col("gold_id"), F.col("run_at")))
    splits = table(spark, folder, "gold_splits").where(~is_blank(F.col("id")))
    parts.append(_ref(splits, "gold_splits", "id", "id", "gold", F.col("id"), F.lit(None)))
    registries = table(spark, folder, "registry_manifest").where(~is_blank(F.col("framework")))
    parts.append(_ref(registries, "registry_manifest", "framework", "framework", "framework", F.col("framework"), F.lit(None)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def project_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Registry sections with the time they were in force, gold pairs from their creation on, frameworks with entries."""
    entries = table(spark, folder, "registry_entries")
    gold = table(spark, folder, "gold_pairs")
    ts = lambda c: F.col(c).cast("timestamp").alias(c)
    since = F.coalesce(F.col("added_at").cast("timestamp"), F.lit(EVER).cast("timestamp")).alias("added_at")
    sections = entries.select(F.lit("section").alias("ns"), F.concat("framework", F.lit(SEP), "citation_id").alias("parent_key"), since, ts("removed_at"))
    frameworks = entries.select(F.lit("framework").alias("ns"), F.col("framework").alias("parent_key"), F.lit(None).cast("timestamp").alias("added_at"), F.lit(None).cast("timestamp").alias("removed_at"))
    pairs = gold.select(F.lit("gold").alias("ns"), F.col("id").alias("parent_key"), F.col("created_at").cast("timestamp").alias("added_at"), F.lit(None).cast("timestamp").alias("removed_at"))
    return sections.unionByName(frameworks).unionByName(pairs)


def reference_states(spark: SparkSession, folder: str, periods: int = PERIODS) -> list[OrphanState]:
    """The orphan state after each of ``periods`` equal periods of the references' time."""
    refs = project_references(spark, folder)
    first, last = refs.agg(F.min("ref_at"), F.max("ref_at")).first()
    ends = [first + (last - first) * (i + 1) / periods for i in range(periods)] if first else [None]
    return run_batches(spark, refs, project_parents(spark, folder), ends)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return reference_states(spark, folder)[-1].refs.where("orphan_at_ref").select("table_name", "record_key", "field_name")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, field and month."""
    return snapshot(reference_states(spark, folder)[-1].refs)


def p3_waiting(spark: SparkSession, folder: str) -> DataFrame:
    """References seen and open after each period, per table and field."""
    return waiting(reference_states(spark, folder))


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per framework of the registry manifest: the recorded recall beside the share of gold citations of that framework
    that find their section, and the orphan count."""
    recorded = table(spark, folder, "registry_manifest").select("framework", F.col("toy_gold_recall").alias("recorded_recall"), F.size(F.coalesce("toy_gold_missing", F.array().cast("array<string>"))).cast("long").alias("recorded_missing"))
    citations = reference_states(spark, folder)[-1].refs.where(F.col("ns") == "section")
    refs = citations.groupBy(F.split("parent_key", SEP)[0].alias("framework")).agg(F.count("*").alias("refs"), F.count_if("orphan_at_ref").alias("orphans"))
    return recorded.join(refs, "framework", "left").select(
        "framework",
        "recorded_recall",
        "recorded_missing",
        F.coalesce("refs", F.lit(0)).cast("long").alias("refs"),
        F.coalesce("orphans", F.lit(0)).cast("long").alias("orphans"),
        F.round(F.when(F.col("refs") > 0, 1 - F.coalesce("orphans", F.lit(0)) / F.col("refs")), 6).alias("observed_recall"),
    )
