"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, budget, calibration, canonical, leakage, neardup, residue, splitleak, splitting
from citeloom.sources.tables import table

CITATIONS = ["predicted_citation_id", "expected_citation_id"]


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered pieces of every oversized file named by the manifest."""
    docs = splitting.named_files(table(spark, folder, "documents"), table(spark, folder, "ingest_manifest"))
    return splitting.split_oversized(docs)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pieces(spark, folder).where(F.col("piece_no") == 1).select("doc_id").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.map_fields(table(spark, folder, "eval_rows"), table(spark, folder, "registry_entries"), "eval_id", "target_framework", CITATIONS)


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Unmatched values per field and framework."""
    rows = p2_found(spark, folder).where(F.col("citation_id") == canonical.UNMATCHED)
    frameworks = table(spark, folder, "eval_rows").groupBy("eval_id").agg(F.min("target_framework").alias("target_framework"))
    return rows.join(frameworks, "eval_id").groupBy("field_name", "target_framework").agg(F.count("*").alias("n"))


def p4_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    return budget.gold_budget(table(spark, folder, "gold_pairs"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, folder, "gold_pairs"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, folder, "gold_pairs"))


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return splitleak.cross_split_pairs(table(spark, folder, "gold_pairs"), table(spark, folder, "gold_splits"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return splitleak.overlap_report(_overlaps(spark, folder), table(spark, folder, "gold_pairs"), table(spark, folder, "gold_splits"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.shortfalls(table(spark, folder, "eval_rows"), table(spark, folder, "sample_targets"))


def p7_sample(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.draw(table(spark, folder, "eval_rows"), table(spark, folder, "sample_targets"))[0]


def p7_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """What each target needs, what exists and what it lacks for that, as the draw reports it."""
    report = calibration.draw(table(spark, folder, "eval_rows"), table(spark, folder, "sample_targets"))[1]
    return report.select("plan_name", "dimension", "category", "needed", "available", F.greatest(F.lit(0), F.col("needed") - F.col("available")).alias("short"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_gaps, with the rows drawn and what the sample lacks."""
    return calibration.draw(table(spark, folder, "eval_rows"), table(spark, folder, "sample_targets"))[1]


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each plan's sample, and different ones."""
    return p7_sample(spark, folder).groupBy("plan_name").agg(F.count("*").alias("n"), F.count_distinct("eval_id").alias("ids"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_places(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks with the place of one stretch in the document's text."""
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), places=True)


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find_residue(table(spark, folder, "documents")).select("doc_id").distinct()


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus without the documents that hold residue."""
    return residue.without_residue(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p2_unmatched, p4_token_budget, p5_found, p5_groups, p6_found, p6_report, p7_found, p7_sample, p7_gaps, p7_report, p7_totals, p8_ids, p9_found, p9_places, p9_items, p10_found, p10_clean)
}

_UNIQUE = """u AS (SELECT eval_id, min(struct_pack(a := nullif(lower(trim(judge_bucket)), ''), b := nullif(lower(trim(target_jurisdiction)), ''), c := nullif(lower(trim(model)), ''))) AS r
  FROM eval_rows WHERE eval_id IS NOT NULL GROUP BY eval_id),
  long AS (SELECT 'judge_bucket' AS dimension, r.a AS category FROM u UNION ALL SELECT 'target_jurisdiction', r.b FROM u UNION ALL SELECT 'model', r.c FROM u),
  have AS (SELECT dimension, category, count(*) AS n FROM long WHERE category IS NOT NULL GROUP BY ALL),
  need AS (SELECT DISTINCT t.*, greatest(min_rows, ((SELECT count(*) FROM u) * sample_permille // 1000) * target_permille // 1000) AS needed FROM sample_targets t),
  gaps AS (SELECT plan_name, need.dimension, need.category, CAST(needed AS BIGINT) AS needed, CAST(coalesce(n, 0) AS BIGINT) AS available,
    CAST(greatest(0, needed - coalesce(n, 0)) AS BIGINT) AS short
    FROM need LEFT JOIN have ON have.dimension = need.dimension AND have.category = lower(trim(need.category)))"""

SQL = {
    "p1_found": r"""SELECT DISTINCT d.doc_id FROM documents d
  WHERE length(d.text) > 6000 AND regexp_replace(regexp_replace(d.md_relpath, '[\\/]+', '/', 'g'), '^(\./)+', '') IN (
    SELECT regexp_replace(regexp_replace(md_relpath, '[\\/]+', '/', 'g'), '^(\./)+', '') FROM ingest_manifest
    WHERE NOT coalesce(failed, false) AND md_relpath IS NOT NULL)""",
    "p7_found": f"WITH {_UNIQUE} SELECT plan_name, dimension, category FROM gaps WHERE short > 0",
    "p7_gaps": f"WITH {_UNIQUE} SELECT * FROM gaps",
    "p7_totals": """WITH u AS (SELECT count(DISTINCT eval_id) AS n FROM eval_rows)
  SELECT DISTINCT plan_name, u.n * sample_permille // 1000 AS n, u.n * sample_permille // 1000 AS ids FROM sample_targets, u""",
}
