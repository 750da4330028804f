"""Evaluation rows, their slices, and set overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.citation import citation_match
from citeloom.functions.jsonx import BUCKETS
from citeloom.functions.numeric import ratio_or_null, unit_score

HIGH_SCORE = 0.7


def framework_pair() -> Column:
    return F.concat_ws("__", "source_framework", "target_framework")


def distinct_evaluations(rows: DataFrame, columns: list[str], key: str = "eval_id") -> DataFrame:
    """Rows that were delivered twice once."""
    return rows.select(key, *columns).distinct()


def scored(rows: DataFrame) -> DataFrame:
    """``match`` (0 or 1, recomputed), ``score`` (clipped) and ``pair`` for each row."""
    return rows.withColumns({"match": citation_match(F.col("predicted_citation_id"), F.col("expected_citation_id")), "score": unit_score(F.col("judge_score")), "pair": framework_pair()})


def slice_measures() -> list[Column]:
    """n, mean match, mean score and share of high scores; 0 where there are no rows. Scores are summed in millionths, so
    the mean doesn't depend on the order of the rows."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return [
        F.count("*").alias("n"),
        zero(F.avg("match")).alias("tier1_citation_match"),
        F.coalesce(F.round(F.try_divide(F.sum(F.round(F.col("score") * 1_000_000).cast("long")), F.count("*"))) / 1_000_000, F.lit(0.0)).alias("tier2_judge_mean"),
        zero(F.avg((F.col("score") >= HIGH_SCORE).cast("int"))).alias("tier2_judge_pct_above_0_7"),
    ]


def slices(rows: DataFrame) -> DataFrame:
    """All slices of each model in one pass: overall, by target jurisdiction, by target language, by framework pair."""
    dims = ["model", "target_jurisdiction", "target_language", "pair"]
    sets = [["model"], *[["model", d] for d in dims[1:]]]
    out = rows.groupingSets(sets, *dims).agg(F.grouping_id().alias("g"), *slice_measures())
    kind = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "target_jurisdiction").when(F.col("g") == 5, "target_language").otherwise("framework_pair")
    key = F.when(F.col("g") == 3, F.col("target_jurisdiction")).when(F.col("g") == 5, F.col("target_language")).when(F.col("g") == 6, F.col("pair"))
    return out.select("model", kind.alias("slice_kind"), key.alias("slice_key"), "n", "tier1_citation_match", "tier2_judge_mean", "tier2_judge_pct_above_0_7")


def bucket_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., one column per bucket, 0 where there are none; other values of the bucket are not counted."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col("judge_bucket") == b).alias(b) for b in BUCKETS])


def overlap(expected: Column, extracted: Column) -> Column:
    """struct of sorted true positives, false positives, false negatives, recall and precision (null on an empty side)."""
    a, b = F.array_distinct(expected), F.array_distinct(extracted)
    tp = F.array_sort(F.array_intersect(a, b))
    return F.struct(
        tp.alias("tp"),
        F.array_sort(F.array_except(b, a)).alias("fp"),
        F.array_sort(F.array_except(a, b)).alias("fn"),
        ratio_or_null(F.size(tp), F.size(a)).alias("recall"),
        ratio_or_null(F.size(tp), F.size(b)).alias("precision"),
    )


def parser_means(pages: DataFrame) -> DataFrame:
    """parser, pages and means that skip nulls."""
    return pages.groupBy("parser").agg(
        F.count("*").alias("pages"),
        F.round(F.avg("recall"), 6).alias("recall_mean"),
        F.round(F.avg("precision"), 6).alias("precision_mean"),
        F.round(F.avg("reading_order"), 6).alias("reading_order_mean"),
        F.round(F.avg("structure"), 6).alias("structure_share"),
    )


def parser_winner(means: DataFrame) -> DataFrame:
    """parser, decided_by: best reading order, recall deciding ties; nobody while a mean is missing or all is tied."""
    best = means.agg(
        F.max(F.struct("reading_order_mean", F.coalesce("recall_mean", F.lit(-1.0)).alias("r"))).alias("top"),
        F.bool_or(F.col("reading_order_mean").isNull()).alias("open"),
    )
    m = means.crossJoin(F.broadcast(best)).where(~F.col("open"))  # one row against a few parsers
    ties = F.count("*").over(_all())
    first = m.where((F.col("reading_order_mean") == F.col("top.reading_order_mean")))
    first = first.withColumn("ro_ties", ties)
    first = first.where(F.coalesce("recall_mean", F.lit(-1.0)) == F.col("top.r")).withColumn("all_ties", ties)
    return first.where(F.col("all_ties") == 1).select("parser", F.when(F.col("ro_ties") > 1, "citation recall").otherwise("reading order").alias("decided_by"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def apply_fills(pages: DataFrame, fills: DataFrame, columns: list[str]) -> DataFrame:
    """Reviewer values over page scores by (parser, page_index); blank cells leave the old value."""
    f = fills.select("parser", "page_index", *[F.col(c).alias(f"_{c}") for c in columns])
    out = pages.join(f, ["parser", "page_index"], "left")
    for c in columns:
        filled = F.when(F.trim(F.col(f"_{c}").cast("string")) != "", F.col(f"_{c}"))
        out = out.withColumn(c, F.coalesce(filled.try_cast(pages.schema[c].dataType), F.col(c))).drop(f"_{c}")
    return out
