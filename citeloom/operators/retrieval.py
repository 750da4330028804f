"""Nearest entries by cosine within a jurisdiction, and routing of requests.

Queries are a stated set; they go against the whole index in blocks of bounded size. A task keeps the best entry of each
query over its batch, so what is shuffled is one row per query and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.numeric import unit_vector

#: Queries of one block; it bounds what is broadcast.
BLOCK = 4096
THRESHOLD = 0.75


def build_index(entries: DataFrame, vector: str = "embedding") -> DataFrame:
    """The entries with unit vectors. An empty index is an error of the caller, see ``gates.require_rows``."""
    return entries.withColumn(vector, unit_vector(F.col(vector)).cast("array<float>"))


def _best(shared, within: bool, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, vectors = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist())
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            index = flat.reshape(len(keys), -1)
            order = np.argsort(keys, kind="stable")
            index, keys = index[order], keys[order]
            group = np.array(batch.column(1).to_pylist())[order]
            out = [[], [], []]
            for g in set(groups.tolist()) if within else [None]:
                mine = np.flatnonzero(groups == g) if within else np.arange(len(ids))
                rows = np.flatnonzero(group == g) if within else np.arange(len(keys))
                if len(mine) and len(rows):
                    scores = np.round(vectors[mine] @ index[rows].T, digits)
                    # An entry never answers its own query.
                    scores[ids[mine][:, None] == keys[rows][None, :]] = -np.inf
                    best = scores.argmax(1)
                    ok = np.isfinite(scores[np.arange(len(mine)), best])
                    out[0] += ids[mine][ok].tolist()
                    out[1] += keys[rows][best][ok].tolist()
                    out[2] += scores[np.arange(len(mine)), best][ok].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "hit_id", "cosine"])

    return run


def nearest(index: DataFrame, queries: DataFrame, within: bool = True, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """query_id, hit_id, cosine: each query's best other entry, of its own jurisdiction if ``within``; of equal ones the
    least id. Both: id (long), jurisdiction, embedding (unit vectors). Queries without candidates give no row; null
    vectors take no part."""
    spark = index.sparkSession
    rows = index.where(F.col("embedding").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long"), "jurisdiction", "embedding")
    out, part = None, []

    def flush():
        nonlocal out, part
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in part]), np.array([r[1] for r in part]), np.array([r[2] for r in part], np.float64)))
        found = rows.mapInArrow(_best(shared, within, digits), "query_id long, hit_id long, cosine double")
        out, part = found if out is None else out.unionByName(found), []

    for r in queries.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long"), "jurisdiction", "embedding").toLocalIterator():
        part.append(r)
        if len(part) >= block:
            flush()
    if part:
        flush()
    if out is None:
        return spark.createDataFrame([], "query_id long, hit_id long, cosine double")
    best = out.groupBy("query_id").agg(F.max(F.struct("cosine", (-F.col("hit_id")).alias("h"))).alias("b"))
    return best.select("query_id", (-F.col("b.h")).alias("hit_id"), F.col("b.cosine").alias("cosine"))


def retrieve(queries: DataFrame, hits: DataFrame, threshold: float | None = THRESHOLD) -> DataFrame:
    """Every query with hit_id, cosine and ``error``: none within the jurisdiction, or below the threshold."""
    out = queries.join(hits, queries["id"] == hits["query_id"], "left").drop("query_id")
    low = (F.col("cosine") < threshold) if threshold is not None else F.lit(False)
    error = F.when(F.col("hit_id").isNull(), "no entry").when(low, "no confident match")
    return out.withColumn("error", error).withColumn("hit_id", F.when(F.col("error").isNull(), F.col("hit_id")))


def route(retrieved: DataFrame, fine_tune: DataFrame) -> DataFrame:
    """provenance of each request: retrieval where it hit, else the fine-tuned model's answer, else none. ``fine_tune``
    (id, answer) is joined to misses alone, so a hit never has one."""
    hits = retrieved.where(F.col("error").isNull()).select("id", F.lit("gold-retrieval").alias("provenance"), F.col("hit_id").cast("string").alias("answer"))
    misses = retrieved.where(F.col("error").isNotNull()).select("id").join(fine_tune, "id", "left")
    known = F.when(F.col("answer").isNotNull(), "fine-tune-generalization").otherwise("no-confident-match")
    return hits.unionByName(misses.select("id", known.alias("provenance"), "answer"))


def side_by_side(retrieved: DataFrame, fine_tune: DataFrame, gold: DataFrame, base: DataFrame) -> DataFrame:
    """id, label, answer in three rows per request: retrieval, fine-tuned model, and gold or else the base model."""
    r = retrieved.select("id", F.col("hit_id").cast("string").alias("retrieval"))
    wide = r.join(fine_tune.select("id", F.col("answer").alias("fine_tune")), "id", "left").join(gold.select("id", F.col("answer").alias("gold")), "id", "left").join(base.select("id", F.col("answer").alias("base")), "id", "left")
    third = F.coalesce("gold", "base", F.lit("unavailable"))
    return wide.select("id", F.col("retrieval"), F.col("fine_tune"), third.alias("reference")).unpivot("id", ["retrieval", "fine_tune", "reference"], "label", "answer")


def domain_flags(best: DataFrame, train_share: float = 0.9) -> DataFrame:
    """query_id, cosine, in_domain: whether a query's best cosine reaches the given percentile of all best cosines."""
    cut = best.agg(F.percentile("cosine", train_share).alias("cut"))
    return best.crossJoin(F.broadcast(cut)).select("query_id", "cosine", (F.col("cosine") >= F.round("cut", 6)).alias("in_domain"))


def top_entries(scored: DataFrame, k: int) -> DataFrame:
    """query_id, hit_id, cosine, rank: the k best of each query."""
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "hit_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
