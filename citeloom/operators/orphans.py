"""References to records that do not exist: keyed pending-orphan state, kept up incrementally.

A *reference* names a parent by (``ns``, ``parent_key``) at a time ``ref_at`` (null: at any time). A *parent* row gives an
interval in which the key is in force; a row with ``removed_at`` closes the interval that began at the same
``added_at``, and one without ``added_at`` but with ``removed_at`` is a deletion of the key, which closes what began before
it. ``advance`` takes one batch of each:

* new references probe the parent index and are either resolved or wait as orphans;
* arriving parents resolve the waiting references of their key;
* deletions reopen the references of their key.

The state lies in the shared checkpoint folder, split into buckets by parent key. A batch reads and rewrites only the buckets
that it touches, and within them probes only the references of keys that it touches; the folders of older batches stay as
they are, so a batch that fails leaves the state before it whole. All steps are equi-joins on the parent key (left semi and
left anti), so a key that holds a third of all references is split by adaptive execution and no group is ever collected.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.session import checkpoint_dir, cut_lineage

REF_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("record_key", T.StringType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("ns", T.StringType()),
        T.StructField("parent_key", T.StringType()),
        T.StructField("ref_at", T.TimestampType()),
    ]
)
PARENT_SCHEMA = T.StructType(
    [
        T.StructField("ns", T.StringType()),
        T.StructField("parent_key", T.StringType()),
        T.StructField("added_at", T.TimestampType()),
        T.StructField("removed_at", T.TimestampType()),
    ]
)
REF_COLUMNS = REF_SCHEMA.fieldNames()
FLAGGED = T.StructType([*REF_SCHEMA.fields, T.StructField("orphan_at_ref", T.BooleanType()), T.StructField("is_open", T.BooleanType())])
#: Buckets of the state; their number is fixed when a state begins.
BUCKETS = 16


@dataclass(frozen=True)
class OrphanState:
    """What has been seen so far. ``ref_paths`` and ``parent_paths`` name the newest folder of each bucket, ``deletions``
    says whether a key was ever deleted, ``as_of`` is the time of the last batch."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS
    batch: int = 0
    ref_paths: dict[int, str] = field(default_factory=dict)
    parent_paths: dict[int, str] = field(default_factory=dict)
    deletions: bool = False
    as_of: object = None

    @staticmethod
    def empty(spark: SparkSession, buckets: int = BUCKETS) -> "OrphanState":
        return OrphanState(spark, f"{checkpoint_dir(spark).rstrip('/')}/orphans-{uuid.uuid4().hex}", buckets)

    def _read(self, paths: dict[int, str], schema: T.StructType, only: set[int] | None = None) -> DataFrame:
        names = [p for b, p in sorted(paths.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    @property
    def refs(self) -> DataFrame:
        """Every reference seen, with ``orphan_at_ref`` (no parent in force at ``ref_at``, by all that is known now) and
        ``is_open`` (none in force at ``as_of``)."""
        return self._read(self.ref_paths, FLAGGED)

    @property
    def parents(self) -> DataFrame:
        """The parent index: intervals and deletions."""
        return self._read(self.parent_paths, PARENT_SCHEMA)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("ns", "parent_key"), F.lit(buckets)).cast("int")


def _is_deletion() -> Column:
    return F.col("added_at").isNull() & F.col("removed_at").isNotNull()


def merge_parents(parents: DataFrame, arrived: DataFrame) -> DataFrame:
    """The parent index with a batch of arrivals and deletions: an interval is known by its key and ``added_at``; a row
    with ``removed_at`` closes it, whichever row comes first. Repeated rows count once. Null keys are no parents."""
    both = parents.unionByName(arrived.select(*PARENT_SCHEMA.fieldNames())).where(F.col("parent_key").isNotNull())
    intervals = both.where(~_is_deletion()).groupBy("ns", "parent_key", "added_at").agg(F.min("removed_at").alias("removed_at"))
    return intervals.unionByName(both.where(_is_deletion()).distinct())


def intervals(parents: DataFrame, deletions: bool = True) -> DataFrame:
    """The times in which each parent is in force (_ns, _key, _added, _removed), deletions of keys applied."""
    rows = parents.where(~_is_deletion()).select(F.col("ns").alias("_ns"), F.col("parent_key").alias("_key"), F.col("added_at").alias("_added"), F.col("removed_at").alias("_removed"))
    if not deletions:
        return rows
    gone = parents.where(_is_deletion()).select(F.col("ns").alias("d_ns"), F.col("parent_key").alias("d_key"), F.col("removed_at").alias("d_at"))
    later = _same("_ns", "d_ns") & (F.col("_key") == F.col("d_key")) & (F.col("_added").isNull() | (F.col("d_at") >= F.col("_added")))
    return rows.join(gone, later, "left").groupBy("_ns", "_key", "_added").agg(F.least(F.min("_removed"), F.min("d_at")).alias("_removed"))


def _flag(refs: DataFrame, valid: DataFrame, at: Column, name: str) -> DataFrame:
    """``refs`` with the column ``name``: whether no parent is in force at ``at`` (null: no parent at all). A null key has
    none."""
    in_force = at.isNull() | ((F.col("_added").isNull() | (F.col("_added") <= at)) & (F.col("_removed").isNull() | (F.col("_removed") > at)))
    match = (F.col("ns") == F.col("_ns")) & (F.col("parent_key") == F.col("_key")) & in_force
    return refs.join(valid, match, "left_semi").withColumn(name, F.lit(False)).unionByName(refs.join(valid, match, "left_anti").withColumn(name, F.lit(True)))


def _write(df: DataFrame, state: OrphanState, kind: str, touched: set[int]) -> dict[int, str]:
    path = f"{state.folder}/{kind}/batch={state.batch + 1}"
    # Few files of each bucket, a hot bucket in several tasks.
    df.withColumn("bucket", _bucket(state.buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    jvm = state.spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    there = {f.getPath().getName() for f in root.getFileSystem(state.spark._jsc.hadoopConfiguration()).listStatus(root)}
    return {b: f"{path}/bucket={b}" for b in sorted(touched) if f"bucket={b}" in there}


def advance(state: OrphanState, new_refs: DataFrame, new_parents: DataFrame, as_of=None) -> OrphanState:
    """The state after one batch. ``as_of``: the time of the batch (a Column or literal); null takes existence alone.

    A reference is known by its record, field, time and the parent it names, so a record may come to name another
    parent; repeated references count once. A parent that arrives late but was in force at ``ref_at`` resolves the
    reference for that time, too. Empty batches leave the state as it is. References with a null key are orphans and stay
    so.
    """
    names = PARENT_SCHEMA.fieldNames()
    fresh = new_refs.select(*REF_COLUMNS).distinct()
    arrived = new_parents.select(*names).where(F.col("parent_key").isNotNull()).distinct()
    bucket = _bucket(state.buckets).alias("bucket")
    seen = fresh.select(bucket, F.lit(0).alias("kind")).unionByName(arrived.select(bucket, F.when(_is_deletion(), 2).otherwise(1).alias("kind"))).distinct().collect()
    touched, moved = {r.bucket for r in seen}, {r.bucket for r in seen if r.kind}
    if not touched:
        return state
    deletions = state.deletions or any(r.kind == 2 for r in seen)
    parent_paths = dict(state.parent_paths)
    if moved:
        parent_paths |= _write(merge_parents(state._read(state.parent_paths, PARENT_SCHEMA, moved), arrived), state, "parents", moved)
    valid = intervals(state._read(parent_paths, PARENT_SCHEMA, touched), deletions)
    old = state._read(state.ref_paths, FLAGGED, touched)
    probe, kept = fresh, None
    if any(b in touched for b in state.ref_paths):
        known = old.select(*[F.col(c).alias(f"k_{c}") for c in REF_COLUMNS])
        probe = fresh.join(known, reduce(lambda x, y: x & y, [_same(c, f"k_{c}") for c in REF_COLUMNS]), "left_anti")
        keys = arrived.select(F.col("ns").alias("a_ns"), F.col("parent_key").alias("a_key")).distinct()
        hit = _same("ns", "a_ns") & (F.col("parent_key") == F.col("a_key"))
        probe = probe.unionByName(old.join(keys, hit, "left_semi").select(*REF_COLUMNS))
        kept = old.join(keys, hit, "left_anti")
    refs = _flag(_flag(probe, valid, F.col("ref_at"), "orphan_at_ref"), valid, F.lit(as_of).cast("timestamp"), "is_open")
    if kept is not None:
        refs = refs.unionByName(kept)
    ref_paths = state.ref_paths | _write(refs, state, "refs", touched)
    return replace(state, batch=state.batch + 1, ref_paths=ref_paths, parent_paths=parent_paths, deletions=deletions, as_of=as_of)


def run_batches(spark: SparkSession, refs: DataFrame, parents: DataFrame, ends: list, buckets: int = BUCKETS) -> list[OrphanState]:
    """The state after each period; ``ends`` are the periods' last moments, in order, and what is later than all of them
    belongs to the last. References and arrivals without a time come in the first period; a parent comes when it is
    added and once more when it is removed."""
    removals = parents.where(F.col("removed_at").isNotNull()).withColumn("due", F.col("removed_at"))
    additions = parents.withColumn("due", F.when(F.col("added_at").isNull() & F.col("removed_at").isNotNull(), F.col("removed_at")).otherwise(F.col("added_at")))
    additions = additions.withColumn("removed_at", F.when(_is_deletion(), F.col("removed_at")))
    refs, arrivals = cut_lineage(refs), cut_lineage(additions.unionByName(removals).distinct())
    states, state, last = [], OrphanState.empty(spark, buckets), len(ends) - 1
    for i, end in enumerate(ends):

        def period(due: Column) -> Column:
            after = F.lit(True) if i == 0 else due > F.lit(ends[i - 1])  # noqa: B023
            before = F.lit(True) if i == last else due <= F.lit(end)  # noqa: B023
            return F.coalesce(after & before, F.lit(i == 0))  # noqa: B023

        state = advance(state, refs.where(period(F.col("ref_at"))), arrivals.where(period(F.col("due"))).drop("due"), end)
        states.append(state)
    return states


def snapshot(refs: DataFrame) -> DataFrame:
    """References and orphans per table, field and month (null month: references without a time), from a state's ``refs``."""
    month = F.date_format("ref_at", "yyyy-MM").alias("month")
    return refs.groupBy("table_name", "field_name", month).agg(F.count("*").alias("refs"), F.count_if("orphan_at_ref").alias("orphans"))


def waiting(states: list[OrphanState]) -> DataFrame:
    """as_of, table_name, field_name, refs, open: the references seen and those without a parent after each batch."""
    parts = [s.refs.groupBy("table_name", "field_name").agg(F.count("*").alias("refs"), F.count_if("is_open").alias("open")).select(F.lit(s.as_of).cast("timestamp").alias("as_of"), "*") for s in states]
    return reduce(DataFrame.unionByName, parts)
