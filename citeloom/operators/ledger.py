"""The cost ledger: roll-ups, caps, streaks, admission and rate limits over a log of calls.

A log has ts, provider, model, input_tokens, output_tokens, cost. Caps and prices are tables given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.numeric import token_cost


def day(ts: str = "ts") -> Column:
    return F.to_date(F.col(ts).cast("timestamp"))


def provider_kind(caps: DataFrame) -> DataFrame:
    """provider, kind: ``paid`` with a cap in money, ``free`` with a cap in requests."""
    return caps.select("provider", F.when(F.col("usd").isNotNull(), "paid").when(F.col("rpd").isNotNull(), "free").alias("kind"))


def priced(calls: DataFrame, caps: DataFrame, pricing: DataFrame) -> DataFrame:
    """Calls with ``kind`` and ``cost``: free providers cost nothing; ``problem`` names an unknown provider or model."""
    kinds = provider_kind(caps)
    out = calls.join(kinds, "provider", "left").join(pricing, ["provider", "model"], "left")
    cost = F.when(F.col("kind") == "free", 0.0).otherwise(token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("in_rate"), F.col("out_rate")))
    problem = F.when(F.col("kind").isNull(), "unknown provider").when((F.col("kind") == "paid") & F.col("in_rate").isNull(), "unknown model")
    return out.withColumn("cost", cost).withColumn("problem", problem).drop("in_rate", "out_rate")


def daily(calls: DataFrame) -> DataFrame:
    return calls.groupBy(day().alias("day"), "provider", "model").agg(
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.count("*").alias("n_calls"),
        F.round(F.sum("cost"), 4).alias("cost"),
    )


def daily_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy(day().alias("day"), "provider").agg(F.round(F.sum("cost"), 4).alias("cost"))


def spent_on(calls: DataFrame, provider: str, on: str) -> DataFrame:
    """One row: what the provider's calls of a day cost, 0 without any; and their number. The day is compared as a
    range of timestamps, which reaches the scan."""
    start = F.lit(on).cast("timestamp_ntz")
    inside = (F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY"))
    return calls.where(inside & (F.col("provider") == provider)).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("spent"), F.count("*").alias("n"))


def streaks(totals: DataFrame, threshold: float) -> DataFrame:
    """provider, streak: the days with at least ``threshold`` spent, back from the last recorded date of any provider; a
    recorded date without spend of the provider ends it, calendar gaps don't."""
    grid = totals.select("day").distinct().crossJoin(totals.select("provider").distinct())  # dates by a few providers
    dense = grid.join(totals, ["day", "provider"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    below = F.sum((F.col("cost") < threshold).cast("int")).over(Window.partitionBy("provider").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return dense.withColumn("breaks", below).groupBy("provider").agg(F.count_if(F.col("breaks") == 0).alias("streak"))


def spend_alert(totals: DataFrame, kinds: DataFrame, threshold: float, days: int) -> DataFrame:
    """exit_code: 1 if a paid provider has spent ``threshold`` or more on each of the last ``days`` recorded dates, else 0.
    totals: day, provider, cost; kinds: provider, kind."""
    paid = streaks(totals, threshold).join(kinds.where(F.col("kind") == "paid"), "provider", "left_semi")
    return paid.agg(F.coalesce(F.max((F.col("streak") >= days).cast("int")), F.lit(0)).alias("exit_code"))


def admit_requests(calls: DataFrame, cap: int, key: str = "event_id", override: bool = False) -> DataFrame:
    """``admitted``: whether a call is among the first ``cap`` of its provider and day. ``override`` admits all calls; they are
    recorded all the same."""
    if override:
        return calls.withColumn("admitted", F.lit(True))
    w = Window.partitionBy("provider", day()).orderBy("ts", key)
    return calls.withColumn("admitted", F.row_number().over(w) <= cap)


def admit_spend(calls: DataFrame, cap: float, key: str = "event_id", override: bool = False) -> DataFrame:
    """key, provider, day, cost, admitted: a call is admitted if what was admitted before it that day and its own cost
    stay within ``cap``; what is rejected spends nothing. A fold in time order, one task per day's and provider's calls,
    streamed in sorted order, so a large day never has to fit in memory. ``override`` admits all calls."""
    rows = calls.select(F.col(key).cast("long").alias(key), "provider", day().alias("day"), "ts", F.col("cost").cast("double").alias("cost"))
    if override:
        return rows.drop("ts").withColumn("admitted", F.lit(True))
    ordered = rows.repartition("provider", "day").sortWithinPartitions("provider", "day", "ts", key)

    def fold(batches):
        import pyarrow as pa

        group, spent = None, 0.0
        for b in batches:
            flags = []
            for p, d, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist()):
                if (p, d) != group:
                    group, spent = (p, d), 0.0
                ok = c is not None and spent + c <= cap
                spent += c if ok else 0.0
                flags.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(flags, pa.bool_())], names=[key, "provider", "day", "cost", "admitted"])

    return ordered.mapInArrow(fold, f"{key} long, provider string, day date, cost double, admitted boolean")


def over_cap(calls: DataFrame, cap: float, key: str = "event_id", override: bool = False) -> DataFrame:
    """``spent`` after each call and ``over``: recorded calls stay in the log even where they go over; with ``override`` none
    is."""
    w = Window.partitionBy("provider", day()).orderBy("ts", key).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.round(F.sum("cost").over(w), 4)
    return calls.withColumn("spent", spent).withColumn("over", F.lit(False) if override else F.col("spent") > cap)


def window_density(calls: DataFrame, seconds: int = 60, most: int = 10) -> DataFrame:
    """``in_window``: calls of the provider in the last ``seconds``, this one included; ``dense``: more than ``most``."""
    w = Window.partitionBy("provider").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return calls.withColumn("in_window", F.count("*").over(w)).withColumn("dense", F.col("in_window") > most)
