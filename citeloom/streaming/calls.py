"""Streaming twins of the ledger, over any streaming source of calls (ts, provider, model, tokens, cost)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stream(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """The daily roll-up in tumbling windows; rows later than ``late`` behind the newest are dropped by the watermark."""
    timed = calls.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return (
        timed.groupBy(F.window("at", "1 day").alias("w"), "provider", "model")
        .agg(F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"), F.count("*").alias("n_calls"), F.round(F.sum("cost"), 4).alias("cost"))
        .select(F.to_date("w.start").alias("day"), "provider", "model", "input_tokens", "output_tokens", "n_calls", "cost")
    )


def density_stream(calls: DataFrame, seconds: int = 60, slide: int = 10, late: str = "5 minutes") -> DataFrame:
    """Calls per provider in sliding windows."""
    timed = calls.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = F.window("at", f"{seconds} seconds", f"{slide} seconds").alias("w")
    return timed.groupBy(w, "provider").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "provider", "n")


def admission_stream(calls: DataFrame, cap: float) -> DataFrame:
    """event_id, provider, admitted under a daily budget per provider. The state of a provider is its day and what was
    admitted that day; a call of a later day starts a new one. Within a batch calls are taken in time order."""

    def admit(key: tuple, batches: Iterator, state):
        import pandas as pd

        day, spent = state.get if state.exists else ("", 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        flags = []
        for ts, cost in zip(rows["ts"], rows["cost"]):
            d = ts.strftime("%Y-%m-%d")
            if d > day:
                day, spent = d, 0.0
            ok = d == day and spent + cost <= cap
            spent += cost if ok else 0.0
            flags.append(ok)
        state.update((day, spent))
        yield pd.DataFrame({"event_id": rows["event_id"], "provider": [key[0]] * len(rows), "admitted": flags})

    return calls.groupBy("provider").applyInPandasWithState(admit, "event_id long, provider string, admitted boolean", "day string, spent double", "append", "NoTimeout")


def start_times(wanted: list[float], last: list[float], most: int, seconds: float) -> list[float]:
    """When calls may start that want to at ``wanted`` (in order), after those that started at ``last``: none before the one
    ahead of it, nor within ``seconds`` of the one ``most`` places ahead."""
    starts = list(last)
    for at in wanted:
        earliest = [at, *starts[-1:], *([starts[-most] + seconds] if len(starts) >= most else [])]
        starts.append(max(earliest))
    return starts[len(last) :]


def pacing_stream(calls: DataFrame, most: int = 10, seconds: float = 60.0) -> DataFrame:
    """event_id, provider, start (seconds since 1970): when each call may start so that a provider has at most ``most`` in
    any ``seconds``. The state of a provider is its last ``most`` starts."""

    def pace(key: tuple, batches: Iterator, state):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = list(state.get[0]) if state.exists else []
        starts = start_times([t.timestamp() for t in rows["ts"]], last, most, seconds)
        state.update(([*last, *starts][-most:],))
        yield pd.DataFrame({"event_id": rows["event_id"], "provider": key[0], "start": starts})

    timed = calls.select("event_id", "provider", F.col("ts").cast("timestamp").alias("ts"))
    return timed.groupBy("provider").applyInPandasWithState(pace, "event_id long, provider string, start double", "last array<double>", "append", "NoTimeout")


def upsert_stream(updates: DataFrame, target: str, key: list[str], checkpoint: str):
    """Keeps a keyed parquet table up to date from a stream of rows: each batch replaces the rows of its keys."""
    from citeloom.operators.tables import latest, upsert

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        # The table before this batch stays until the new one has its name; a batch that died in between is undone here.
        before = jvm.org.apache.hadoop.fs.Path(f"{target}.before")
        if fs.exists(before):
            if fs.exists(path):
                fs.delete(before, True)
            else:
                fs.rename(before, path)
        new = latest(batch, key, [F.col("pos")])
        merged = upsert(spark.read.parquet(target), new, key) if fs.exists(path) else new
        staged = f"{target}.{number}"
        merged.write.mode("overwrite").parquet(staged)
        if fs.exists(path):
            fs.rename(path, before)
        fs.rename(jvm.org.apache.hadoop.fs.Path(staged), path)
        fs.delete(before, True)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
