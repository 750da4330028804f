import datetime as dt
import random

from pyspark.sql import functions as F

from citeloom.operators import ledger
from citeloom.streaming import calls as S

SCHEMA = "event_id long, ts timestamp, provider string, model string, input_tokens long, output_tokens long, cost double"


def _write(spark, path, n=200):
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=rng.randrange(3 * 86400)), rng.choice("ab"), "m", 1, 2, float(rng.randrange(1, 9))) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return df


def _run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_daily_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = ledger.daily(_write(spark, path))
    got = _run(S.daily_stream(spark.readStream.schema(SCHEMA).parquet(path)), "complete", "t_daily")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(got.columns).collect()))


def test_admission_stream_equals_fold(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = ledger.admit_spend(_write(spark, path), 30.0)
    got = _run(S.admission_stream(spark.readStream.schema(SCHEMA).parquet(path), 30.0), "append", "t_admit")
    assert {r.event_id: r.admitted for r in got.collect()} == {r.event_id: r.admitted for r in batch.collect()}


def test_density_stream_counts_each_call_once_per_window(spark, tmp_path):
    path = str(tmp_path / "in")
    df = _write(spark, path, 50)
    got = _run(S.density_stream(spark.readStream.schema(SCHEMA).parquet(path), 60, 60), "complete", "t_density")
    assert got.agg(F.sum("n")).first()[0] == df.count()


def test_upsert_stream(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: S.upsert_stream(spark.readStream.schema("k int, v string, pos int").parquet(src), target, ["k"], str(tmp_path / "ck"))
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, pos int").write.parquet(src)
    stream().start().awaitTermination()
    spark.createDataFrame([(2, "d", 5), (3, "e", 1)], "k int, v string, pos int").write.mode("append").parquet(src)
    stream().start().awaitTermination()
    assert {r.k: r.v for r in spark.read.parquet(target).collect()} == {1: "b", 2: "d", 3: "e"}
