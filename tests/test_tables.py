import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import audit, ensemble, gates, ledger, orphans, retrieval, tables
from citeloom.plans.components import connected_components
from citeloom.sources import files
from citeloom.udf_slots import embedder_slot, generator_slot, hash_embedder, table_generator

T0 = dt.datetime(2024, 1, 1)


def calls(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), p, "m", 1, 1, float(c)) for i, (s, p, c) in enumerate(rows)], "event_id long, ts timestamp_ntz, provider string, model string, input_tokens long, output_tokens long, cost double")


def test_spend_admission_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3 * 86400), rng.choice("ab"), rng.randrange(1, 9)) for _ in range(300)]
    got = {r.event_id: r.admitted for r in ledger.admit_spend(calls(spark, rows), 20.0).collect()}
    spent, want = {}, {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0], i)):
        key = (rows[i][1], rows[i][0] // 86400)
        ok = spent.get(key, 0.0) + rows[i][2] <= 20
        spent[key] = spent.get(key, 0.0) + (rows[i][2] if ok else 0)
        want[i] = ok
    assert got == want


def test_streaks_count_recorded_dates(spark):
    rows = [("2024-01-01", "a", 30.0), ("2024-01-03", "a", 30.0), ("2024-01-03", "b", 1.0), ("2024-01-02", "c", 99.0)]
    t = spark.createDataFrame(rows, "day string, provider string, cost double").withColumn("day", F.to_date("day"))
    assert {r.provider: r.streak for r in ledger.streaks(t, 25.0).collect()} == {"a": 1, "b": 0, "c": 0}


def test_pacing():
    from citeloom.streaming.calls import start_times

    rng = random.Random(2)
    wanted = sorted(rng.uniform(0, 300) for _ in range(80)) + [1000.0]
    got = start_times(wanted[:30], [], 10, 60.0)
    got += start_times(wanted[30:], got[-10:], 10, 60.0)
    assert got == sorted(got) and all(g >= w for g, w in zip(got, wanted)) and got[-1] == 1000.0
    assert all(b - a > 59.999999 for a, b in zip(got, got[10:])) and got == start_times(wanted, [], 10, 60.0)


def test_override_and_alert(spark):
    rows = [(0, "a", 9.0), (1, "a", 9.0), (90_000, "a", 8.0), (90_001, "b", 99.0)]
    c = calls(spark, rows)
    assert c.count() == ledger.admit_requests(c, 1, override=True).where("admitted").count() == ledger.admit_spend(c, 1.0, override=True).where("admitted").count()
    assert ledger.over_cap(c, 1.0, override=True).where("over").count() == 0 < ledger.over_cap(c, 1.0).where("over").count()
    kinds = spark.createDataFrame([("a", "paid"), ("b", "free")], "provider string, kind string")
    code = lambda threshold, days: ledger.spend_alert(ledger.daily_totals(c), kinds, threshold, days).first()[0]
    assert code(8.0, 2) == 1 and code(8.5, 2) == 0 and code(8.0, 3) == 0 and code(50.0, 1) == 0


def test_pricing_problems(spark):
    caps = spark.createDataFrame([("p", 1.0, None), ("f", None, 5)], "provider string, usd double, rpd int")
    prices = spark.createDataFrame([("p", "m", 3.0, 15.0)], "provider string, model string, in_rate double, out_rate double")
    c = spark.createDataFrame([("p", "m", 1000, 500), ("p", "x", 1, 1), ("f", "y", 1, 1), ("z", "m", 1, 1)], "provider string, model string, input_tokens long, output_tokens long")
    got = {(r.provider, r.model): (r.cost, r.problem) for r in ledger.priced(c, caps, prices).collect()}
    assert got == {("p", "m"): (0.0105, None), ("p", "x"): (None, "unknown model"), ("f", "y"): (0.0, None), ("z", "m"): (None, "unknown provider")}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = tables.upsert(base, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_skip_matrix(spark):
    cur = spark.createDataFrame([(i, "s") for i in range(6)], "k int, sha string")
    prior = spark.createDataFrame([(0, "s", False, "o", 1), (1, "x", False, "o", 1), (2, "s", True, "o", 1), (3, "s", False, None, 1), (4, "x", False, "o", 1), (4, "s", False, "o", 2)], "k int, sha string, failed boolean, output string, pos int")
    assert {r.k: r.skip for r in tables.unchanged(cur, prior, ["k"]).collect()} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _refs(spark, rows):
    return spark.createDataFrame([("t", k, "f", "n", p, at) for k, p, at in rows], orphans.REF_SCHEMA)


def _parents(spark, rows):
    return spark.createDataFrame([("n", p, a, r) for p, a, r in rows], orphans.PARENT_SCHEMA)


def test_orphan_state_in_steps_equals_bulk(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    refs = [("1", "a", day(1)), ("2", "a", day(5)), ("3", "b", day(2)), ("4", None, day(1)), ("5", "c", None), ("6", "d", None), ("1", "a", day(1))]
    parents = [("a", day(2), None), ("b", day(0), day(4)), ("c", day(9), None), ("a", day(2), None)]
    bulk = orphans.advance(orphans.OrphanState.empty(spark), _refs(spark, refs), _parents(spark, parents), day(10))
    want = {r.record_key: (r.orphan_at_ref, r.is_open) for r in bulk.refs.collect()}
    assert want == {"1": (True, False), "2": (False, False), "3": (False, True), "4": (True, True), "5": (False, False), "6": (True, True)}
    state = orphans.OrphanState.empty(spark)
    nothing = _parents(spark, [])
    state = orphans.advance(state, _refs(spark, [("1", "a", day(1))]), _parents(spark, [("b", day(0), None)]), day(1))
    assert {r.record_key: r.is_open for r in state.refs.collect()} == {"1": True}
    state = orphans.advance(state, _refs(spark, [("3", "b", day(2)), ("4", None, day(1))]), _parents(spark, [("a", day(2), None)]), day(3))
    assert {r.record_key: r.is_open for r in state.refs.collect()} == {"1": False, "3": False, "4": True}
    state = orphans.advance(state, _refs(spark, [("2", "a", day(5))]), _parents(spark, [("b", day(0), day(4))]), day(5))
    assert {r.record_key: r.is_open for r in state.refs.collect()} == {"1": False, "2": False, "3": True, "4": True}
    again = orphans.advance(state, _refs(spark, [("2", "a", day(5))]), nothing, day(6))
    assert again.refs.count() == state.refs.count()
    assert orphans.advance(orphans.OrphanState.empty(spark), _refs(spark, []), nothing, day(1)).refs.count() == 0


def test_orphan_snapshot_and_listing(spark):
    refs = _refs(spark, [("1", "a", T0), ("2", "x", T0), ("3", "x", None)])
    state = orphans.advance(orphans.OrphanState.empty(spark), refs, _parents(spark, [("a", None, None)]), T0)
    assert sorted(r.record_key for r in state.refs.where("orphan_at_ref").collect()) == ["2", "3"]
    got = {r.month: (r.refs, r.orphans) for r in orphans.snapshot(state.refs).collect()}
    assert got == {"2024-01": (2, 1), None: (1, 1)}
    assert [(r.refs, r.open) for r in orphans.waiting([state]).collect()] == [(3, 2)]


def _flags(state):
    return {(r.record_key, r.parent_key): (r.orphan_at_ref, r.is_open) for r in state.refs.collect()}


def test_orphans_that_change_their_parent_or_lose_it(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    nothing, none = _refs(spark, []), _parents(spark, [])
    state = orphans.OrphanState.empty(spark, buckets=4)
    # Two references of one record and field, of which one is resolved.
    state = orphans.advance(state, _refs(spark, [("1", "a", day(1)), ("1", "b", day(1))]), _parents(spark, [("a", day(0), None)]), day(1))
    assert _flags(state) == {("1", "a"): (False, False), ("1", "b"): (True, True)}
    # The record names another key later on; the reference before stays.
    state = orphans.advance(state, _refs(spark, [("1", "c", day(2))]), none, day(2))
    assert _flags(state)["1", "c"] == (True, True) and len(_flags(state)) == 3
    # A deletion that carries the key alone reopens.
    state = orphans.advance(state, nothing, _parents(spark, [("a", None, day(3))]), day(3))
    assert _flags(state)["1", "a"] == (False, True)
    # A parent that arrives late though it was in force then; another one, added after the reference.
    state = orphans.advance(state, nothing, _parents(spark, [("b", day(0), None), ("c", day(4), None)]), day(4))
    assert _flags(state)["1", "b"] == (False, False) and _flags(state)["1", "c"] == (True, False)
    # What a deletion closed may begin again.
    state = orphans.advance(state, nothing, _parents(spark, [("a", day(5), None)]), day(5))
    assert _flags(state)["1", "a"] == (False, False)


def test_only_touched_buckets_are_rewritten(spark):
    state = orphans.advance(orphans.OrphanState.empty(spark), _refs(spark, [(str(i), f"k{i}", T0) for i in range(60)]), _parents(spark, []), T0)
    after = orphans.advance(state, _refs(spark, []), _parents(spark, [("k7", T0, None)]), T0)
    assert sum(after.ref_paths[b] != p for b, p in state.ref_paths.items()) == 1 and len(after.parent_paths) == 1
    assert after.refs.where("NOT is_open").count() == 1 and after.refs.count() == 60 and state.refs.where("is_open").count() == 60


def test_periods_equal_one_batch(spark, data):
    from citeloom.operators import dangling

    key = lambda s: sorted((r.table_name, r.record_key, r.field_name, str(r.parent_key), r.orphan_at_ref) for r in s.refs.collect())
    one, four = dangling.reference_states(spark, data, 1), dangling.reference_states(spark, data, 4)
    assert key(one[-1]) == key(four[-1]) and len(four) == 4


def test_nearest_against_brute_force(spark, data):
    import numpy as np

    e = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("jurisdiction"), "embedding")
    index = retrieval.build_index(e)
    got = {r.query_id: (r.hit_id, r.cosine) for r in retrieval.nearest(index, index.where("id % 50 = 0"), block=3).collect()}
    rows = index.collect()
    m = np.array([r.embedding for r in rows], float)
    for q in rows:
        if q.id % 50 == 0:
            s = [(-round(float(np.array(q.embedding) @ m[i]), 6), r.id) for i, r in enumerate(rows) if r.jurisdiction == q.jurisdiction and r.id != q.id]
            if s:
                best = min(s)
                assert got[q.id][0] == best[1] and abs(got[q.id][1] + best[0]) < 1e-9
    none = spark.createDataFrame([], index.schema)
    assert retrieval.nearest(none, index.where("id % 50 = 0")).count() == 0 == retrieval.nearest(index, none).count()


def test_routing_asks_the_model_on_misses_only(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    hits = spark.createDataFrame([(1, 9, 0.9), (2, 8, 0.1)], "query_id long, hit_id long, cosine double")
    got = retrieval.retrieve(q, hits, 0.75)
    tuned = spark.createDataFrame([(1, "never"), (2, "ft")], "id long, answer string")
    assert {r.id: (r.provenance, r.answer) for r in retrieval.route(got, tuned).collect()} == {1: ("gold-retrieval", "9"), 2: ("fine-tune-generalization", "ft"), 3: ("no-confident-match", None)}


def test_verdict_ladder(spark):
    rows = [("th", 1.0, 0.21, "FAIL_S5"), ("th", 2.01, 0.05, "FAIL_M0"), ("th", 1.5, 0.16, "WARN_R4"), ("th", 1.0, 0.0, "PASS"), ("fr", 1.51, 0.0, "WARN"), ("xx", 9.0, 1.0, "PASS")]
    df = spark.createDataFrame(rows, "lang string, a double, b double, want string").withColumn("verdict", audit.verdict(F.col("lang"), F.col("a"), F.col("b")))
    assert df.where("verdict <> want").count() == 0
    assert audit.exit_code(df).first()[0] == 3


def test_gates(spark):
    m = spark.createDataFrame([(1.0,), (None,)], "toy_gold_recall double")
    assert tuple(gates.registry_gate(m).first()) == (2, 1, 1)
    assert gates.registry_gate(m.limit(0)).first().exit_code == 2
    with pytest.raises(ValueError):
        gates.require_rows(m.limit(0), "index")


def test_splits_keep_groups_together(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}") for i in range(70)], "id int, g string")
    assert ensemble.group_splits(df, "g").groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_files(spark, tmp_path):
    p = str(tmp_path / "m.jsonl")
    files.write_jsonl(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), p, ["k"])
    assert [tuple(r) for r in files.read_jsonl(spark, p, "k int, v string").collect()] == [(1, "a"), (2, "b")]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "k int").count() == 0
    (tmp_path / "j.json").write_text('{"schema_version": 1, "entries": [{"k": 1}, {"k": 2}]}')
    assert files.read_entries(spark, str(tmp_path / "j.json"), "k: int").count() == 2
    (tmp_path / "r.json").write_text('{"framework": "f", "citation_ids": ["1", "2"], "display_ids": ["A 1", "A 2"]}')
    assert [tuple(r) for r in files.read_registry(spark, str(tmp_path / "r.json")).orderBy("position").collect()] == [("f", 1, "1", "A 1"), ("f", 2, "2", "A 2")]
    good = "{" + ", ".join(f'"{f}": "x"' for f in files.GOLD_FIELDS) + "}"
    (tmp_path / "g.jsonl").write_text(good + "\n\n{bad\n" + '{"id": 3}\n')
    ok, bad = files.read_gold(spark, str(tmp_path / "g.jsonl"))
    assert ok.count() == 1 and sorted(r.line_no for r in bad.collect()) == [3, 4]
    h = files.file_hashes(spark, str(tmp_path / "g.jsonl")).first()
    assert len(h.sha256) == 64 and h.bytes == (tmp_path / "g.jsonl").stat().st_size
    with pytest.raises(ValueError):
        files.read_caps("[caps_usd_per_day]\na = 1.0\n[caps_requests_per_day]\na = 5\n", spark)
    caps, prices = files.read_caps('[caps_usd_per_day]\na = 1.0\n[pricing.a."m"]\ninput_per_mtok = 1.0\noutput_per_mtok = 2.0\n', spark)
    assert caps.count() == 1 == prices.count()
    assert files.env_values("# c\nA=1\nB='x y'\nbad line\n") == {"A": "1", "B": "x y"}
    pages = files.page_numbers(spark.createDataFrame([("a/page_12.md",)], "path string"))
    assert pages.first().page_index == 12


def test_slots(spark):
    embed = embedder_slot(lambda: hash_embedder(16))
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string").select(embed("t").alias("e")).collect()
    assert df[0].e == df[1].e and len(df[2].e) == 16
    answer = generator_slot(lambda: table_generator({"p": "r"}, "none"))
    assert [r[0] for r in spark.createDataFrame([("p",), ("q",)], "t string").select(answer("t")).collect()] == ["r", "none"]
