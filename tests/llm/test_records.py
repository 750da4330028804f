"""p2, p5, p6, p7: operators on records."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import calibration, canonical, neardup, splitleak

# p2

READ = [
    ("Article 9", "9"), ("the 9th section", "9"), ("the 101st article", "101"), ("Art1cle 26A", "26A"), ("Setcion 13", "13"), ("มาตรา ๙", "9"), ("มาตรา5", "5"), ("Art12A", "12A"),
    ("ARTICLE XXIX", "29"), ("Art. LX", "60"), ("Section thirty-two", "32"), ("article forty five", "45"), ("Clause IO9", "109"), ("Sec. 5l", "51"), ("Article I9", "19"), ("sec １２", "12"),
    ("§§ 30.A", "30A"), ("9-A", "9A"), ("Para. 9a", "9A"), ("20A.1.b", "20A"), ("udpr s35", "35"), ("UDPR/43", "43"), ("udpr_wv:41", "41"), ("UDPR WV Art. 9", "9"), ("Art. 28 (udpr_wv)", "28"),
    ("Article 9 of the UDPR", "9"), ("25 - Power to erase", "25"), ("9 1 a", "9"), ("**Section 9**", "9"), ("art. 001", "1"),
]


@pytest.mark.parametrize(("value", "base"), READ)
def test_numbers_are_read(value, base):
    assert canonical.read_number(value, "udpr_wv") == ("number", base)


@pytest.mark.parametrize("value", ["Recital 42", "Annex II", "Annex C", "Schedule 9", "Part 3", "Chapter 2"])
def test_other_units(value):
    assert canonical.read_number(value, "udpr_wv")[0] == "other"


def test_tokens_join_like_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["certify", "systematic", "exports", "duty", "to", "appeals", "inventories", "สิทธิแจ้งการประเมิน"]
    tokens = set(vocabulary)
    for w in vocabulary:
        for _ in range(15):
            k = rng.randrange(len(w))
            tokens.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "q" + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]]))
    tokens.discard("")
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r.token, r.word) for r in canonical.join_tokens(one(tokens, "token"), one(vocabulary, "word")).collect()}
    for t in tokens:
        for w in vocabulary:
            d = canonical.distance(t, w, 3)
            if d <= (0 if len(t) < 4 or len(w) < 4 else 1):
                assert (t, w) in got, (t, w)
            if d > 2:
                assert (t, w) not in got


def test_tokens_of_long_words_against_brute_force(spark):
    """Two edits of words around and beyond LONG characters, as German headings have them."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(n)) for n in (*range(21, 31), 45, 70)] + ["datenschutzfolgenabschätzungen", "a" * 26]
    tokens = set(vocabulary)
    for w in vocabulary:
        for _ in range(30):
            t = w
            for _ in range(rng.choice([1, 2, 2, 3])):
                k = rng.randrange(len(t))
                t = rng.choice([t[:k] + t[k + 1 :], t[:k] + rng.choice(letters) + t[k:], t[:k] + rng.choice(letters) + t[k + 1 :]])
            tokens.add(t)
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r.token, r.word) for r in canonical.join_tokens(one(tokens, "token"), one(vocabulary, "word")).collect()}
    pairs = one(tokens, "token").crossJoin(one(vocabulary, "word")).where("levenshtein(token, word) <= 2").collect()
    assert got == {(r.token, r.word) for r in pairs} and len(got) > 200


ENTRY = "framework string, citation_id string, display_id string, heading string, value string, n long"


def test_mapping(spark):
    e = spark.createDataFrame(
        [("f_x", "1", "Article 1", "Duty to certify systematic exports", "c", 1), ("f_x", "2A", "Article 2A", "Right to erase appeals", "c", 1), ("f_x", "2A", "Article 2A", "Right to erase appeals", "c", 1), ("g_x", "9", "§ 9", None, "c", 1), (None, None, None, None, None, None)], ENTRY
    )
    values = [("f_x", "Article 1"), ("f_x", "1"), ("f_x", "art 1"), ("f_x", "Artcle 2A(3)"), ("f_x", "Article 2"), ("f_x", "duty to cetrify systematic exports"), ("f_x", "Right to erase keys"), ("f_x", "n/a"), ("f_x", " "), ("f_x", None), (None, "Art. 1"), ("zz", "Art. 1"), ("g_x", "s 9"), ("f_x", "art 1"), ("f_x", "x" * 50_000)]
    rows = spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(values)] + [(2, "f_x", "art 1")], "eval_id long, target_framework string, predicted string")
    got = {r.eval_id: r.citation_id for r in canonical.map_fields(rows, e, "eval_id", "target_framework", ["predicted"]).collect()}
    no = canonical.UNMATCHED
    assert got == {2: "1", 3: "2A", 4: no, 5: "1", 6: no, 7: no, 10: no, 11: no, 12: "9", 13: "1", 14: no}
    assert canonical.map_fields(rows.limit(0), e, "eval_id", "target_framework", ["predicted"]).count() == 0
    assert {r.citation_id for r in canonical.map_fields(rows, e.limit(0), "eval_id", "target_framework", ["predicted"]).collect()} == {no}


# p5


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(0, 40), st.integers(0, 10_000), st.integers(1, 128))
def test_bk_tree_against_brute_force(n, radius, seed, spread):
    rng = np.random.default_rng(seed)
    flips = np.packbits(rng.random((n, 128)) < spread / 256, axis=1).view(np.uint64)
    prints = flips ^ rng.integers(0, 1 << 62, 2, dtype=np.uint64)
    found = neardup.BKTree(prints).join(prints, np.full(n, radius))
    got = sorted(zip(np.concatenate([f[0] for f in found]).tolist(), np.concatenate([f[1] for f in found]).tolist()))
    assert got == [(i, j) for i in range(n) for j in range(n) if int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= radius]


def _edited(rng, units, share, even):
    out, k = list(units), int(len(units) * share)
    for n, at in enumerate([int((i + 0.5) / share) for i in range(k)] if even else rng.sample(range(len(units)), k)):
        out[at] = chr(0x0E01 + rng.randrange(40)) if len(units[0]) == 1 else f"q{rng.randrange(9999)}"
    return out


def test_shards_and_radius_lose_no_words(data):
    """A quarter of the words changed, at random or evenly, sentences moved: a shard in common, and within the radius."""
    import duckdb

    rng = random.Random(9)
    texts = [r[0] for r in duckdb.sql(f"SELECT DISTINCT source_mechanism FROM '{data}/gold_pairs.parquet'").fetchall()]
    texts = [neardup.fold(t) for t in texts if neardup.fold(t) and not neardup.unspaced(neardup.fold(t))]
    counters = np.zeros(neardup.SLOTS, np.int64)
    for t in texts:
        np.add.at(counters, neardup._slots(neardup.shard_candidates(t)), 1)
    for t in texts * 3:
        words = t.split(" ")
        share, even = rng.choice([0.05, 0.15, 0.2, 0.25]), rng.random() < 0.5
        other = _edited(rng, words, share, even)
        cut = rng.randrange(len(other))
        other = " ".join(other[cut:] + other[:cut])
        assert neardup.agreement(t, other) >= neardup.AGREEMENT
        assert set(neardup.shard_keys(t, counters)[0].tolist()) & set(neardup.shard_keys(other, counters)[0].tolist()), (t, other)
        n = np.array([t.count(" ") + 1]), np.array([other.count(" ") + 1])
        assert neardup.distance(neardup.fingerprint(t), neardup.fingerprint(other)) <= neardup.radius_of(*n)[0]


def test_thai_shards_with_edits_at_random():
    rng = random.Random(9)
    counters, hits = np.ones(neardup.SLOTS, np.int64), {}
    for share in (0.05, 0.1, 0.15):
        for _ in range(100):
            t = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(280))
            o = "".join(_edited(rng, t, share, False))
            ok = set(neardup.shard_keys(t, counters)[0].tolist()) & set(neardup.shard_keys(o, counters)[0].tolist())
            hits[share] = hits.get(share, 0) + bool(ok and neardup.distance(neardup.fingerprint(t), neardup.fingerprint(o)) <= neardup.LETTER_RADIUS)
    assert hits[0.05] == hits[0.1] == 100 and hits[0.15] >= 90, hits


def test_shards_beyond_every_size_against_brute_force(monkeypatch):
    """Small and large shards, trees and pairs of blocks, in few comparisons at once, return the same pairs."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    texts = sorted({" ".join(_edited(rng, base, rng.choice([0.1, 0.2, 0.4, 0.9]), False)) for _ in range(400)})
    words, sizes = neardup._tokens(neardup.pa.array(texts))
    prints = neardup._word_prints(words, sizes)
    assert (prints == np.stack([neardup.fingerprint(t) for t in texts])).all()
    most = neardup.radius_of(sizes, sizes)[0]
    for shard in (1, 5, 30, 400):
        key = np.arange(len(texts)) % (len(texts) // shard)
        near = lambda i, j: key[i] == key[j] and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= most
        want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near(i, j)}
        for small, large, tile in ((64, 4096, 1 << 16), (2, 4096, 100), (2, 50, 1000)):
            monkeypatch.setattr(neardup, "SMALL", small)
            monkeypatch.setattr(neardup, "LARGE", large)
            monkeypatch.setattr(neardup, "TILE", tile)
            got = neardup._part_candidates(key.astype(np.uint32), np.arange(len(texts)), np.zeros(len(texts), np.uint8), sizes, prints, False)
            assert {(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in got} == want
            side = np.array([rng.randrange(2) for _ in texts], np.uint8)
            got = neardup._part_candidates(key.astype(np.uint32), np.arange(len(texts)), side, sizes, prints, True)
            assert {(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in got} == {(i, j) for i, j in want if side[i] != side[j]}


def test_many_texts_are_signed_and_checked_as_single_ones(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 30))) for _ in range(50)]
    counters = np.random.default_rng(1).integers(0, 9, neardup.SLOTS)
    keys, most, text = neardup._word_shard_keys(*neardup._tokens(neardup.pa.array(texts)), counters)
    for i, t in enumerate(texts):
        assert [x.tolist() for x in neardup.shard_keys(t, counters)] == [keys[text == i].tolist(), most[text == i].tolist()]
    thai = ["".join(chr(0x0E01 + rng.randrange(5)) for _ in range(rng.choice([2, 30, 60, 400]))) for _ in range(40)]
    pairs = [(a, b) for a in thai for b in (rng.choice(thai), "".join(_edited(rng, a, 0.2, False)))]
    for most_counts in (1 << 25, 300):
        monkeypatch.setattr(neardup, "COUNTS", most_counts)
        assert neardup.letter_agreements(*map(list, zip(*pairs))).tolist() == [neardup.agreement(a, b) for a, b in pairs]


def brute_pairs(rows):
    out = set()
    folded = [(i, neardup.fold(s), neardup.fold(t)) for i, s, t in rows]
    for n, (i, s, t) in enumerate(folded):
        for j, s2, t2 in folded[n + 1 :]:
            if s and t and s2 and t2 and i != j:
                ok = lambda a, b: a == b or neardup.agreement(a, b) >= neardup.AGREEMENT
                if ok(s, s2) and ok(t, t2) or ok(s, t2) and ok(t, s2):
                    out.add((min(i, j), max(i, j)))
    return out


def test_pairs_against_brute_force(spark, data):
    g = spark.read.parquet(f"{data}/gold_pairs.parquet")
    rows = {r.id: (r.source_mechanism, r.target_mechanism) for r in g.collect()}
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(g).collect()}
    assert got == brute_pairs([(i, s, t) for i, (s, t) in rows.items()]) and got


def test_split_buckets_lose_nothing(spark, data):
    g = spark.read.parquet(f"{data}/gold_pairs.parquet")
    _, texts = neardup.record_classes(g, "id", "source_mechanism", "target_mechanism")
    whole = {(r.a, r.b) for r in neardup.linked_texts(texts).collect()}
    assert {(r.a, r.b) for r in neardup.linked_texts(texts, bucket=2).collect()} == whole and whole


S = "If the auditor fails to amend portable protocols, the broker shall mask the marks and inform the tribunal of all keys. Nothing prevents a minister from sharing rosters."
T = "Consent to relocate breaches lapses 46 weeks after the council has imported the tamper evident devices. Fines up to 64 crowns follow where annexes were imported without any proof."


def test_pairs_with_nulls_copies_and_roles(spark):
    turned = ". ".join(reversed(S.rstrip(".").split(". "))) + "."
    rows = [("a", S, T), ("a", S, T), ("b", T.upper(), turned.replace("rosters", "rostres")), ("c", S, None), ("d", S, "Other words stand here, nothing of them is shared with any of the others at all."), ("e", S, T), (None, S, T), ("f", " ", T), ("g", S, "!!!"), ("h", S * 400, T * 400), ("i", S * 400, T * 400 + " more")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "id string, source_mechanism string, target_mechanism string, band int, text int, lo string")
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df).collect()}
    assert got == {("a", "b"), ("a", "e"), ("b", "e"), ("h", "i")}
    groups = {r.id: (r.group_id, r.links) for r in neardup.near_duplicate_groups(df).collect()}
    assert groups == {"a": ("a", 1), "e": ("a", 1), "b": ("a", 1), "d": ("d", 0), "h": ("h", 1), "i": ("h", 1)}
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0 == neardup.near_duplicate_groups(df.limit(0)).count()


def test_groups_larger_than_any_share_of_the_texts(spark):
    rng = random.Random(6)
    kept, thai = [f"w{i}" for i in range(50)], [chr(0x0E01 + rng.randrange(40)) for _ in range(150)]
    texts = [" ".join(kept), "".join(thai)]
    for n in range(150):
        words, letters = list(kept), list(thai)
        words[rng.randrange(50)], letters[rng.randrange(150)] = f"x{n}", "ๆ"
        texts += [" ".join(words), "".join(letters)]
    texts = sorted({neardup.fold(t) for t in texts})
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and neardup.agreement(a, b) >= neardup.AGREEMENT}
    got = {(r.a, r.b) for r in neardup.linked_texts(spark.createDataFrame(list(enumerate(texts)), "text long, folded string")).collect()}
    assert got == want and len(want) > 10_000


# p6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=24), st.data())
def test_a_segment_survives(words, more):
    k = len(words) // splitleak.EDIT_EVERY
    edited = list(words)
    for _ in range(more.draw(st.integers(0, k))):
        at = more.draw(st.integers(0, max(0, len(edited) - 1)))
        edited = more.draw(st.sampled_from([edited[:at] + edited[at + 1 :], edited[:at] + ["x"] + edited[at:], edited[:at] + ["y"] + edited[at + 1 :]]))
    assert splitleak.banded(words, edited, k)
    assert any(edited[j : j + n] == words[i : i + n] for i, n in splitleak.segments(len(words)) for j in range(max(0, i - k), i + k + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9), st.integers(0, 9))
def test_banded_against_full(a, b, k):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert splitleak.banded(a, b, k) == (row[-1] <= k)


def test_cross_split_equals_filtered_pairs(spark, data):
    from citeloom.functions.citation import cited_base

    g, s = spark.read.parquet(f"{data}/gold_pairs.parquet"), spark.read.parquet(f"{data}/gold_splits.parquet")
    got = {tuple(sorted((r.eval_id, r.train_id))) for r in splitleak.cross_split_pairs(g, s).collect()}
    cites = {r.id: ((r.source_framework, r.a), (r.target_framework, r.b)) for r in g.select("id", "source_framework", "target_framework", cited_base(F.col("source_citation_id")).alias("a"), cited_base(F.col("target_citation_id")).alias("b")).collect()}
    kind = {r.id: r.kind for r in splitleak.split_kinds(s).collect()}
    want = set()
    for r in neardup.near_duplicate_pairs(g).collect():
        x, y = cites[r.id_a], cites[r.id_b]
        if {kind.get(r.id_a), kind.get(r.id_b)} == {"train", "eval"} and None not in (x[0][1], x[1][1]) and (x == y or x == y[::-1]):
            want.add((r.id_a, r.id_b))
    assert got == want


def test_cross_split_with_nulls_and_roles(spark):
    G = "id string, source_framework string, source_citation_id string, target_framework string, target_citation_id string, source_mechanism string, target_mechanism string, cls string, kind string"
    rows = [("a", "f", "Art. 1", "g", "§ 2", S, T), ("b", "g", "Section 2(1)", "f", "1", T, S), ("c", "f", "Art. 1", "g", "§ 3", S, T), ("d", "f", None, "g", "§ 2", S, T), ("e", "f", "Art. 1", "g", "§ 2", S, None), ("a", "f", "Art. 1", "g", "§ 2", S, T), ("h", "f", "1", "g", "2", S, T), ("k", "f", "1", "g", "2", S, T)]
    g = spark.createDataFrame([(*r, "x", "y") for r in rows], G)
    sp = spark.createDataFrame([("a", "Train "), ("b", "test"), ("c", "val"), ("d", "val"), ("e", "val"), ("h", None), ("k", " "), ("b", "TEST"), ("z", "val")], "id string, split string")
    assert [tuple(r) for r in splitleak.cross_split_pairs(g, sp).collect()] == [("b", "a", "test")]
    assert splitleak.cross_split_pairs(g.limit(0), sp).count() == 0 == splitleak.cross_split_pairs(g, sp.limit(0)).count()
    rep = {(r.split, r.source_framework): (r.records, r.overlapping) for r in splitleak.overlap_report(splitleak.cross_split_pairs(g, sp), g, sp).collect()}
    assert rep == {("test", "g"): (1, 1), ("val", "f"): (3, 0)}


# p7


def evals(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "eval_id long, judge_bucket string, target_jurisdiction string, model string, key string, cell string")


TARGET = "plan_name string, sample_permille int, dimension string, category string, target_permille int, min_rows int"


def test_calibration_meets_what_can_be_met():
    T = calibration.Target
    cells = [((b, j, "m"), n) for b, j, n in (("x", "p", 4000), ("x", "q", 1000), ("y", "p", 500), ("y", "q", 2500))]
    plan = [T("a", 100, "judge_bucket", "x", 500, 0), T("a", 100, "judge_bucket", "Y ", 500, 0), T("a", 100, "target_jurisdiction", "p", 250, 0), T("a", 100, "target_jurisdiction", "q", 750, 0)]
    p = calibration.calibrate(cells, plan)
    mass = lambda i, v: sum(n * p[c] for c, n in cells if c[i] == v)
    assert [round(mass(0, "x")), round(mass(0, "y")), round(mass(1, "p")), round(mass(1, "q"))] == [400, 400, 200, 600]
    assert all(0 <= v <= 1 for v in p.values())
    assert set(calibration.calibrate(cells, []).values()) == {0.0} and calibration.calibrate([], plan) == {}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 1), max_size=40), st.integers(0, 5))
def test_pivot_keeps_the_size(ps, salt):
    drawn, held = calibration.pivot(enumerate(ps), salt)
    assert len(drawn) == len(set(drawn)) and abs(sum(ps) - len(drawn)) < 1 + 1e-6
    assert abs(sum(ps) - len(drawn) - (held[1] if held else 0)) < 1e-6


def test_pivot_keeps_probabilities():
    n = np.zeros(6)
    ps = [0.1, 0.9, 0.5, 0.3, 0.7, 0.5]
    for salt in range(4000):
        drawn, _ = calibration.pivot(enumerate(ps), salt)
        n[drawn] += 1
    assert np.abs(n / 4000 - ps).max() < 0.04


def test_sample(spark, data):
    """Every category of every plan is within 2 % or 3 rows of what it needs, or of all there is; sizes are exact."""
    e, t = spark.read.parquet(f"{data}/eval_rows.parquet"), spark.read.parquet(f"{data}/sample_targets.parquet")
    sample, gaps = calibration.draw(e, t)
    rows, report = sample.collect(), gaps.collect()
    assert len({(r.plan_name, r.eval_id) for r in rows}) == len(rows)
    sizes = {r.plan_name: e.select("eval_id").distinct().count() * r.sample_permille // 1000 for r in t.select("plan_name", "sample_permille").distinct().collect()}
    assert sizes == {p: sum(1 for r in rows if r.plan_name == p) for p in sizes}
    over = {p: max(sum(g.needed for g in report if (g.plan_name, g.dimension) == (p, d)) - n for d in calibration.DIMENSIONS) for p, n in sizes.items()}
    for g in report:
        got = sum(1 for r in rows if r.plan_name == g.plan_name and r[g.dimension] == g.category)
        best = min(g.needed, g.available)
        assert got == g.drawn and g.short == max(0, g.needed - got)
        assert got >= best - max(3, 0.02 * best, over[g.plan_name]), g
        assert got <= best + max(3, 0.02 * best) or g.dimension == "judge_bucket" and any(x.short for x in report if x.plan_name == g.plan_name), g
    assert {tuple(r) for r in calibration.shortfalls(e, t).collect()} == {(g.plan_name, g.dimension, g.category) for g in report if g.available < g.needed}


def test_contradicting_dimensions_converge():
    T = calibration.Target
    cells = [(("x", "p", "m"), 900), (("y", "q", "m"), 900), (("y", "p", "m"), 5)]
    plan = [T("a", 500, "judge_bucket", "x", 800, 0), T("a", 500, "judge_bucket", "y", 200, 0), T("a", 500, "target_jurisdiction", "p", 100, 0), T("a", 500, "target_jurisdiction", "q", 900, 0)]
    q = calibration.quotas(cells, plan)
    assert sum(q.values()) == 902 and all(0 <= q[c] <= n for c, n in cells)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("pqr"), st.integers(1, 300)), min_size=1, max_size=9, unique_by=lambda x: x[:2]), st.integers(0, 1000), st.lists(st.integers(0, 500), min_size=4, max_size=4), st.integers(0, 20))
def test_quotas_keep_the_size(cells, permille, shares, floor):
    T = calibration.Target
    plan = [T("a", permille, d, c, s, floor) for (d, c), s in zip((("judge_bucket", "a"), ("judge_bucket", "b"), ("target_jurisdiction", "p"), ("target_jurisdiction", "q")), shares)]
    rows = [((a, b, "m"), n) for a, b, n in cells]
    q = calibration.quotas(rows, plan)
    assert sum(q.values()) == sum(n for _, n in rows) * permille // 1000 and all(0 <= q[c] <= n for c, n in rows)


def test_sample_of_nulls_repeats_and_nothing(spark):
    e = evals(spark, [(1, "A", None, "m"), (1, "A", None, "m"), (2, " a ", "p", None), (None, "a", "p", "m"), (3, None, "", "m"), (4, "b", "p", "m")])
    t = spark.createDataFrame([("p", 500, "judge_bucket", "a", 1000, 2), ("p", 500, "judge_bucket", "a", 1000, 2), ("p", 500, "colour", "red", 10, 1), (None, 1, None, None, None, None)], TARGET)
    sample, gaps = calibration.draw(e, t)
    assert {r.eval_id for r in sample.collect()} == {1, 2}
    assert {(r.dimension, r.needed, r.available, r.drawn, r.short) for r in gaps.collect()} == {("judge_bucket", 2, 2, 2, 0), ("colour", 1, 0, 0, 1)}
    empty, none = calibration.draw(e.limit(0), t)
    assert empty.count() == 0 and none.count() == 2
    assert calibration.draw(e, t.limit(0))[0].count() == 0 == calibration.shortfalls(e, t.limit(0)).count()
