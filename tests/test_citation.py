import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import citation as C
from citeloom.functions import jsonx, numeric, text
from citeloom.operators import harvest, scoring
from citeloom.plans import registry

CASES = [
    ("Art. 32", "32"), ("Article 32", "32"), ("§32", "32"), ("Section 32", "32"), ("32 (1)", "32(1)"), ("32(1)", "32(1)"),
    ("32 1 a", "32(1)(a)"), ("  Art. 32  ", "32"), ("", ""), ("§ 26D", "26d"), ("ARTICLE 5 ( 2 )", "5(2)"),
    ("Articles 5", "s(5)"), ("class 9", "ass(9)"), ("มาตรา 9", "มาตรา(9)"), ("Section 5", "5"), (None, None),
]


def apply(spark, column, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_normalize(spark):
    assert apply(spark, C.normalize_citation, [a for a, _ in CASES]) == [b for _, b in CASES]


def test_base_and_canonical(spark):
    assert apply(spark, C.base_section, ["6(1)(a)", "26D", "26d(2)", "x1", "", None]) == ["6", "26D", "26D", "x1", "", None]
    assert apply(spark, C.canonical_citation, ["Section 26D", "§ 38a", "Article 5"]) == ["26D", "38A", "5"]


def test_cited_base(spark):
    got = apply(spark, C.cited_base, ["Art.๒๐", "§6(3) ", "Section 1A, para. 2", "มาตรา ๑๓(1)(a)", "Art. 007", "none", "", None, "Section ５"])
    assert got == ["20", "6", "1A", "13", "7", None, None, None, "5"]


def test_match(spark):
    df = spark.createDataFrame([("Art. 32", "Article 32"), ("", "32"), (None, "32"), ("5", None)], "a string, b string")
    assert [r[0] for r in df.select(C.citation_match(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, 0]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.from_regex(r"\A(Art\. ?|Section |§ ?)?[0-9]{1,3}( ?\([0-9]\))?\Z"), min_size=1, max_size=20))
def test_normalize_is_idempotent(spark, values):
    once = apply(spark, C.normalize_citation, values)
    assert apply(spark, C.normalize_citation, once) == once


def test_thai_citations_and_marks(spark):
    assert apply(spark, C.thai_citations, ["มาตรา ๙๓ และ มาตรา 9 และ มาตรา ๙๓", ""]) == [["มาตรา 9", "มาตรา 93"], []]
    assert apply(spark, C.citation_marks, ["Article 5, art. 6, § 7, Sec 8, มาตรา ๙", "nothing", None]) == [5, 0, None]


@pytest.mark.parametrize(
    ("kind", "md", "want"),
    [
        ("article", "Article 1 Article 2\nArticles 5 to 7 article 3 Article 199.", [("1", "Article 1"), ("2", "Article 2"), ("5", "Article 5"), ("6", "Article 6"), ("7", "Article 7"), ("199", "Article 199")]),
        ("section_upper", "SECTION 1. SEC. 2. SEC. 12. Section 20", [("1", "Section 1"), ("2", "Section 2"), ("12", "Section 12"), ("20", "Section 20")]),
        ("paragraph", "§ 38 und Section 38, § 38a", [("38", "Section 38"), ("38A", "Section 38a")]),
        ("matra", "มาตรา ๙๓ Section 93", [("93", "Section 93")]),
        ("section", "- 13. Consent\n- **26D.** Duty\n**3.**", [("3", "Section 3"), ("13", "Section 13"), ("26D", "Section 26D")]),
        ("article", None, []),
        ("article", "", []),
    ],
)
def test_harvest(spark, kind, md, want):
    docs = spark.createDataFrame([("f", 1, md, "x")], "framework string, doc_id int, text string, display string")
    hits = harvest.harvest(docs, harvest.EXTRACTORS[kind], ["framework"], "text", "doc_id")
    rows = harvest.ordered(harvest.registry(hits, ["framework"]), ["framework"]).orderBy("position").collect()
    assert [(r.canonical, r.display) for r in rows] == want


def test_recall_without_gold_is_one(spark):
    have = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "framework string, base string")
    gold = spark.createDataFrame([("a", "2"), ("a", "9"), ("a", "2")], "framework string, base string")
    got = {r.framework: (r.recall, r.missing) for r in harvest.gold_recall(have, gold).collect()}
    assert got == {"a": (0.5, ["9"]), "b": (1.0, [])}


def test_ranges_of_the_whole_table(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").collect()
    want = sorted((r.l_orderkey, r.l_linenumber, n) for r in lines for n in range(r.l_linenumber, r.l_linenumber + int(r.l_quantity) + 1))
    got = registry.QUERIES["fn21_expand_range_all"](spark, data).collect()
    assert sorted(map(tuple, got)) == want and max(r.l_quantity for r in lines) > 5


def test_json(spark):
    raw = ['{"citation_id": "1", "target_mechanism": "m", "mapping_justification": "j"}', '{"citation_id": 32, "target_mechanism": "m", "mapping_justification": "j"}', "[1]", "x{", None]
    got = apply(spark, jsonx.parse_candidate, raw)
    assert [(r.citation_id, r.error) for r in got] == [("1", None), (None, "field"), (None, "not an object"), (None, "not JSON"), (None, "not JSON")]
    raw = ['{"score": 1.7, "bucket": "exact", "reasoning": "r"}', '{"score": "abc", "bucket": "great"}', "{}", "nope", "[]"]
    got = apply(spark, jsonx.parse_judge, raw)
    assert [(r.score, r.bucket, r.error) for r in got] == [(1.0, "exact", None), (0.0, "wrong", None), (0.0, "wrong", None), (0.0, "wrong", "not JSON"), (0.0, "wrong", "not an object")]


def test_numbers_and_text(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.4,), (9.0,)], "v double")
    assert [r[0] for r in df.select(numeric.unit_score(F.col("v"))).collect()] == [0.0, 0.0, 0.0, 0.4, 1.0]
    assert apply(spark, text.parse_mix, ["1/2/3", "1/2", "a/b/c", None]) == [[1, 2, 3], None, None, None]
    assert apply(spark, text.word_count, ["a  b c", "", None]) == [3, 0, None]
    one = spark.createDataFrame([("", "x")], "a string, b string").select(text.fill_template("{a}-{b}", a=F.col("a"), b=F.col("b"))).first()[0]
    assert one == "<a missing>-x"


def test_overlap_and_winner(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["c"]), (["a"], [])], "x array<string>, y array<string>")
    got = [r[0] for r in df.select(scoring.overlap(F.col("x"), F.col("y"))).collect()]
    assert [(r.tp, r.fp, r.fn, r.recall, r.precision) for r in got] == [(["b"], ["c"], ["a"], 0.5, 0.5), ([], ["c"], [], None, 0.0), ([], [], ["a"], 0.0, None)]
    schema = "parser string, pages long, recall_mean double, precision_mean double, reading_order_mean double, structure_share double"
    win = lambda rows: [tuple(r) for r in scoring.parser_winner(spark.createDataFrame(rows, schema)).collect()]
    assert win([("m", 5, 1.0, 1.0, 5.0, 1.0), ("t", 5, 1.0, 1.0, 4.0, 1.0)]) == [("m", "reading order")]
    assert win([("m", 5, 0.9, 1.0, 5.0, 1.0), ("t", 5, 1.0, 1.0, 5.0, 1.0)]) == [("t", "citation recall")]
    assert win([("m", 5, 1.0, 1.0, 5.0, 1.0), ("t", 5, 1.0, 1.0, 5.0, 1.0)]) == []
    assert win([("m", 5, 1.0, 1.0, None, 1.0), ("t", 5, 1.0, 1.0, 5.0, 1.0)]) == []


def test_slices_of_nothing(spark):
    empty = spark.createDataFrame([], "match int, score double")
    assert tuple(empty.agg(*scoring.slice_measures()).first()) == (0, 0.0, 0.0, 0.0)


def test_rules_by_framework():
    import pytest

    from citeloom.operators import harvest

    assert harvest.rules_for("bdsg")[0].display == "Section {n}" and all(harvest.rules_for(f) for f in harvest.FRAMEWORKS)
    with pytest.raises(ValueError, match="nowhere"):
        harvest.rules_for("nowhere")
