"""p1, p4, p8, p9, p10: operators on texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import bpe, budget, leakage, residue, splitting

DOCS = "doc_id long, text string, source string, host string, kind string, raw string, _text string, _file string, md_relpath string"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "clash", "clash", "clash", "clash", "clash", f"a/{i}.md") for i, t in enumerate(texts)], DOCS)


# p1


def check_pieces(text, limit, overlap):
    spans = splitting.split_spans(text, limit, overlap)
    if len(text) <= limit:
        assert spans == ([(0, len(text))] if text else [])
        return spans
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (_, end), (start, _) in zip(spans, spans[1:]):
        assert end - start == overlap
    assert all(0 < end - start <= limit for start, end in spans)
    return spans


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" ab.\n#ั้é", max_size=900), st.integers(20, 120), st.integers(0, 25))
def test_pieces_cover_the_text(text, limit, overlap):
    check_pieces(text, limit, min(overlap, limit // 4))


def test_pieces_cut_at_the_strongest_boundary():
    text = "x" * 500 + "\n\n## Article 2\n" + "word. " * 90
    spans = check_pieces(text, 900, 100)
    assert text[spans[1][0] + 100 :].startswith("## Article 2")
    assert splitting.split_spans(None) == [] == splitting.split_spans("")
    with pytest.raises(ValueError):
        splitting.split_spans("x", 100, 50)
    check_pieces("ก" * 30_000, 6000, 200)
    check_pieces("a" * 300_000, 6000, 200)


def test_split_table(spark):
    d = docs(spark, [None, "", "short", "word " * 3000, "word " * 3000])
    out = splitting.split_oversized(d).collect()
    assert {r.doc_id for r in out} == {3, 4} and all(len(r.piece) <= 6000 for r in out)
    m = spark.createDataFrame([("./a//3.md", False), ("a\\4.md", True), (None, False), ("a/1.md", None)], "md_relpath string, failed boolean")
    assert sorted(r.doc_id for r in splitting.named_files(d, m).collect()) == [1, 3]
    assert splitting.split_oversized(d.limit(0)).count() == 0


# p8


def test_ids_equal_the_tokenizer(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    d = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in d.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(d).collect()}
    want = dict(zip(texts, (e.ids for e in t.encode_batch(list(texts.values()), add_special_tokens=False))))
    assert got == want
    rng, m = random.Random(3), bpe.model()
    for _ in range(3000):
        x = "".join(rng.choice(" \n\t'sdlverabXYZ019.,é–ก็้\xa0\x85\x1c 　\U0001f600m") for _ in range(rng.randint(0, 25)))
        assert m.encode(x) == t.encode(x, add_special_tokens=False).ids
    assert m.encode("<|endoftext|>") == t.encode("<|endoftext|>", add_special_tokens=False).ids


def test_ids_of_nothing_and_of_long_texts(spark):
    d = docs(spark, [None, "", "a" * 200_000, "a", "a"])
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(d).collect()}
    assert got[0] == [] == got[1] and got[3] == got[4] and len(got[2]) > 0
    assert bpe.encode_corpus(d.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcdehinorst énภ", min_size=1, max_size=40), st.text(alphabet="abcdehinorst", max_size=10), st.integers(0, 39))
def test_append_and_edit_equal_encoding_anew(text, more, at):
    e = bpe.model().encoder
    data, tail = text.encode(), more.encode()
    table = e.extend(data, [])
    assert e.read(e.extend(data + tail, list(table))) == e.encode(data + tail)
    at = min(at, len(data))
    changed = data[:at] + b"x" + data[at:]
    assert e.read(e.edit(changed, table, at)) == e.encode(changed)
    assert [e.read(table, i) for i in range(len(data) + 1)] == [e.encode(data[:i]) for i in range(len(data) + 1)]
    assert b"".join(e.tokens[i] for i in e.encode(data)) == data


# p4


def test_budget_equals_encoding_every_text(spark, data):
    g = spark.read.parquet(f"{data}/gold_pairs.parquet")
    rows = budget.gold_budget(g).collect()
    m = bpe.model()
    one = budget.one_row_per_pair(g).collect()
    want = {}
    for r in one:
        k = r.source_framework
        want[k] = want.get(k, 0) + len(m.encode(r.source_mechanism))
    assert {r.source_framework: r.tokens for r in rows if r.dimension == "framework"} == want
    total = sum(want.values())
    for dim in ("language", "jurisdiction", "all"):
        assert sum(r.tokens for r in rows if r.dimension == dim) == total
        assert sum(r.texts for r in rows if r.dimension == dim) == len(one)


def test_budget_with_nulls_repeats_and_clashes(spark):
    schema = "id string, source_mechanism string, source_framework string, source_language string, source_jurisdiction string, created_at timestamp, n long, piece string, tokens long"
    rows = [("1", "a b", "f", "eng", None, None, 1, "x", 1), ("1", "a b", "f", "eng", None, None, 1, "x", 1), ("2", None, None, None, "", None, 1, "x", 1), ("3", "", "f", "EN-gb", "j", None, 1, "x", 1)]
    g = spark.createDataFrame(rows, schema)
    got = {(r.source_framework, r.source_language, r.source_jurisdiction): (r.texts, r.tokens) for r in budget.gold_budget(g).collect() if r.dimension == "all"}
    assert got == {("f", "en", "(none)"): (1, 2), ("(none)", "und", "(none)"): (1, 0), ("f", "en", "j"): (1, 0)}
    assert budget.gold_budget(g.limit(0)).count() == 0


def test_language_codes(spark):
    df = spark.createDataFrame([("eng", "en"), (" EN-gb", "en"), ("fre", "fr"), ("und", "und"), (None, "und"), ("", "und"), ("xx", "und"), ("may", "ms")], "a string, b string")
    assert df.where(budget.language_code(F.col("a")) != F.col("b")).count() == 0


# p9


def brute_leak(item, text):
    """Whether some run of 20 to 40 words of an item is within a tenth of its length in edits of a run of the text."""
    a, b = leakage.words(item), leakage.words(text)
    for n in range(20, min(len(a), 40) + 1):
        for i in range(len(a) - n + 1):
            row = [0] * (len(b) + 1)
            for x in a[i : i + n]:
                new = [row[0] + 1]
                for j, y in enumerate(b, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            if min(row) * 10 <= n:
                return True
    return False


def test_leaks_against_brute_force():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("al", "be", "ce", "do", "ur") for b in ("ra", "mi", "to", "ne", "sk")]
    items = [(i, " ".join(rng.choice(words) for _ in range(45))) for i in range(4)]
    scan, hits = leakage.Scanner(items), 0
    for _ in range(60):
        item = rng.choice(items)[1].split()
        at = rng.randrange(20)
        run = item[at : at + rng.randrange(14, 26)]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(run))
            run = run[:k] + rng.choice([[], ["zzz"], ["qqq", run[k]]]) + run[k + 1 :]
        text = " ".join([rng.choice(words) for _ in range(15)] + run + [rng.choice(words) for _ in range(15)])
        got = scan.find(text)
        for i, t in items:
            assert (i in got) == brute_leak(t, text)
            hits += i in got
    assert hits > 5


def test_leaks_with_edits_wherever_they_stand():
    rng = random.Random(3)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 12))) for _ in range(80))
    scan, units = leakage.Scanner([(7, item)]), item.split()
    for size, edits in ((20, 2), (30, 3), (39, 3)):
        for trial in range(300):
            at = rng.randrange(len(units) - size + 1)
            run = list(units[at : at + size])
            first = rng.randrange(size - edits + 1)
            where = [first + i for i in range(edits)] if trial % 3 == 0 else rng.sample(range(size), edits)
            for k in where:
                run[k] = rng.choice(["", "zzz", "q" * 50, run[k] + " yyy"])
            assert scan.find("zz " + " ".join(run) + " zz") == {7}, (at, where, run)
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(300))
    scan = leakage.Scanner([(7, thai)])
    for _ in range(200):
        at = rng.randrange(len(thai) - 90)
        run = list(thai[at : at + 90])
        for k in rng.sample(range(90), 6):
            run[k] = rng.choice(["", "ๆ", run[k] + "ฯ"])
        assert scan.find("ข้อ " + "".join(run)) == {7}


def test_leaks_behind_long_markup_and_places(spark):
    item = " ".join(f"word{i}" for i in range(25))
    split = item.split()
    text = "Intro &amp; more. " + " ".join(split[:10]) + '<a href="' + "x" * 300 + '" class="y">' + " ".join(split[10:]) + "</a> tail"
    r = leakage.find_leaks(docs(spark, [text]), spark.createDataFrame([(5, item)], "item_id long, text string"), places=True).collect()
    assert len(r) == 1 and text[r[0].first : r[0].last].startswith("word0 ") and text[r[0].first : r[0].last].endswith("word24")


def test_leaks_whatever_the_layout(spark):
    item = "the quick brown fox jumps over the lazy dog while nine grey wolves watch from a distant hill and never dare to come any closer at all"
    odd = "Note: THE **quick** brown<br> fox jum-\nps over the &quot;lazy&quot; dog, while nine\n> grey wolves watch­ from a distant hill and never dare to come"
    texts = [None, "", odd, item.replace(" ", ""), item.replace(" ", "_"), " ".join(item.split()[:15]), item.replace("grey", "red"), item.upper() + " x" * 200_000]
    items = spark.createDataFrame([(1, item, "c"), (2, None, "c"), (3, " ", "c")], "item_id long, text string, doc_id string")
    got = {r.doc_id for r in leakage.find_leaks(docs(spark, texts), items).collect()}
    assert got == {2, 3, 4, 6, 7}
    assert leakage.find_leaks(docs(spark, texts), items.limit(0)).count() == 0
    assert leakage.find_leaks(docs(spark, texts).limit(0), items).count() == 0


def test_leaks_in_scripts_without_spaces():
    rng = random.Random(5)
    item = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(300))
    scan = leakage.Scanner([(7, item)])
    cut = item[50:160]
    assert scan.find("ข้อ " + cut) == {7}
    assert scan.find(cut[:40] + "\n" + cut[41:80] + "กก" + cut[80:]) == {7}
    assert scan.find(item[50:110]) == set()


def test_offsets_lead_back_to_the_text():
    text = "A<br>b-\nC d"
    flat, places = leakage.offsets(text)
    assert flat == "abcd" and [text[p].lower() for p in places] == list(flat)


# p10

RESIDUE = ["a {{ AMOUNT }} b", "x ${title}", "#{jurisdiction} y", "[[title]]", "<<Section Ref>> 9", "«AMOUNT» z", "%effective-date% a", "@@title@@", "$title$", "<INSERT_title>", "[INSERT title]", "[isi title di sini]", "[Bitte title ergänzen]", "[à compléter : title]", "[ระบุ title]", "[title HERE]", "{% title %}",
           "Text.\nlorem ipsum dolor sit amet", "blah blah blah", "Ullam cillum quis labore dolor amet.", "404 Not Found", "Error:\nthe requested page could not be found\n\nHome", "<h1>Access Denied</h1>", "HTTP 500 – Internal Server Error", "Please enable\nJavaScript to view this page.", "UNCAUGHT TYPEERROR AT LINE 147", "... decided. Seite nicht gefunden"]
CONTENT = ["Let {a, b} denote the set of keys and {c} its complement.", '`{"kind": "keys", "count": 3}`', "Cost: $ 9.9 per copy.", "23 % of the keys were reviewed in year 3.", "[...] [repealed] [inserted text in italics]", "Name: ____ Date: ____", "The office logs each response such as 404 or 503 returned.", "He may not treat a page that was not found as withdrawal.", "They shall answer an access denied on grounds of keys.",
           "A template with placeholders is annexed.", "A portal must work for persons whose browser runs no scripts.", "See <sup>3</sup> « les actes »", "", None, "Amendedbyorderno.5[insertedtextinitalics]."]


# None of these stands in the code.
HELD_OUT = ["You need to enable JavaScript to run this app.", "JavaScript is disabled in your browser.", "This website requires JavaScript.", "Votre navigateur ne prend pas en charge JavaScript, veuillez l'activer.", "Ihr Browser unterstützt kein JavaScript oder es ist deaktiviert. Bitte aktivieren.", "Error 404", "404 - File or directory not found.", "HTTP Error 503. The service is unavailable.", "Internal Server Error", "502 Bad Gateway", "Fatal error: Uncaught Exception in /var/www/x.php on line 12", "Traceback (most recent call last):",
            "Warning: mysql_connect(): no such host in /srv/a.php on line 7", "The page you requested could not be found.", "Sorry, the page you are looking for might have been removed.", "java.lang.NullPointerException: name", "SQLSTATE[HY000] [2002] Connection refused", "You don't have permission to access this resource.", "Your session timed out.", "[Your Name]", "Dear {first_name},", "Insert text here", "[BITTE ERGÄNZEN]", "Sed ut perspiciatis unde omnis iste natus error", "test test test test", "Type your name here", "Add content here", "Dies ist ein Absatz.\nPlatzhaltertext", "[Insert Date]", "An unexpected error has occurred."]
HELD_OUT_CONTENT = ["The controller must keep scripts of all interviews.", "Persons who need javascript training shall apply.", "404 sections were amended.", "Error is no defence.", "The session of the council has expired members removed.", "Access denied to a minor is recorded.", "Section 404 Not every page counts.", "A page is one side of a leaf. The page has two margins.", "Sous réserve des avis, plus de copies sont tenus. Les statuts sont reçus.", "Hukum umum tertentu terpakai.", "Zum Zwecke der Datenübermittlung, um das Forum zu nutzen.", "You may request that records be erased without delay.", "The set {a, b} of { keys }.", "Warning: no act may be split."]


def test_residue_that_stands_nowhere_in_the_code(spark):
    got = {r.doc_id for r in residue.find_residue(docs(spark, [f"Article 1 of the act.\n{x}" for x in HELD_OUT + HELD_OUT_CONTENT])).collect()}
    assert got == set(range(len(HELD_OUT))), [(HELD_OUT + HELD_OUT_CONTENT)[i] for i in got ^ set(range(len(HELD_OUT)))]


def test_residue_and_content(spark):
    got = {r.doc_id for r in residue.find_residue(docs(spark, RESIDUE + CONTENT)).collect()}
    assert got == set(range(len(RESIDUE)))
    assert residue.find_residue(docs(spark, []).limit(0)).count() == 0


def test_boilerplate_is_subtracted(spark):
    footer = "Please enable JavaScript to view this page."
    texts = [f"Article {i} of the act.\n{footer}" for i in range(30)] + [f"Article.\n{footer}\n404 Not Found"]
    assert {r.doc_id for r in residue.find_residue(docs(spark, texts)).collect()} == {30}
    few = docs(spark, [footer, "x", None], None)
    assert {r.doc_id for r in residue.find_residue(few).collect()} == {0}


def test_residue_on_many_pages_of_a_host(spark):
    notice = "Home\nPlease enable JavaScript to view this page.\nContact"
    whole = ["404 Not Found", "Error:\nthe requested page could not be found\n\nHome", notice, "Text text text text", "# {{ TITLE }}\nDate: [INSERT date]"]
    within = ["404 Not Found", "Error:\nthe requested page could not be found", "lorem ipsum dolor sit amet", "$title$"]
    for pages in (18, 20, 60):
        few = pages // 2
        texts = [w for w in whole for _ in range(few)] + [f"Article {'x' * i} of the act.\n{w}" for w in within for i in range(few)]
        clean = [f"Section {'y' * i} of the act.\nHome\nContact" for i in range(few)]
        for at in range(0, len(texts), few):
            host = docs(spark, texts[at : at + few] + clean)
            assert {r.doc_id for r in residue.find_residue(host).collect()} == set(range(few)), texts[at]
            assert {r.doc_id for r in residue.without_residue(host).collect()} == set(range(few, few * 2)), texts[at]
    numbered = docs(spark, [f"Please enable JavaScript to view this page.\nRequest {i}" for i in range(30)])
    assert residue.find_residue(numbered).count() == 30


def test_residue_in_a_long_text(spark):
    long = "the act applies. " * 30_000
    assert residue.find_residue(docs(spark, [long, long + "\n\n[INSERT title]", long])).collect()[0].doc_id == 1


def test_the_rest_of_the_corpus(spark):
    d = docs(spark, RESIDUE + CONTENT)
    rest = residue.without_residue(d)
    assert rest.columns == d.columns and {r.doc_id for r in rest.collect()} == set(range(len(RESIDUE), len(RESIDUE) + len(CONTENT)))
