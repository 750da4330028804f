"""Citation strings, registries, evaluation slices and set overlap: queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import citation as C
from citeloom.functions import jsonx, numeric, text
from citeloom.operators import harvest, scoring
from citeloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_WS = r"[\s\x{00A0}\x{000B}]"


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def norm_sql(c: str) -> str:
    s = strip_sql(rf"regexp_replace({strip_sql(c)}, '(?i)^(article|section|paragraph|clause|art\.?|sec\.?|para\.?|cl\.?|§)', '')")
    tight = rf"regexp_replace(regexp_replace({s}, '{_WS}*\({_WS}*', '(', 'g'), '{_WS}*\){_WS}*', ')', 'g')"
    return rf"lower(CASE WHEN contains({s}, '(') THEN {tight} ELSE regexp_replace({s}, '{_WS}+([^\s\x{{00A0}}\x{{000B}}]+)', '(\1)', 'g') END)"


def canon_sql(c: str) -> str:
    n = norm_sql(c)
    return f"CASE WHEN regexp_matches({n}, '[a-z]$') THEN left({n}, length({n}) - 1) || upper(right({n}, 1)) ELSE {n} END"


def base_sql(c: str) -> str:
    return rf"CASE WHEN regexp_matches({c}, '^[0-9]+[A-Za-z]?') THEN upper(regexp_extract({c}, '^([0-9]+[A-Za-z]?)', 1)) ELSE {c} END"


ORDER_SQL = "coalesce(try_cast(nullif(regexp_extract(canonical, '^([0-9]+)', 1), '') AS BIGINT), 1000000000)"
SCORE_SQL = "(CASE WHEN judge_score IS NULL OR isnan(judge_score) THEN 0.0 ELSE greatest(0.0, least(1.0, judge_score)) END)"
MATCH_SQL = f"(CASE WHEN predicted_citation_id <> '' AND expected_citation_id <> '' AND {norm_sql('predicted_citation_id')} = {norm_sql('expected_citation_id')} THEN 1 ELSE 0 END)"


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_rows").select(F.col("predicted_citation_id").alias("raw")).where("raw IS NOT NULL").distinct()


@query(f"SELECT DISTINCT predicted_citation_id AS raw, {norm_sql('predicted_citation_id')} AS normalized FROM eval_rows WHERE predicted_citation_id IS NOT NULL")
def fn01_normalize_citation(spark, folder):
    return _typed(spark, folder).select("raw", C.normalize_citation(F.col("raw")).alias("normalized"))


@query(f"SELECT raw, {base_sql('n')} AS base FROM (SELECT DISTINCT predicted_citation_id AS raw, {norm_sql('predicted_citation_id')} AS n FROM eval_rows WHERE predicted_citation_id IS NOT NULL)")
def fn02_base_section(spark, folder):
    return _typed(spark, folder).select("raw", C.base_section(C.normalize_citation(F.col("raw"))).alias("base"))


@query(f"SELECT DISTINCT predicted_citation_id AS raw, {canon_sql('predicted_citation_id')} AS canonical FROM eval_rows WHERE predicted_citation_id IS NOT NULL")
def fn03_canonical_citation(spark, folder):
    return _typed(spark, folder).select("raw", C.canonical_citation(F.col("raw")).alias("canonical"))


@query("SELECT framework, citation_id, translate(display_id, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS ascii_display FROM registry_entries")
def fn04_thai_digits(spark, folder):
    return table(spark, folder, "registry_entries").select("framework", "citation_id", C.ascii_digits(F.col("display_id")).alias("ascii_display"))


@query(
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, 'มาตรา\s*([๐-๙0-9]+)', 1),
  lambda x: 'มาตรา ' || translate(x, '๐๑๒๓๔๕๖๗๘๙', '0123456789')))), ';') AS cited FROM documents WHERE text LIKE '%มาตรา%'"""
)
def fn05_thai_citations(spark, folder):
    docs = table(spark, folder, "documents").where(F.contains("text", F.lit("มาตรา")))
    return docs.select("doc_id", F.array_join(C.thai_citations(F.col("text")), ";").alias("cited"))


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(?:§[\s\x{00A0}]*\p{Nd}+|\bArticle[\s\x{00A0}]+\p{Nd}+|\bArt\.?[\s\x{00A0}]+\p{Nd}+|\bSection[\s\x{00A0}]+\p{Nd}+|\bSec\.?[\s\x{00A0}]+\p{Nd}+|มาตรา[\s\x{00A0}]*[๐-๙0-9]+)')) AS BIGINT) AS marks
  FROM documents WHERE text IS NOT NULL"""
)
def fn06_citation_marks(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", C.citation_marks(F.col("text")).cast("long").alias("marks"))


PROMPT = "Map {citation} of {framework} to {target}."


@query("SELECT DISTINCT id, 'Map ' || coalesce(nullif(source_citation_id, ''), '<citation missing>') || ' of ' || coalesce(nullif(source_framework, ''), '<framework missing>') || ' to ' || coalesce(nullif(target_framework, ''), '<target missing>') || '.' AS prompt FROM gold_pairs")
def fn07_prompts(spark, folder):
    g = table(spark, folder, "gold_pairs")
    return g.select("id", text.fill_template(PROMPT, citation=F.col("source_citation_id"), framework=F.col("source_framework"), target=F.col("target_framework")).alias("prompt")).distinct()


@query("SELECT DISTINCT id, CAST((length(coalesce(source_mechanism, '')) + length(coalesce(target_mechanism, ''))) // 4 AS BIGINT) AS tokens FROM gold_pairs")
def fn08_estimated_tokens(spark, folder):
    return table(spark, folder, "gold_pairs").select("id", text.estimated_tokens(F.col("source_mechanism"), F.col("target_mechanism")).alias("tokens")).distinct()


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s\x{00A0}\x{000B}\x{0085}\x{2028}\x{2029}\x{3000}\x{2000}-\x{200A}]+')) AS BIGINT) AS words FROM documents WHERE text IS NOT NULL")
def fn09_word_count(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(r"SELECT framework, citation_id, CAST(len(list_distinct(regexp_extract_all(heading, '[^\x00-\x7F]'))) AS BIGINT) AS kinds FROM registry_entries")
def fn10_non_ascii(spark, folder):
    return table(spark, folder, "registry_entries").select("framework", "citation_id", F.size(text.distinct_non_ascii(F.col("heading"))).cast("long").alias("kinds"))


@query("SELECT framework, citation_id, strlen(left(heading, 1)) = 1 AS single FROM registry_entries")
def fn11_single_byte(spark, folder):
    return table(spark, folder, "registry_entries").select("framework", "citation_id", text.is_single_byte(F.substring("heading", 1, 1)).alias("single"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_linenumber AS INTEGER) AS easy, 2 AS medium, 3 AS hard FROM lineitem")
def fn12_parse_mix(spark, folder):
    mix = text.parse_mix(F.concat_ws("/", F.col("l_linenumber").cast("string"), F.lit("2"), F.lit("3")))
    return table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), mix[0].alias("easy"), mix[1].alias("medium"), mix[2].alias("hard"))


@query(f"SELECT DISTINCT eval_id, {SCORE_SQL} AS score FROM eval_rows")
def fn14_unit_score(spark, folder):
    return table(spark, folder, "eval_rows").select("eval_id", numeric.unit_score(F.col("judge_score")).alias("score")).distinct()


@query("""SELECT framework, pdf_relpath, parsed_at AT TIME ZONE 'UTC' AS parsed_at, round(coalesce(char_count / nullif(page_count, 0), 0), 6) AS zero_kind, round(char_count / nullif(page_count, 0), 6) AS null_kind FROM (SELECT DISTINCT framework, pdf_relpath, parsed_at, char_count, page_count FROM ingest_manifest)""")
def fn15_ratios(spark, folder):
    m = table(spark, folder, "ingest_manifest").select("framework", "pdf_relpath", F.col("parsed_at").cast("timestamp_ntz").alias("parsed_at"), "char_count", "page_count").distinct()
    a, b = F.col("char_count"), F.col("page_count")
    return m.select("framework", "pdf_relpath", "parsed_at", F.round(numeric.ratio_or_zero(a, b), 6).alias("zero_kind"), F.round(numeric.ratio_or_null(a, b), 6).alias("null_kind"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Raw model answers made from evaluations, some of them broken."""
    e = table(spark, folder, "eval_rows").select("eval_id", "predicted_citation_id", "judge_score", "judge_bucket", "judge_reasoning").distinct()
    full = F.to_json(F.struct(F.col("predicted_citation_id").alias("citation_id"), F.lit("m").alias("target_mechanism"), F.lit("j").alias("mapping_justification")))
    kind = F.col("eval_id") % 5
    raw = F.when(kind == 0, F.lit('{"citation_id": 32, "target_mechanism": "m", "mapping_justification": "j"}')).when(kind == 1, F.lit("[1, 2]")).when(kind == 2, F.lit("no json {")).otherwise(full)
    return e.select("eval_id", raw.alias("raw"))


@query(
    """SELECT eval_id, CASE WHEN eval_id % 5 > 2 AND predicted_citation_id IS NOT NULL THEN predicted_citation_id END AS citation_id,
  CASE eval_id % 5 WHEN 0 THEN 'field' WHEN 1 THEN 'not an object' WHEN 2 THEN 'not JSON' ELSE CASE WHEN predicted_citation_id IS NULL THEN 'field' END END AS error
  FROM (SELECT DISTINCT eval_id, predicted_citation_id, judge_score, judge_bucket, judge_reasoning FROM eval_rows)"""
)
def fn19_parse_candidate(spark, folder):
    return _answers(spark, folder).select("eval_id", jsonx.parse_candidate(F.col("raw")).alias("c")).select("eval_id", "c.citation_id", "c.error")


@query(
    f"""SELECT eval_id, {SCORE_SQL} AS score, CASE WHEN judge_bucket IN ('wrong','partial_wrong','partial_right','substantively_right','exact') THEN judge_bucket ELSE 'wrong' END AS bucket,
  coalesce(nullif(judge_reasoning, ''), '<no reasoning returned>') AS reasoning FROM (SELECT DISTINCT eval_id, judge_score, judge_bucket, judge_reasoning FROM eval_rows)"""
)
def fn20_parse_judge(spark, folder):
    e = table(spark, folder, "eval_rows").select("eval_id", "judge_score", "judge_bucket", "judge_reasoning").distinct()
    raw = F.to_json(F.struct(F.when(~F.isnan("judge_score"), F.col("judge_score")).alias("score"), F.col("judge_bucket").alias("bucket"), F.col("judge_reasoning").alias("reasoning")))
    return e.select("eval_id", jsonx.parse_judge(raw).alias("j")).select("eval_id", "j.score", "j.bucket", "j.reasoning")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, unnest(range(CAST(l_linenumber AS BIGINT), CAST(l_linenumber + l_quantity AS BIGINT) + 1)) AS n FROM lineitem WHERE l_quantity <= 5")
def fn21_expand_range(spark, folder):
    a = F.col("l_linenumber").cast("long")
    b = (F.col("l_linenumber") + F.col("l_quantity")).cast("long")
    return table(spark, folder, "lineitem").where("l_quantity <= 5").select("l_orderkey", a.alias("l_linenumber"), F.explode(C.expand_range(a, b)).alias("n"))


@query()
def fn21_expand_range_all(spark, folder):
    """The ranges of all lines; fn21_expand_range and its SQL hold those of at most 5 pieces."""
    a = F.col("l_linenumber").cast("long")
    b = (F.col("l_linenumber") + F.col("l_quantity")).cast("long")
    return table(spark, folder, "lineitem").select("l_orderkey", a.alias("l_linenumber"), F.explode(C.expand_range(a, b)).alias("n"))


def _registry_of(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("framework", "doc_id", "text")
    hits = harvest.harvest(docs, harvest.EXTRACTORS[kind], ["framework"], "text", "doc_id")
    return harvest.ordered(harvest.registry(hits, ["framework"]), ["framework"]).select("framework", F.col("position").cast("long").alias("position"), "canonical", "display")


def _harvest_sql(passes: list[tuple[str, str]]) -> str:
    """(RE2 pattern, display prefix) of each pass."""
    parts = [
        f"SELECT framework, doc_id, {i} AS pass, unnest(range(len(l))) AS pos, '{d}' || translate(unnest(l), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS display FROM (SELECT framework, doc_id, regexp_extract_all(text, '{p}', 1) AS l FROM documents WHERE text IS NOT NULL)"
        for i, (p, d) in enumerate(passes)
    ]
    return f"""WITH hits AS ({' UNION ALL '.join(parts)}), canon AS (SELECT *, {canon_sql('display')} AS canonical FROM hits),
  reg AS (SELECT framework, canonical, arg_min(display, struct_pack(a := doc_id, b := pass, c := pos)) AS display FROM canon WHERE canonical <> '' GROUP BY framework, canonical)
  SELECT framework, CAST(row_number() OVER (PARTITION BY framework ORDER BY {ORDER_SQL}, canonical) AS BIGINT) AS position, canonical, display FROM reg"""


_S = r"[\s\x{00A0}]"
_SECTION = (rf"\bSection{_S}+([0-9]+[A-Za-z]?)\b", "Section ")


@query(_harvest_sql([(rf"\bArticles?{_S}+([0-9]+)", "Article ")]))
def rx01_articles(spark, folder):
    return _registry_of(spark, folder, "article")


@query(_harvest_sql([(rf"(?m)^-{_S}+\*{{0,2}}([0-9]+[A-Za-z]*)\.{_S}+[^\s\x{{00A0}}]", "Section "), (r"\*\*([0-9]+[A-Za-z]*)\.\*\*", "Section "), _SECTION]))
def rx02_sections(spark, folder):
    return _registry_of(spark, folder, "section")


@query(_harvest_sql([_SECTION, (rf"\bSECTION{_S}+([0-9]+[A-Za-z]?)\b", "Section "), (rf"\bSEC\.{_S}*([0-9]+[A-Za-z]?)\b", "Section ")]))
def rx03_sections_upper(spark, folder):
    return _registry_of(spark, folder, "section_upper")


@query(_harvest_sql([(rf"(?m)^#{{1,6}}{_S}+\*{{1,2}}([0-9]+[A-Za-z]?){_S}+", "Section "), (rf"\b[Ss]\.{_S}+([0-9]+[A-Za-z]?)\b", "Section "), _SECTION]))
def rx04_section_headings(spark, folder):
    return _registry_of(spark, folder, "section_heading")


@query(_harvest_sql([(rf"§{_S}*([0-9]+[a-z]?)\b", "Section "), _SECTION]))
def rx05_paragraph_signs(spark, folder):
    return _registry_of(spark, folder, harvest.FRAMEWORKS["bdsg"])


@query(_harvest_sql([(rf"\bSeksyen{_S}+([0-9]+[A-Za-z]?)\b", "Section "), _SECTION]))
def rx06_seksyen(spark, folder):
    return _registry_of(spark, folder, "seksyen")


@query(_harvest_sql([(r"มาตรา[\s\x{00A0}]*([๐-๙0-9]+[A-Za-z]?)", "Section "), _SECTION]))
def rx07_matra(spark, folder):
    return _registry_of(spark, folder, "matra")


@query(
    f"""SELECT framework, count(DISTINCT canonical) AS citation_count FROM (SELECT framework, {canon_sql("'Section ' || n")} AS canonical FROM
  (SELECT framework, unnest(regexp_extract_all(text, '{_SECTION[0]}', 1)) AS n FROM documents WHERE text IS NOT NULL)) GROUP BY framework"""
)
def ag13_registry_union(spark, folder):
    docs = table(spark, folder, "documents").select("framework", "doc_id", "text")
    return harvest.registry(harvest.harvest(docs, [harvest.SECTION], ["framework"], "text", "doc_id"), ["framework"]).groupBy("framework").agg(F.count("*").alias("citation_count"))


@query(
    """WITH d AS (SELECT framework, count(DISTINCT citation_id) AS n FROM registry_entries GROUP BY framework),
  p AS (SELECT framework, sum(page_count) AS pages FROM (SELECT DISTINCT framework, pdf_relpath, parsed_at, page_count FROM ingest_manifest WHERE NOT failed) GROUP BY framework)
  SELECT d.framework, CAST(n AS BIGINT) AS citations, CAST(pages AS BIGINT) AS pages, round(n / nullif(pages, 0), 6) AS cites_per_page FROM d LEFT JOIN p USING (framework)"""
)
def ag14_cites_per_page(spark, folder):
    d = table(spark, folder, "registry_entries").groupBy("framework").agg(F.countDistinct("citation_id").alias("citations"))
    p = table(spark, folder, "ingest_manifest").where("NOT failed").select("framework", "pdf_relpath", "parsed_at", "page_count").distinct().groupBy("framework").agg(F.sum("page_count").alias("pages"))
    return d.join(p, "framework", "left").select("framework", "citations", "pages", F.round(F.try_divide("citations", "pages"), 6).alias("cites_per_page"))


_CITED = """upper(regexp_extract(translate({c}, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '^[^0-9]*0*([0-9]+[A-Z]?)', 1))"""


@query(
    f"""WITH g AS (SELECT DISTINCT * FROM (SELECT source_framework AS framework, {_CITED.format(c='source_citation_id')} AS base FROM gold_pairs
    UNION ALL SELECT target_framework, {_CITED.format(c='target_citation_id')} FROM gold_pairs) WHERE base <> ''),
  r AS (SELECT DISTINCT framework, citation_id AS base FROM registry_entries),
  h AS (SELECT g.framework, count(*) AS gold, count(r.base) AS hits, string_agg(CASE WHEN r.base IS NULL THEN g.base END, ';' ORDER BY g.base) AS missing FROM g LEFT JOIN r ON r.framework = g.framework AND r.base = g.base GROUP BY g.framework)
  SELECT f.framework, CAST(coalesce(gold, 0) AS BIGINT) AS gold, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(coalesce(hits / gold, 1.0), 6) AS recall, coalesce(missing, '') AS missing
  FROM (SELECT DISTINCT framework FROM registry_entries) f LEFT JOIN h ON h.framework = f.framework"""
)
def ag15_gold_recall(spark, folder):
    g = table(spark, folder, "gold_pairs")
    cited = [g.select(F.col(f"{s}_framework").alias("framework"), C.cited_base(F.col(f"{s}_citation_id")).alias("base")) for s in ("source", "target")]
    have = table(spark, folder, "registry_entries").select("framework", F.col("citation_id").alias("base"))
    out = harvest.gold_recall(have, cited[0].unionByName(cited[1]))
    return out.select("framework", "gold", "hits", F.round("recall", 6).alias("recall"), F.array_join("missing", ";").alias("missing"))


@query(
    f"""SELECT framework, citation_id AS canonical, CAST(row_number() OVER (PARTITION BY framework ORDER BY {ORDER_SQL.replace('canonical', 'citation_id')}, citation_id) AS BIGINT) AS position
  FROM (SELECT DISTINCT framework, citation_id FROM registry_entries)"""
)
def so01_citation_order(spark, folder):
    e = table(spark, folder, "registry_entries").select("framework", F.col("citation_id").alias("canonical")).distinct()
    return harvest.ordered(e, ["framework"]).select("framework", "canonical", F.col("position").cast("long").alias("position"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["gold_id", "model", "source_framework", "target_framework", "target_jurisdiction", "target_language", "predicted_citation_id", "expected_citation_id", "judge_score", "judge_bucket"]
    return scoring.scored(scoring.distinct_evaluations(table(spark, folder, "eval_rows"), cols))


_ROWS = f"""rows AS (SELECT *, {MATCH_SQL} AS match, {SCORE_SQL} AS score, concat_ws('__', source_framework, target_framework) AS pair FROM (
  SELECT DISTINCT eval_id, gold_id, model, source_framework, target_framework, target_jurisdiction, target_language, predicted_citation_id, expected_citation_id, judge_score, judge_bucket FROM eval_rows))"""
_MEASURES = """count(*) AS n, round(coalesce(avg(match), 0), 6) AS tier1_citation_match, coalesce(round(sum(CAST(round(score * 1000000) AS BIGINT)) / count(*)) / 1000000, 0) AS tier2_judge_mean,
  round(coalesce(avg(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END), 0), 6) AS tier2_judge_pct_above_0_7"""


@query(f"WITH {_ROWS} SELECT eval_id, match FROM rows")
def ev01_citation_match(spark, folder):
    return _rows(spark, folder).select("eval_id", "match")


@query(f"WITH {_ROWS} SELECT gold_id, max(match) AS any_match FROM rows GROUP BY gold_id")
def ev02_any_match(spark, folder):
    e = table(spark, folder, "eval_rows").select("gold_id", "predicted_citation_id", "expected_citation_id").distinct()
    by_answer = e.select("gold_id", C.citation_match_any(F.array("predicted_citation_id"), F.col("expected_citation_id")).alias("m"))
    return by_answer.groupBy("gold_id").agg(F.max("m").alias("any_match"))


@query(
    f"""SELECT DISTINCT eval_id, CASE WHEN coalesce(predicted_citation_id, '') = '' THEN 0.0 ELSE {SCORE_SQL} END AS judge_score,
  CASE WHEN coalesce(predicted_citation_id, '') = '' THEN 'wrong' ELSE judge_bucket END AS judge_bucket FROM eval_rows"""
)
def ev03_judge_short_circuit(spark, folder):
    none = F.coalesce("predicted_citation_id", F.lit("")) == ""
    return table(spark, folder, "eval_rows").select("eval_id", F.when(none, 0.0).otherwise(numeric.unit_score(F.col("judge_score"))).alias("judge_score"), F.when(none, "wrong").otherwise(F.col("judge_bucket")).alias("judge_bucket")).distinct()


@query(
    f"""SELECT e.eval_id, g.id AS gold_id, e.model, g.source_framework || '__' || g.target_framework AS framework_pair, {MATCH_SQL} AS citation_match
  FROM (SELECT DISTINCT eval_id, gold_id, model, predicted_citation_id, expected_citation_id FROM eval_rows) e JOIN (SELECT DISTINCT id, source_framework, target_framework FROM gold_pairs) g ON g.id = e.gold_id"""
)
def ev04_eval_rows(spark, folder):
    g = table(spark, folder, "gold_pairs").select(F.col("id").alias("gold_id"), "source_framework", "target_framework").distinct()
    e = table(spark, folder, "eval_rows").select("eval_id", "gold_id", "model", "predicted_citation_id", "expected_citation_id").distinct()
    return e.join(g, "gold_id").select("eval_id", "gold_id", "model", scoring.framework_pair().alias("framework_pair"), C.citation_match(F.col("predicted_citation_id"), F.col("expected_citation_id")).alias("citation_match"))


@query(f"WITH {_ROWS} SELECT {_MEASURES} FROM rows")
def ag01_slice(spark, folder):
    return _rows(spark, folder).agg(*scoring.slice_measures())


@query(f"WITH {_ROWS} SELECT pair, {_MEASURES} FROM rows GROUP BY pair")
def ag02_by_framework_pair(spark, folder):
    return _rows(spark, folder).groupBy("pair").agg(*scoring.slice_measures())


@query(
    f"""WITH {_ROWS} SELECT model, 'overall' AS slice_kind, NULL AS slice_key, {_MEASURES} FROM rows GROUP BY model
  UNION ALL SELECT model, 'target_jurisdiction', target_jurisdiction, {_MEASURES} FROM rows GROUP BY model, target_jurisdiction
  UNION ALL SELECT model, 'target_language', target_language, {_MEASURES} FROM rows GROUP BY model, target_language
  UNION ALL SELECT model, 'framework_pair', pair, {_MEASURES} FROM rows GROUP BY model, pair"""
)
def ag03_eval_grouping_sets(spark, folder):
    return scoring.slices(_rows(spark, folder))


@query(
    f"WITH {_ROWS} SELECT model, "
    + ", ".join(f"count(*) FILTER (WHERE judge_bucket = '{b}') AS {b}" for b in jsonx.BUCKETS)
    + " FROM rows GROUP BY model"
)
def ag04_bucket_counts(spark, folder):
    return scoring.bucket_counts(_rows(spark, folder), ["model"])


@query(
    """SELECT j AS jurisdiction, count(*) AS n FROM (SELECT DISTINCT id, unnest([source_jurisdiction, target_jurisdiction]) AS j FROM gold_pairs) GROUP BY j"""
)
def ag16_coverage_counts(spark, folder):
    g = table(spark, folder, "gold_pairs").select("id", "source_jurisdiction", "target_jurisdiction").distinct()
    return g.select("id", F.explode(F.array("source_jurisdiction", "target_jurisdiction")).alias("jurisdiction")).distinct().groupBy("jurisdiction").agg(F.count("*").alias("n"))


@query("SELECT coalesce(error, 'ok') AS outcome, count(*) AS n FROM ingest_manifest GROUP BY 1")
def ag17_outcome_counts(spark, folder):
    return table(spark, folder, "ingest_manifest").groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT expected_citation_id) AS citations, count(DISTINCT gold_id) AS golds, count(DISTINCT model) AS models FROM eval_rows")
def ag18_exact_distinct(spark, folder):
    return table(spark, folder, "eval_rows").agg(F.countDistinct("expected_citation_id").alias("citations"), F.countDistinct("gold_id").alias("golds"), F.countDistinct("model").alias("models"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per order: the part numbers and supplier numbers modulo 50 as expected and extracted marks."""
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page_index"), F.concat(F.lit("c"), F.col("l_partkey") % 50).alias("a"), F.concat(F.lit("c"), F.col("l_suppkey") % 50).alias("b"), (F.col("l_orderkey") % 3).alias("p"))
    sets = li.groupBy("page_index").agg(F.collect_set("a").alias("expected"), F.collect_set("b").alias("extracted"), F.first("p").alias("p"))
    return sets.select(F.concat(F.lit("parser"), F.col("p").cast("string")).alias("parser"), "page_index", "expected", "extracted")


_PAGES = """pages AS (SELECT 'parser' || (l_orderkey % 3) AS parser, l_orderkey AS page_index, list_distinct(list('c' || (l_partkey % 50))) AS a, list_distinct(list('c' || (l_suppkey % 50))) AS b FROM lineitem GROUP BY l_orderkey),
  s AS (SELECT parser, page_index, a, b, list_sort(list_intersect(a, b)) AS tp FROM pages),
  scored AS (SELECT parser, page_index, array_to_string(tp, ';') AS tp, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ';') AS fp,
    array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ';') AS fn, len(tp) / len(a) AS recall, len(tp) / len(b) AS precision FROM s)"""


@query(f"WITH {_PAGES} SELECT parser, page_index, tp, fp, fn, round(recall, 6) AS recall, round(precision, 6) AS precision FROM scored")
def ev05_page_overlap(spark, folder):
    p = _pages(spark, folder).select("parser", "page_index", scoring.overlap(F.col("expected"), F.col("extracted")).alias("o"))
    join = lambda c: F.array_join(f"o.{c}", ";").alias(c)
    return p.select("parser", "page_index", join("tp"), join("fp"), join("fn"), F.round("o.recall", 6).alias("recall"), F.round("o.precision", 6).alias("precision"))


def _scored_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder).select("parser", "page_index", scoring.overlap(F.col("expected"), F.col("extracted")).alias("o"))
    return p.select("parser", "page_index", "o.recall", "o.precision", F.when(F.col("page_index") % 7 > 0, (F.col("page_index") % 5 + 1).cast("double")).alias("reading_order"), F.when(F.col("page_index") % 4 > 0, (F.col("page_index") % 2).cast("double")).alias("structure"))


_MEANS = f"""{_PAGES}, means AS (SELECT parser, count(*) AS pages, round(avg(recall), 6) AS recall_mean, round(avg(precision), 6) AS precision_mean,
  round(avg(CASE WHEN page_index % 7 > 0 THEN page_index % 5 + 1 END), 6) AS reading_order_mean, round(avg(CASE WHEN page_index % 4 > 0 THEN page_index % 2 END), 6) AS structure_share FROM scored GROUP BY parser)"""


@query(f"WITH {_MEANS} SELECT * FROM means")
def ag09_parser_means(spark, folder):
    return scoring.parser_means(_scored_pages(spark, folder))


@query(f"WITH {_MEANS} SELECT parser, 'reading order' AS decided_by FROM means WHERE reading_order_mean = (SELECT max(reading_order_mean) FROM means)")
def so05_parser_winner(spark, folder):
    return scoring.parser_winner(scoring.parser_means(_scored_pages(spark, folder)))


@query(
    f"""WITH {_PAGES} SELECT parser, page_index, CAST(CASE WHEN page_index % 2 = 0 THEN 4 WHEN page_index % 7 > 0 THEN page_index % 5 + 1 END AS DOUBLE) AS reading_order FROM scored"""
)
def jn10_reviewer_fills(spark, folder):
    pages = _scored_pages(spark, folder)
    fills = pages.select("parser", "page_index", F.when(F.col("page_index") % 2 == 0, "4").otherwise(" ").alias("reading_order"))
    return scoring.apply_fills(pages, fills, ["reading_order"]).select("parser", "page_index", "reading_order")
