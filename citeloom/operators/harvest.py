"""Citation registries from document text: a rules table, one generator branch per rule, first display wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.citation import ascii_digits, canonical_citation, expand_range, section_order


@dataclass(frozen=True)
class Rule:
    """A pass over the text: group 1 is the number; ``until`` is the group that ends a range."""

    pattern: str
    display: str
    until: int = 0


# How each kind of text writes its sections, in the order of the passes.
SECTION = Rule(r"(?U)\bSection\s+(\d+[A-Za-z]?)(?![\w])", "Section {n}")
EXTRACTORS: dict[str, list[Rule]] = {
    "article": [Rule(r"(?U)\bArticles?\s+(\d+)(?!\d)", "Article {n}"), Rule(r"(?U)\bArticles?\s+(\d+)\s+to\s+(\d+)\b", "Article {n}", 2)],
    "section": [
        Rule(r"(?Um)^-\s+\*{0,2}(\d+[A-Za-z]*)\.\s+\S", "Section {n}"),
        Rule(r"(?U)\*\*(\d+[A-Za-z]*)\.\*\*", "Section {n}"),
        SECTION,
    ],
    "section_upper": [SECTION, Rule(r"(?U)\bSECTION\s+(\d+[A-Za-z]?)(?![\w])", "Section {n}"), Rule(r"(?U)\bSEC\.\s*(\d+[A-Za-z]?)(?![\w])", "Section {n}")],
    "section_heading": [
        Rule(r"(?Um)^#{1,6}\s+\*{1,2}(\d+[A-Za-z]?)\s+", "Section {n}"),
        Rule(r"(?U)(?<![A-Za-z])[Ss]\.\s+(\d+[A-Za-z]?)(?![\w])", "Section {n}"),
        SECTION,
    ],
    "paragraph": [Rule(r"(?U)§\s*(\d+[a-z]?)(?![\w])", "Section {n}"), SECTION],
    "seksyen": [Rule(r"(?U)\bSeksyen\s+(\d+[A-Za-z]?)(?![\w])", "Section {n}"), SECTION],
    "matra": [Rule(r"(?U)มาตรา\s*([๐-๙0-9]+[A-Za-z]?)(?![๐-๙0-9])", "Section {n}"), SECTION],
}


# Which of them a framework's texts take.
FRAMEWORKS = {"gdpr": "article", "uk_gdpr": "article", "loi_il": "article", "pdpa_sg": "section", "dpa_2012_ph": "section_upper", "dpa_2018": "section_heading", "bdsg": "paragraph", "pdpa_my": "seksyen", "pdpa_th": "matra"}


def rules_for(framework: str) -> list[Rule]:
    """The rules of a framework's texts; a ValueError names one that has none."""
    if framework not in FRAMEWORKS:
        raise ValueError(f"no extractor for framework {framework!r}; there are {sorted(FRAMEWORKS)}")
    return EXTRACTORS[FRAMEWORKS[framework]]


def harvest(docs: DataFrame, rules: list[Rule], by: list[str], text: str = "text", position: str | None = None) -> DataFrame:
    """by..., doc_pos, pass, at, canonical, display of every match. Null texts give none; an empty table no rows.

    Every pattern is a literal of its own branch, so it is compiled once; the scan is shared by what Catalyst reuses.
    """
    doc_pos = (F.col(position) if position else F.lit(0)).alias("doc_pos")
    out = None
    for no, rule in enumerate(rules):
        hits = docs.select(*by, doc_pos, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(1))).alias("at", "n"), *([F.col(text)] if rule.until else []))
        if rule.until:
            last = F.element_at(F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(rule.until)), F.col("at") + 1)
            hits = hits.select(*by, "doc_pos", "at", F.explode(expand_range(F.col("n").try_cast("long"), last.try_cast("long"))).alias("n")).withColumn("n", F.col("n").cast("string"))
        shown = F.concat(*[F.lit(p) if p != "{n}" else ascii_digits(F.col("n")) for p in _parts(rule.display)])
        part = hits.select(*by, "doc_pos", F.lit(no).alias("pass"), "at", canonical_citation(shown).alias("canonical"), shown.alias("display"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("canonical") != "")


def _parts(display: str) -> list[str]:
    head, _, tail = display.partition("{n}")
    return [p for p in (head, "{n}", tail) if p]


def registry(matches: DataFrame, by: list[str]) -> DataFrame:
    """by..., canonical, display: each id once, with the display of its first match (document, pass, place)."""
    first = F.min_by("display", F.struct("doc_pos", "pass", "at"))
    return matches.groupBy(*by, "canonical").agg(first.alias("display"))


def ordered(entries: DataFrame, by: list[str]) -> DataFrame:
    """The registry with ``position``: ids by their number, then by themselves."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(section_order(F.col("canonical")), "canonical")
    return entries.withColumn("position", F.row_number().over(w))


def gold_recall(registry_ids: DataFrame, gold_bases: DataFrame) -> DataFrame:
    """framework, gold, hits, recall, missing: the share of gold base sections a framework's registry has and the sorted
    rest. Frameworks of ``registry_ids`` without gold have recall 1. Both: framework, base."""
    gold = gold_bases.where(F.col("base").isNotNull() & (F.col("base") != "")).select("framework", "base").distinct()
    have = registry_ids.select("framework", F.col("base").alias("have")).distinct()
    hit = gold.join(have.withColumnRenamed("framework", "_f"), (F.col("framework") == F.col("_f")) & (F.col("base") == F.col("have")), "left")
    per = hit.groupBy("framework").agg(
        F.count("*").alias("gold"),
        F.count("have").alias("hits"),
        F.array_sort(F.collect_list(F.when(F.col("have").isNull(), F.col("base")))).alias("missing"),
    )
    frameworks = registry_ids.select("framework").distinct()
    none = F.array().cast("array<string>")
    return frameworks.join(per, "framework", "left").select(
        "framework",
        F.coalesce("gold", F.lit(0)).cast("long").alias("gold"),
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.coalesce(F.col("hits") / F.col("gold"), F.lit(1.0)).alias("recall"),
        F.coalesce("missing", none).alias("missing"),
    )
