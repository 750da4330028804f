"""Tokenizer audit per language and citation density of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.citation import citation_marks
from citeloom.functions.numeric import ratio_or_zero
from citeloom.functions.text import distinct_non_ascii, is_single_byte, word_count

# The thresholds of the verdicts.
THAI_FAIL_SINGLE_BYTE, THAI_WARN_SINGLE_BYTE = 0.20, 0.15
THAI_FAIL_TOKENS, THAI_WARN_TOKENS, LATIN_WARN_TOKENS = 2.0, 2.5, 1.5
DENSITY_RATIO = 0.5


def simple_tokens(text: Column) -> Column:
    """A tokenizer in SQL alone: runs of ASCII letters or digits, and every other character that isn't a blank."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"), F.lit(0))


def audit(docs: DataFrame, lang: str = "lang", text: str = "text", tokens=simple_tokens, unspaced: tuple[str, ...] = ("th",)) -> DataFrame:
    """Per language: characters, tokens, tokens per character and word (null in scripts without spaces), the share of
    single-byte tokens and percentiles of token lengths. Empty texts count as documents without tokens."""
    sizes = docs.groupBy(F.col(lang).alias("lang")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total_chars"), F.coalesce(F.sum(word_count(F.col(text))), F.lit(0)).alias("words"))
    # Lengths are counted per value first: percentiles need the counts alone, not a row for each token.
    pieces = docs.select(F.col(lang).alias("l"), F.explode(tokens(F.col(text))).alias("piece"))
    counted = pieces.groupBy("l", F.length("piece").alias("len")).agg(F.count("*").alias("n"), F.count_if(is_single_byte(F.col("piece"))).alias("single"))
    pct = lambda p: F.expr(f"percentile(len, {p}, n)").alias(f"token_char_len_p{round(p * 100)}")
    per = counted.groupBy("l").agg(F.sum("n").alias("total_tokens"), F.sum("single").alias("single"), pct(0.5), pct(0.9), pct(0.99))
    out = sizes.join(per, F.col("lang").eqNullSafe(F.col("l")), "left")
    n = F.coalesce("total_tokens", F.lit(0))
    return out.select(
        "lang",
        F.col("total_chars").cast("long"),
        n.cast("long").alias("total_tokens"),
        F.round(ratio_or_zero(n, F.col("total_chars")), 6).alias("tokens_per_char"),
        F.round(F.when(~F.coalesce(F.col("lang").isin(*unspaced), F.lit(False)), ratio_or_zero(n, F.col("words"))), 6).alias("tokens_per_word"),
        F.round(ratio_or_zero(F.col("single"), n), 6).alias("single_byte_token_fraction"),
        *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("token_char_len_p50", "token_char_len_p90", "token_char_len_p99")],
    )


def verdict(lang: Column, per_char: Column, single: Column) -> Column:
    """The ladder of verdicts; languages without one pass."""
    thai = F.when(single >= THAI_FAIL_SINGLE_BYTE, "FAIL_S5").when(per_char >= THAI_FAIL_TOKENS, "FAIL_M0").when((per_char >= THAI_WARN_TOKENS) | (single >= THAI_WARN_SINGLE_BYTE), "WARN_R4").otherwise("PASS")
    latin = F.when(per_char > LATIN_WARN_TOKENS, "WARN").otherwise("PASS")
    return F.when(lang == "th", thai).when(lang.isin("fr", "de", "en"), latin).otherwise("PASS")


def exit_code(verdicts: DataFrame) -> DataFrame:
    """One row: 3 with a FAIL, 1 with a WARN, else 0."""
    severity = F.when(F.startswith("verdict", F.lit("FAIL")), 3).when(F.startswith("verdict", F.lit("WARN")), 1).otherwise(0)
    return verdicts.agg(F.coalesce(F.max(severity), F.lit(0)).alias("exit_code"))


def fragmented_characters(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = 20) -> DataFrame:
    """lang, ch, tokens, rank: per language the distinct non-ASCII characters that take most tokens (here: bytes)."""
    chars = docs.select(F.col(lang).alias("lang"), F.explode(distinct_non_ascii(F.col(text))).alias("ch")).distinct()
    w = Window.partitionBy("lang").orderBy(F.col("tokens").desc(), F.col("ch").desc())
    return chars.withColumn("tokens", F.octet_length("ch").cast("long")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def density(docs: DataFrame, pages: Column, group: Column, text: str = "text") -> DataFrame:
    """doc columns with chars_per_page and cites_per_page; documents without pages count as one page."""
    n = F.coalesce(F.when(pages > 0, pages), F.lit(1))
    return docs.withColumns({"grp": group, "cites": citation_marks(F.col(text)).cast("long"), "chars_per_page": F.round(F.length(text) / n, 6), "cites_per_page": F.round(citation_marks(F.col(text)) / n, 6)})


def density_report(rows: DataFrame, one: str, other: str) -> DataFrame:
    """One row: the unweighted mean density of two groups, their ratio and verdict (null without documents)."""
    mean = lambda g: F.round(F.avg(F.when(F.col("grp") == g, F.col("cites_per_page"))), 6)
    out = rows.agg(mean(one).alias("mean_one"), mean(other).alias("mean_other"), F.count_if(F.col("grp") == one).alias("n_one"), F.count_if(F.col("grp") == other).alias("n_other"))
    ratio = F.round(F.try_divide("mean_one", "mean_other"), 6)
    return out.withColumn("ratio", ratio).withColumn("verdict", F.when(F.col("ratio") >= DENSITY_RATIO, "PASS").when(F.col("ratio").isNotNull(), "FAIL"))
