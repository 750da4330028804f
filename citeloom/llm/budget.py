"""Token budget per source, language and jurisdiction under an existing tokenizer.

Texts are cut by the tokenizer's own rule in the JVM; each distinct piece is tokenized once, and its length is joined
with the frequencies of the piece per slice. Nothing but distinct pieces leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm import bpe

# Fixed value: the tokenizer's splitting rule with its \s spelled for the JVM's regular expressions.
JVM_PIECE = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}+"
)
# Three-letter language codes (both kinds) and the two-letter code they stand for.
LANGUAGE_CODES = {
    "eng": "en",
    "deu": "de",
    "ger": "de",
    "fra": "fr",
    "fre": "fr",
    "msa": "ms",
    "may": "ms",
    "zsm": "ms",
    "tha": "th",
}
#: The code of unknown languages.
UNKNOWN = "und"


def language_code(c: Column) -> Column:
    """One code per language: case, blanks and regions folded, three-letter codes mapped; null, blank and undetermined
    ones are ``und``. Codes that aren't of two letters after this are ``und``, too."""
    code = F.regexp_extract(F.lower(c), r"^[\s ]*([a-z]+)", 1)
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    short = F.coalesce(F.try_element_at(pairs, code), code)
    return F.when(short.rlike("^[a-z]{2}$") & (short != "xx"), short).otherwise(UNKNOWN)


def _lengths(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.model(folder, vocabulary)
        size = m.width().itemsize
        for batch in batches:
            n = [len(m.piece(p.as_py())) // size for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["piece", "length"])

    return run


def piece_counts(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by..., piece, n: how often each piece occurs in each slice; summed before the shuffle."""
    return texts.select(*by, F.explode(F.regexp_extract_all(F.col(text), F.lit(JVM_PIECE), F.lit(0))).alias("piece")).groupBy(*by, "piece").agg(F.count("*").alias("n"))


def token_budget(texts: DataFrame, by: list[str], text: str = "text", folder: str = bpe.TOKENIZER_DIR, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """by..., texts, chars, tokens per slice. Null texts count as texts without characters and tokens; ``by`` values may
    be null and form a slice of their own. An empty table gives no rows."""
    counts = piece_counts(texts, by, text)
    lengths = counts.select("piece").distinct().mapInArrow(_lengths(folder, vocabulary), "piece string, length long")
    tokens = counts.join(lengths, "piece").groupBy(*by).agg(F.sum(F.col("n") * F.col("length")).alias("_tokens"))
    sizes = texts.groupBy(*by).agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    t = tokens.select(*[F.col(c).alias(f"_{c}") for c in by], "_tokens")
    same = None
    for c in by:
        cond = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = cond if same is None else same & cond
    return sizes.join(t, same, "left").select(*by, "texts", "chars", F.coalesce("_tokens", F.lit(0)).cast("long").alias("tokens"))


def one_row_per_pair(gold: DataFrame) -> DataFrame:
    """Each id once: of rows with the same id the least by creation, mechanism and the slice columns."""
    rest = ["source_mechanism", "source_framework", "source_language", "source_jurisdiction"]
    first = F.min(F.struct(F.coalesce("created_at", F.timestamp_seconds(F.lit(0))).alias("at"), *rest)).alias("r")
    return gold.groupBy("id").agg(first).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def gold_budget(gold: DataFrame, folder: str = bpe.TOKENIZER_DIR, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """The budget of the source mechanisms of gold pairs: totals per framework, per language, per jurisdiction and per
    combination (``dimension`` says which; the columns it doesn't name are null). Null keys are '(none)'."""
    named = lambda c: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit("(none)")).alias(c)
    rows = one_row_per_pair(gold).select(named("source_framework"), language_code(F.col("source_language")).alias("source_language"), named("source_jurisdiction"), F.col("source_mechanism").alias("text"))
    by = ["source_framework", "source_language", "source_jurisdiction"]
    parts = token_budget(rows, by, "text", folder, vocabulary)
    total = [F.sum(c).cast("long").alias(c) for c in ("texts", "chars", "tokens")]
    sets = parts.groupingSets([["source_framework"], ["source_language"], ["source_jurisdiction"], by], *by).agg(F.grouping_id().alias("_set"), *total)
    name = F.when(F.col("_set") == 3, "framework").when(F.col("_set") == 5, "language").when(F.col("_set") == 6, "jurisdiction").otherwise("all")
    return sets.select(name.alias("dimension"), *by, "texts", "chars", "tokens")
