"""Manifests, registries, gold sets and reports as files."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSONL manifest; blank lines are skipped, a bad line is an error, a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_entries(spark: SparkSession, path: str, entry: str, field: str = "entries") -> DataFrame:
    """The entries of a JSON manifest {version, generated_at, entries: [...]}; a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], entry)
    return spark.read.schema(f"`{field}` array<struct<{entry}>>").option("multiLine", True).json(path).select(F.inline(field))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """framework, position, canonical, display of a registry file; a missing file is an error."""
    df = spark.read.schema("framework string, jurisdiction string, citation_ids array<string>, display_ids array<string>").option("multiLine", True).json(path)
    zipped = F.posexplode(F.arrays_zip("citation_ids", "display_ids")).alias("position", "e")
    return df.select("framework", zipped).select("framework", (F.col("position") + 1).alias("position"), F.col("e.citation_ids").alias("canonical"), F.col("e.display_ids").alias("display"))


GOLD_FIELDS = ["id", *[f"{s}_{f}" for s in ("source", "target") for f in ("jurisdiction", "framework", "citation_id", "mechanism", "language")]]


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid pairs, bad lines): bad lines carry file, line number and what is wrong. Lines end at \\n alone."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("no", "line"))
    v = F.try_parse_json(F.col("line"))
    missing = F.array(*[F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == "STRING", F.lit(False)), F.lit(f)) for f in GOLD_FIELDS])
    rows = lines.where(F.trim("line") != "").select("file", (F.col("no") + 1).alias("line_no"), v.alias("v"), F.array_compact(missing).alias("missing"))
    good = rows.where(F.col("v").isNotNull() & (F.size("missing") == 0)).select(*[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in GOLD_FIELDS], F.try_variant_get("v", "$.notes", "string").alias("notes"))
    bad = rows.where(F.col("v").isNull() | (F.size("missing") > 0)).select("file", "line_no", F.when(F.col("v").isNull(), "not JSON").otherwise(F.concat(F.lit("missing: "), F.array_join("missing", ", "))).alias("problem"))
    return good, bad


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files of a folder or pattern."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_caps(text: str, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(caps, pricing) of a TOML configuration; a provider with both kinds of cap is an error."""
    doc = tomllib.loads(text)
    usd, rpd = doc.get("caps_usd_per_day", {}), doc.get("caps_requests_per_day", {})
    if both := sorted(set(usd) & set(rpd)):
        raise ValueError(f"providers with two caps: {both}")
    caps = [(p, float(usd[p]) if p in usd else None, rpd.get(p)) for p in sorted({*usd, *rpd})]
    prices = [(p, m, float(x["input_per_mtok"]), float(x["output_per_mtok"])) for p, ms in doc.get("pricing", {}).items() for m, x in ms.items()]
    return spark.createDataFrame(caps, "provider string, usd double, rpd int"), spark.createDataFrame(prices, "provider string, model string, in_rate double, out_rate double")


def read_sources(text: str, spark: SparkSession) -> DataFrame:
    """framework, jurisdiction, filename, description, url, manual of a YAML list under ``sources``; each needs exactly one
    of url and manual."""
    import yaml

    rows = []
    for s in (yaml.safe_load(text) or {}).get("sources", []):
        if bool(s.get("url")) == bool(s.get("manual", False)):
            raise ValueError(f"{s.get('framework')}: exactly one of url and manual")
        rows.append((s["framework"], s["jurisdiction"], s["filename"], s["description"], s.get("url"), bool(s.get("manual", False))))
    return spark.createDataFrame(rows, "framework string, jurisdiction string, filename string, description string, url string, manual boolean")


def page_numbers(df: DataFrame, path: str = "path") -> DataFrame:
    """``page_index`` from a file name page_<n>; other names are an error."""
    n = F.regexp_extract(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), r"^page_(\d+)$", 1)
    return df.withColumn("page_index", F.when(n != "", n.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no page number: "), F.col(path))).cast("int")))


def env_values(text: str) -> dict[str, str]:
    """KEY=value lines; comments and blank lines are skipped, quotes around values dropped."""
    pairs = (line.partition("=") for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, eq, v in pairs if eq and re.fullmatch(r"\w+", k.strip())}


def write_jsonl(df: DataFrame, path: str, key: list[str]) -> None:
    """A manifest of a bounded number of rows as one sorted JSONL folder, replaced as a whole by the commit protocol."""
    df.orderBy(*key).coalesce(1).write.mode("overwrite").json(path)


EVAL_COLUMNS = "gold_id model source_jurisdiction source_framework target_jurisdiction target_framework source_language target_language predicted_citation_id expected_citation_id citation_match judge_score judge_bucket judge_reasoning".split()


def eval_csv(rows: DataFrame) -> DataFrame:
    """The 14 columns of the evaluation CSV: scores with four places, line breaks in reasoning as blanks."""
    fixed = {"judge_score": F.format_string("%.4f", "judge_score"), "judge_reasoning": F.translate("judge_reasoning", "\n\r", "  ")}
    return rows.select(*[fixed.get(c, F.col(c)).alias(c) for c in EVAL_COLUMNS])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def score_table(pages: DataFrame) -> DataFrame:
    """Arrays joined by '; ', nulls empty, ratios with three places."""
    number = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.3f", c)), F.lit("")).alias(c)
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ").alias(c)
    return pages.select("parser", "page_index", joined("expected"), joined("extracted"), joined("tp"), joined("fp"), joined("fn"), number("recall"), number("precision"))


def long_metrics(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """keys..., metric, value: one row per measure, for experiment logs."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(keys, measures, "metric", "value")
