"""Model output as JSON, with strict types: a number is no string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.numeric import unit_score

# The buckets of a judge, in their order.
BUCKETS = ("wrong", "partial_wrong", "partial_right", "substantively_right", "exact")


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(_kind(v), F.lit("OBJECT")), F.lit(False))


def parse_candidate(raw: Column, fields: tuple[str, ...] = ("citation_id", "target_mechanism", "mapping_justification")) -> Column:
    """struct(fields..., error): the string fields, or nulls and what is wrong: not JSON, not an object, field."""
    v = F.try_parse_json(raw)
    strings = None
    for f in fields:
        ok = F.coalesce(_kind(_field(v, f)) == "STRING", F.lit(False))
        strings = ok if strings is None else strings & ok
    error = F.when(v.isNull(), "not JSON").when(~is_object(v), "not an object").when(~strings, "field")
    return F.struct(*[F.when(error.isNull(), F.try_variant_get(v, f"$.{f}", "string")).alias(f) for f in fields], error.alias("error"))


def parse_judge(raw: Column) -> Column:
    """struct(score, bucket, reasoning, error): scores clipped, unknown buckets ``wrong``, missing reasoning a
    placeholder; what doesn't parse scores 0 in bucket ``wrong``. A score that is no number counts as 0."""
    v = F.try_parse_json(raw)
    ok = is_object(v)
    bucket = F.try_variant_get(v, "$.bucket", "string")
    reasoning = F.try_variant_get(v, "$.reasoning", "string")
    error = F.when(v.isNull(), "not JSON").when(~ok, "not an object")
    return F.struct(
        F.when(ok, unit_score(F.try_variant_get(v, "$.score", "double"))).otherwise(0.0).alias("score"),
        F.when(ok & bucket.isin(*BUCKETS), bucket).otherwise("wrong").alias("bucket"),
        F.when(~ok | v.isNull(), "judge output did not parse").otherwise(F.coalesce(F.when(reasoning != "", reasoning), F.lit("<no reasoning returned>"))).alias("reasoning"),
        error.alias("error"),
    )


def pair_list(raw: Column) -> Column:
    """The list in a model's answer as a variant: code fences dropped; a list itself, or the first list among the fields
    pairs, data, items, mapping_pairs; null where there is none."""
    body = F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    v = F.try_parse_json(body)
    options = [F.when(F.startswith(_kind(v), F.lit("ARRAY")), v)]
    options += [F.when(F.startswith(_kind(_field(v, f)), F.lit("ARRAY")), _field(v, f)) for f in ("pairs", "data", "items", "mapping_pairs")]
    return F.coalesce(*options)
