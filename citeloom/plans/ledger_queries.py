"""Ledger, audit, density, retrieval, keyed tables, gates and extensions: queries and their SQL twins."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import numeric
from citeloom.operators import audit, ensemble, gates, ledger, retrieval, tables
from citeloom.plans.citation_queries import norm_sql
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


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as calls: the event's type is the provider, tokens come from its properties."""
    e = table(spark, folder, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return e.select("event_id", "ts", F.col("event_type").alias("provider"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), k.alias("input_tokens"), (k * 2).alias("output_tokens"), F.coalesce(F.round(F.abs("value"), 4), F.lit(0.0)).alias("cost"))


_CALLS = """calls AS (SELECT event_id, ts, event_type AS provider, 'm' || (user_id % 5) AS model, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS input_tokens,
  coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) * 2 AS output_tokens, coalesce(round(abs(value), 4), 0.0) AS cost FROM events)"""
_PROVIDERS = "(SELECT DISTINCT provider FROM calls)"


def _caps(calls: DataFrame) -> DataFrame:
    """Providers whose name sorts before 'p' pay; the others have a request cap."""
    p = calls.select("provider").distinct()
    paid = F.col("provider") < "p"
    return p.select("provider", F.when(paid, 30.0).alias("usd"), F.when(~paid, 1500).alias("rpd"))


def _pricing(calls: DataFrame) -> DataFrame:
    m = calls.select("provider", "model").distinct().where("model <> 'm4'")
    return m.withColumns({"in_rate": F.lit(3.0), "out_rate": F.lit(15.0)})


@query(
    f"""WITH {_CALLS} SELECT event_id, CASE WHEN provider < 'p' THEN 'paid' ELSE 'free' END AS kind,
  round(CASE WHEN provider >= 'p' THEN 0.0 WHEN model <> 'm4' THEN (input_tokens * 3.0 + output_tokens * 15.0) / 1000000 END, 8) AS cost,
  CASE WHEN provider < 'p' AND model = 'm4' THEN 'unknown model' END AS problem FROM calls"""
)
def jn06_priced_calls(spark, folder):
    c = _calls(spark, folder).drop("cost")
    return ledger.priced(c, _caps(c), _pricing(c)).select("event_id", "kind", F.round("cost", 8).alias("cost"), "problem")


@query(f"WITH {_CALLS} SELECT DISTINCT provider, CASE WHEN provider < 'p' THEN 'paid' ELSE 'free' END AS kind FROM calls")
def jn07_provider_kind(spark, folder):
    return ledger.provider_kind(_caps(_calls(spark, folder)))


@query(f"WITH {_CALLS} SELECT event_id, round((input_tokens * 3.0 + output_tokens * 15.0) / 1000000, 8) AS cost FROM calls")
def fn13_token_cost(spark, folder):
    c = _calls(spark, folder)
    return c.select("event_id", F.round(numeric.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(3.0), F.lit(15.0)), 8).alias("cost"))


@query(f"WITH {_CALLS} SELECT CAST(ts AS DATE) AS day, provider, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS n_calls, round(sum(cost), 4) AS cost FROM calls GROUP BY ALL")
def ag05_daily_rollup(spark, folder):
    return ledger.daily(_calls(spark, folder))


@query(f"WITH {_CALLS} SELECT CAST(ts AS DATE) AS day, provider, round(sum(cost), 4) AS cost FROM calls GROUP BY ALL")
def ag06_daily_totals(spark, folder):
    return ledger.daily_totals(_calls(spark, folder))


@query(f"WITH {_CALLS} SELECT round(coalesce(sum(cost), 0), 4) AS spent FROM calls WHERE provider = 'click' AND CAST(ts AS DATE) = DATE '2024-01-05'")
def ag07_spent_today(spark, folder):
    return ledger.spent_on(_calls(spark, folder), "click", "2024-01-05").select("spent")


@query(f"WITH {_CALLS} SELECT count(*) AS n FROM calls WHERE provider = 'click' AND CAST(ts AS DATE) = DATE '2024-01-05'")
def ag08_requests_today(spark, folder):
    return ledger.spent_on(_calls(spark, folder), "click", "2024-01-05").select("n")


@query(
    f"""WITH {_CALLS}, t AS (SELECT CAST(ts AS DATE) AS day, provider, round(sum(cost), 4) AS cost FROM calls GROUP BY ALL),
  m AS (SELECT quantile_cont(cost, 0.3) AS thr FROM t),
  grid AS (SELECT d.day, p.provider, coalesce(t.cost, 0) AS cost FROM (SELECT DISTINCT day FROM t) d CROSS JOIN (SELECT DISTINCT provider FROM t) p LEFT JOIN t USING (day, provider)),
  b AS (SELECT provider, sum(CASE WHEN cost < (SELECT round(thr, 4) FROM m) THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY day DESC) AS breaks FROM grid)
  SELECT provider, count(*) FILTER (WHERE breaks = 0) AS streak FROM b GROUP BY provider"""
)
def wn01_streaks(spark, folder):
    totals = ledger.daily_totals(_calls(spark, folder))
    threshold = totals.agg(F.round(F.percentile("cost", 0.3), 4)).first()[0]
    return ledger.streaks(totals, threshold if threshold is not None else 0.0)


@query(
    f"""WITH RECURSIVE {_CALLS}, o AS (SELECT event_id, provider, CAST(ts AS DATE) AS day, cost, row_number() OVER (PARTITION BY provider, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM calls),
  f AS (SELECT event_id, provider, day, n, cost <= 500.0 AS admitted, CASE WHEN cost <= 500.0 THEN cost ELSE 0.0 END AS spent FROM o WHERE n = 1
    UNION ALL
    SELECT o.event_id, o.provider, o.day, o.n, f.spent + o.cost <= 500.0, CASE WHEN f.spent + o.cost <= 500.0 THEN f.spent + o.cost ELSE f.spent END
    FROM f JOIN o ON o.provider = f.provider AND o.day = f.day AND o.n = f.n + 1)
  SELECT event_id, admitted FROM f"""
)
def wn02_spend_admission(spark, folder):
    return ledger.admit_spend(_calls(spark, folder), 500.0).select("event_id", "admitted")


@query(f"WITH {_CALLS} SELECT event_id, row_number() OVER (PARTITION BY provider, CAST(ts AS DATE) ORDER BY ts, event_id) <= 40 AS admitted FROM calls")
def wn03_request_admission(spark, folder):
    return ledger.admit_requests(_calls(spark, folder), 40).select("event_id", "admitted")


@query(
    f"""WITH {_CALLS}, s AS (SELECT event_id, round(sum(cost) OVER (PARTITION BY provider, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent FROM calls)
  SELECT event_id, spent, spent > 500 AS over FROM s"""
)
def wn04_over_cap(spark, folder):
    return ledger.over_cap(_calls(spark, folder), 500.0).select("event_id", "spent", "over")


@query(
    f"""WITH {_CALLS}, w AS (SELECT event_id, count(*) OVER (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS in_window FROM calls)
  SELECT event_id, in_window, in_window > 10 AS dense FROM w"""
)
def wn06_window_density(spark, folder):
    return ledger.window_density(_calls(spark, folder)).select("event_id", "in_window", "dense")


@query(f"WITH {_CALLS}, t AS (SELECT CAST(ts AS DATE) AS day, provider, round(sum(cost), 4) AS cost, count(*) AS n FROM calls GROUP BY ALL) SELECT day, provider, CASE WHEN cost > 3000 THEN 'OVER' WHEN cost >= 2500 THEN 'WARN' ELSE 'OK' END AS spend_flag, CASE WHEN n > 70 THEN 'OVER' WHEN n >= 56 THEN 'WARN' ELSE 'OK' END AS request_flag FROM t")
def fn17_flags(spark, folder):
    t = _calls(spark, folder).groupBy(ledger.day().alias("day"), "provider").agg(F.round(F.sum("cost"), 4).alias("cost"), F.count("*").alias("n"))
    return t.select("day", "provider", numeric.spend_flag(F.col("cost"), F.lit(3000.0), F.lit(2500.0)).alias("spend_flag"), numeric.request_flag(F.col("n"), F.lit(70)).alias("request_flag"))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def fn18_utc_day(spark, folder):
    return table(spark, folder, "events").select("event_id", ledger.day().alias("day"))


_PAID_STREAKS = f"""WITH {_CALLS}, t AS (SELECT CAST(ts AS DATE) AS day, provider, round(sum(cost), 4) AS cost FROM calls GROUP BY ALL),
  m AS (SELECT round(quantile_cont(cost, 0.3), 4) AS thr FROM t),
  grid AS (SELECT d.day, p.provider, coalesce(t.cost, 0) AS cost FROM (SELECT DISTINCT day FROM t) d CROSS JOIN (SELECT DISTINCT provider FROM t) p LEFT JOIN t USING (day, provider)),
  b AS (SELECT provider, sum(CASE WHEN cost < (SELECT thr FROM m) THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY day DESC) AS breaks FROM grid),
  s AS (SELECT provider, count(*) FILTER (WHERE breaks = 0) AS streak FROM b WHERE provider < 'p' GROUP BY provider)"""


def _alerts(spark, folder, days: list[int]):
    calls = _calls(spark, folder)
    totals = ledger.daily_totals(calls)
    threshold = totals.agg(F.round(F.percentile("cost", 0.3), 4)).first()[0]
    parts = [ledger.spend_alert(totals, ledger.provider_kind(_caps(calls)), threshold or 0.0, n).select(F.lit(n).alias("days"), "exit_code") for n in days]
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@query(_PAID_STREAKS + " SELECT CAST(d.days AS INTEGER) AS days, CAST(coalesce((SELECT max(CASE WHEN streak >= d.days THEN 1 ELSE 0 END) FROM s), 0) AS INTEGER) AS exit_code FROM (VALUES (1), (2), (3), (5), (40)) d(days)")
def gt03_alert(spark, folder):
    """The alert of paid providers' streaks, for several lengths."""
    return _alerts(spark, folder, [1, 2, 3, 5, 40])


@query(f"WITH {_CALLS} SELECT event_id, provider < 'p' OR row_number() OVER (PARTITION BY provider, CAST(ts AS DATE) ORDER BY ts, event_id) <= 20 AS admitted, false AS over FROM calls")
def wn05_override(spark, folder):
    """Caps of 20 calls a day, overridden for the paid providers; all calls are recorded, none of theirs is over."""
    calls = _calls(spark, folder)
    paid = F.col("provider") < "p"
    parts = [ledger.admit_requests(calls.where(paid), 20, override=True), ledger.admit_requests(calls.where(~paid), 20)]
    over = ledger.over_cap(calls, 0.0, override=True).select("event_id", "over")
    return parts[0].unionByName(parts[1]).select("event_id", "admitted").join(over, "event_id")


def _lang_docs(spark, folder):
    return table(spark, folder, "documents").select(F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang"), "text")


_TOKENS = r"regexp_extract_all(text, '[A-Za-z0-9]+|[^\sA-Za-z0-9\x{000B}]')"
_LANG = "docs AS (SELECT lower(substr(trim(lang), 1, 2)) AS lang, text FROM documents)"
_AUDIT = rf"""{_LANG}, sizes AS (SELECT lang, sum(length(text)) AS total_chars, sum(len(regexp_extract_all(text, '[^\s\x{{00A0}}\x{{000B}}\x{{0085}}\x{{2028}}\x{{2029}}\x{{3000}}\x{{2000}}-\x{{200A}}]+'))) AS words FROM docs GROUP BY lang),
  pieces AS (SELECT lang, unnest({_TOKENS}) AS piece FROM docs),
  per AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE strlen(piece) = 1) AS single, quantile_cont(length(piece), 0.5) AS p50, quantile_cont(length(piece), 0.9) AS p90, quantile_cont(length(piece), 0.99) AS p99 FROM pieces GROUP BY lang),
  audit AS (SELECT s.lang, CAST(total_chars AS BIGINT) AS total_chars, n AS total_tokens, round(n / total_chars, 6) AS tokens_per_char, round(CASE WHEN coalesce(s.lang, '') <> 'th' THEN n / words END, 6) AS tokens_per_word,
    round(single / n, 6) AS single_byte_token_fraction, round(p50, 6) AS token_char_len_p50, round(p90, 6) AS token_char_len_p90, round(p99, 6) AS token_char_len_p99
    FROM sizes s JOIN per ON per.lang IS NOT DISTINCT FROM s.lang)"""
_VERDICT = """CASE WHEN lang = 'th' THEN CASE WHEN single_byte_token_fraction >= 0.2 THEN 'FAIL_S5' WHEN tokens_per_char >= 2.0 THEN 'FAIL_M0' WHEN tokens_per_char >= 2.5 OR single_byte_token_fraction >= 0.15 THEN 'WARN_R4' ELSE 'PASS' END
  WHEN lang IN ('fr', 'de', 'en') THEN CASE WHEN tokens_per_char > 1.5 THEN 'WARN' ELSE 'PASS' END ELSE 'PASS' END"""


@query(f"WITH {_AUDIT} SELECT * FROM audit")
def ag11_token_audit(spark, folder):
    return audit.audit(_lang_docs(spark, folder))


@query("SELECT framework, round(quantile_cont(char_count, 0.5), 6) AS p50, round(quantile_cont(char_count, 0.9), 6) AS p90, round(quantile_cont(char_count, 0.99), 6) AS p99 FROM ingest_manifest WHERE char_count IS NOT NULL GROUP BY framework")
def ag12_percentiles(spark, folder):
    p = F.percentile("char_count", [0.5, 0.9, 0.99])
    return table(spark, folder, "ingest_manifest").where("char_count IS NOT NULL").groupBy("framework").agg(p.alias("p")).select("framework", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@query(f"WITH {_AUDIT} SELECT lang, {_VERDICT} AS verdict FROM audit")
def ev06_audit_verdicts(spark, folder):
    a = audit.audit(_lang_docs(spark, folder))
    return a.select("lang", audit.verdict(F.col("lang"), F.col("tokens_per_char"), F.col("single_byte_token_fraction")).alias("verdict"))


@query(f"WITH {_AUDIT}, v AS (SELECT {_VERDICT} AS verdict FROM audit) SELECT CAST(max(CASE WHEN verdict LIKE 'FAIL%' THEN 3 WHEN verdict LIKE 'WARN%' THEN 1 ELSE 0 END) AS INTEGER) AS exit_code FROM v")
def gt02_audit_exit(spark, folder):
    return audit.exit_code(ev06_audit_verdicts(spark, folder))


@query(
    rf"""WITH {_LANG}, c AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM docs),
  ok AS (SELECT lang, ch, CAST(strlen(ch) AS BIGINT) AS tokens FROM c WHERE NOT regexp_matches(ch, '[\p{{C}}\p{{Z}}]')),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tokens DESC, ch DESC) AS rank FROM ok) SELECT lang, ch, tokens, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"""
)
def so04_fragmented_characters(spark, folder):
    return audit.fragmented_characters(_lang_docs(spark, folder))


def _density(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "source", "text")
    pages = F.greatest(F.lit(1), F.floor(F.length("text") / 2500)).cast("long")
    return audit.density(docs, pages, F.when(F.startswith("source", F.lit("mirror")), "print").otherwise("regulator"))


_MARKS = r"len(regexp_extract_all(text, '(?i)(?:§[\s\x{00A0}]*\p{Nd}+|\bArticle[\s\x{00A0}]+\p{Nd}+|\bArt\.?[\s\x{00A0}]+\p{Nd}+|\bSection[\s\x{00A0}]+\p{Nd}+|\bSec\.?[\s\x{00A0}]+\p{Nd}+|มาตรา[\s\x{00A0}]*[๐-๙0-9]+)'))"
_DENSITY = f"""d AS (SELECT CASE WHEN source LIKE 'mirror%' THEN 'print' ELSE 'regulator' END AS grp, round({_MARKS} / greatest(1, length(text) // 2500), 6) AS cites_per_page FROM documents WHERE text IS NOT NULL),
  r AS (SELECT round(avg(cites_per_page) FILTER (WHERE grp = 'print'), 6) AS mean_one, round(avg(cites_per_page) FILTER (WHERE grp = 'regulator'), 6) AS mean_other, count(*) FILTER (WHERE grp = 'print') AS n_one, count(*) FILTER (WHERE grp = 'regulator') AS n_other FROM d)"""


@query(f"WITH {_DENSITY} SELECT *, round(mean_one / nullif(mean_other, 0), 6) AS ratio, CASE WHEN mean_one / mean_other >= 0.5 THEN 'PASS' WHEN mean_one / mean_other IS NOT NULL THEN 'FAIL' END AS verdict FROM r")
def ag10_density_report(spark, folder):
    return audit.density_report(_density(spark, folder), "print", "regulator")


@query(f"WITH {_DENSITY} SELECT CASE WHEN mean_one / mean_other >= 0.5 THEN 'PASS' WHEN mean_one / mean_other IS NOT NULL THEN 'FAIL' END AS verdict FROM r")
def gt05_density_gate(spark, folder):
    return audit.density_report(_density(spark, folder), "print", "regulator").select("verdict")


@query("SELECT doc_id, source, coalesce(source LIKE 'mirror%', false) AS flagged FROM documents")
def so03_report_order(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source", F.coalesce(F.startswith("source", F.lit("mirror")), F.lit(False)).alias("flagged"))
    return d.orderBy("flagged", "source", "doc_id")


def _vectors(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("jurisdiction"), "embedding")
    return retrieval.build_index(e)


def _retrieved(spark, folder, within=True):
    index = _vectors(spark, folder)
    return retrieval.nearest(index, index.where(F.col("id") % 50 == 0), within)


_DOT = "list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_UNIT = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(CAST(v AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda w: CAST(w AS DOUBLE) * CAST(w AS DOUBLE)))) AS FLOAT)) AS embedding FROM embeddings)"
_NEAREST = f"""{_UNIT}, s AS (SELECT q.vec_id AS query_id, x.vec_id AS hit_id, round({_DOT}, 6) AS cosine FROM e q JOIN e x ON q.label = x.label AND q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, hit_id) AS rn FROM s) WHERE rn = 1)"""


@query(f"WITH {_NEAREST} SELECT query_id, hit_id, cosine FROM best")
def rt02_nearest_in_bucket(spark, folder):
    return _retrieved(spark, folder)


@query(
    f"""WITH {_UNIT}, s AS (SELECT q.vec_id AS query_id, x.vec_id AS hit_id, round({_DOT}, 6) AS cosine FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
  SELECT query_id, hit_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, hit_id) AS rn FROM s) WHERE rn = 1"""
)
def so06_nearest_overall(spark, folder):
    return _retrieved(spark, folder, within=False)


def _routed(spark, folder):
    queries = _vectors(spark, folder).where(F.col("id") % 50 == 0).select("id")
    got = retrieval.retrieve(queries, _retrieved(spark, folder), 0.35)
    tuned = queries.where(F.col("id") % 100 == 0).select("id", F.concat(F.lit("ft-"), F.col("id").cast("string")).alias("answer"))
    return queries, got, tuned


@query(
    f"""WITH {_NEAREST}, q AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 50 = 0)
  SELECT id, CASE WHEN cosine >= 0.35 THEN 'gold-retrieval' WHEN id % 100 = 0 THEN 'fine-tune-generalization' ELSE 'no-confident-match' END AS provenance,
  CASE WHEN cosine >= 0.35 THEN CAST(hit_id AS VARCHAR) WHEN id % 100 = 0 THEN 'ft-' || id END AS answer FROM q LEFT JOIN best ON query_id = id"""
)
def rt03_route(spark, folder):
    _, got, tuned = _routed(spark, folder)
    return retrieval.route(got, tuned)


@query(
    f"""WITH {_NEAREST}, q AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 50 = 0), w AS (SELECT id, CASE WHEN cosine >= 0.35 THEN CAST(hit_id AS VARCHAR) END AS retrieval,
  CASE WHEN id % 100 = 0 THEN 'ft-' || id END AS fine_tune, CASE WHEN id % 150 = 0 THEN 'gold' ELSE 'base' END AS reference FROM q LEFT JOIN best ON query_id = id)
  SELECT id, 'retrieval' AS label, retrieval AS answer FROM w UNION ALL SELECT id, 'fine_tune', fine_tune FROM w UNION ALL SELECT id, 'reference', reference FROM w"""
)
def rt05_side_by_side(spark, folder):
    queries, got, tuned = _routed(spark, folder)
    gold = queries.where(F.col("id") % 150 == 0).withColumn("answer", F.lit("gold"))
    return retrieval.side_by_side(got, tuned, gold, queries.withColumn("answer", F.lit("base")))


@query("SELECT CAST(label AS VARCHAR) AS jurisdiction, count(*) AS n FROM embeddings GROUP BY 1")
def rt01_index_buckets(spark, folder):
    return _vectors(spark, folder).groupBy("jurisdiction").agg(F.count("*").alias("n"))


@query(f"WITH {_NEAREST}, cut AS (SELECT round(quantile_cont(cosine, 0.9), 6) AS c FROM best) SELECT query_id, cosine, cosine >= (SELECT c FROM cut) AS in_domain FROM best")
def sp05_in_domain(spark, folder):
    return retrieval.domain_flags(_retrieved(spark, folder))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 5) AS squared FROM embeddings")
def fn23_dot(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.round(numeric.dot(F.col("embedding"), F.col("embedding")), 5).alias("squared"))


def _orders(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    base = o.where("o_orderkey % 3 <> 0")
    new = o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("U"))
    return base, new


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"""
)
def st01_upsert(spark, folder):
    base, new = _orders(spark, folder)
    return tables.upsert(base, new, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0")
def sp06_remaining(spark, folder):
    base, new = _orders(spark, folder)
    return tables.remaining(base, new, ["o_orderkey"]).select("o_orderkey")


_LATEST = "row_number() OVER (PARTITION BY framework, pdf_relpath ORDER BY parsed_at DESC, sha256_pdf DESC) AS rn"


@query(f"SELECT framework, pdf_relpath, sha256_pdf, failed FROM (SELECT *, {_LATEST} FROM ingest_manifest) WHERE rn = 1")
def wn07_latest_row(spark, folder):
    m = table(spark, folder, "ingest_manifest").select("framework", "pdf_relpath", "sha256_pdf", "failed", "parsed_at")
    return tables.latest(m, ["framework", "pdf_relpath"], [F.col("parsed_at"), F.col("sha256_pdf")]).drop("parsed_at")


@query("SELECT framework, arg_min(citation_id, struct_pack(a := added_at, b := citation_id)) AS first_id FROM registry_entries WHERE added_at IS NOT NULL GROUP BY framework")
def wn08_first_wins(spark, folder):
    return table(spark, folder, "registry_entries").where("added_at IS NOT NULL").groupBy("framework").agg(F.min_by("citation_id", F.struct("added_at", "citation_id")).alias("first_id"))


@query("SELECT DISTINCT model, gold_id FROM eval_rows")
def wn09_pair_order(spark, folder):
    return table(spark, folder, "eval_rows").select("model", "gold_id").distinct().orderBy("model", "gold_id")


_CUT = "TIMESTAMP '2025-06-01'"


@query(
    f"""WITH cur AS (SELECT DISTINCT framework, pdf_relpath, sha256_pdf AS sha FROM ingest_manifest WHERE parsed_at AT TIME ZONE 'UTC' >= {_CUT}),
  prior AS (SELECT * FROM (SELECT *, {_LATEST} FROM ingest_manifest WHERE parsed_at AT TIME ZONE 'UTC' < {_CUT}) WHERE rn = 1)
  SELECT c.framework, c.pdf_relpath, c.sha, coalesce(p.sha256_pdf = c.sha AND NOT coalesce(p.failed, false) AND p.md_relpath IS NOT NULL, false) AS skip FROM cur c LEFT JOIN prior p ON p.framework = c.framework AND p.pdf_relpath = c.pdf_relpath"""
)
def pf04_skip_unchanged(spark, folder):
    m = table(spark, folder, "ingest_manifest")
    late = F.col("parsed_at") >= F.lit("2025-06-01").cast("timestamp")
    cur = m.where(late).select("framework", "pdf_relpath", F.col("sha256_pdf").alias("sha")).distinct()
    prior = m.where(~late).select("framework", "pdf_relpath", F.col("sha256_pdf").alias("sha"), "failed", F.col("md_relpath").alias("output"), F.struct("parsed_at", "sha256_pdf").alias("pos"))
    return tables.unchanged(cur, prior, ["framework", "pdf_relpath"])


@query("SELECT framework, len(source_sha256) >= 1 AS same FROM registry_manifest WHERE source_sha256 IS NOT NULL")
def pf05_same_sources(spark, folder):
    m = table(spark, folder, "registry_manifest").where("source_sha256 IS NOT NULL")
    return m.select("framework", tables.same_set(F.reverse("source_sha256"), F.col("source_sha256")).alias("same"))


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size > 40 THEN CASE WHEN p_partkey % 2 = 0 THEN 'manual_present' ELSE 'manual_missing' END
  WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'skipped_idempotent' ELSE 'downloaded' END AS outcome FROM part"""
)
def pf06_fetch_outcomes(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_size", "p_name")
    spec = p.select("p_partkey", (F.col("p_size") > 40).alias("manual"))
    disk = p.where("p_partkey % 2 = 0").select("p_partkey", F.sha2("p_name", 256).alias("disk_sha"))
    known = p.where("p_partkey % 3 = 0").select("p_partkey", F.sha2("p_name", 256).alias("known_sha"))
    return tables.outcomes(spec, disk, known, ["p_partkey"])


@query(
    """SELECT DISTINCT q.id, q.k, f.first_target FROM (SELECT DISTINCT id, source_citation_id || '|' || source_framework || '|' || target_jurisdiction AS k FROM gold_pairs) q
  LEFT JOIN (SELECT source_citation_id || '|' || source_framework || '|' || target_jurisdiction AS k, arg_min(target_citation_id, id) AS first_target FROM gold_pairs WHERE target_citation_id IS NOT NULL GROUP BY 1) f ON f.k = q.k"""
)
def jn08_gold_lookup(spark, folder):
    g = table(spark, folder, "gold_pairs")
    k = F.concat(F.col("source_citation_id"), F.lit("|"), F.col("source_framework"), F.lit("|"), F.col("target_jurisdiction")).alias("k")
    right = g.where("target_citation_id IS NOT NULL").select(k, "id", F.col("target_citation_id").alias("first_target"))
    return tables.first_match(g.select("id", k).distinct(), right.withColumnRenamed("id", "pos"), ["k"], "pos").select("id", "k", "first_target")


@query("SELECT DISTINCT framework, citation_id FROM registry_entries e WHERE NOT EXISTS (SELECT 1 FROM eval_rows v WHERE v.target_framework = e.framework AND v.expected_citation_id = e.display_id)")
def jn09_uncited_sections(spark, folder):
    e = table(spark, folder, "registry_entries").select("framework", "citation_id", "display_id")
    v = table(spark, folder, "eval_rows").select(F.col("target_framework").alias("framework"), F.col("expected_citation_id").alias("display_id"))
    return tables.without_match(e, v, ["framework", "display_id"]).select("framework", "citation_id").distinct()


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def jn01_source_manifest(spark, folder):
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query(
    """SELECT d.doc_id, m.n AS rows FROM documents d JOIN (SELECT md_relpath, count(*) AS n FROM ingest_manifest WHERE NOT failed AND md_relpath IS NOT NULL GROUP BY md_relpath) m ON m.md_relpath = d.md_relpath"""
)
def jn03_manifest_documents(spark, folder):
    m = table(spark, folder, "ingest_manifest").where("NOT failed AND md_relpath IS NOT NULL").groupBy("md_relpath").agg(F.count("*").alias("rows"))
    return table(spark, folder, "documents").select("doc_id", "md_relpath").join(m, "md_relpath").select("doc_id", "rows")


@query("SELECT g.framework, m.model FROM (SELECT DISTINCT framework FROM registry_manifest) g CROSS JOIN (SELECT DISTINCT category AS model FROM sample_targets WHERE dimension = 'model') m")
def jn04_generation_grid(spark, folder):
    frameworks = table(spark, folder, "registry_manifest").select("framework").distinct()
    models = table(spark, folder, "sample_targets").where("dimension = 'model'").select(F.col("category").alias("model")).distinct()
    return frameworks.crossJoin(models)  # two fixed dimension tables


@query("SELECT DISTINCT framework, pdf_relpath FROM ingest_manifest WHERE framework IN ('udpr_wv', 'tla_tq')")
def pf01_allow_list(spark, folder):
    return table(spark, folder, "ingest_manifest").where(F.col("framework").isin("udpr_wv", "tla_tq")).select("framework", "pdf_relpath").distinct()


@query("SELECT DISTINCT framework, pdf_relpath FROM ingest_manifest WHERE framework IN ('udpr_wv', 'tla_tq') AND regexp_matches(pdf_relpath, '/act_[0-9]+\\.pdf$')")
def pf02_subset(spark, folder):
    return pf01_allow_list(spark, folder).where(F.col("pdf_relpath").rlike(r"/act_[0-9]+\.pdf$"))


@query("SELECT framework, count(DISTINCT md_relpath) AS files FROM ingest_manifest WHERE NOT failed AND md_relpath IS NOT NULL GROUP BY framework")
def pf03_usable_documents(spark, folder):
    return table(spark, folder, "ingest_manifest").where("NOT failed AND md_relpath IS NOT NULL").groupBy("framework").agg(F.countDistinct("md_relpath").alias("files"))


@query(r"SELECT DISTINCT framework, pdf_relpath, concat_ws('/', 'data/ingest', jurisdiction, framework, regexp_replace(regexp_extract(pdf_relpath, '[^/]*$'), '\.[^.]*$', '.md')) AS md_path FROM ingest_manifest")
def pf07_output_paths(spark, folder):
    name = F.regexp_replace(F.regexp_extract("pdf_relpath", r"([^/]*)$", 1), r"\.[^.]*$", ".md")
    return table(spark, folder, "ingest_manifest").select("framework", "pdf_relpath", F.concat_ws("/", F.lit("data/ingest"), "jurisdiction", "framework", name).alias("md_path")).distinct()


@query("SELECT framework, citation_id, heading FROM registry_entries WHERE framework = 'udpr_wv' AND citation_id = '1' ORDER BY added_at LIMIT 1")
def pf08_point_lookup(spark, folder):
    e = table(spark, folder, "registry_entries").where("framework = 'udpr_wv' AND citation_id = '1'")
    return e.orderBy("added_at").limit(1).select("framework", "citation_id", "heading")  # a lookup of one row


@query("SELECT DISTINCT id, source_framework || '__' || target_framework AS framework_pair FROM gold_pairs")
def pf10_framework_pair(spark, folder):
    return table(spark, folder, "gold_pairs").select("id", F.concat_ws("__", "source_framework", "target_framework").alias("framework_pair")).distinct()


@query("SELECT framework, pdf_relpath, parsed_at AT TIME ZONE 'UTC' AS parsed_at, (framework = 'udpr_wv' AND regexp_matches(pdf_relpath, '/order_')) AS flagged FROM (SELECT DISTINCT framework, pdf_relpath, parsed_at FROM ingest_manifest)")
def pf12_print_flag(spark, folder):
    m = table(spark, folder, "ingest_manifest").select("framework", "pdf_relpath", F.col("parsed_at").cast("timestamp_ntz").alias("parsed_at")).distinct()
    return m.withColumn("flagged", (F.col("framework") == "udpr_wv") & F.col("pdf_relpath").contains("/order_"))


@query("SELECT DISTINCT id AS gold_id, source_mechanism AS source_clause_text, target_jurisdiction, target_framework, target_citation_id, target_mechanism FROM gold_pairs WHERE trim(source_mechanism) <> ''")
def pf15_index_entries(spark, folder):
    g = table(spark, folder, "gold_pairs").where(F.trim("source_mechanism") != "")
    return g.select(F.col("id").alias("gold_id"), F.col("source_mechanism").alias("source_clause_text"), "target_jurisdiction", "target_framework", "target_citation_id", "target_mechanism").distinct()


@query("SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE coalesce(toy_gold_recall, 0) < 1) AS failing, CAST(CASE WHEN count(*) = 0 THEN 2 WHEN bool_or(coalesce(toy_gold_recall, 0) < 1) THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM registry_manifest")
def gt01_registry_gate(spark, folder):
    return gates.registry_gate(table(spark, folder, "registry_manifest"))


@query(
    """WITH g AS (SELECT DISTINCT id, source_jurisdiction, target_jurisdiction FROM gold_pairs), c AS (SELECT j, count(*) AS n FROM (SELECT DISTINCT id, unnest([source_jurisdiction, target_jurisdiction]) AS j FROM g) GROUP BY j)
  SELECT w.j AS jurisdiction, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(n, 0) >= 20 AS ok FROM (SELECT unnest(['wv', 'tq', 'zz']) AS j) w LEFT JOIN c ON c.j = w.j
  UNION ALL SELECT '(all)', count(*), count(*) >= 100 FROM g"""
)
def gt04_gold_coverage(spark, folder):
    g = table(spark, folder, "gold_pairs").select("id", "source_jurisdiction", "target_jurisdiction").distinct()
    return gates.coverage(g, ["wv", "tq", "zz"], 100, 20)


@query("SELECT count(*) FILTER (WHERE (p_partkey % 2 = 0) <> (p_size > 25)) AS valid, count(*) AS n FROM part")
def gt07_exactly_one(spark, folder):
    p = table(spark, folder, "part").select(F.when(F.col("p_partkey") % 2 == 0, "u").alias("url"), (F.col("p_size") > 25).alias("manual"))
    return p.agg(F.count_if(gates.exactly_one("url", "manual")).alias("valid"), F.count("*").alias("n"))


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE failed) AS failures, CAST(CASE WHEN bool_or(failed) THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM ingest_manifest")
def gt08_run_status(spark, folder):
    return gates.run_status(table(spark, folder, "ingest_manifest"))


@query("SELECT DISTINCT framework, pdf_relpath FROM ingest_manifest")
def so02_manifest_order(spark, folder):
    return table(spark, folder, "ingest_manifest").select("framework", "pdf_relpath").distinct().orderBy("framework", "pdf_relpath")


@query("SELECT DISTINCT category FROM sample_targets WHERE dimension = 'model' AND category NOT IN (SELECT model FROM eval_rows WHERE model IS NOT NULL)")
def st05_missing_values(spark, folder):
    want = table(spark, folder, "sample_targets").where("dimension = 'model'").select("category").distinct()
    return want.exceptAll(want.join(table(spark, folder, "eval_rows").select(F.col("model").alias("category")), "category", "left_semi"))


@query("SELECT DISTINCT eval_id, printf('%.4f', judge_score) AS judge_score, translate(judge_reasoning, chr(10) || chr(13), '  ') AS judge_reasoning FROM eval_rows WHERE judge_score IS NOT NULL AND NOT isnan(judge_score)")
def sk04_eval_csv(spark, folder):
    e = table(spark, folder, "eval_rows").where("judge_score IS NOT NULL AND NOT isnan(judge_score)")
    return e.select("eval_id", F.format_string("%.4f", "judge_score").alias("judge_score"), F.translate("judge_reasoning", "\n\r", "  ").alias("judge_reasoning")).distinct()


_VOTES = f"""v AS (SELECT DISTINCT gold_id AS item, model AS m, {norm_sql("coalesce(predicted_citation_id, '')")} AS id FROM eval_rows WHERE model IS NOT NULL AND gold_id IS NOT NULL),
  p AS (SELECT item, id, count(DISTINCT m) AS n FROM v GROUP BY ALL),
  b AS (SELECT item, max(n) FILTER (WHERE id <> '') AS agree, count(DISTINCT CASE WHEN id <> '' THEN CASE WHEN regexp_matches(id, '^[0-9]+[A-Za-z]?') THEN upper(regexp_extract(id, '^([0-9]+[A-Za-z]?)', 1)) ELSE id END END) AS bases FROM p GROUP BY item),
  w AS (SELECT item, count(DISTINCT m) AS voters FROM v GROUP BY item),
  t AS (SELECT w.item, voters, CAST(coalesce(agree, 0) AS BIGINT) AS agree, bases, CASE WHEN voters >= 4 AND coalesce(agree, 0) >= voters THEN 'HIGH'
    WHEN coalesce(agree, 0) / voters >= 0.75 OR (bases = 1 AND coalesce(agree, 0) > 0) THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM w JOIN b USING (item))"""


@query(f"WITH {_VOTES} SELECT * FROM t")
def sp02_agreement_tiers(spark, folder):
    v = table(spark, folder, "eval_rows").where("model IS NOT NULL AND gold_id IS NOT NULL")
    return ensemble.agreement_tiers(v, "gold_id", "model", "predicted_citation_id")


_BUCKET = "CAST(('0x' || substr(md5({c}), 1, 7)) AS BIGINT) % 100"


@query(f"SELECT DISTINCT id FROM gold_pairs WHERE {_BUCKET.format(c='id')} < 10")
def sp03_audit_sample(spark, folder):
    return ensemble.audit_sample(table(spark, folder, "gold_pairs").select("id").distinct(), "id", 10)


@query(f"SELECT DISTINCT id, CASE WHEN {_BUCKET.format(c='source_framework')} < 80 THEN 'train' WHEN {_BUCKET.format(c='source_framework')} < 90 THEN 'val' ELSE 'test' END AS split FROM gold_pairs WHERE source_framework IS NOT NULL")
def sp04_group_splits(spark, folder):
    g = table(spark, folder, "gold_pairs").where("source_framework IS NOT NULL").select("id", "source_framework").distinct()
    return ensemble.group_splits(g, "source_framework").select("id", "split")


@query("SELECT target_jurisdiction, count(*) AS n, round(avg(coalesce(citation_match, 0)), 6) AS share, round(avg(coalesce(citation_match, 0)), 6) >= 0.5 AS ok FROM (SELECT DISTINCT eval_id, target_jurisdiction, citation_match FROM eval_rows) GROUP BY target_jurisdiction")
def sp07_spot_check(spark, folder):
    e = table(spark, folder, "eval_rows").select("eval_id", "target_jurisdiction", "citation_match").distinct().withColumn("hit", F.coalesce("citation_match", F.lit(0)))
    return gates.spot_check(e, "target_jurisdiction", "hit", 0.5)


@query(
    """WITH s AS (SELECT model, target_jurisdiction AS k, round(avg(coalesce(citation_match, 0)), 6) AS x FROM (SELECT DISTINCT eval_id, model, target_jurisdiction, citation_match FROM eval_rows) GROUP BY ALL)
  SELECT a.model, 'target_jurisdiction' AS slice_kind, a.k AS slice_key, round(a.x - b.x, 6) AS delta FROM s a JOIN s b ON a.k IS NOT DISTINCT FROM b.k WHERE b.model = 'loris-8b' AND a.model <> 'loris-8b'"""
)
def sp08_model_deltas(spark, folder):
    e = table(spark, folder, "eval_rows").select("eval_id", "model", "target_jurisdiction", "citation_match").distinct()
    s = e.groupBy("model", "target_jurisdiction").agg(F.round(F.avg(F.coalesce("citation_match", F.lit(0))), 6).alias("x"))
    s = s.select("model", F.lit("target_jurisdiction").alias("slice_kind"), F.col("target_jurisdiction").alias("slice_key"), "x")
    return ensemble.model_deltas(s, "loris-8b", "x")


@query("SELECT DISTINCT v.eval_id FROM eval_rows v WHERE EXISTS (SELECT 1 FROM registry_entries e WHERE e.framework = v.target_framework AND e.display_id = v.predicted_citation_id)")
def sp01_known_citations(spark, folder):
    e = table(spark, folder, "registry_entries").select(F.col("framework").alias("target_framework"), F.col("display_id").alias("predicted_citation_id"))
    return table(spark, folder, "eval_rows").select("eval_id", "target_framework", "predicted_citation_id").join(e, ["target_framework", "predicted_citation_id"], "left_semi").select("eval_id").distinct()


@query("SELECT DISTINCT c.framework, c.pdf_relpath, p.sha256_pdf IS NOT NULL AS known FROM (SELECT DISTINCT framework, pdf_relpath FROM ingest_manifest) c LEFT JOIN (SELECT framework, pdf_relpath, max(sha256_pdf) AS sha256_pdf FROM ingest_manifest WHERE failed GROUP BY ALL) p ON p.framework = c.framework AND p.pdf_relpath = c.pdf_relpath")
def jn02_prior_rows(spark, folder):
    m = table(spark, folder, "ingest_manifest")
    prior = tables.latest(m.where("failed").select("framework", "pdf_relpath", "sha256_pdf"), ["framework", "pdf_relpath"], [F.col("sha256_pdf")])
    cur = m.select("framework", "pdf_relpath").distinct()
    return cur.join(prior, ["framework", "pdf_relpath"], "left").select("framework", "pdf_relpath", F.col("sha256_pdf").isNotNull().alias("known"))


@query("SELECT DISTINCT d.doc_id, CASE lower(substr(trim(d.lang), 1, 2)) WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'ms' THEN 'Malay' WHEN 'th' THEN 'Thai' ELSE 'unknown' END AS language FROM documents d")
def pf09_language_lookup(spark, folder):
    names = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("ms", "Malay"), ("th", "Thai")], "code string, language string")
    d = table(spark, folder, "documents").select("doc_id", F.lower(F.substring(F.trim("lang"), 1, 2)).alias("code"))
    return d.join(names, "code", "left").select("doc_id", F.coalesce("language", F.lit("unknown")).alias("language")).distinct()


REQUEST = "source_framework string, source_citation_id string, target_framework string"


@query("SELECT DISTINCT id, source_framework, source_citation_id, target_framework FROM gold_pairs")
def pf13_request_payload(spark, folder):
    g = table(spark, folder, "gold_pairs")
    body = F.to_json(F.struct("source_framework", "source_citation_id", "target_framework"))
    return g.select("id", F.from_json(body, REQUEST).alias("r")).select("id", "r.*").distinct()


@query("SELECT DISTINCT eval_id, model AS label, coalesce(predicted_citation_id, '') AS citation_id FROM eval_rows")
def pf14_result_columns(spark, folder):
    return table(spark, folder, "eval_rows").select("eval_id", F.col("model").alias("label"), F.coalesce("predicted_citation_id", F.lit("")).alias("citation_id")).distinct()


@query("SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) = list_sort(list_distinct(list(l_linestatus))) AS same FROM lineitem GROUP BY l_orderkey")
def st04_set_equality(spark, folder):
    sets = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return sets.select("l_orderkey", tables.same_set(F.col("a"), F.col("b")).alias("same"))


@query("SELECT framework, citation_id FROM registry_entries WHERE removed_at IS NULL UNION SELECT framework, citation_id FROM registry_entries WHERE added_at > TIMESTAMPTZ '2023-01-01 00:00:00+00'")
def st03_pass_union(spark, folder):
    e = table(spark, folder, "registry_entries").select("framework", "citation_id", "added_at", "removed_at")
    a, b = e.where("removed_at IS NULL"), e.where(F.col("added_at") > F.lit("2023-01-01").cast("timestamp"))
    return a.unionByName(b).select("framework", "citation_id").distinct()


@query("SELECT DISTINCT eval_id, '{\"candidate\":' || CASE WHEN predicted_citation_id = '' OR predicted_citation_id IS NULL THEN 'null' ELSE '{\"n\":' || length(predicted_citation_id) || '}' END || '}' AS body FROM eval_rows")
def sk13_serving_json(spark, folder):
    some = F.when(F.col("predicted_citation_id") != "", F.struct(F.length("predicted_citation_id").alias("n")))
    return table(spark, folder, "eval_rows").select("eval_id", F.to_json(F.struct(some.alias("candidate")), {"ignoreNullFields": "false"}).alias("body")).distinct()


@query("SELECT eval_id, CAST(CASE WHEN eval_id % 4 = 3 THEN NULL ELSE 2 END AS INTEGER) AS pairs FROM (SELECT DISTINCT eval_id FROM eval_rows)")
def sc21_draft_pairs(spark, folder):
    from citeloom.functions.jsonx import pair_list

    k = F.col("eval_id") % 4
    raw = F.when(k == 0, F.lit("[1, 2]")).when(k == 1, F.lit('```json\n{"pairs": [1, 2]}\n```')).when(k == 2, F.lit('{"items": [3, 4]}')).otherwise("nothing")
    rows = table(spark, folder, "eval_rows").select("eval_id").distinct()
    return rows.select("eval_id", F.size(F.try_variant_get(pair_list(raw), "$", "array<int>")).alias("pairs")).select("eval_id", F.when(F.col("pairs") >= 0, F.col("pairs")).alias("pairs"))


@query("SELECT id AS gold_id, sqrt(1.0) AS norm FROM (SELECT DISTINCT id FROM gold_pairs WHERE trim(source_mechanism) <> '')")
def sk11_vector_index(spark, folder):
    from citeloom.udf_slots import embedder_slot, hash_embedder

    embed = embedder_slot(lambda: hash_embedder(16))
    g = table(spark, folder, "gold_pairs").where(F.trim("source_mechanism") != "").groupBy("id").agg(F.min("source_mechanism").alias("text"))
    index = retrieval.build_index(g.withColumn("embedding", embed("text")))
    return index.select(F.col("id").alias("gold_id"), F.round(F.sqrt(numeric.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


@query("SELECT model, metric, CAST(value AS DOUBLE) AS value FROM (SELECT model, count(*)::DOUBLE AS n, count(DISTINCT gold_id)::DOUBLE AS golds FROM (SELECT DISTINCT eval_id, model, gold_id FROM eval_rows WHERE model IS NOT NULL) GROUP BY model) UNPIVOT (value FOR metric IN (n, golds))")
def sk12_long_metrics(spark, folder):
    from citeloom.sources.files import long_metrics

    e = table(spark, folder, "eval_rows").where("model IS NOT NULL").select("eval_id", "model", "gold_id").distinct()
    return long_metrics(e.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("gold_id").alias("golds")), ["model"], ["n", "golds"])


@query(SQL["ag05_daily_rollup"])
def ss01_daily_stream(spark, folder):
    """The streaming twin of the daily roll-up, run to the end of what there is; the result is days by providers by models."""
    import uuid

    from citeloom.streaming.calls import daily_stream

    schema = table(spark, folder, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    calls = source.select("event_id", "ts", F.col("event_type").alias("provider"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), k.alias("input_tokens"), (k * 2).alias("output_tokens"), F.coalesce(F.round(F.abs("value"), 4), F.lit(0.0)).alias("cost"))
    name = f"daily_{uuid.uuid4().hex}"
    run = daily_stream(calls).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)
