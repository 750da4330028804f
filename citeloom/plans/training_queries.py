"""Queries over the project's tables that belong to the core: dangling references."""

from __future__ import annotations

from citeloom.operators import dangling

QUERIES = {"p3_found": dangling.p3_found, "p3_counts": dangling.p3_counts, "p3_recall": dangling.p3_recall, "p3_waiting": dangling.p3_waiting}

_BASE = """upper(regexp_extract(translate({c}, '๐๑๒๓๔๕๖๗๘๙０１２３４５６７８９', '01234567890123456789'), '^[^0-9]*0*([0-9]+[A-Z]?)', 1))"""

_REFS = f"""
WITH refs AS (
  SELECT 'gold_pairs' AS table_name, id AS record_key, 'source_citation_id' AS field_name, source_framework AS fw,
         {_BASE.format(c='source_citation_id')} AS k, created_at AS ref_ts FROM gold_pairs WHERE trim(source_citation_id) <> ''
  UNION SELECT 'gold_pairs', id, 'target_citation_id', target_framework, {_BASE.format(c='target_citation_id')}, created_at
  FROM gold_pairs WHERE trim(target_citation_id) <> ''
  UNION SELECT 'eval_rows', CAST(eval_id AS VARCHAR), 'gold_id', 'gold', gold_id, run_at FROM eval_rows WHERE trim(gold_id) <> ''
  UNION SELECT 'gold_splits', id, 'id', 'gold', id, NULL FROM gold_splits WHERE trim(id) <> ''
  UNION SELECT 'registry_manifest', framework, 'framework', 'framework', framework, NULL FROM registry_manifest WHERE trim(framework) <> ''
), found AS (
  SELECT * FROM refs r WHERE NOT (
    (table_name = 'gold_pairs' AND EXISTS (SELECT 1 FROM registry_entries e WHERE e.framework = r.fw AND e.citation_id = r.k
       AND e.added_at <= r.ref_ts AND (e.removed_at IS NULL OR e.removed_at > r.ref_ts)))
    OR (fw = 'gold' AND EXISTS (SELECT 1 FROM gold_pairs g WHERE g.id = r.k AND (r.ref_ts IS NULL OR g.created_at <= r.ref_ts)))
    OR (table_name = 'registry_manifest' AND EXISTS (SELECT 1 FROM registry_entries e WHERE e.framework = r.k)))
)"""

SQL = {
    "p3_found": _REFS + " SELECT table_name, record_key, field_name FROM found",
    "p3_counts": _REFS
    + """ SELECT r.table_name, r.field_name, r.month, CAST(r.n AS BIGINT) AS refs, CAST(coalesce(o.n, 0) AS BIGINT) AS orphans
  FROM (SELECT table_name, field_name, strftime(ref_ts AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM refs GROUP BY ALL) r
  LEFT JOIN (SELECT table_name, field_name, strftime(ref_ts AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM found GROUP BY ALL) o
  ON r.table_name = o.table_name AND r.field_name = o.field_name AND r.month IS NOT DISTINCT FROM o.month""",
    "p3_recall": _REFS
    + """ SELECT m.framework, m.toy_gold_recall AS recorded_recall, CAST(coalesce(len(m.toy_gold_missing), 0) AS BIGINT) AS recorded_missing,
  CAST(coalesce(r.n, 0) AS BIGINT) AS refs, CAST(coalesce(o.n, 0) AS BIGINT) AS orphans,
  round(CASE WHEN r.n > 0 THEN 1 - coalesce(o.n, 0) / r.n END, 6) AS observed_recall
  FROM registry_manifest m
  LEFT JOIN (SELECT fw, count(*) AS n FROM refs WHERE table_name = 'gold_pairs' GROUP BY fw) r ON r.fw = m.framework
  LEFT JOIN (SELECT fw, count(*) AS n FROM found WHERE table_name = 'gold_pairs' GROUP BY fw) o ON o.fw = m.framework""",
}
