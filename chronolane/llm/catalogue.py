"""Queries of the training-data operators, with equivalent SQL where SQL can express them at whole-table size."""

from __future__ import annotations

from chronolane.llm import mixing, packing, quantiles, runs, spans
from chronolane.sources.adapters import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---- 1: repeated consecutive events
_RUNS = """WITH e AS (SELECT vin, ts, seq, col1, lower(trim(col3)) AS c3, CASE WHEN NOT isnan(col2) THEN col2 END AS c2 FROM status_rows WHERE vin IS NOT NULL AND ts IS NOT NULL),
 l AS (SELECT *, lag(seq) OVER w IS NOT NULL AND col1 IS NOT DISTINCT FROM lag(col1) OVER w AND c3 IS NOT DISTINCT FROM lag(c3) OVER w
   AND ((c2 IS NULL AND lag(c2) OVER w IS NULL) OR coalesce(abs(c2 - lag(c2) OVER w) <= 0.5, false)) AS same FROM e WINDOW w AS (PARTITION BY vin ORDER BY ts, seq)),
 n AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY vin ORDER BY ts, seq) AS no FROM l),
 g AS (SELECT vin, min(ts) AS ts_from, max(ts) AS ts_to, count(*) AS n_rows, min(col1) AS col1, min(c3) AS col3 FROM n GROUP BY vin, no) """
add(
    "p1_found",
    lambda spark, d: runs.event_runs(table(spark, d, "status_rows")).where("n_rows > 1").select("vin", "ts_from", "ts_to"),
    f"{_RUNS} SELECT vin, ts_from, ts_to FROM g WHERE n_rows > 1",
)
add("p1_runs", lambda spark, d: runs.event_runs(table(spark, d, "status_rows")), f"{_RUNS} SELECT vin, ts_from, ts_to, ts_to - ts_from AS duration_ms, n_rows, col1, col3 FROM g")

# ---- 7: percentiles (approximate with a stated bound; p7_bounds holds them against exact ranks)
_AZKP = ["azkp", "qddjzj"]


def _bounds(spark, d):
    rows = table(spark, d, "azkp_rows")
    return quantiles.bounds_kept(rows, quantiles.percentiles(rows, _AZKP), _AZKP)


_VALUES = """WITH v AS (SELECT vin, CAST(floor(ts / 86400000.0) AS INTEGER) AS day_no, 'azkp' AS field FROM azkp_rows WHERE azkp > -2147483648 AND vin IS NOT NULL AND ts IS NOT NULL
 UNION ALL SELECT vin, CAST(floor(ts / 86400000.0) AS INTEGER), 'qddjzj' FROM azkp_rows WHERE NOT isnan(qddjzj) AND qddjzj <> '-infinity' AND vin IS NOT NULL AND ts IS NOT NULL)"""
add("p7_percentiles", lambda spark, d: quantiles.percentiles(table(spark, d, "azkp_rows"), _AZKP))
add("p7_bounds", _bounds, f"{_VALUES} SELECT vin, day_no, field, count(*) AS n, true AS within FROM v GROUP BY ALL UNION ALL SELECT vin, CAST(NULL AS INTEGER), field, count(*), true FROM v GROUP BY vin, field")

_GROUPED = f"""{_VALUES.replace("'azkp' AS field", "'azkp' AS field, CAST(azkp AS DOUBLE) AS x").replace("'qddjzj' FROM", "'qddjzj', qddjzj FROM")}, a AS (SELECT vin, day_no, field, x FROM v UNION ALL SELECT vin, CAST(NULL AS INTEGER), field, x FROM v),
 g AS (SELECT vin, day_no, field, count(*) AS n, list(x ORDER BY x) AS xs FROM a GROUP BY ALL)"""
_AT = ", ".join(f"xs[CAST(greatest(ceil(CAST({p} AS DOUBLE) * n), 1) AS BIGINT)] AS {quantiles.column_name(p)}" for p in quantiles.PROBS)


def _exact(spark, d):
    """Groups of up to 200 values are never compressed: their percentiles are exact."""
    return quantiles.percentiles(table(spark, d, "azkp_rows"), _AZKP).where("n <= 200").drop("rank_error")


add("p7_small_groups", _exact, f"{_GROUPED} SELECT vin, day_no, field, n, {_AT} FROM g WHERE n <= 200")

# ---- 8: packing (the boxes depend on the tokenizer; p8_check states what must hold of them)
def _boxes(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "token_boxes"))


add("p8_boxes", _boxes)
add("p8_fill", lambda spark, d: packing.box_fill(_boxes(spark, d)))
add("p8_check", lambda spark, d: packing.box_check(_boxes(spark, d)), "SELECT box_kind, (SELECT count(*) FROM documents) AS n_texts, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_badly_cut FROM token_boxes")
add("p8_bound", lambda spark, d: packing.box_bound(_boxes(spark, d)), "SELECT box_kind, capacity_tokens, true AS within, true AS possible FROM token_boxes")

# ---- 9: mixing
add("p9_mix", lambda spark, d: mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))
add("p9_shares", lambda spark, d: mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "mix_targets")))
add(
    "p9_check",
    lambda spark, d: mixing.mix_check(table(spark, d, "documents"), table(spark, d, "mix_targets")),
    "SELECT lower(trim(source)) AS source, true AS share_kept, true AS repeats_kept, true AS schedule_kept FROM mix_targets",
)

# ---- 10: shared spans (SQL by enumerating every window; for the smaller scales)
_WINDOWS = """WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS s FROM documents WHERE length(text) >= 200),
 h AS (SELECT doc_id, s, md5(substring(text, s, 200)) AS g FROM w), r AS (SELECT g FROM h GROUP BY g HAVING count(DISTINCT doc_id) > 1), m AS (SELECT h.* FROM h JOIN r USING (g))"""
add(
    "p10_found",
    lambda spark, d: spans.sharing_pairs(table(spark, d, "documents")),
    f"{_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, g FROM m) a JOIN (SELECT DISTINCT doc_id, g FROM m) b USING (g) WHERE a.doc_id < b.doc_id",
)
_ORDER = "OVER (PARTITION BY doc_id ORDER BY s)"
add(
    "p10_passages",
    lambda spark, d: spans.shared_passages(table(spark, d, "documents")),
    f"{_WINDOWS}, n AS (SELECT doc_id, s, CASE WHEN s <= lag(s) {_ORDER} + 200 THEN 0 ELSE 1 END AS f FROM m), k AS (SELECT *, sum(f) {_ORDER} AS no FROM n) "
    "SELECT doc_id, CAST(min(s) - 1 AS INTEGER) AS char_from, CAST(max(s) + 199 AS INTEGER) AS char_to FROM k GROUP BY doc_id, no",
)
add(
    "p10_shared",
    lambda spark, d: spans.shared_shares(table(spark, d, "documents")),
    f"{_WINDOWS}, n AS (SELECT doc_id, least(200, coalesce(lead(s) {_ORDER} - s, 200)) AS c, CASE WHEN s <= lag(s) {_ORDER} + 200 THEN 0 ELSE 1 END AS f FROM m), "
    "k AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS shared_chars, CAST(sum(f) AS BIGINT) AS n_passages FROM n GROUP BY doc_id) "
    "SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(n_passages, 0) AS n_passages, "
    "round(coalesce(shared_chars / nullif(length(text), 0), 0.0), 6) AS shared_share FROM documents LEFT JOIN k USING (doc_id)",
)
add(
    "p10_links",
    lambda spark, d: spans.sharing_links(table(spark, d, "documents")),
    f"{_WINDOWS}, c AS (SELECT text, min(doc_id) AS class_id, count(*) AS n_copies FROM documents WHERE length(text) >= 200 GROUP BY text), "
    "k AS (SELECT DISTINCT m.g, c.class_id FROM m JOIN documents d USING (doc_id) JOIN c ON c.text = d.text), "
    "l AS (SELECT a.class_id, count(DISTINCT b.class_id) AS n_links FROM k a JOIN k b USING (g) WHERE a.class_id <> b.class_id GROUP BY a.class_id) "
    "SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links FROM documents d LEFT JOIN c USING (text) LEFT JOIN l ON l.class_id = c.class_id",
)
