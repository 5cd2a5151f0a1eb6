"""Queries of the general data-processing operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import grid, redelivery, rolling, sessions, spikes
from chronolane.sources.adapters import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---- 2: messages delivered more than once
_MESSAGES = "SELECT row_id, vin, ts, row_number() OVER (PARTITION BY lower(trim(vin)), ts ORDER BY recv_at DESC NULLS LAST, batch_id DESC NULLS LAST, batch_pos DESC NULLS LAST, row_id DESC) AS rn FROM vehicle_rows"
add(
    "p2_found",
    lambda spark, d: redelivery.repeated_rows(table(spark, d, "vehicle_rows")),
    f"SELECT row_id FROM ({_MESSAGES} WHERE vin IS NOT NULL AND ts IS NOT NULL) WHERE rn > 1",
)
add(
    "p2_messages",
    lambda spark, d: redelivery.once_each(table(spark, d, "vehicle_rows")).select("row_id", "vin", "ts", "recv_at", "soc", "jubk"),
    f"SELECT row_id, vin, ts, recv_at, soc, jubk FROM vehicle_rows WHERE row_id NOT IN (SELECT row_id FROM ({_MESSAGES} WHERE vin IS NOT NULL AND ts IS NOT NULL) WHERE rn > 1)",
)

# ---- 3: rolling totals
_DAILY = """WITH r AS (SELECT DISTINCT vin, ts, yxms, ljlc, rlxhl, zdl, clzt FROM trip_rows WHERE vin IS NOT NULL AND ts IS NOT NULL),
 d AS (SELECT vin, CAST(floor(ts / 86400000.0) AS INTEGER) AS day_no, count(*) AS n, coalesce(sum(rlxhl), 0) AS sr, count(rlxhl) AS cr,
   coalesce(sum(CASE WHEN isfinite(zdl) THEN zdl END), 0) AS sz, count(CASE WHEN isfinite(zdl) THEN 1 END) AS cz FROM r GROUP BY 1, 2),
 e AS (SELECT vin, min(day_no) AS a, max(day_no) AS b FROM d GROUP BY vin),
 c AS (SELECT vin, CAST(unnest(range(a, b + 1)) AS INTEGER) AS day_no FROM e),
 g AS (SELECT c.vin, c.day_no, max(CASE WHEN d.n > 0 THEN d.day_no END) OVER (PARTITION BY c.vin ORDER BY c.day_no) AS p,
   min(CASE WHEN d.n > 0 THEN d.day_no END) OVER (PARTITION BY c.vin ORDER BY c.day_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM c LEFT JOIN d USING (vin, day_no)),
 t AS (SELECT g.vin, g.day_no, CAST(greatest(g.q - g.p - 1, 0) AS INTEGER) AS gap_days, """
for _p in (7, 30):
    _in = f"FILTER (d.day_no > g.day_no - {_p})"
    _DAILY += f"""CAST(coalesce(sum(n) {_in}, 0) AS BIGINT) AS n_{_p}, CAST(coalesce(sum(sr) {_in}, 0) AS DOUBLE) AS sum_rlxhl_{_p},
   CAST(coalesce(sum(cr) {_in}, 0) AS BIGINT) AS cnt_rlxhl_{_p}, CAST(coalesce(sum(cz) {_in}, 0) AS BIGINT) AS cnt_zdl_{_p},
   round(CAST(sum(sr) {_in} AS DOUBLE) / nullif(sum(cr) {_in}, 0), 9) AS avg_rlxhl_{_p}, round(coalesce(sum(sz) {_in}, 0), 6) AS sum_zdl_{_p},
   round(round(sum(sz) {_in}, 6) / nullif(sum(cz) {_in}, 0), 9) AS avg_zdl_{_p}{"," if _p == 7 else ""} """
_DAILY += "FROM g LEFT JOIN d ON d.vin = g.vin AND d.day_no <= g.day_no AND d.day_no > g.day_no - 30 GROUP BY g.vin, g.day_no, g.p, g.q)"


def _totals(spark, d):
    """Sums of doubles to six digits, their last ones depend on the order of adding; averages from them."""
    made = rolling.rolling_totals(table(spark, d, "trip_rows"), "recv_at")
    made = made.withColumns({f"sum_zdl_{p}": F.round(f"sum_zdl_{p}", 6) for p in rolling.PERIODS})
    return made.withColumns({f"avg_{m}_{p}": F.round(F.col(f"sum_{m}_{p}") / F.nullif(F.col(f"cnt_{m}_{p}"), F.lit(0)), 9) for m in rolling.MEASURES for p in rolling.PERIODS})


add(
    "p3_found",
    lambda spark, d: rolling.quiet_days(table(spark, d, "trip_rows"), "recv_at"),
    f"{_DAILY} SELECT vin, day_no, CAST(x AS INTEGER) AS trail_days FROM (SELECT *, unnest([7, 30]) AS x FROM t) WHERE gap_days < 50 AND CASE x WHEN 7 THEN n_7 ELSE n_30 END = 0",
)
add("p3_rolling", _totals, f"{_DAILY} SELECT * FROM t")

# ---- 4: implausible readings (found: SQL after the definition, see tests for brute force)
_READINGS = " UNION ALL ".join(f"SELECT DISTINCT vin, ts, '{f}' AS field, {f} AS v, {a} AS lo, {b} AS hi FROM sensor_rows WHERE vin IS NOT NULL AND ts IS NOT NULL AND {f} IS NOT NULL AND NOT isnan({f})" for f, (a, b) in spikes.BOUNDS.items())
_SPIKES = f"""WITH r AS (SELECT *, v BETWEEN lo AND hi AS ok FROM ({_READINGS})),
 c AS (SELECT *, abs(v - lag(v) OVER w) AS d, lag(v, 1) OVER w AS b1, lag(v, 2) OVER w AS b2, lag(v, 3) OVER w AS b3, lead(v, 1) OVER w AS a1, lead(v, 2) OVER w AS a2, lead(v, 3) OVER w AS a3
   FROM r WHERE ok WINDOW w AS (PARTITION BY vin, field ORDER BY ts, v)),
 m AS (SELECT vin, field, 10 * median(d) AS t FROM c WHERE d > 0 GROUP BY 1, 2),
 f AS (SELECT c.*, t, {{0}} FROM c JOIN m USING (vin, field)),
 k AS (SELECT *, row_number() OVER (PARTITION BY vin, field ORDER BY ts, v) - row_number() OVER (PARTITION BY vin, field, v ORDER BY ts) AS run FROM r WHERE field <> 'soc'),
 s AS (SELECT *, count(*) OVER (PARTITION BY vin, field, v, run) AS n FROM k)
SELECT DISTINCT vin, ts, field FROM (SELECT vin, ts, field FROM r WHERE NOT ok UNION ALL SELECT vin, ts, field FROM f WHERE {{1}} UNION ALL SELECT vin, ts, field FROM s WHERE n >= 25)"""
# names of the readings around a row: b3 b2 b1 v a1 a2 a3; an excursion of k rows starting i before the row
_AROUND = ["b3", "b2", "b1", "v", "a1", "a2", "a3"]
_TESTS = []
for _k in (1, 2, 3):
    for _i in range(_k):
        _x = _AROUND[3 - _i : 3 - _i + _k]
        _before, _after = _AROUND[2 - _i], _AROUND[3 - _i + _k]
        _TESTS.append("(" + " AND ".join(f"abs({x} - {_before}) > t AND abs({x} - {_after}) > t" for x in _x) + ")")
add(
    "p4_found",
    lambda spark, d: spikes.implausible(table(spark, d, "sensor_rows")).select("vin", "ts", "field").distinct(),
    _SPIKES.format("1 AS one", " OR ".join(_TESTS)),
)

# ---- 5: sessions
_SESSIONS = """WITH r AS (SELECT vin, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY vin ORDER BY ts) <= 1800000 THEN 0 ELSE 1 END AS s FROM trip_rows WHERE vin IS NOT NULL AND ts IS NOT NULL),
 n AS (SELECT vin, ts, sum(s) OVER (PARTITION BY vin ORDER BY ts) AS no FROM r) """


def _sessions(spark, d):
    return sessions.sessions(table(spark, d, "trip_rows"), arrival="recv_at")


add("p5_found", lambda spark, d: _sessions(spark, d).select("vin", "ts_from", "ts_to"), f"{_SESSIONS} SELECT vin, min(ts) AS ts_from, max(ts) AS ts_to FROM n GROUP BY vin, no")
add("p5_sessions", _sessions, f"{_SESSIONS} SELECT vin, min(ts) AS ts_from, max(ts) AS ts_to, max(ts) - min(ts) AS duration_ms, count(*) AS n_rows FROM n GROUP BY vin, no")

# ---- 6: regular grid
_GRID = """WITH u AS (SELECT vin, ts, arg_max(soc, (recv_at, soc)) AS v FROM pulse_rows WHERE vin IS NOT NULL AND ts IS NOT NULL AND isfinite(soc) GROUP BY 1, 2),
 i AS (SELECT vin, ts, v, lead(ts) OVER (PARTITION BY vin ORDER BY ts) AS nx, ts - ts % 60000 AS s0 FROM u),
 j AS (SELECT *, CASE WHEN nx IS NULL THEN s0 ELSE (nx - 1) - (nx - 1) % 60000 END AS s1, nx - nx % 60000 AS sn, CASE WHEN nx IS NULL THEN least(ts + 300000, s0 + 60000) ELSE least(ts + 300000, nx) END AS e FROM i),
 c AS (SELECT *, unnest(range(s0, s1 + 1, 60000)) AS slot_ts FROM j),
 w AS (SELECT vin, slot_ts, v, greatest(least(e, slot_ts + 60000) - greatest(ts, slot_ts), 0) AS w, CASE WHEN slot_ts > s0 AND slot_ts < sn THEN (sn - s0) // 60000 - 1 ELSE 0 END AS g, CASE WHEN slot_ts = s0 THEN 1 ELSE 0 END AS r FROM c),
 g AS (SELECT vin, slot_ts, CAST(sum(r) AS BIGINT) AS n_readings, sum(w) AS w, sum(v * w) AS vw, max(g) AS gap_slots FROM w GROUP BY 1, 2)"""


def _grid(spark, d):
    return grid.regular_grid(table(spark, d, "pulse_rows"), "soc", arrival="recv_at")


add("p6_found", lambda spark, d: grid.missing_slots(table(spark, d, "pulse_rows"), "soc", arrival="recv_at"), f"{_GRID} SELECT vin, slot_ts FROM g WHERE n_readings = 0 AND gap_slots < 1440")
add(
    "p6_grid",
    lambda spark, d: _grid(spark, d).withColumns({"value": F.round("value", 9), "coverage": F.round("coverage", 9)}),
    f"{_GRID} SELECT vin, slot_ts, n_readings, round(vw / nullif(w, 0), 9) AS value, round(w / 60000, 9) AS coverage, CASE WHEN n_readings > 0 THEN 'measured' WHEN w > 0 THEN 'filled' ELSE 'missing' END AS status, CAST(gap_slots AS BIGINT) AS gap_slots FROM g",
)
