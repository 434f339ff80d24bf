"""Independent SQL for the registered queries, in the dialect of DuckDB.

The statements read the shared tables directly and follow the definitions, not the plans: self-joins and
plain windows instead of blocks, carries and hot-key splits.
"""

from __future__ import annotations

EV = """ev AS (
  SELECT event_id, user_id, value, event_type, (epoch_us(ts) - 1704067200000000) // 1000000 AS sec,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events)"""

POS = EV + """, allpos AS (
  SELECT event_id AS seq, CAST(CASE WHEN k = 99 THEN 2 ELSE 0 END AS SMALLINT) AS type,
         CAST(sec // 2400 AS INT) AS time, CAST(user_id AS INT) AS vid, k AS speed, CAST(0 AS INT) AS xway,
         CAST(k % 5 AS SMALLINT) AS lane, CAST(event_id % 2 AS SMALLINT) AS direction,
         CAST((user_id + sec // 2400 // 180) % 5 AS SMALLINT) AS segment,
         CAST(((user_id + sec // 2400 // 180) % 5) * 5280 + k AS INT) AS position,
         CAST(sec // 2400 // 60 + 1 AS INT) AS minute
  FROM ev), pos AS (SELECT * FROM allpos WHERE type = 0)"""

AVG = POS + """, lagged AS (
  SELECT *, lag(direction * 1000 + segment) OVER (PARTITION BY vid, minute ORDER BY seq) AS prev FROM pos
), marked AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev <> direction * 1000 + segment THEN 1 ELSE 0 END)
            OVER (PARTITION BY vid, minute ORDER BY seq) AS run FROM lagged
), speeds AS (
  SELECT min(seq) AS seq, vid, minute, xway, direction, segment, CAST(sum(speed) // count(*) AS INT) AS avg_speed
  FROM marked GROUP BY vid, minute, xway, direction, segment, run)"""

LAV = AVG + """, lavs AS (
  SELECT CAST(m.minute + 1 AS INT) AS minute, m.xway, m.direction, m.segment,
         CAST(sum(s.avg_speed) // count(*) AS INT) AS lav
  FROM (SELECT DISTINCT minute, xway, direction, segment FROM speeds) m
  JOIN speeds s ON s.xway = m.xway AND s.direction = m.direction AND s.segment = m.segment
               AND s.minute BETWEEN m.minute - 4 AND m.minute
  GROUP BY 1, 2, 3, 4)"""

RUNNING = AVG + """, kept AS (
  SELECT a.seq, a.minute, a.xway, a.direction, a.segment, b.avg_speed, row_number() OVER (PARTITION BY a.seq ORDER BY b.seq) AS rn
  FROM speeds a JOIN speeds b ON b.xway = a.xway AND b.direction = a.direction AND b.segment = a.segment
   AND b.minute BETWEEN a.minute - 4 AND a.minute AND b.seq <= a.seq
), running AS (
  SELECT seq, CAST(minute + 1 AS INT) AS minute, xway, direction, segment, CAST(sum(avg_speed) // count(*) AS INT) AS lav
  FROM kept WHERE rn <= 11 GROUP BY ALL)"""

TOLL = LAV + """, cells AS (
  SELECT minute, xway, direction, segment, CAST(count(*) AS INT) AS n FROM pos GROUP BY ALL
), changes AS (
  SELECT * FROM (SELECT *, lag(segment) OVER (PARTITION BY vid ORDER BY seq) AS before FROM pos WHERE lane <> 4)
  WHERE before IS NULL OR before <> segment
), tolls AS (
  SELECT c.seq, c.vid, c.minute, c.segment, c.direction, coalesce(l.lav, 0) AS speed,
         CAST(CASE WHEN coalesce(l.lav, 0) < 50 AND coalesce(n.n, 0) > 50 THEN 2 * (n.n - 50) * (n.n - 50) ELSE 0 END AS INT) AS toll
  FROM changes c
  LEFT JOIN lavs l ON l.minute = c.minute AND l.xway = c.xway AND l.direction = c.direction AND l.segment = c.segment
  LEFT JOIN cells n ON n.minute = c.minute - 1 AND n.xway = c.xway AND n.direction = c.direction AND n.segment = c.segment)"""

ACCIDENTS = POS + """, accidents AS (
  SELECT DISTINCT p.minute, p.xway, p.direction, p.segment FROM pos p JOIN ev e ON e.event_id = p.seq
  WHERE e.event_type = 'error' AND p.speed = 0)"""

CDR = EV + """, cdr AS (
  SELECT event_id AS call_id, CAST(user_id AS VARCHAR) AS caller,
         CAST(CASE WHEN k % 10 = 5 THEN user_id + 5 ELSE user_id + (k % 10) - 5 END AS VARCHAR) AS callee,
         1704067200 + sec // 2400 AS answer_ts, CAST(floor(value * 60) AS INT) AS duration, k >= 5 AS established
  FROM ev)"""

NEW = CDR + """, flagged AS (
  SELECT *, row_number() OVER (PARTITION BY caller, callee ORDER BY call_id) = 1 AS new_callee FROM cdr
), est AS (SELECT * FROM flagged WHERE established)"""

# Decayed sums by a self-join over all earlier calls of the same caller.
RATES = NEW + """, rates AS (
  SELECT a.call_id, a.caller, a.callee, a.answer_ts, a.duration, a.new_callee,
         sum(ln(1 / 0.9672) * pow(0.9672, a.answer_ts - b.answer_ts)) AS ecr,
         sum(ln(1 / 0.9917) * pow(0.9917, a.answer_ts - b.answer_ts)) AS ecr24,
         sum(CASE WHEN b.new_callee THEN ln(1 / 0.9672) * pow(0.9672, a.answer_ts - b.answer_ts) ELSE 0 END) AS encr,
         sum(CASE WHEN b.new_callee THEN b.duration * ln(1 / 0.9917) * pow(0.9917, a.answer_ts - b.answer_ts) ELSE 0 END) AS ct24
  FROM est a JOIN est b ON b.caller = a.caller
   AND (b.answer_ts < a.answer_ts OR (b.answer_ts = a.answer_ts AND b.call_id <= a.call_id))
  GROUP BY ALL)"""

RCR = """, received AS (
  SELECT a.call_id, a.caller, a.answer_ts,
         coalesce(sum(ln(1 / 0.9672) * pow(0.9672, a.answer_ts - b.answer_ts)), 0) AS rcr
  FROM est a LEFT JOIN est b ON b.callee = a.caller
   AND (b.answer_ts < a.answer_ts OR (b.answer_ts = a.answer_ts AND b.call_id < a.call_id))
  GROUP BY ALL)"""

# The moving average as one window sum. It is anchored at the first call whose running sum of durations
# reaches 10, and good for up to a million calls.
GACD = """, numbered AS (
  SELECT call_id, duration, sum(duration) OVER (ORDER BY call_id) AS upto, row_number() OVER (ORDER BY call_id) AS rn FROM cdr
), head AS (SELECT rn AS hrn, upto AS a0 FROM numbered WHERE upto >= 10 ORDER BY rn LIMIT 1
), averages AS (
  SELECT call_id, CASE WHEN rn < hrn THEN 0.0 ELSE
      pow(1 - 2 / 86401.0::DOUBLE, rn - hrn) * (a0 + sum(CASE WHEN rn > hrn
        THEN duration * (2 / 86401.0::DOUBLE) * pow(1 - 2 / 86401.0::DOUBLE, -(rn - hrn)) ELSE 0 END) OVER (ORDER BY rn)) END AS global_acd
  FROM numbered, head)"""

RATIOS = RATES + RCR + GACD + """, ratios AS (
  SELECT r.call_id, r.caller, r.answer_ts,
         CASE WHEN v.rcr = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, r.ecr / v.rcr / 10)) END AS fofir,
         least(1.0, greatest(0.0, r.encr / r.ecr)) AS url,
         CASE WHEN g.global_acd = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, r.ct24 / r.ecr24 / g.global_acd / 10)) END AS acd
  FROM rates r JOIN received v USING (call_id) JOIN averages g USING (call_id) WHERE r.new_callee)"""


def r(column: str, digits: int = 6) -> str:
    """Rounding that is the same arithmetic in both engines."""
    scale = 10**digits
    return f"floor(({column}) * {scale}.0::DOUBLE + 0.5) / {scale}.0::DOUBLE"


def _slots(key: str, count: int, width: str) -> str:
    part = [f"('0x' || substr(md5({key}), {at}, 12))::BIGINT" for at in (1, 13)]
    return ", ".join(f"({part[0]} + {i} * {part[1]}) % {width}" for i in range(count))


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


NOTHING = "CAST(NULL AS INT) AS vid, CAST(NULL AS INT) AS speed, CAST(NULL AS INT) AS toll"
NO_CELL = (
    "CAST(NULL AS INT) AS xway, CAST(NULL AS SMALLINT) AS direction, CAST(NULL AS SMALLINT) AS segment, CAST(NULL AS INT) AS count"
)
POSITION = "seq, type, time, vid, speed, xway, lane, direction, segment, position, minute"
AS_RUN_AVG = """, asrun AS (
  SELECT seq, lag(vid) OVER w AS vid, lag(minute) OVER w AS minute, lag(xway) OVER w AS xway, lag(direction) OVER w AS direction,
         lag(segment) OVER w AS segment, lag(speed) OVER w AS avg_speed
  FROM pos WINDOW w AS (ORDER BY seq))"""
SCORED = f"""call_id, caller, answer_ts, {r('fofir')} AS fofir, {r('url')} AS url, {r('acd')} AS acd,
  {r('fofir * 2 + url * 3 + acd * 3')} AS score"""

LINEAR_ROAD = {
    "lr_parse_positions": _with(POS, f"SELECT {POSITION} FROM pos"),
    "lr_minute": _with(POS, "SELECT seq, CAST(time // 60 + 1 AS INT) AS minute FROM pos"),
    "lr_exit_lane": _with(POS, "SELECT seq, vid, lane FROM pos WHERE lane = 4"),
    "lr_average_speed": _with(AVG, "SELECT seq, vid, minute, xway, direction, segment, avg_speed FROM speeds"),
    "lr_average_speed_as_run": _with(POS + AS_RUN_AVG, "SELECT * FROM asrun WHERE vid IS NOT NULL"),
    "lr_lav": _with(LAV, "SELECT minute, xway, direction, segment, lav FROM lavs"),
    "lr_lav_running": _with(RUNNING, "SELECT seq, minute, xway, direction, segment, lav FROM running"),
    "lr_toll_las": _with(
        RUNNING, "SELECT minute, xway, direction, segment, arg_max(lav, seq) AS lav FROM running GROUP BY 1, 2, 3, 4"
    ),
    "lr_toll_cv": _with(
        POS,
        "SELECT minute, xway, direction, segment, CAST(count(*) AS INT) AS count FROM pos GROUP BY 1, 2, 3, 4 HAVING count(*) > 50",
    ),
    "lr_lav_as_run": _with(
        POS + AS_RUN_AVG,
        "SELECT seq, CAST(minute + 1 AS INT) AS minute, xway, direction, segment, avg_speed AS lav FROM asrun WHERE vid IS NOT NULL",
    ),
    "lr_count_vehicles": _with(
        POS,
        "SELECT minute, xway, direction, segment, CAST(count(*) AS INT) AS count FROM pos GROUP BY 1, 2, 3, 4 HAVING count(*) > 50",
    ),
    "lr_count_progress": _with(
        POS,
        f""", full_cells AS (SELECT minute FROM pos GROUP BY minute, xway, direction, segment HAVING count(*) > 50)
SELECT DISTINCT minute, {NO_CELL} FROM pos WHERE minute NOT IN (SELECT minute FROM full_cells)""",
    ),
    "lr_count_as_run": _with(
        POS, f"SELECT seq, CAST(coalesce(lag(minute) OVER (ORDER BY seq), -1) AS INT) AS minute, {NO_CELL} FROM pos"
    ),
    "lr_toll_las_as_run": _with(POS, f"SELECT seq, {NOTHING} FROM pos WHERE seq > (SELECT min(seq) FROM pos)"),
    "lr_toll_cv_as_run": _with(POS, f"SELECT seq, {NOTHING} FROM pos"),
    "lr_toll_pos_as_run": _with(POS, f"SELECT seq, {NOTHING} FROM pos"),
    "lr_toll": _with(TOLL, "SELECT seq, vid, speed, toll, minute, direction, segment FROM tolls"),
    "lr_toll_accidents": _with(
        TOLL + ACCIDENTS[len(POS):],
        """SELECT t.seq, t.vid, t.speed, CASE WHEN EXISTS (
  SELECT 1 FROM accidents a WHERE a.minute = t.minute - 1 AND a.direction = t.direction AND
    (CASE WHEN t.direction = 0 THEN a.segment - t.segment ELSE t.segment - a.segment END) BETWEEN 0 AND 4)
  THEN 0 ELSE t.toll END AS toll FROM tolls t""",
    ),
    "lr_accident_block": _with(
        ACCIDENTS,
        """SELECT p.seq, p.vid FROM pos p WHERE NOT EXISTS (
  SELECT 1 FROM accidents a WHERE a.minute = p.minute - 1 AND a.xway = p.xway AND a.direction = p.direction AND
    (CASE WHEN p.direction = 0 THEN a.segment - p.segment ELSE p.segment - a.segment END) BETWEEN 0 AND 4)""",
    ),
    "lr_segment_changes": _with(TOLL, "SELECT seq, vid, minute, segment FROM changes"),
    "lr_last_toll": _with(
        TOLL,
        """, events_by_car AS (
  SELECT vid, seq, toll FROM tolls UNION ALL SELECT vid, seq, 0 FROM pos WHERE lane = 4)
SELECT vid, seq, toll FROM events_by_car e WHERE toll > 0 AND seq = (SELECT max(seq) FROM events_by_car f WHERE f.vid = e.vid)""",
    ),
    "lr_as_run_total": _with(
        POS,
        "SELECT 'pos' AS branch, count(*) AS n FROM pos UNION ALL SELECT 'cv', count(*) FROM pos UNION ALL SELECT 'las', count(*) - 1 FROM pos",
    ),
}

VOIP = {
    "vs_parse_cdrs": _with(CDR, "SELECT call_id, caller, callee, answer_ts, duration, established FROM cdr"),
    "vs_new_callee": _with(NEW, "SELECT call_id, caller, callee, new_callee FROM flagged"),
    "vs_pre_rcr": _with(
        CDR,
        """SELECT call_id, 'caller' AS role, caller AS key, answer_ts FROM cdr
UNION ALL SELECT call_id, 'callee', callee, answer_ts FROM cdr""",
    ),
    "vs_global_acd": _with(CDR + GACD, f"SELECT call_id, {r('global_acd', 4)} AS global_acd FROM averages"),
    "vs_decayed_rate": _with(
        CDR,
        f"""SELECT a.call_id, a.callee, {r('sum(b.duration * ln(1 / 0.9672) * pow(0.9672, a.answer_ts - b.answer_ts))')} AS w
FROM cdr a JOIN cdr b ON b.callee = a.callee
 AND (b.answer_ts < a.answer_ts OR (b.answer_ts = a.answer_ts AND b.call_id <= a.call_id))
GROUP BY a.call_id, a.callee""",
    ),
    "vs_new_callee_bloom": _with(
        CDR,
        f""", pairs AS (SELECT caller, callee, min(call_id) AS first FROM cdr GROUP BY 1, 2
), owned AS (SELECT first, unnest([{_slots("concat_ws('|', caller, callee)", 5, "(SELECT 8 * count(*) FROM pairs)")}]) AS slot FROM pairs
), known AS (SELECT o.first FROM (SELECT DISTINCT first, slot FROM owned) o GROUP BY o.first
  HAVING bool_and(EXISTS (SELECT 1 FROM owned e WHERE e.slot = o.slot AND e.first < o.first)))
SELECT call_id, caller, callee, call_id IN (SELECT first FROM pairs) AND call_id NOT IN (SELECT first FROM known) AS new_callee FROM cdr""",
    ),
    "vs_ecr_sketch": _with(
        NEW,
        f""", counters AS (SELECT call_id, answer_ts, unnest([0, 1, 2]) AS line,
    unnest([{_slots("caller", 3, "(SELECT 8 * count(DISTINCT caller) FROM est)")}]) AS slot FROM est
), rated AS (SELECT a.call_id, a.line, sum(ln(1 / 0.9672) * pow(0.9672, a.answer_ts - b.answer_ts)) AS rate
  FROM counters a JOIN counters b ON b.line = a.line AND b.slot = a.slot
   AND (b.answer_ts < a.answer_ts OR (b.answer_ts = a.answer_ts AND b.call_id <= a.call_id)) GROUP BY ALL)
SELECT call_id, caller, {r('(SELECT min(rate) FROM rated x WHERE x.call_id = est.call_id)')} AS ecr FROM est""",
    ),
    "vs_slow_rates": _with(
        CDR,
        f"""SELECT a.call_id, a.callee, {r('sum(b.duration * ln(1 / 0.99999) * pow(0.99999, a.answer_ts - b.answer_ts))')} AS day,
  {r('sum(b.duration * ln(1 / 0.9999) * pow(0.9999, a.answer_ts - b.answer_ts))')} AS hour,
  {r('sum(b.duration * ln(1 / 0.9672) * pow(0.9672, a.answer_ts - b.answer_ts))')} AS minute
FROM cdr a JOIN cdr b ON b.callee = a.callee
 AND (b.answer_ts < a.answer_ts OR (b.answer_ts = a.answer_ts AND b.call_id <= a.call_id))
GROUP BY a.call_id, a.callee""",
    ),
    "vs_ecr": _with(RATES, f"SELECT call_id, caller, {r('ecr')} AS ecr FROM rates"),
    "vs_ecr24": _with(RATES, f"SELECT call_id, caller, {r('ecr24')} AS ecr24 FROM rates"),
    "vs_encr": _with(RATES, f"SELECT call_id, caller, {r('encr')} AS encr FROM rates WHERE new_callee"),
    "vs_ct24": _with(RATES, f"SELECT call_id, caller, {r('ct24')} AS ct24 FROM rates WHERE new_callee"),
    "vs_rcr": _with(NEW + RCR, f"SELECT call_id, caller, {r('rcr')} AS rcr FROM received"),
    "vs_score_fn": _with(
        CDR,
        "SELECT call_id, CASE WHEN duration < 0 THEN 0.0 WHEN duration > 900 THEN 1.0 ELSE duration / 900.0::DOUBLE END AS score FROM cdr",
    ),
    "vs_acd": _with(RATIOS, f"SELECT call_id, caller, {r('acd')} AS acd FROM ratios"),
    "vs_fofir": _with(
        RATES + RCR,
        f"""SELECT r.call_id, r.caller,
  {r('CASE WHEN v.rcr = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, r.ecr / v.rcr / 10)) END')} AS fofir
FROM rates r JOIN received v USING (call_id)""",
    ),
    "vs_url": _with(RATIOS, f"SELECT call_id, caller, {r('url')} AS url FROM ratios"),
    "vs_reordering_ecr": _with(
        RATES, f"SELECT c.call_id, c.caller, {r('x.ecr')} AS ecr FROM cdr c LEFT JOIN rates x USING (call_id)"
    ),
    "vs_score": _with(RATIOS, f"SELECT {SCORED} FROM ratios"),
    "vs_variant_reordering": _with(RATIOS, f"SELECT {SCORED} FROM ratios"),
    "vs_variant_forwarding": _with(RATIOS, f"SELECT {SCORED} FROM ratios"),
    "vs_score_top": _with(RATIOS, f"SELECT {SCORED} FROM ratios ORDER BY score DESC, call_id LIMIT 100"),
    "vs_score_as_run": _with(
        RATIOS,
        f""", messages AS (
  SELECT call_id, caller, answer_ts, 'fofir' AS source FROM est UNION ALL SELECT call_id, caller, answer_ts, 'url' FROM est WHERE new_callee
  UNION ALL SELECT call_id, caller, answer_ts, 'acd' FROM est WHERE new_callee
), sums AS (SELECT *, fofir * 2 + url * 3 + acd * 3 AS score FROM ratios)
SELECT m.call_id, m.source, {r("coalesce((SELECT arg_min(s.score, s.call_id) FROM sums s WHERE s.caller = m.caller AND s.answer_ts = m.answer_ts AND s.call_id < m.call_id AND NOT isnan(s.score)), 0)")} AS score
FROM messages m""",
    ),
}


REC = EV + """, rec AS (
  SELECT event_id AS seq, event_type AS name, CAST(sec // 60 AS BIGINT) AS second, CAST(floor(value * 100) AS DOUBLE) AS value FROM ev)"""

GRID = """, grid AS (
  SELECT name, unnest(generate_series(a, b)) AS second FROM (SELECT name, min(second) AS a, max(second) AS b FROM rec GROUP BY name))"""

STATISTICS = {
    "met_count_per_second": _with(
        REC + GRID,
        "SELECT g.name, g.second, count(r.seq) AS count FROM grid g LEFT JOIN rec r ON r.name = g.name AND r.second = g.second GROUP BY 1, 2",
    ),
    "met_avg_per_second": _with(
        REC + GRID,
        """SELECT g.name, g.second, CASE WHEN count(r.seq) = 0 THEN -1 ELSE CAST(sum(CAST(r.value AS BIGINT)) AS BIGINT) // count(r.seq) END AS average
FROM grid g LEFT JOIN rec r ON r.name = g.name AND r.second = g.second GROUP BY 1, 2""",
    ),
    "met_gauge": _with(
        REC,
        """, grid AS (
  SELECT name, unnest(generate_series(a, b)) AS report FROM (
    SELECT name, min(second // 10) AS a, max(second // 10) AS b FROM rec GROUP BY name))
SELECT g.name, g.report, coalesce(sum(r.value) / count(r.value), -1) AS gauge
FROM grid g LEFT JOIN rec r ON r.name = g.name AND r.second // 10 = g.report GROUP BY 1, 2""",
    ),
    "met_every_nth": _with(
        REC,
        "SELECT seq, name, second, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS n FROM rec) WHERE n % 100 = 0",
    ),
    "met_rate_limited": "WITH RECURSIVE " + REC + """, placed AS MATERIALIZED (
  SELECT name, seq, second // 60 AS second, row_number() OVER (PARTITION BY name ORDER BY seq) AS i FROM rec
), walk AS (
  SELECT name, 0::BIGINT AS i, 0::BIGINT AS seq, false AS taken, 0::BIGINT AS accepted FROM placed GROUP BY name
  UNION ALL
  SELECT w.name, p.i, p.seq, w.accepted <= p.second, w.accepted + CASE WHEN w.accepted <= p.second THEN 1 ELSE 0 END
  FROM walk w JOIN placed p ON p.name = w.name AND p.i = w.i + 1)
SELECT seq, name FROM walk WHERE taken""",
    "met_summary": _with(
        REC,
        """, sorted AS (
  SELECT name, list_sort(list(value)) AS v, count(*) AS samples, sum(value) / count(*) AS mean
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS n FROM rec) WHERE n % 3 = 0 GROUP BY name
), offered AS (SELECT name, count(*) AS total FROM rec GROUP BY name
), ranks AS (SELECT name, samples, total, mean, v, p, greatest(1.0::DOUBLE, least(samples::DOUBLE, p * (samples + 1))) AS pos
  FROM sorted JOIN offered USING (name), (SELECT unnest([0.05::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.95::DOUBLE]) AS p)
), found AS (SELECT *, v[CAST(floor(pos) AS BIGINT)] + (v[least(samples, CAST(floor(pos) AS BIGINT) + 1)] - v[CAST(floor(pos) AS BIGINT)]) * (pos - floor(pos)) AS q FROM ranks)
SELECT name, any_value(samples) AS samples, any_value(total) AS total, any_value(mean) AS mean, any_value(v[1]) AS p0,
  max(CASE WHEN p = 0.05 THEN q END) AS p5, max(CASE WHEN p = 0.25 THEN q END) AS p25, max(CASE WHEN p = 0.5 THEN q END) AS p50,
  max(CASE WHEN p = 0.75 THEN q END) AS p75, max(CASE WHEN p = 0.95 THEN q END) AS p95, any_value(v[samples]) AS p100
FROM found GROUP BY name""",
    ),
    "met_latency": _with(
        EV,
        "SELECT event_id AS seq, CAST(floor(value) AS BIGINT) AS latency, CAST(floor(value) AS BIGINT) + k AS end_latency FROM ev",
    ),
    "met_throughput": _with(EV, "SELECT count(*) // (max(sec // 2400) - min(sec // 2400)) AS throughput FROM ev"),
    "met_mean_rate": _with(
        EV,
        """, upto AS (
  SELECT second, CAST(sum(n) OVER (ORDER BY second) AS BIGINT) AS n, min(second) OVER () AS start
  FROM (SELECT sec // 2400 AS second, count(*) AS n FROM ev GROUP BY 1))
SELECT second, CASE WHEN second > start THEN n // (second - start) ELSE 0 END AS rate FROM upto""",
    ),
    "met_metric_line": _with(
        REC + GRID,
        """SELECT 'source.' || g.name || '.rate ' || count(r.seq) || ' ' || g.second AS line
FROM grid g LEFT JOIN rec r ON r.name = g.name AND r.second = g.second GROUP BY g.name, g.second""",
    ),
    "met_ewma": _with(
        REC,
        f""", placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS n FROM rec), avgs AS (
  SELECT a.seq, a.name, sum(b.second * CASE WHEN b.n = 1 THEN 1 ELSE 0.5 END * pow(0.5::DOUBLE, a.n - b.n)) AS average_arrival
  FROM placed a JOIN placed b ON b.name = a.name AND b.n BETWEEN a.n - 99 AND a.n GROUP BY a.seq, a.name)
SELECT seq, name, {r('average_arrival', 4)} AS average_arrival FROM avgs""",
    ),
}

MET = EV + """, m AS (
  SELECT event_id AS seq, CAST(user_id % 3 AS INT) AS rep, concat('Storm.node', CAST(user_id % 4 AS VARCHAR)) AS node,
         CAST(sec // 2400 + 300 * (user_id % 5) AS INT) AS t, CAST(floor(value * 100) AS DOUBLE) AS value,
         CASE k % 4 WHEN 0 THEN 'latency' WHEN 1 THEN 'throughput' WHEN 2 THEN 'sink-throughput' ELSE 'input-queue' END AS parameter,
         CASE k % 3 WHEN 0 THEN 'OS' WHEN 1 THEN 'CUSTOM-QS' ELSE 'CUSTOM-FCFS' END AS variant,
         CAST(1000 * (1 + user_id % 5) AS INT) AS rate, 'run' AS experiment
  FROM ev)"""

RUN = "experiment, variant, rate, parameter, rep"
REBASED = f""", rebased AS (
  SELECT * REPLACE (CAST(t - min(t) OVER (PARTITION BY {RUN}) AS INT) AS t) FROM m)"""


def _trimmed(table: str) -> str:
    return f""", lasts AS (SELECT *, max(t) OVER (PARTITION BY {RUN}) AS last FROM {table}), trimmed AS (
  SELECT * REPLACE (CASE WHEN t < floor(last * 0.3::DOUBLE) OR t > ceil(last - last * 0.2::DOUBLE) THEN NULL ELSE value END AS value) FROM lasts)"""


# Sums to nine decimals, in any order.
SUM = "CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE)"
MEAN = f"{SUM} / count(value)"


def _nodes(table: str, parameter: str, aggregate: str, more: str = "") -> str:
    return f"""SELECT parameter, variant, rep, {more} rate, {aggregate} AS value FROM (
  SELECT parameter, variant, rep, {more} rate, node, {MEAN} AS value FROM {table}
  WHERE parameter = '{parameter}' GROUP BY ALL) GROUP BY parameter, variant, rep, {more} rate"""


def _interpolated(p: float) -> str:
    """Linear interpolation between the two ranks around 1 + p (n - 1) of the sorted list v."""
    low = f"CAST(floor({p}::DOUBLE * (len(v) - 1)) AS BIGINT) + 1"
    share = f"({p}::DOUBLE * (len(v) - 1) + 1 - floor({p}::DOUBLE * (len(v) - 1) + 1))"
    return f"(v[{low}] + (v[least(len(v), {low} + 1)] - v[{low}]) * {share})"


RATES = [1000, 2000, 3000, 4000, 5000]
BASE_MEANS = ", means AS (SELECT variant, rate, sum(value) / count(value) AS value FROM m WHERE parameter = 'throughput' GROUP BY 1, 2)"

EXPERIMENTS = {
    "ana_graphite_flatten": _with(
        EV,
        """SELECT event_id AS seq, 'Storm.node' || (user_id % 4) || '.' || event_type AS target, sec AS t,
  CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS value FROM ev
UNION ALL SELECT event_id, 'Storm.node' || (user_id % 4) || '.' || event_type, sec + 1, 1.5::DOUBLE FROM ev""",
    ),
    "ana_alias_by_node": _with(MET, "SELECT seq, substr(node, 7) || '.' || variant AS alias FROM m"),
    "ana_rebase_time": _with(MET + REBASED, "SELECT seq, t FROM rebased"),
    "ana_trim": _with(MET + REBASED + _trimmed("rebased"), "SELECT seq, t, value FROM trimmed"),
    "ana_variant_cols": _with(
        MET, "SELECT seq, variant AS scheduler, CAST(rate AS DOUBLE) AS load, CAST(rep AS DOUBLE) AS parallelism FROM m"
    ),
    "ana_prefer_raw": _with(
        MET, "SELECT seq, CASE WHEN parameter = 'latency' AND rep <> 0 THEN 'latency-ignored' ELSE parameter END AS parameter FROM m"
    ),
    "ana_units": _with(
        MET,
        """, shifted AS (SELECT * REPLACE (value - 300 AS value) FROM m)
SELECT seq, parameter, CASE WHEN rep = 2 THEN 'Flink' ELSE 'Storm' END AS spe,
  CASE WHEN variant = 'CUSTOM-FCFS' AND parameter IN ('throughput', 'sink-throughput') THEN value / 30
       WHEN parameter = 'latency' AND value < 0 THEN NULL WHEN parameter = 'latency' THEN value / 1000 ELSE value END AS value
FROM shifted""",
    ),
    "ana_overview": _with(
        MET + ", raw AS (SELECT * REPLACE (CASE WHEN parameter = 'latency' AND rep = 0 THEN 'latency-raw' ELSE parameter END AS parameter) FROM m)"
        + REBASED.replace("FROM m", "FROM raw") + _trimmed("rebased"),
        f""", ready AS (
  SELECT variant, rep, node, rate, CASE parameter WHEN 'latency' THEN 'latency-ignored' WHEN 'latency-raw' THEN 'latency' ELSE parameter END AS parameter,
    CASE WHEN parameter = 'latency-raw' THEN value / 1000
         WHEN variant = 'CUSTOM-FCFS' AND parameter IN ('throughput', 'sink-throughput') THEN value / 30 ELSE value END AS value
  FROM trimmed)
{_nodes('ready', 'throughput', r(SUM, 4))}
UNION ALL {_nodes('ready', 'latency', r(MEAN, 4))}
UNION ALL SELECT 'max-latency' AS parameter, * EXCLUDE (parameter) FROM ({_nodes('ready', 'latency', r('max(value)', 4))})""",
    ),
    "ana_latency_percentiles": _with(
        MET,
        f""", lists AS (SELECT experiment, rate, variant, list_sort(list(value)) AS v FROM m WHERE parameter = 'latency' GROUP BY 1, 2, 3
), both_p AS (
  SELECT experiment, rate, variant, 'latency-sampled-p99' AS parameter, {_interpolated(0.99)} AS value FROM lists
  UNION ALL SELECT experiment, rate, variant, 'latency-sampled-p999', {_interpolated(0.999)} FROM lists)
SELECT experiment, rate, variant, parameter, CAST(1 AS INT) AS rep, 'default' AS node, CAST(1 AS INT) AS t, {r('value', 4)} AS value FROM both_p""",
    ),
    "ana_two_level_mean": _with(MET, _nodes("m", "latency", r(MEAN, 4))),
    "ana_two_level_sum": _with(MET + _trimmed("m"), _nodes("trimmed", "throughput", r(SUM, 4))),
    "ana_two_level_spe": _with(
        MET,
        f""", named AS (SELECT * REPLACE (CASE WHEN rep = 2 THEN 'taskmanager.a' ELSE node END AS node),
  CASE WHEN rep = 2 THEN 'Flink' ELSE 'Storm' END AS spe FROM m)
{_nodes('named', 'throughput', r(MEAN, 4), 'spe,')}""",
    ),
    "ana_max_latency": _with(
        MET,
        f"SELECT 'max-latency' AS parameter, * EXCLUDE (parameter) FROM ({_nodes('m', 'latency', 'max(value)')})",
    ),
    "ana_queue_spread": _with(
        MET, _nodes("m", "input-queue", f"CASE WHEN avg(value) > 0 THEN {r('stddev_pop(value) / avg(value)')} END")
    ),
    "ana_ci95": _with(
        MET,
        f"""SELECT variant, rate, {r('avg(value)', 4)} AS mean, {r('1.96::DOUBLE * stddev_pop(value) / sqrt(count(value))', 4)} AS ci95
FROM m WHERE parameter = 'latency' GROUP BY 1, 2""",
    ),
    "ana_weighted_latency": _with(
        MET,
        f""", sink AS (SELECT * FROM m WHERE parameter = 'sink-throughput'
), totals AS (SELECT variant, rep, t, rate, sum(value) AS total FROM sink GROUP BY 1, 2, 3, 4
), firsts AS (SELECT parameter, variant, rep, t, rate, node, arg_min(value, seq) AS value FROM m GROUP BY ALL
), shares AS (SELECT f.variant, f.rep, f.t, f.rate, f.node, f.value / nullif(o.total, 0) AS share
  FROM firsts f JOIN totals o USING (variant, rep, t, rate) WHERE f.parameter = 'sink-throughput')
SELECT f.variant, f.rep, f.t, f.rate, f.node, 'average-latency' AS parameter, {r('f.value * s.share', 4)} AS value
FROM firsts f LEFT JOIN shares s USING (variant, rep, t, rate, node) WHERE f.parameter = 'latency'""",
    ),
    "ana_total_cpu": _with(
        MET,
        """, g AS (SELECT variant, rep, t, rate, arg_min(value, seq) AS value FROM m WHERE parameter = 'throughput' GROUP BY ALL
), s AS (SELECT variant, rep, t, rate, arg_min(value, seq) AS value FROM m WHERE parameter = 'sink-throughput' GROUP BY ALL)
SELECT m.variant, m.rep, m.t, m.rate, m.node, 'total-cpu' AS parameter, m.value + g.value + s.value AS value
FROM m LEFT JOIN g USING (variant, rep, t, rate) LEFT JOIN s USING (variant, rep, t, rate) WHERE m.parameter = 'latency'""",
    ),
    "ana_pivot": _with(
        MET + BASE_MEANS,
        "SELECT variant, "
        + ", ".join(f'max(CASE WHEN rate = {x} THEN floor(value * 1000 + 0.5) / 1000 END) AS "{x}"' for x in RATES)
        + " FROM means GROUP BY variant",
    ),
    "ana_relative": _with(
        MET + BASE_MEANS,
        """SELECT b.variant AS baseline, a.variant, a.rate, CASE WHEN a.variant = b.variant THEN '-'
  WHEN b.value IS NULL OR b.value = 0 OR a.value IS NULL THEN 'missing'
  WHEN abs(100 * (a.value - b.value) / b.value) < 100 THEN printf('%+.0f%%', 100 * (a.value - b.value) / b.value)
  ELSE printf('%+.1fx', a.value / b.value) END AS relative
FROM means a JOIN means b ON b.rate = a.rate""",
    ),
    "ana_rolling": _with(
        MET,
        f""", per AS (SELECT parameter, variant, rate, t, avg(value) AS value FROM m GROUP BY 1, 2, 3, 4
), smooth AS (SELECT * REPLACE (avg(value) OVER (PARTITION BY parameter, variant, rate ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS value) FROM per)
SELECT parameter, variant, rate, t, {r('value', 4)} AS value FROM smooth""",
    ),
    "ana_variant_order": _with(
        MET, "SELECT DISTINCT variant, CAST(CASE WHEN variant = 'OS' THEN 0 ELSE 1 END AS INT) AS position FROM m WHERE rate BETWEEN 2000 AND 4000"
    ),
    "ana_queue_box": _with(
        MET,
        f""", queues AS (SELECT rate, variant, node || '-' || (seq % 7) AS node, value FROM m
  WHERE parameter = 'input-queue' AND seq % 50 > 1
), means AS (SELECT rate, variant, node, sum(value) / count(*) AS value FROM queues GROUP BY 1, 2, 3
), lists AS (SELECT rate, variant, list_sort(list(value)) AS v FROM means GROUP BY 1, 2
), boxes AS (SELECT rate, variant, {_interpolated(0.25)} AS q1, {_interpolated(0.5)} AS median, {_interpolated(0.75)} AS q3 FROM lists
), marked AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM means JOIN boxes USING (rate, variant))
SELECT rate, variant, {r('any_value(q1)', 4)} AS q1, {r('any_value(median)', 4)} AS median, {r('any_value(q3)', 4)} AS q3,
  {r('min(CASE WHEN inside THEN value END)', 4)} AS low, {r('max(CASE WHEN inside THEN value END)', 4)} AS high,
  CAST(sum(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM marked GROUP BY rate, variant""",
    ),
    "ana_policy": _with(
        MET,
        """SELECT seq, CASE WHEN variant = 'OS' THEN 'OS' ELSE 'CUSTOM' END AS scheduler,
  CASE variant WHEN 'OS' THEN 'default' WHEN 'CUSTOM-QS' THEN 'QS' ELSE 'FCFS' END AS policy FROM m""",
    ),
    "ana_run_summary": _with(
        MET, "SELECT experiment, variant, rate, count(DISTINCT rep) AS reps, max(t) / 60 AS minutes FROM m GROUP BY 1, 2, 3"
    ),
}


def _h(op: str) -> str:
    """Number that decides whether query q keeps a tuple at operator op."""
    x = f"((((event_id + 1 + q * 7907) % 999983) * (7919 + 104729 * ({op} + 1))) % 999983)"
    return f"((({x} * {x} % 999983) * {x} + 12345 * {op}) % 999983)"


def _chains(values: list[list[float]], source: str = "ev") -> str:
    """Events per query that pass all operators, from a parameter list of (query, selectivities)."""
    rows = ", ".join(f"({q}, {', '.join(f'{s!r}::DOUBLE' for s in ops)})" for q, ops in enumerate(values))
    passed = " AND ".join(f"{_h(str(j))} < s{j} * 999983" for j in range(len(values[0])))
    names = ", ".join(f"s{j}" for j in range(len(values[0])))
    return f"""SELECT CAST(q AS INT) AS query_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
FROM {source}, (VALUES {rows}) params(q, {names}) WHERE {passed} GROUP BY q"""


def _synthetic() -> dict[str, str]:
    from rillstone.plans.catalog import CHAIN_LENGTH, CHAIN_QUERIES, CLASSES, VARIED

    equal = 0.01 ** (1 / 3)
    high, low = (_chains(CLASSES[c], f"(SELECT * FROM ev WHERE event_type {op} 'error')") for c, op in (("HIGH", "="), ("LOW", "<>")))
    one = " AND ".join(f"{_h(str(j))} < {equal!r}::DOUBLE * 999983" for j in range(CHAIN_LENGTH))
    return {
        "syn_fanout": _with(EV, "SELECT event_id, CAST(q AS INT) AS query_id FROM ev, range(20) t(q)"),
        "syn_filter_chain": _with(EV, f"SELECT event_id FROM (SELECT event_id, 0 AS q FROM ev) WHERE {one}"),
        "syn_chain_counts": _with(EV, _chains([[equal] * CHAIN_LENGTH] * CHAIN_QUERIES)),
        "syn_selectivity": _with(EV, _chains(VARIED)),
        "syn_multiclass": _with(
            EV,
            f"""SELECT 'HIGH' AS class, CAST(3 AS INT) AS priority, * FROM ({high})
UNION ALL SELECT 'LOW', CAST(1 AS INT), * FROM ({low})""",
        ),
        "syn_stress_value": _with(EV, "SELECT event_id, pi() * (CAST(k AS BIGINT) * k * k * k * k)::DOUBLE AS f1 FROM ev"),
    }


LINES = POS + """, lines AS (
  SELECT seq, concat_ws(',', type, time, vid, speed, xway, lane, direction, segment, position) AS line FROM allpos)"""

SOURCES = {
    "src_cyclic_replay": _with(
        LINES,
        """, placed AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n FROM lines)
SELECT seq, line, c * n + i AS emission, (c * n + i) * 1000 // 4000 AS ts_ms FROM placed, range(3) t(c)""",
    ),
    "src_encode_envelope": _with(LINES, "SELECT seq, (seq * 10 + 1700000000000) || '|' || line AS value FROM lines"),
    "src_decode_envelope": _with(
        LINES, "SELECT seq, 1800000000000 AS ts_ms, line, seq * 10 + 1700000000000 AS ts_ext_ms FROM lines"
    ),
}


def statements() -> dict[str, str]:
    return {**LINEAR_ROAD, **VOIP, **STATISTICS, **EXPERIMENTS, **_synthetic(), **SOURCES}
