"""DuckDB SQL for the transit queries: named parts, each query being a selection from them."""

from __future__ import annotations

from headway.functions.scalars import Z

_z = ", ".join(f"({i}, {z!r}::DOUBLE)" for i, z in enumerate(Z, 1))
_levels = "[" + ", ".join(str(i / 100) for i in range(101)) + "]"
_levels99 = "[" + ", ".join(str(i / 100) for i in range(1, 100)) + "]"

#: (name, SQL, parts that it reads)
PARTS = {
    "fixes": ("""SELECT event_type AS route_id, user_id AS vehicle_id, event_id AS fix_id, epoch_us(ts) AS u, value AS speed_kmh,
        CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) // 10 AS INTEGER) AS seg_seq,
        CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 10 AS DOUBLE) / 10 AS progress, CAST(hour(ts) // 6 AS INTEGER) AS time_bucket, CAST(round(value * 100) AS BIGINT) AS cents, day(ts) <= 20 AS history FROM events""", ()),
    "dist": ("SELECT *, CAST(sum(cents) OVER (PARTITION BY vehicle_id ORDER BY u, fix_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dist_c FROM fixes", ("fixes",)),
    "past": ("SELECT *, speed_kmh AS x FROM fixes WHERE history", ("fixes",)),
    "pairs": ("""SELECT *, lead(u) OVER w AS next_u, lead(speed_kmh) OVER w AS next_v, lead(dist_c) OVER w AS next_c
        FROM dist WINDOW w AS (PARTITION BY vehicle_id ORDER BY u, fix_id)""", ("dist",)),
    "windows": ("""SELECT *, list(speed_kmh) OVER (PARTITION BY vehicle_id ORDER BY u, fix_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS xs FROM fixes
        QUALIFY len(xs) = 12""", ("fixes",)),
    "scored_windows": ("""SELECT *, round(list_sum(list_transform(range(1, 12), lambda i: (xs[i + 1] - xs[i]) * (xs[i + 1] - xs[i]))) / 11, 4) AS mse FROM windows""", ("windows",)),
    "marks": ("SELECT *, CASE WHEN speed_kmh <= 5 THEN 1 WHEN speed_kmh >= 10 THEN 0 END AS mark FROM fixes", ("fixes",)),
    "states": ("""SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY u, fix_id ROWS UNBOUNDED PRECEDING), 0) AS stopped FROM marks""", ("marks",)),
    "changes": ("""SELECT *, lead(u) OVER w AS next_u, CASE WHEN stopped <> lag(stopped, 1, 0) OVER w THEN 1 ELSE 0 END AS change
        FROM states WINDOW w AS (PARTITION BY vehicle_id ORDER BY u, fix_id)""", ("states",)),
    "runs": ("SELECT *, sum(change) OVER (PARTITION BY vehicle_id ORDER BY u, fix_id ROWS UNBOUNDED PRECEDING) AS run FROM changes", ("changes",)),
    "episodes": ("""SELECT vehicle_id, run, min(u) AS enter_u, arg_min(fix_id, (u, fix_id)) AS enter_fix_id, max(coalesce(next_u, u)) AS exit_u, count(*) AS n_fixes,
        (max(coalesce(next_u, u)) - min(u)) / 1e6 AS dwell_s FROM runs WHERE stopped = 1 GROUP BY vehicle_id, run""", ("runs",)),
    "grid": ("""SELECT * FROM (VALUES (3.0::DOUBLE), (5.0), (8.0)) a(enter), (VALUES (8.0::DOUBLE), (10.0), (15.0)) b(exit) WHERE enter < exit""", ()),
    "grid_states": ("""SELECT *, coalesce(last_value(CASE WHEN speed_kmh <= enter THEN 1 WHEN speed_kmh >= exit THEN 0 END IGNORE NULLS)
        OVER (PARTITION BY enter, exit, vehicle_id ORDER BY u, fix_id ROWS UNBOUNDED PRECEDING), 0) AS stopped FROM fixes, grid""", ("fixes", "grid")),
    "grid_changes": ("""SELECT *, lead(u) OVER w AS next_u, CASE WHEN stopped <> lag(stopped, 1, 0) OVER w THEN 1 ELSE 0 END AS change
        FROM grid_states WINDOW w AS (PARTITION BY enter, exit, vehicle_id ORDER BY u, fix_id)""", ("grid_states",)),
    "grid_runs": ("SELECT *, sum(change) OVER (PARTITION BY enter, exit, vehicle_id ORDER BY u, fix_id ROWS UNBOUNDED PRECEDING) AS run FROM grid_changes", ("grid_changes",)),
    "grid_episodes": ("""SELECT enter, exit, (max(coalesce(next_u, u)) - min(u)) / 1e6 AS dwell_s FROM grid_runs WHERE stopped = 1 GROUP BY enter, exit, vehicle_id, run""", ("grid_runs",)),
    "grid_shares": ("""SELECT enter, exit, count(*) AS n_episodes, avg(CAST(dwell_s < 7200 AS DOUBLE)) AS short_share,
        avg(CAST(dwell_s >= 43200 AS DOUBLE)) AS long_share FROM grid_episodes GROUP BY enter, exit""", ("grid_episodes",)),
    "quants": (f"SELECT route_id, seg_seq, count(*) AS n, list_transform(quantile_cont(x, {_levels}), lambda v: round(v, 6)) AS q FROM past GROUP BY route_id, seg_seq", ("past",)),
    "baseline": ("SELECT route_id, seg_seq, n, q[11] AS p10, q[51] AS p50, q[91] AS p90, q FROM quants", ("quants",)),
    "z": (f"SELECT * FROM (VALUES {_z}) t(i, z)", ()),
    "levels": (f"SELECT route_id AS grp, quantile_cont(x, {_levels99}) AS e FROM past GROUP BY route_id", ("past",)),
    "emp": ("SELECT grp, CAST(i AS INTEGER) AS i, z, round(e[i], 6) AS emp FROM levels, z", ("levels", "z")),
    "smooth": ("""SELECT *, CASE WHEN count(emp) OVER w = 5 THEN round(avg(emp) OVER w, 6) END AS smooth FROM emp
        WINDOW w AS (PARTITION BY grp ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""", ("emp",)),
    "first": ("""SELECT *, round((lead(smooth) OVER w - lag(smooth) OVER w) / (lead(z) OVER w - lag(z) OVER w), 6) AS d1 FROM smooth
        WINDOW w AS (PARTITION BY grp ORDER BY i)""", ("smooth",)),
    "qq": ("""SELECT *, round((lead(d1) OVER w - lag(d1) OVER w) / (lead(z) OVER w - lag(z) OVER w), 6) AS d2 FROM first
        WINDOW w AS (PARTITION BY grp ORDER BY i)""", ("first",)),
    "middle": ("SELECT qq.*, m.d1 AS d50 FROM qq JOIN qq m ON m.grp = qq.grp AND m.i = 50", ("qq",)),
    "tols": ("SELECT * FROM (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0)) t(tol)", ()),
    "zones": ("""SELECT grp, method, tol, coalesce(max(i) FILTER (far AND i < 50) + 1, 1) AS lo, coalesce(min(i) FILTER (far AND i > 50) - 1, 99) AS hi FROM (
        SELECT grp, i, tol, 'curvature' AS method, abs(d2) > tol * d50 AS far FROM middle, tols
        UNION ALL SELECT grp, i, tol, 'inflection', abs(d1 / nullif(d50, 0) - 1) > tol FROM middle, tols) GROUP BY grp, method, tol""", ("middle", "tols")),
    "live": ("SELECT f.*, speed_kmh AS x, q FROM fixes f JOIN baseline USING (route_id, seg_seq) WHERE NOT history", ("fixes", "baseline")),
    "counted": ("SELECT *, len(list_filter(q, lambda v: v <= x)) AS below FROM live", ("live",)),
    "scored": ("""SELECT *, round(CASE WHEN below = 0 THEN 0.0::DOUBLE WHEN below > 100 THEN 100.0
        ELSE (below - 1) + (x - q[below]) / nullif(q[below + 1] - q[below], 0) END, 6) AS raw_pct FROM counted""", ("counted",)),
    "terms": ("SELECT *, list(raw_pct) OVER (PARTITION BY vehicle_id ORDER BY u, fix_id ROWS UNBOUNDED PRECEDING) AS ps FROM scored", ("scored",)),
    "ema": ("SELECT *, round(list_reduce(ps, lambda y, v: v * 0.2::DOUBLE + y * 0.8::DOUBLE), 6) AS ema_pct FROM terms", ("terms",)),
    "gated": ("""SELECT *, CASE WHEN raw_pct > 86 THEN 'anomaly_high' WHEN raw_pct < 12 THEN 'anomaly_low' ELSE 'micro' END AS channel,
        least(CAST(floor(ema_pct) AS INTEGER), 99) AS e FROM ema""", ("ema",)),
    "steps": ("""SELECT *, CAST(round(CASE channel WHEN 'anomaly_high' THEN (x - q[87]) * 1000 WHEN 'anomaly_low' THEN (x - q[13]) * 1000 ELSE 0 END) AS BIGINT) AS a_step,
        CAST(round(CASE channel WHEN 'micro' THEN (q[e + 1] + (ema_pct - e) * (q[e + 2] - q[e + 1]) - q[51]) * 1000 ELSE 0 END) AS BIGINT) AS m_step FROM gated""", ("gated",)),
    "dual": ("""SELECT *, CAST(sum(a_step) OVER w AS BIGINT) AS anomaly_ms, CAST(sum(m_step) OVER w AS BIGINT) AS micro_ms,
        CAST(sum(a_step + m_step) OVER w AS BIGINT) AS total_ms FROM steps WINDOW w AS (PARTITION BY vehicle_id ORDER BY u, fix_id ROWS UNBOUNDED PRECEDING)""", ("steps",)),
    "live_states": ("""SELECT *, coalesce(last_value(CASE WHEN x <= 5 THEN 1 WHEN x >= 10 THEN 0 END IGNORE NULLS)
        OVER (PARTITION BY vehicle_id ORDER BY u, fix_id ROWS UNBOUNDED PRECEDING), 0) AS live_stopped FROM dual""", ("dual",)),
    "agent": ("SELECT * FROM live_states QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY u DESC, fix_id DESC) = 1", ("live_states",)),
    "stats": ("""SELECT route_id, seg_seq, count(*) AS n_traversals, avg(CAST(exit_u IS NOT NULL AS DOUBLE)) AS p_stop,
        coalesce(sum(exit_u - enter_u)::DOUBLE / nullif(count(exit_u), 0) / 1e6, 0) AS mean_dwell_s FROM past LEFT JOIN episodes ON episodes.vehicle_id = past.vehicle_id AND enter_fix_id = fix_id GROUP BY route_id, seg_seq""", ("past", "episodes")),
    "plan": ("""SELECT a.vehicle_id, a.route_id, a.seg_seq AS cur, a.total_ms, b.seg_seq, b.p10, b.p50,
        round(coalesce((1 - a.progress) * c.p50, 0), 6) AS remaining_current,
        round(b.q[e + 1] + (ema_pct - e) * (b.q[e + 2] - b.q[e + 1]), 6) AS pace_s,
        round(coalesce((1 - a.progress) * round(c.q[e + 1] + (ema_pct - e) * (c.q[e + 2] - c.q[e + 1]), 6), 0), 6) AS remaining_pace,
        coalesce(p_stop, 0) * coalesce(mean_dwell_s, 0) AS weight
        FROM agent a JOIN baseline b ON b.route_id = a.route_id AND b.seg_seq > a.seg_seq LEFT JOIN baseline c ON c.route_id = a.route_id AND c.seg_seq = a.seg_seq
        LEFT JOIN stats s ON s.route_id = b.route_id AND s.seg_seq = b.seg_seq""", ("agent", "baseline", "stats")),
    "shares": ("""SELECT *, round(CASE WHEN sum(weight) OVER w > 0 THEN greatest(0, total_ms) / 1000 * weight / nullif(sum(weight) OVER w, 0)
        ELSE greatest(0, total_ms) / 1000 / count(*) OVER w END, 6) AS share FROM plan WINDOW w AS (PARTITION BY vehicle_id)""", ("plan",)),
    "tick": ("""SELECT *, round(least(share, p50 - p10), 6) AS capped FROM shares""", ("shares",)),
    "ahead": ("""SELECT *, round(greatest(0.0::DOUBLE, greatest(0, total_ms) / 1000 - sum(capped) OVER w), 6) AS delay_after, round(remaining_current + sum(p50 - capped) OVER w, 6) AS eta_s,
        round(remaining_pace + sum(greatest(pace_s - capped, least(p10, pace_s))) OVER w, 6) AS pace_eta_s
        FROM tick WINDOW w AS (PARTITION BY vehicle_id ORDER BY seg_seq ROWS UNBOUNDED PRECEDING)""", ("tick",)),
    "zoned": ("""SELECT g.*, coalesce(z.lo, 12) AS lo, coalesce(z.hi, 86) AS hi FROM ema g LEFT JOIN (
        SELECT grp, CASE WHEN max(lo) <= min(hi) THEN max(lo) END AS lo, CASE WHEN max(lo) <= min(hi) THEN min(hi) END AS hi FROM zones
        WHERE (method = 'curvature' AND tol = 2) OR (method = 'inflection' AND tol = 1) GROUP BY grp) z ON z.grp = g.route_id""", ("ema", "zones")),
    "zone_gated": ("""SELECT *, CASE WHEN raw_pct > hi THEN 'anomaly_high' WHEN raw_pct < lo THEN 'anomaly_low' ELSE 'micro' END AS channel,
        least(CAST(floor(ema_pct) AS INTEGER), 99) AS e FROM zoned""", ("zoned",)),
    "zone_steps": ("""SELECT *, CAST(round(CASE channel WHEN 'anomaly_high' THEN (x - q[hi + 1]) * 1000 WHEN 'anomaly_low' THEN (x - q[lo + 1]) * 1000 ELSE 0 END) AS BIGINT) AS a_step,
        CAST(round(CASE channel WHEN 'micro' THEN (q[e + 1] + (ema_pct - e) * (q[e + 2] - q[e + 1]) - q[51]) * 1000 ELSE 0 END) AS BIGINT) AS m_step FROM zone_gated""", ("zone_gated",)),
    "zone_dual": ("""SELECT *, CAST(sum(a_step) OVER w AS BIGINT) AS anomaly_ms, CAST(sum(m_step) OVER w AS BIGINT) AS micro_ms,
        CAST(sum(a_step + m_step) OVER w AS BIGINT) AS total_ms FROM zone_steps WINDOW w AS (PARTITION BY vehicle_id ORDER BY u, fix_id ROWS UNBOUNDED PRECEDING)""", ("zone_steps",)),
    "line": ("SELECT vehicle_id, fix_id, u, next_u, speed_kmh, next_v, dist_c / 100.0::DOUBLE AS d, next_c / 100.0::DOUBLE AS next_d FROM pairs WHERE next_u IS NOT NULL", ("pairs",)),
    "ends": ("SELECT vehicle_id, min(d) AS began FROM line GROUP BY vehicle_id", ("line",)),
    "places": ("""SELECT vehicle_id, k, u + CAST(round((k * 500 - d) / (next_d - d) * (next_u - u)) AS BIGINT) AS at_u
        FROM (SELECT *, unnest(generate_series(0, 10)) AS k FROM line JOIN ends USING (vehicle_id)) WHERE next_d > d AND (k * 500 > d OR (k * 500 = d AND d = began)) AND k * 500 <= next_d""", ("line", "ends")),
    "passed": ("""SELECT a.vehicle_id, CAST(a.k AS INTEGER) AS seg_seq, (b.at_u - a.at_u) / 1e6 AS x FROM places a JOIN places b ON b.vehicle_id = a.vehicle_id AND b.k = a.k + 1""", ("places",)),
    "grid_points": ("""SELECT vehicle_id, k, speed_kmh + (k * 3600000000 - u)::DOUBLE / (next_u - u) * (next_v - speed_kmh) AS v, d + (k * 3600000000 - u)::DOUBLE / (next_u - u) * (next_d - d) AS d
        FROM (SELECT *, unnest(generate_series((u + 3599999999) // 3600000000, (next_u - 1) // 3600000000)) AS k FROM line)""", ("line",)),
    "grid_errors": ("""SELECT vehicle_id, k, round(list_sum(list_transform(range(1, 12), lambda i: (xs[i + 1] - xs[i]) * (xs[i + 1] - xs[i]))) / 11, 4) AS mse FROM (
        SELECT *, list(v) OVER (PARTITION BY vehicle_id ORDER BY k ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS xs FROM grid_points) WHERE len(xs) = 12""", ("grid_points",)),
    "grid_bad": ("SELECT vehicle_id, k FROM grid_errors WHERE mse > (SELECT round(quantile_cont(mse, 0.99), 6) FROM grid_errors)", ("grid_errors",)),
    "grid_clean": ("SELECT * FROM grid_points ANTI JOIN grid_bad USING (vehicle_id, k)", ("grid_points", "grid_bad")),
    "line_samples": ("""SELECT * FROM passed ANTI JOIN (SELECT vehicle_id, CAST(floor(d / 500) AS INTEGER) AS seg_seq FROM grid_points SEMI JOIN grid_bad USING (vehicle_id, k)) b
        USING (vehicle_id, seg_seq)""", ("passed", "grid_points", "grid_bad")),
    "grid_marks": ("""SELECT *, coalesce(last_value(CASE WHEN v <= 5 THEN 1 WHEN v >= 10 THEN 0 END IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS stopped,
        lead(k) OVER (PARTITION BY vehicle_id ORDER BY k) AS next_k FROM grid_clean""", ("grid_clean",)),
    "grid_turns": ("""SELECT *, CASE WHEN stopped <> lag(stopped, 1, 0) OVER (PARTITION BY vehicle_id ORDER BY k) THEN 1 ELSE 0 END AS change FROM grid_marks""", ("grid_marks",)),
    "grid_stops": ("""SELECT vehicle_id, CAST(floor(arg_min(d, k) / 500) AS INTEGER) AS seg_seq, (max(coalesce(next_k, k)) - min(k)) * 3600000000 AS us FROM (
        SELECT *, sum(change) OVER (PARTITION BY vehicle_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM grid_turns) WHERE stopped = 1 GROUP BY vehicle_id, run""", ("grid_turns",)),
    "line_stats": ("""SELECT seg_seq, count(*) AS n_traversals, avg(CAST(stops IS NOT NULL AS DOUBLE)) AS p_stop, coalesce(sum(us)::DOUBLE / nullif(sum(stops), 0) / 1e6, 0) AS mean_dwell_s
        FROM line_samples LEFT JOIN (SELECT vehicle_id, seg_seq, count(*) AS stops, sum(us) AS us FROM grid_stops GROUP BY vehicle_id, seg_seq) USING (vehicle_id, seg_seq) GROUP BY seg_seq""", ("line_samples", "grid_stops")),
    "line_baseline": ("SELECT seg_seq, count(*) AS n, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90 FROM line_samples GROUP BY seg_seq", ("line_samples",)),
    "noise": ("""SELECT vehicle_id, fix_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY u, fix_id) AS i,
        (dist_c % 500000) / 100.0::DOUBLE + (CASE WHEN fix_id % 97 = 0 THEN 5000.0::DOUBLE ELSE 0 END - CASE WHEN fix_id % 5 = 0 THEN 2.0::DOUBLE ELSE 0 END) AS d FROM dist""", ("dist",)),
    "wild": ("SELECT *, lag(d) OVER w AS before, coalesce(d - lag(d) OVER w > 600, false) AS wild FROM noise WINDOW w AS (PARTITION BY vehicle_id ORDER BY i)", ("noise",)),
    "held": ("""SELECT *, CASE WHEN lag(wild) OVER w THEN lag(before) OVER w ELSE before END AS held, lead(wild) OVER w AS wild_next, lead(d) OVER w AS d_next
        FROM wild WINDOW w AS (PARTITION BY vehicle_id ORDER BY i)""", ("wild",)),
    "trips": ("""SELECT *, CAST(sum(CASE WHEN coalesce(d < held - 100, false) AND NOT coalesce(wild_next AND d_next >= held - 100, false) THEN 1 ELSE 0 END)
        OVER (PARTITION BY vehicle_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip FROM held""", ("held",)),
    "moves": ("SELECT *, coalesce((d - lag(d) OVER (PARTITION BY vehicle_id, trip ORDER BY i)) / 10.0::DOUBLE, 0) AS v FROM trips", ("trips",)),
    "scores": ("SELECT *, round(v * v, 6) + coalesce(lead(round(v * v, 6)) OVER (PARTITION BY vehicle_id, trip ORDER BY i), 0) AS score FROM moves", ("moves",)),
    "ranked": ("SELECT *, coalesce(lag(score) OVER w, -1) AS score_before, coalesce(lead(score) OVER w, -1) AS score_after FROM scores WINDOW w AS (PARTITION BY vehicle_id, trip ORDER BY i)", ("scores",)),
    "in_place": ("""SELECT vehicle_id, fix_id, trip, i * 10000000 AS u, max(d) OVER (PARTITION BY vehicle_id, trip ORDER BY i ROWS UNBOUNDED PRECEDING) AS d FROM ranked
        WHERE NOT (score > 10000 AND score > score_before AND score >= score_after)""", ("ranked",)),
    "stream_place": ("""SELECT vehicle_id, fix_id, trip, i * 10000000 AS u, max(d) OVER (PARTITION BY vehicle_id, trip ORDER BY i ROWS UNBOUNDED PRECEDING) AS d FROM trips
        WHERE NOT coalesce((wild AND d - d_next > 600) OR (d < held - 100 AND wild_next AND d_next >= held - 100), false)""", ("trips",)),
    "stream_pairs": ("""SELECT *, lead(u) OVER w AS next_u, lead(d) OVER w AS next_d, lead(fix_id) OVER w AS next_id, d = min(d) OVER (PARTITION BY vehicle_id, trip) AS began FROM stream_place
        WINDOW w AS (PARTITION BY vehicle_id, trip ORDER BY u, fix_id)""", ("stream_place",)),
    "stream_places": ("""SELECT vehicle_id, trip, k, next_id, u + CAST(round((k * 500 - d) / (next_d - d) * (next_u - u)) AS BIGINT) AS at_u
        FROM (SELECT *, unnest(generate_series(0, 10)) AS k FROM stream_pairs) WHERE next_d > d AND (k * 500 > d OR (k * 500 = d AND began)) AND k * 500 <= next_d""", ("stream_pairs",)),
    "stream_times": ("""SELECT a.vehicle_id, a.trip, CAST(a.k AS INTEGER) AS seg_seq, b.at_u AS u, b.next_id AS fix_id, (b.at_u - a.at_u) / 1e6 AS x
        FROM stream_places a JOIN stream_places b ON b.vehicle_id = a.vehicle_id AND b.trip = a.trip AND b.k = a.k + 1""", ("stream_places",)),
    "noisy_pairs": ("""SELECT *, lead(u) OVER w AS next_u, lead(d) OVER w AS next_d, d = min(d) OVER (PARTITION BY vehicle_id, trip) AS began FROM in_place WINDOW w AS (PARTITION BY vehicle_id, trip ORDER BY u, fix_id)""", ("in_place",)),
    "noisy_places": ("""SELECT vehicle_id, trip, k, u + CAST(round((k * 500 - d) / (next_d - d) * (next_u - u)) AS BIGINT) AS at_u
        FROM (SELECT *, unnest(generate_series(0, 10)) AS k FROM noisy_pairs) WHERE next_d > d AND (k * 500 > d OR (k * 500 = d AND began)) AND k * 500 <= next_d""", ("noisy_pairs",)),
    "noisy_times": ("SELECT CAST(a.k AS INTEGER) AS seg_seq, (b.at_u - a.at_u) / 1e6 AS x FROM noisy_places a JOIN noisy_places b ON b.vehicle_id = a.vehicle_id AND b.trip = a.trip AND b.k = a.k + 1", ("noisy_places",)),
    "spectrum_tols": ("SELECT i / 4.0::DOUBLE AS tol FROM range(1, 25) r(i)", ()),
    "spectrum": ("""SELECT grp, method, tol, coalesce(max(i) FILTER (far AND i < 50) + 1, 1) AS lo, coalesce(min(i) FILTER (far AND i > 50) - 1, 99) AS hi FROM (
        SELECT grp, i, tol, 'curvature' AS method, abs(d2) > tol * d50 AS far FROM middle, spectrum_tols
        UNION ALL SELECT grp, i, tol, 'inflection', abs(d1 / nullif(d50, 0) - 1) > tol FROM middle, spectrum_tols) GROUP BY grp, method, tol""", ("middle", "spectrum_tols")),
    "spectrum_runs": ("""SELECT grp, method, min(tol) AS tol, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n_tols FROM (
        SELECT *, row_number() OVER (PARTITION BY grp, method ORDER BY tol) - row_number() OVER (PARTITION BY grp, method, lo, hi ORDER BY tol) AS run FROM spectrum) GROUP BY grp, method, lo, hi, run""", ("spectrum",)),
    "plateaus": ("SELECT * FROM spectrum_runs QUALIFY row_number() OVER (PARTITION BY grp, method ORDER BY lo = 1 AND hi = 99, n_tols DESC, tol) = 1", ("spectrum_runs",)),
    "rooms": ("SELECT *, greatest(0, total_ms) / 1000 AS budget, round(greatest(0.0::DOUBLE, p50 - p10), 6) AS room, round(greatest(0.0::DOUBLE, p50 - p10), 6) * (1 + weight) AS fill_weight FROM plan", ("plan",)),
    "filling": ("""SELECT *, round(room / nullif(fill_weight, 0), 12) AS fills FROM rooms""", ("rooms",)),
    "levels_of": ("""SELECT a.vehicle_id, a.fills, (a.budget - coalesce(sum(b.room) FILTER (b.fills < a.fills), 0)) / sum(b.fill_weight) FILTER (b.fills >= a.fills) AS level
        FROM filling a JOIN filling b ON b.vehicle_id = a.vehicle_id WHERE a.fills IS NOT NULL GROUP BY a.vehicle_id, a.fills, a.seg_seq, a.budget""", ("filling",)),
    "filled": ("""SELECT f.*, CASE WHEN l.level IS NULL THEN room ELSE least(room, greatest(0.0::DOUBLE, l.level * fill_weight)) END AS filled FROM filling f LEFT JOIN (
        SELECT vehicle_id, max(level) AS level FROM levels_of WHERE level <= fills GROUP BY vehicle_id) l ON l.vehicle_id = f.vehicle_id""", ("filling", "levels_of")),
    "filled_ahead": ("""SELECT vehicle_id, route_id, seg_seq, round(filled, 4) AS recovery, round(greatest(0.0::DOUBLE, budget - sum(round(filled, 6)) OVER w), 4) AS delay_after,
        round(remaining_current + sum(greatest(p50 - round(filled, 6), least(p10, p50))) OVER w, 4) AS eta_s FROM filled WINDOW w AS (PARTITION BY vehicle_id ORDER BY seg_seq ROWS UNBOUNDED PRECEDING)""", ("filled",)),
    "day_medians": ("""SELECT route_id, seg_seq, (u // 86400000000 + 1) * 86400000000 AS since_u, round(quantile_cont(speed_kmh, 0.5), 6) AS day_p50, count(*) AS day_n FROM fixes GROUP BY route_id, seg_seq, since_u""", ("fixes",)),
    "met": ("""SELECT f.vehicle_id, f.fix_id, f.route_id, f.seg_seq, f.speed_kmh, m.since_u, m.day_p50, m.day_n FROM fixes f ASOF LEFT JOIN day_medians m
        ON m.route_id = f.route_id AND m.seg_seq = f.seg_seq AND f.u >= m.since_u""", ("fixes", "day_medians")),
    "gps": ("""SELECT vehicle_id, fix_id, 37.5::DOUBLE + 0.003::DOUBLE * (floor(s) + (s - floor(s))) + 0.0001::DOUBLE * (fix_id % 5 - 2) AS lat,
        127.0::DOUBLE + 0.004::DOUBLE * (floor(s) % 2 + (s - floor(s)) * (1 - 2 * (floor(s) % 2))) AS lon FROM (SELECT *, (dist_c % 500000) / 50000.0::DOUBLE AS s FROM dist)""", ("dist",)),
    "shape": ("SELECT k, 37.5::DOUBLE + 0.003::DOUBLE * k AS lat, 127.0::DOUBLE + 0.004::DOUBLE * (k % 2) AS lon, 37.5::DOUBLE + 0.003::DOUBLE * (k + 1) AS to_lat, 127.0::DOUBLE + 0.004::DOUBLE * ((k + 1) % 2) AS to_lon FROM range(0, 10) r(k)", ()),
    "shape_lengths": ("""SELECT *, 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(to_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(to_lat)) * pow(sin(radians(to_lon - lon) / 2), 2))) AS length FROM shape""", ("shape",)),
    "shape_edges": ("SELECT *, coalesce(sum(length) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, cos(radians(lat)) AS squeeze FROM shape_lengths", ("shape_lengths",)),
    "projected": ("""SELECT vehicle_id, fix_id, start, length, px, py, bx, by_, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * bx + py * by_) / (bx * bx + by_ * by_))) AS t FROM (
        SELECT g.vehicle_id, g.fix_id, e.start, e.length, (g.lon - e.lon) * squeeze AS px, g.lat - e.lat AS py, (e.to_lon - e.lon) * squeeze AS bx, e.to_lat - e.lat AS by_ FROM gps g, shape_edges e)""", ("gps", "shape_edges")),
    "matched": ("""SELECT vehicle_id, fix_id, round(sqrt(pow(px - t * bx, 2) + pow(py - t * by_, 2)) * (6371008.8::DOUBLE / 57.29577951308232::DOUBLE), 3) AS off_m, start + t * length AS dist_m FROM projected
        QUALIFY row_number() OVER (PARTITION BY vehicle_id, fix_id ORDER BY round(sqrt(pow(px - t * bx, 2) + pow(py - t * by_, 2)) * (6371008.8::DOUBLE / 57.29577951308232::DOUBLE), 3), start + t * length) = 1""", ("projected",)),
    "line_rows": ("SELECT 'line' AS route_id, * FROM line_baseline JOIN line_stats USING (seg_seq)", ("line_baseline", "line_stats")),
}

#: Each query's columns and the part that they come from, then anything after it.
SELECTS = {
    "q_source_fixes": ("route_id, vehicle_id, fix_id, u, speed_kmh, seg_seq, time_bucket, dist_c, history", "dist"),
    "q_source_segments": ("route_id, seg_seq, count(*) AS n_fixes, sum(cents)::DOUBLE / count(cents) / 100 AS length_m", "fixes", "GROUP BY route_id, seg_seq"),
    "q_travel_samples": ("route_id, seg_seq, time_bucket, vehicle_id, fix_id, u, x", "past"),
    "q_route_filter": ("route_id, vehicle_id, fix_id, u, speed_kmh", "fixes", "WHERE route_id = 'click'"),
    "q_stop_crossings": ("""vehicle_id, boundary, round((u + (boundary * 50000 - dist_c)::DOUBLE / (next_c - dist_c) * (next_u - u)) / 1e6, 3) AS cross_s
        FROM (SELECT *, unnest(generate_series(dist_c // 50000 + 1, next_c // 50000)) AS boundary""", "pairs", "WHERE next_u IS NOT NULL)"),
    "q_resample": ("""vehicle_id, k, round(speed_kmh + (k * 3600000000 - u)::DOUBLE / (next_u - u) * (next_v - speed_kmh), 6) AS value
        FROM (SELECT *, unnest(generate_series((u + 3599999999) // 3600000000, (next_u - 1) // 3600000000)) AS k""", "pairs", "WHERE next_u IS NOT NULL)"),
    "q_seq_windows": ("vehicle_id, fix_id AS end_fix_id, xs[1] AS first_x, xs[12] AS last_x, round(list_sum(xs), 4) AS sum_x", "windows"),
    "q_mse_persistence": ("vehicle_id, fix_id AS end_fix_id, mse", "scored_windows"),
    "q_outlier_reject": ("vehicle_id, fix_id, speed_kmh", "fixes", "WHERE fix_id NOT IN (SELECT fix_id FROM scored_windows WHERE mse > (SELECT round(quantile_cont(mse, 0.99), 6) FROM scored_windows WHERE history))", ("scored_windows",)),
    "q_stop_state": ("vehicle_id, fix_id, speed_kmh, stopped", "states"),
    "q_stop_episodes": ("vehicle_id, enter_u, exit_u, n_fixes, dwell_s", "episodes"),
    "q_threshold_grid": ("*, long_share - short_share AS score", "grid_shares"),
    "q_quantile_norm": ("vehicle_id, time_bucket, fix_id, x, round(100 * percent_rank() OVER (PARTITION BY vehicle_id, time_bucket ORDER BY x), 6) AS pct", "past"),
    "q_segment_quantiles": ("route_id, seg_seq, n, p10, p50, p90", "baseline"),
    "q_qq_points": ("grp, i, z, emp, smooth, d1, d2", "qq"),
    "q_qq_curvature": ("*", "zones", "WHERE method = 'curvature' AND tol = 2"),
    "q_qq_inflection": ("*", "zones", "WHERE method = 'inflection' AND tol = 1"),
    "q_qq_sensitivity": ("*", "zones"),
    "q_safe_zone": ("grp, CASE WHEN max(lo) <= min(hi) THEN max(lo) END AS lo, CASE WHEN max(lo) <= min(hi) THEN min(hi) END AS hi", "zones",
        "WHERE (method = 'curvature' AND tol = 2) OR (method = 'inflection' AND tol = 1) GROUP BY grp"),
    "q_raw_pct": ("vehicle_id, fix_id, x, raw_pct", "scored"),
    "q_channel": ("vehicle_id, fix_id, channel", "gated"),
    "q_ema_pct": ("vehicle_id, fix_id, ema_pct", "ema"),
    "q_anomaly_delay": ("vehicle_id, fix_id, anomaly_ms", "dual"),
    "q_micro_delay": ("vehicle_id, fix_id, micro_ms", "dual"),
    "q_dual_delay": ("vehicle_id, fix_id, channel, anomaly_ms, micro_ms, total_ms", "dual"),
    "q_channel_calibrated": ("vehicle_id, fix_id, lo, hi, channel", "zone_gated"),
    "q_dual_delay_calibrated": ("vehicle_id, fix_id, channel, anomaly_ms, micro_ms, total_ms", "zone_dual"),
    "q_prepared_baseline": ("route_id, seg_seq, n, p10, p50, p90, n_traversals, p_stop, mean_dwell_s", "line_rows"),
    "q_zone_plateaus": ("grp, method, tol, lo, hi, n_tols", "plateaus"),
    "q_recovery_filled": ("vehicle_id, route_id, seg_seq, room, round(fill_weight, 6) AS weight, round(filled, 5) AS recovery", "filled"),
    "q_flagship_filled": ("*", "filled_ahead"),
    "q_asof_baseline": ("*", "met"),
    "q_traversal_stream": ("vehicle_id, trip, seg_seq, u, fix_id, x", "stream_times"),
    "q_agent_resumed": ("vehicle_id, u AS last_u, route_id, seg_seq, progress, live_stopped AS stopped, ema_pct, anomaly_ms, micro_ms", "agent"),
    "q_map_match": ("vehicle_id, fix_id, round(dist_m, 1) AS dist_m, round(off_m, 1) AS off_m", "matched", "WHERE off_m <= 60"),
    "q_fixes_in_place": ("vehicle_id, fix_id, trip, round(d, 2) AS dist_m", "in_place"),
    "q_jitter_baseline": ("'line' AS route_id, seg_seq, count(*) AS n, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90", "noisy_times", "GROUP BY seg_seq"),
    "q_eta_pace": ("vehicle_id, route_id, seg_seq, remaining_pace AS remaining_current, pace_s, pace_eta_s AS eta_s", "ahead"),
    "q_agent_state": ("vehicle_id, u AS last_u, route_id, seg_seq, progress, live_stopped AS stopped, ema_pct, anomaly_ms, micro_ms", "agent"),
    "q_agent_stream": ("vehicle_id, u AS last_u, route_id, seg_seq, progress, live_stopped AS stopped, ema_pct, anomaly_ms, micro_ms", "agent"),
    "q_eta_sink": ("vehicle_id, route_id, seg_seq, capped AS recovery, delay_after, eta_s", "ahead"),
    "q_stop_stats": ("*", "stats"),
    "q_recovery_alloc": ("vehicle_id, route_id, seg_seq, weight, share AS recovery", "shares"),
    "q_recovery_capped": ("vehicle_id, route_id, seg_seq, weight, capped AS recovery", "tick"),
    "q_delay_propagation": ("vehicle_id, route_id, seg_seq, delay_after", "ahead"),
    "q_eta": ("vehicle_id, route_id, seg_seq, eta_s", "ahead"),
    "q_flagship": ("vehicle_id, route_id, cur, seg_seq, total_ms, remaining_current, capped AS recovery, delay_after, eta_s", "ahead"),
}


def needed(part: str, found: dict[str, None]) -> dict[str, None]:
    """The parts that one reads, in an order that defines each before its use."""
    for p in PARTS[part][1]:
        needed(p, found)
    found.setdefault(part)
    return found


def sql(columns: str, part: str, rest: str = "", more: tuple[str, ...] = ()) -> str:
    names: dict[str, None] = {}
    for p in (*more, part):
        needed(p, names)
    parts = ",\n".join(f"{n} AS ({PARTS[n][0]})" for n in names)
    return f"WITH {parts}\nSELECT {columns} FROM {part} {rest}"


ORACLE_SQL = {name: sql(*args) for name, args in SELECTS.items()}
