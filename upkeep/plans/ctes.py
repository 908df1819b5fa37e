"""The fleet model and the marts as DuckDB common table expressions: an independent statement of what the operators compute."""

from __future__ import annotations

import re

SEV = "['low', 'medium', 'high', 'critical']"
KIND = "['wheel_profile', 'brake_disc', 'bogie_frame', 'pantograph_head', 'door_actuator']"
REPORTED = "['wheel scan', 'brake thermal', 'bogie acoustic', 'pantograph camera', 'general']"


def family(text: str, order: str = "wheel brake bogie pantograph", default: str = "other") -> str:
    words = {"wheel": "wheel|rodadura", "brake": "brake|fren", "bogie": "bogie|suspension", "pantograph": "pant|capt"}
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), '{words[f]}') THEN '{f}'" for f in order.split()) + f" ELSE '{default}' END"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least({float(high)}::DOUBLE, greatest({float(low)}::DOUBLE, {x})) END"


def unit(x: str) -> str:
    """x scaled to 0..1 over all rows."""
    return f"CASE WHEN max({x}) OVER () - min({x}) OVER () < 1e-9 THEN 0.0::DOUBLE ELSE (({x}) - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"


DAY = "day, unit_id, component_id"

CTES: dict[str, str] = {
    "ev": "SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id AS component_id, user_id // 8 AS unit_id, event_type, value FROM events",
    "readings": "SELECT event_id AS reading_id, ts, day, unit_id, component_id, value, 20 + (event_id % 100) / 2 AS temperature, (event_id % 13)::DOUBLE AS vibration, (event_id % 150)::DOUBLE AS wear, (50 + event_id % 50) / 100 AS load FROM ev WHERE event_type IN ('view', 'click')",
    "inspections": f"SELECT event_id AS inspection_id, ts, day, unit_id, component_id, least(100.0::DOUBLE, value) AS score, CASE WHEN value >= 60 THEN 1 ELSE 0 END AS defect, (50 + event_id % 50) / 100 AS confidence, {SEV}[event_id % 4 + 1] AS severity, {REPORTED}[event_id % 5 + 1] AS reported FROM ev WHERE event_type = 'signup'",
    "failures": "SELECT event_id AS failure_id, ts, day, unit_id, component_id, (1 + event_id % 5)::INT AS severity, 1 + value / 50 AS downtime_h, (event_id % 2)::INT AS repeated, 'mode_' || (event_id % 3) AS mode FROM ev WHERE event_type = 'error'",
    "alerts": f"SELECT reading_id AS alert_id, ts, day, unit_id, component_id, CASE WHEN reading_id % 3 <> 0 THEN 1 ELSE 0 END AS early, (reading_id % 2)::INT AS attended, {SEV}[reading_id % 4 + 1] AS severity, CASE WHEN reading_id % 5 < 3 THEN 'sensor' ELSE 'inspection' END AS origin FROM readings WHERE value > 80",
    "maintenance": "SELECT event_id AS maintenance_id, ts, day, unit_id, component_id, unit_id % 25 AS depot_id, (event_id % 3 = 0)::INT AS corrective, (event_id % 3 = 1)::INT AS condition_based, (event_id % 3 = 2)::INT AS planned, 1 + value / 100 AS hours, value * 20 AS cost FROM ev WHERE event_type = 'purchase'",
    "calendar": "SELECT unnest(generate_series((SELECT min(day) FROM ev), (SELECT max(day) FROM ev), INTERVAL 1 DAY))::DATE AS day",
    "weeks": "SELECT unnest(generate_series((SELECT min(day) FROM ev), (SELECT max(day) FROM ev), INTERVAL 7 DAY))::DATE AS snapshot",
    "backlog": f"SELECT snapshot AS day, event_id AS order_id, unit_id % 25 AS depot_id, unit_id, component_id, date_diff('day', e.day, snapshot) AS age_days, {SEV}[event_id % 4 + 1] AS severity, least(100.0::DOUBLE, date_diff('day', e.day, snapshot) * 2 + value / 5) AS risk FROM ev e JOIN weeks ON snapshot >= e.day WHERE event_type = 'purchase'",
    "units": "SELECT unit_id, unit_id % 6 AS fleet_id, unit_id % 25 AS depot_id, unit_id % 16 AS line_id, (3 + unit_id % 4) || '_cars' AS configuration, (5 + unit_id % 6) / 2 AS service_criticality FROM (SELECT DISTINCT unit_id FROM ev)",
    "components": f"SELECT p_partkey AS component_id, p_partkey // 8 AS unit_id, p_type AS system, {KIND}[p_partkey % 5 + 1] AS kind, (1 + p_size % 5)::DOUBLE AS criticality, p_size / 40 AS age_ratio, (p_retailprice - 900) / 100 AS cycles_ratio FROM part WHERE p_partkey IN (SELECT component_id FROM ev)",
    "depots": f"SELECT n_nationkey::BIGINT AS depot_id, n_name AS depot_name, 50 + coalesce(wealth, 0) / 200 AS capacity, {KIND}[n_nationkey % 5 + 1] || ' ' || {KIND}[(n_nationkey + 2) % 5 + 1] AS speciality FROM nation LEFT JOIN (SELECT s_nationkey, round(avg(abs(s_acctbal)), 2) AS wealth FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey",
    "service": """SELECT day, unit_id, fleet_id, line_id, 20.0::DOUBLE AS planned_h, 20 - unavailable_h AS available_h, unavailable_h, floor(unavailable_h / 4)::BIGINT AS cancellations, unavailable_h / 20 AS punctuality_hit, (unavailable_h > 8)::INT AS substitution
        FROM (SELECT c.day, u.*, least(20.0::DOUBLE, coalesce(d, 0) + coalesce(h, 0) * 13 / 20) AS unavailable_h FROM units u CROSS JOIN calendar c
        LEFT JOIN (SELECT day, unit_id, sum(downtime_h) AS d FROM failures GROUP BY ALL) f ON f.day = c.day AND f.unit_id = u.unit_id LEFT JOIN (SELECT day, unit_id, sum(hours) AS h FROM maintenance GROUP BY ALL) m ON m.day = c.day AND m.unit_id = u.unit_id)""",
    "context": "SELECT day, line_id, (10 + (line_id * 3 + day(day)) % 25)::DOUBLE AS ambient, (40 + (line_id + day(day)) % 30)::DOUBLE AS humidity, (10 + line_id % 5) / 10 AS intensity, (line_id % 5) / 5 AS congestion FROM (SELECT DISTINCT line_id FROM units) CROSS JOIN calendar",
    "inputs": f"""SELECT s.*, c.kind, c.system, c.criticality, c.age_ratio, c.cycles_ratio, u.line_id, x.ambient, x.humidity, x.intensity, x.congestion, coalesce(i.defect_score, 0) AS defect_score, coalesce(i.inspection_confidence, 0) AS inspection_confidence, coalesce(i.defect_flag, 0) AS defect_flag,
        coalesce(m.maintenance_events, 0)::BIGINT AS maintenance_events, coalesce(m.maintenance_hours, 0) AS maintenance_hours, coalesce(m.corrective_share, 0) AS corrective_share, coalesce(m.condition_share, 0) AS condition_share, coalesce(f.failures, 0)::BIGINT AS failures, coalesce(f.failure_downtime_h, 0) AS failure_downtime_h, coalesce(f.failure_severity, 0) AS failure_severity, coalesce(f.repeated, 0) AS repeated
        FROM (SELECT {DAY}, avg(value) AS sensor_mean, stddev_samp(value) AS sensor_std, max(value) AS sensor_max, avg(temperature) AS temperature, avg(vibration) AS vibration, avg(wear) AS wear, avg(load) AS load FROM readings GROUP BY ALL) s
        JOIN components c ON c.component_id = s.component_id
        LEFT JOIN (SELECT {DAY}, max(score) AS defect_score, avg(confidence) AS inspection_confidence, max(defect) AS defect_flag FROM inspections GROUP BY ALL) i ON (i.day, i.unit_id, i.component_id) = (s.day, s.unit_id, s.component_id)
        LEFT JOIN (SELECT {DAY}, count(*) AS maintenance_events, sum(hours) AS maintenance_hours, avg(corrective) AS corrective_share, avg(condition_based) AS condition_share FROM maintenance GROUP BY ALL) m ON (m.day, m.unit_id, m.component_id) = (s.day, s.unit_id, s.component_id)
        LEFT JOIN (SELECT {DAY}, count(*) AS failures, sum(downtime_h) AS failure_downtime_h, avg(severity) AS failure_severity, max(repeated) AS repeated FROM failures GROUP BY ALL) f ON (f.day, f.unit_id, f.component_id) = (s.day, s.unit_id, s.component_id)
        JOIN units u ON u.unit_id = s.unit_id LEFT JOIN context x ON x.day = s.day AND x.line_id = u.line_id""",
    "failalert": f"""SELECT coalesce(a.day, f.day) AS day, coalesce(a.unit_id, f.unit_id) AS unit_id, coalesce(a.component_id, f.component_id) AS component_id, coalesce(alerts, 0)::BIGINT AS alerts, coalesce(early_alerts, 0)::BIGINT AS early_alerts, coalesce(critical_alerts, 0)::BIGINT AS critical_alerts, coalesce(attended_share, 0) AS attended_share,
        coalesce(failures, 0)::BIGINT AS failures, coalesce(downtime_h, 0) AS downtime_h, coalesce(mean_severity, 0) AS mean_severity, coalesce(repeated, 0) AS repeated
        FROM (SELECT {DAY}, count(*) AS alerts, count(*) FILTER (early = 1) AS early_alerts, count(*) FILTER (severity = 'critical') AS critical_alerts, avg(attended) AS attended_share FROM alerts GROUP BY ALL) a
        FULL JOIN (SELECT {DAY}, count(*) AS failures, sum(downtime_h) AS downtime_h, avg(severity) AS mean_severity, max(repeated) AS repeated FROM failures GROUP BY ALL) f ON (a.day, a.unit_id, a.component_id) = (f.day, f.unit_id, f.component_id)""",
    "patterns": """SELECT *, CASE WHEN events >= 6 AND repeated_events >= 3 THEN 'structural_high' WHEN events >= 3 THEN 'medium' ELSE 'low' END AS segment FROM (SELECT kind, mode, f.unit_id, f.component_id, count(*) AS events, sum(repeated)::BIGINT AS repeated_events, sum(downtime_h) AS downtime_h, avg(severity) AS mean_severity FROM failures f JOIN components c ON c.component_id = f.component_id GROUP BY ALL)""",
    "avail": """SELECT s.*, coalesce(backlog_items, 0)::BIGINT AS backlog_items, coalesce(backlog_risk, 0) AS backlog_risk, coalesce(overdue_items, 0)::BIGINT AS overdue_items, coalesce(critical_items, 0)::BIGINT AS critical_items, coalesce(shop_hours, 0) AS shop_hours, coalesce(corrective_share, 0) AS corrective_share,
        CASE WHEN backlog_items > 0 THEN overdue_items / backlog_items ELSE 0.0::DOUBLE END AS overdue_ratio, CASE WHEN backlog_items > 0 THEN critical_items / backlog_items ELSE 0.0::DOUBLE END AS critical_ratio, CASE WHEN planned_h > 0 THEN available_h / planned_h ELSE 0 END AS availability
        FROM service s LEFT JOIN (SELECT day, unit_id, count(*) AS backlog_items, sum(risk) AS backlog_risk, count(*) FILTER (age_days >= 14) AS overdue_items, count(*) FILTER ((age_days >= 21 AND severity IN ('high', 'critical')) OR risk >= 70) AS critical_items FROM backlog GROUP BY ALL) b ON b.day = s.day AND b.unit_id = s.unit_id
        LEFT JOIN (SELECT day, unit_id, sum(hours) AS shop_hours, avg(corrective) AS corrective_share FROM maintenance GROUP BY ALL) m ON m.day = s.day AND m.unit_id = s.unit_id""",
    "mart": """SELECT *, 100.0 - deterioration AS health, abs(rolling_change) AS rolling_abs_change FROM (SELECT i.*, coalesce(alerts, 0)::BIGINT AS alerts, coalesce(early_alerts, 0)::BIGINT AS early_alerts, coalesce(critical_alerts, 0)::BIGINT AS critical_alerts, coalesce(attended_share, 0) AS attended_share,
        avg(sensor_mean) OVER w7 AS rolling_mean, stddev_samp(sensor_mean) OVER w7 AS rolling_std, sensor_mean - lag(sensor_mean, 7) OVER w AS rolling_change, (sum(CASE WHEN alerts > 0 THEN 1 ELSE 0 END) OVER w30)::BIGINT AS alert_days_30, (sum(i.failures) OVER w30)::BIGINT AS failures_30, (sum(maintenance_events) OVER w180)::BIGINT AS maintenance_180,
        load * 0.45 + congestion * 0.35 + abs(ambient - 22) / 30 * 0.20 AS stress, least(100.0, greatest(0.0, least(coalesce(age_ratio, 0), 1.5) / 1.5 * 30 + least(coalesce(cycles_ratio, 0), 1.5) / 1.5 * 25 + least(coalesce(wear, 0), 140) / 140 * 30 + least(coalesce(vibration, 0), 12) / 12 * 15)) AS deterioration
        FROM inputs i LEFT JOIN failalert a ON (a.day, a.unit_id, a.component_id) = (i.day, i.unit_id, i.component_id)
        WINDOW w AS (PARTITION BY i.component_id ORDER BY i.day), w7 AS (PARTITION BY i.component_id ORDER BY i.day ROWS 6 PRECEDING), w30 AS (PARTITION BY i.component_id ORDER BY i.day ROWS 29 PRECEDING), w180 AS (PARTITION BY i.component_id ORDER BY i.day ROWS 179 PRECEDING))""",
    "unitday": """SELECT *, (100 - mean_health) / 100 * 0.30 + least(critical_components, 8) / 8 * 0.20 + least(critical_ratio, 1.0) * 0.10 + exposure / 100 * 0.05 + least(unavailable_h, 24) / 24 * 0.20 + least(substitution, 1)::DOUBLE * 0.15 AS risk FROM (SELECT a.*, c.* EXCLUDE (day, unit_id), CASE WHEN backlog_items > 0 THEN least(100.0, (overdue_items::DOUBLE * 0.75 + critical_items::DOUBLE * 1.20 + backlog_risk / 90) / backlog_items * 28) ELSE 0.0 END AS exposure
        FROM avail a LEFT JOIN (SELECT day, unit_id, count(*) AS component_count, count(*) FILTER (health <= 35) AS critical_components, avg(health) AS mean_health, avg(deterioration) AS mean_deterioration, sum(failures)::BIGINT AS failures, sum(failure_downtime_h) AS failure_downtime_h, sum(alerts)::BIGINT AS alerts, sum(critical_alerts)::BIGINT AS critical_alerts, sum(maintenance_hours) AS maintenance_hours, avg(stress) AS stress, avg(repeated) AS repeat_intensity FROM mart GROUP BY ALL) c ON c.day = a.day AND c.unit_id = a.unit_id)""",
    "depotday": """SELECT d.*, depot_name, capacity, coalesce(corrective_share, 0) AS corrective_share, coalesce(planned_share, 0) AS planned_share, CASE WHEN capacity > 0 THEN (maintenance_hours + backlog_items::DOUBLE * 0.20 + overdue_items::DOUBLE * 0.35 + critical_items::DOUBLE * 0.75 + exposure * 0.12 + unavailable_h * 0.05) / capacity ELSE 0 END AS saturation
        FROM (SELECT day, depot_id, sum(backlog_items)::BIGINT AS backlog_items, sum(backlog_risk) AS backlog_risk, sum(overdue_items)::BIGINT AS overdue_items, sum(critical_items)::BIGINT AS critical_items, avg(exposure) AS exposure, sum(maintenance_hours) AS maintenance_hours, avg(risk) AS mean_risk, sum(unavailable_h) AS unavailable_h, sum(cancellations)::BIGINT AS cancellations, sum(substitution)::BIGINT AS substitutions FROM unitday JOIN (SELECT unit_id AS u, depot_id FROM units) ON u = unit_id GROUP BY ALL) d
        JOIN depots USING (depot_id) LEFT JOIN (SELECT day, depot_id, avg(corrective) AS corrective_share, avg(planned) AS planned_share FROM maintenance GROUP BY ALL) m ON m.day = d.day AND m.depot_id = d.depot_id""",
    "fleetweek": """SELECT w.*, CASE WHEN failures > 0 THEN available_h / failures ELSE available_h END AS mtbf, CASE WHEN failures > 0 THEN downtime_h / failures ELSE 0 END AS mttr, coalesce(corrective_share, 0) AS corrective_share, coalesce(condition_share, 0) AS condition_share, coalesce(planned_share, 0) AS planned_share
        FROM (SELECT date_trunc('week', day)::DATE AS week, fleet_id, avg(availability) AS availability, sum(available_h) AS available_h, sum(failures)::BIGINT AS failures, sum(failure_downtime_h) AS downtime_h, sum(maintenance_hours) AS maintenance_hours, avg(repeat_intensity) AS repeat_intensity, avg(risk) AS mean_risk, sum(backlog_items)::BIGINT AS backlog_items, sum(backlog_risk) AS backlog_risk, sum(overdue_items)::BIGINT AS overdue_items, sum(critical_items)::BIGINT AS critical_items, avg(exposure) AS exposure FROM unitday GROUP BY 1, 2) w
        LEFT JOIN (SELECT date_trunc('week', day)::DATE AS week, fleet_id, avg(corrective) AS corrective_share, avg(condition_based) AS condition_share, avg(planned) AS planned_share FROM maintenance m JOIN (SELECT unit_id AS u, fleet_id FROM units) ON u = unit_id GROUP BY 1, 2) m ON m.week = w.week AND m.fleet_id = w.fleet_id""",
    # inspections by family
    "tech": f"SELECT component_id, {family('kind')} AS technical FROM components",
    "seen": f"SELECT *, (named = family OR named = 'other')::INT AS consistent FROM (SELECT i.*, {family('reported')} AS named, coalesce(technical, {family('reported')}) AS family FROM inspections i LEFT JOIN tech USING (component_id)) WHERE family IN ('wheel', 'brake', 'bogie', 'pantograph')",
    "failed": f"SELECT * FROM (SELECT failure_id, component_id, day AS failed, coalesce(technical, {family('mode')}) AS family FROM failures LEFT JOIN tech USING (component_id)) WHERE family IN ('wheel', 'brake', 'bogie', 'pantograph')",
    "linked": "SELECT f.*, i.ts AS found, date_diff('day', i.ts, f.failed::TIMESTAMP) AS lead, i.confidence FROM failed f JOIN seen i ON i.component_id = f.component_id AND i.family = f.family AND defect = 1 AND date_diff('day', i.ts, f.failed::TIMESTAMP) BETWEEN 0 AND 30 QUALIFY row_number() OVER (PARTITION BY failure_id ORDER BY i.ts DESC) = 1",
    "outcome": "SELECT i.family, (f.failure_id IS NOT NULL)::INT AS hit FROM seen i LEFT JOIN failed f ON i.component_id = f.component_id AND i.family = f.family AND date_diff('day', i.ts, f.failed::TIMESTAMP) BETWEEN 0 AND 30 WHERE defect = 1 QUALIFY row_number() OVER (PARTITION BY inspection_id ORDER BY f.failed, f.failure_id) = 1",
    "chain": "SELECT l.family, (alert_id IS NOT NULL)::INT AS chained, date_diff('hour', found, a.ts) AS to_alert, date_diff('hour', a.ts, failed::TIMESTAMP) AS to_failure FROM linked l LEFT JOIN (SELECT * FROM alerts WHERE early = 1) a ON a.component_id = l.component_id AND a.ts BETWEEN found AND failed::TIMESTAMP QUALIFY row_number() OVER (PARTITION BY failure_id ORDER BY a.ts, alert_id) = 1",
    "follow": "SELECT i.family, (m.maintenance_id IS NOT NULL)::INT AS followed FROM seen i LEFT JOIN maintenance m ON m.component_id = i.component_id AND date_diff('day', i.ts, m.ts) BETWEEN 0 AND 14 WHERE defect = 1 AND i.severity IN ('high', 'critical') QUALIFY row_number() OVER (PARTITION BY inspection_id ORDER BY m.ts, m.maintenance_id) = 1",
    "famkpi": """SELECT family, coalesce(monitored, 0)::BIGINT AS monitored, coalesce(inspected, 0)::BIGINT AS inspected, coalesce(inspections, 0)::BIGINT AS inspections, coalesce(detections, 0)::BIGINT AS detections, coalesce(failures, 0)::BIGINT AS failures, coalesce(foreseen, 0)::BIGINT AS foreseen, coalesce(confirmed, 0)::BIGINT AS confirmed, coalesce(detected, 0)::BIGINT AS detected,
        coverage, detection_rate, foreseen_rate, 1 - hit_rate AS false_alert_rate, coverage * foreseen_rate * coalesce(confidence_before, 0) * hit_rate AS detection_value, coalesce(consistency, 0) AS consistency, coalesce(chain_rate, 0) AS chain_rate, coalesce(follow_rate, 0) AS follow_rate, coalesce(lead_days, 0) AS lead_days, coalesce(to_alert_h, 0) AS to_alert_h, coalesce(to_failure_h, 0) AS to_failure_h
        FROM (SELECT *, coalesce(inspected / nullif(monitored, 0), 0) AS coverage, coalesce(detections / nullif(inspections, 0), 0) AS detection_rate, coalesce(foreseen / nullif(failures, 0), 0) AS foreseen_rate, coalesce(confirmed / nullif(detected, 0), 0) AS hit_rate FROM (VALUES ('wheel'), ('brake'), ('bogie'), ('pantograph')) g(family)
        LEFT JOIN (SELECT technical AS family, count(DISTINCT component_id) AS monitored FROM tech GROUP BY 1) USING (family) LEFT JOIN (SELECT family, count(DISTINCT component_id) AS inspected, count(DISTINCT inspection_id) AS inspections, sum(defect) AS detections, avg(consistent) AS consistency FROM seen GROUP BY 1) USING (family)
        LEFT JOIN (SELECT family, count(DISTINCT failure_id) AS failures FROM failed GROUP BY 1) USING (family) LEFT JOIN (SELECT family, count(*) AS foreseen, avg(lead) AS lead_days, avg(confidence) AS confidence_before FROM linked GROUP BY 1) USING (family) LEFT JOIN (SELECT family, sum(hit) AS confirmed, count(*) AS detected FROM outcome GROUP BY 1) USING (family)
        LEFT JOIN (SELECT family, avg(chained) AS chain_rate, avg(to_alert) AS to_alert_h, avg(to_failure) AS to_failure_h FROM chain GROUP BY 1) USING (family) LEFT JOIN (SELECT family, avg(followed) AS follow_rate FROM follow GROUP BY 1) USING (family))""",
    "cbvalue": """SELECT *, CASE WHEN early_alerts > 0 THEN attended / early_alerts ELSE 0 END AS attention_rate, service_cost - cost AS net_value FROM (SELECT count(*) FILTER (early = 1) AS early_alerts, count(*) FILTER (early = 1 AND attended = 1) AS attended, count(*) FILTER (early = 1 AND origin = 'sensor')::DOUBLE * 0.18 AS avoidable_corrective FROM alerts)
        CROSS JOIN (SELECT count(*) AS interventions, sum(hours) AS hours, sum(cost) AS cost FROM maintenance WHERE condition_based = 1) CROSS JOIN (SELECT sum(unavailable_h) * 0.12 AS avoidable_hours, sum(cancellations)::DOUBLE * 95 AS service_cost FROM service)""",
    # features
    "blday": "SELECT day, unit_id, component_id, max(age_days) AS age_days, max(risk) AS order_risk, ['low', 'medium', 'high', 'critical'][max(list_position(['low', 'medium', 'high', 'critical'], severity))] AS severity FROM backlog GROUP BY 1, 2, 3",
    "q": "SELECT quantile_cont(sensor_std, 0.35) AS std35, quantile_cont(sensor_std, 0.75) AS std75, quantile_cont(sensor_std, 0.95) AS std95, quantile_cont(rolling_abs_change, 0.95) AS change95, quantile_cont(stress, 0.95) AS stress95, quantile_cont(ambient, 0.5) AS ambient50 FROM mart",
    "shocks": """SELECT *, (coalesce(sensor_std >= std95, false) OR coalesce(stress > 1.25, false) OR critical_alerts >= 2 OR shock = 1)::INT AS anomaly FROM (SELECT *, (residual / greatest(coalesce(nullif(coalesce(rolling_std, sensor_std), 0), greatest(coalesce(std35, 0), 0.05)), 0.05) >= 2.9 AND residual >= std75 * 0.6)::INT AS shock FROM (SELECT *, coalesce(sensor_max - rolling_mean, 0) AS residual FROM mart CROSS JOIN q))""",
    "since": """SELECT s.*, date_diff('day', m.day, s.day) AS days_since_maintenance, date_diff('day', f.day, s.day) AS days_since_failure FROM shocks s ASOF LEFT JOIN (SELECT DISTINCT component_id, day FROM maintenance) m ON m.component_id = s.component_id AND m.day <= s.day ASOF LEFT JOIN (SELECT DISTINCT component_id, day FROM failures) f ON f.component_id = s.component_id AND f.day <= s.day""",
    "feat0": f"""SELECT s.*, (sum(anomaly) OVER w30)::BIGINT AS anomalies_30, (sum(shock) OVER w30)::BIGINT AS shocks_30, max(defect_score) OVER w14 AS defect_recent, avg(inspection_confidence) OVER w14 AS confidence_recent,
        {clip("abs(ambient - ambient50) / 18 + abs(humidity - 50) / 55 + coalesce(intensity, 1) * 0.65 + coalesce(congestion, 0.4) * 0.9", 0, 4.5)} AS environment, (coalesce(age_days, 0) >= 25 OR coalesce(order_risk >= (SELECT coalesce(quantile_cont(risk, 0.8), 40) FROM backlog), false) OR coalesce(b.severity, 'low') IN ('high', 'critical'))::INT AS exposed
        FROM since s LEFT JOIN blday b ON (b.day, b.unit_id, b.component_id) = (s.day, s.unit_id, s.component_id) WINDOW w30 AS (PARTITION BY s.component_id ORDER BY s.day ROWS 29 PRECEDING), w14 AS (PARTITION BY s.component_id ORDER BY s.day ROWS 13 PRECEDING)""",
    "feat1": f"""SELECT *, {clip(f"2.10 * {clip('coalesce(sensor_std, 0) / greatest(coalesce(std95, 0), 1)', 0, 2.5)} + 1.35 * {clip('coalesce(rolling_abs_change, 0) / greatest(coalesce(change95, 0), 1)', 0, 2.5)} + 1.05 * {clip('shocks_30 / 30', 0, 1)} + 0.95 * {clip('coalesce(stress, 0) / greatest(coalesce(stress95, 0), 1)', 0, 2)} + 1.25 * deterioration / 100", 0, 10)} AS velocity,
        {clip(f"100 * (0.65 * exp(-coalesce(days_since_maintenance, 3650) / 180) + 0.35 * {clip('maintenance_180 / 6', 0, 1)})", 0, 100)} AS restoration FROM feat0""",
    "feat": f"""SELECT *, 100 - health_index AS deterioration_index FROM (SELECT *, {clip(f"coalesce(health, 55) * 0.52 + {clip('100 - velocity * 10', 0, 100)} * 0.18 + {clip('100 - coalesce(defect_recent, 0)', 0, 100)} * 0.12 + restoration * 0.10 - critical_alerts::DOUBLE * 0.65 - exposed * 2 + 14", 1, 100)} AS health_index FROM feat1)""",
    "uq": "SELECT quantile_cont(hours_lost_30, 0.95) AS lost95, quantile_cont(cancellations::DOUBLE, 0.95) AS cancel95, quantile_cont(punctuality_hit, 0.95) AS late95, quantile_cont(service_exposure, 0.85) AS exposure85 FROM ufeat0",
    "ufeat0": f"""SELECT *, {clip("substitution * 45 + service_exposure / 2.2 + CASE WHEN regexp_matches(configuration, '6_cars|5_cars') THEN 16 ELSE 8 END", 0, 100)} AS substitution_difficulty, sum(unavailable_h) OVER (PARTITION BY unit_id ORDER BY day ROWS 29 PRECEDING) AS hours_lost_30 FROM (SELECT u.*, configuration, mean_health_index, risk_components, alert_density, mean_criticality,
        {clip("coalesce(maintenance_hours, 0) * 0.65 + backlog_items::DOUBLE * 0.30 + overdue_items::DOUBLE * 0.60 + critical_items::DOUBLE + exposure * 0.12", 0, 100)} AS maintenance_load, {clip("planned_h * (1 + cancellations::DOUBLE * 0.15) * (1 + service_criticality / 10)", 0, 80)} AS service_exposure
        FROM unitday u LEFT JOIN (SELECT day, unit_id, avg(health_index) AS mean_health_index, count(*) FILTER (health_index < 55) AS risk_components, avg(alert_days_30) AS alert_density, avg(criticality) AS mean_criticality FROM feat GROUP BY ALL) f ON f.day = u.day AND f.unit_id = u.unit_id JOIN (SELECT unit_id AS x, configuration, service_criticality FROM units) ON x = u.unit_id)""",
    "ufeat": f"""SELECT u.*, fleet_size, line_units, {clip(f"({clip('coalesce(hours_lost_30, 0) / greatest(lost95, 1)', 0, 1.4)} * 0.52 + {clip('cancellations / greatest(cancel95, 1)', 0, 1.4)} * 0.28 + {clip('punctuality_hit / greatest(late95, 1)', 0, 1.4)} * 0.20) * 100", 0, 100)} AS service_impact, (fleet_size <= 22 OR line_units <= 5 OR service_exposure >= exposure85)::INT AS fleet_dependency
        FROM ufeat0 u CROSS JOIN uq LEFT JOIN (SELECT fleet_id, count(DISTINCT unit_id) AS fleet_size FROM unitday GROUP BY 1) USING (fleet_id) LEFT JOIN (SELECT day, line_id, count(DISTINCT unit_id) AS line_units FROM unitday GROUP BY 1, 2) USING (day, line_id)""",
    # scores of the last day
    "nowc": "SELECT f.*, " + family("kind", "wheel brake pantograph bogie", "bogie") + " AS family, u.risk, u.service_impact, u.fleet_dependency, u.service_exposure FROM feat f LEFT JOIN (SELECT * FROM ufeat WHERE day = (SELECT max(day) FROM feat)) u ON u.unit_id = f.unit_id WHERE f.day = (SELECT max(day) FROM feat)",
    "rawrisk": "SELECT *, " + clip(f"coalesce(health_index, 60) * 0.58 + {clip('100 - deterioration_index', 0, 100)} * 0.17 + {clip('100 - velocity * 10', 0, 100)} * 0.12 + {clip('100 - coalesce(defect_recent, 0)', 0, 100)} * 0.07 + restoration * 0.10 - exposed * 2", 5, 100) + " AS health_score, round(" + clip(" + ".join(f"{w} * {unit(c)}" for c, w in (("deterioration_index", 0.45), ("velocity", 0.22), ("stress", 0.12), ("anomalies_30", 0.08), ("shocks_30", 0.05), ("exposed", 0.05), ("repeated", 0.03), ("restoration", -0.10))), 0, 1) + ", 9) AS raw FROM nowc",
    "scored": "SELECT *, " + clip("0.03 + 0.88 * pow(0.60 * (rank() OVER (PARTITION BY family ORDER BY raw) + (count(*) OVER (PARTITION BY family, raw) - 1) / 2) / count(*) OVER (PARTITION BY family) + 0.40 * (rank() OVER (ORDER BY raw) + (count(*) OVER (PARTITION BY raw) - 1) / 2) / count(*) OVER (), 1.55)", 0.02, 0.95) + " AS failure_risk FROM rawrisk",
    "uscore": "SELECT *, " + clip("mean_risk * 100 * 0.30 + p90_risk * 100 * 0.22 + coalesce(risk, 0) * 100 * 0.18 + coalesce(service_impact, 0) * 0.12 + mean_deterioration * 0.08 + high_risk / component_count * 100 * 0.10 + coalesce(fleet_dependency, 0) * 3", 0, 100) + " AS unit_score FROM (SELECT unit_id, avg(failure_risk) AS mean_risk, quantile_cont(failure_risk, 0.9) AS p90_risk, count(*) FILTER (failure_risk >= 0.65) AS high_risk, count(*) AS component_count, avg(deterioration_index) AS mean_deterioration, avg(risk) AS risk, avg(service_impact) AS service_impact, max(fleet_dependency) AS fleet_dependency FROM scored GROUP BY 1)",
    "past": "SELECT f.component_id, f.day, f.deterioration_index, coalesce(date_diff('day', f.day, x.day) BETWEEN 0 AND 30, false)::INT AS fails FROM feat f ASOF LEFT JOIN (SELECT DISTINCT component_id, day FROM failures) x ON x.component_id = f.component_id AND x.day >= f.day",
    "labelled": "SELECT component_id, round(deterioration_index / 100, 9) AS score, EXISTS (SELECT 1 FROM failures x WHERE x.component_id = f.component_id AND x.day > f.day AND x.day <= f.day + 7)::INT AS y FROM feat f WHERE day = (SELECT max(day) - 7 FROM ev)",
}

CTES["reviews"] = "SELECT o_orderkey AS review_id, o_custkey AS component_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'escalated' END AS approval_status, 'reviewer_' || substr(o_orderpriority, 1, 1) AS reviewer_id, ((SELECT max(day) FROM ev) + 1)::TIMESTAMP + to_hours(o_orderkey % 660) AS reviewed_at FROM orders"
HORIZON = 7  # as in the catalogue: days in which a failure counts


def _by_day(sql: str) -> str:
    """Scores of the last day, made over every cut day by itself."""
    for old, new in (("OVER ()", "OVER (PARTITION BY day)"), ("PARTITION BY family", "PARTITION BY day, family"), ("OVER (ORDER BY raw)", "OVER (PARTITION BY day ORDER BY raw)"), ("OVER (PARTITION BY raw)", "OVER (PARTITION BY day, raw)"), ("FROM nowc", "FROM cutrows"), ("FROM rawrisk", "FROM cutraw")):
        sql = sql.replace(old, new)
    return sql


# validation: scores at the last mature day of each week, and a calibrator of the cuts that had matured by then
CTES["cutrows"] = f"SELECT f.*, {family('kind', 'wheel brake pantograph bogie', 'bogie')} AS family FROM feat f WHERE day IN (SELECT max(day) FROM feat WHERE day <= (SELECT max(day) - {HORIZON} FROM ev) GROUP BY date_trunc('week', day))"
CTES["cutraw"], CTES["cutscored"] = _by_day(CTES["rawrisk"]), _by_day(CTES["scored"])
CTES["validation"] = f"SELECT day AS cut, component_id, family, round(failure_risk, 9) AS score, EXISTS (SELECT 1 FROM failures x WHERE x.component_id = s.component_id AND x.day > s.day AND x.day <= s.day + {HORIZON})::INT AS y FROM cutscored s"
_TENTHS = ", ".join(str(i / 10) for i in range(11))
CTES["trained"] = f"SELECT c.judged, v.score, v.y FROM (SELECT DISTINCT cut AS judged FROM validation) c JOIN validation v ON date_diff('day', v.cut, c.judged) >= {HORIZON}"
CTES["markers"] = f"SELECT judged, e[2:len(e) - 1] AS inner_ FROM (SELECT judged, list_sort(list_distinct(quantile_cont(score, [{_TENTHS}]))) AS e, count(*) AS n, sum(y) AS events FROM trained GROUP BY 1) WHERE n >= 50 AND events >= 5 AND len(e) >= 4"
CTES["rates"] = "SELECT judged, bin, max(coalesce(rate, 0.5)) OVER (PARTITION BY judged ORDER BY bin) AS p FROM (SELECT judged, unnest(range(len(inner_) + 1)) AS bin FROM markers) g LEFT JOIN (SELECT judged, len(list_filter(inner_, lambda e: score >= e)) AS bin, (sum(y) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS rate FROM trained JOIN markers USING (judged) GROUP BY 1, 2) USING (judged, bin)"
CTES["calibrated"] = "SELECT v.*, p, CASE WHEN p IS NULL THEN 'insufficient_history' ELSE 'rolling' END AS status FROM validation v LEFT JOIN markers m ON m.judged = v.cut LEFT JOIN rates r ON r.judged = v.cut AND r.bin = len(list_filter(inner_, lambda e: score >= e))"
CTES["folded"] = "SELECT *, cut::VARCHAR AS fold FROM calibrated UNION ALL SELECT *, 'overall' FROM calibrated"
CTES["foldplaces"] = "SELECT *, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS hits, count(*) OVER (PARTITION BY fold) AS total, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS r FROM folded WINDOW w AS (PARTITION BY fold ORDER BY score DESC, cut, component_id)"
CTES["folderrors"] = "SELECT fold, sum(n * abs(o - e)) / sum(n) AS calibration_error FROM (SELECT fold, b, count(*) AS n, avg(y) AS o, avg(p) AS e FROM folded JOIN range(10) t(b) ON (p > b / 10 OR (b = 0 AND p = 0)) AND p <= (b + 1) / 10 GROUP BY 1, 2) GROUP BY 1"
CTES["foldmetrics"] = """SELECT f.*, calibration_error FROM (SELECT fold, count(*) AS "rows", sum(y)::BIGINT AS failures, avg(y) AS prevalence, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS roc_auc,
    CASE WHEN sum(y) > 0 THEN sum(hits / k) FILTER (y = 1) / sum(y) END AS average_precision, CASE WHEN sum(y) > 0 THEN avg(y) FILTER (k <= greatest(1, ceil(total * 0.10))) / avg(y) END AS top_decile_lift, avg((score - y) ** 2) AS raw_brier, count(p) AS calibrated_rows, avg((p - y) ** 2) AS calibrated_brier
    FROM foldplaces GROUP BY 1) f LEFT JOIN folderrors USING (fold)"""



def with_ctes(body: str) -> str:
    """The body under the expressions that it needs, in their order."""
    names = re.compile(r"\b(" + "|".join(CTES) + r")\b")
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in {*names.findall(re.sub(r"'[^']*'", "", text))} - need:
            need.add(name)
            visit(CTES[name])

    visit(body)
    order: list[str] = []

    def place(name: str) -> None:
        if name not in order:
            for other in {*names.findall(re.sub(r"'[^']*'", "", CTES[name]))} - {name}:
                if other in need:
                    place(other)
            order.append(name)

    for name in CTES:
        if name in need:
            place(name)
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]})" for n in order) + "\n" + body if order else body
