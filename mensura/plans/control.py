"""Validation rules over staging rows, and the phases of jobs as a stream of events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators.graph import shared_folder
from mensura.operators.rules import RuleSet
from mensura.plans.registry import QUERIES, SQL, register
from mensura.sources.adapters import read_stream

ROWS = "r AS (SELECT s.*, description, unit FROM staging_rows s JOIN bill_items b ON b.row_index = s.id)"
PEERS = "w AS (SELECT DISTINCT lower(string_split(description, ' ')[1]) AS w FROM r), p AS (SELECT w, count(*) AS peers, sum(unit_price_ref) / count(*) AS peer_price FROM w JOIN r ON contains(lower(description), w) AND unit_price_ref <> 0 GROUP BY w), c AS (SELECT r.*, coalesce(peers, 0) AS peers, peer_price FROM r LEFT JOIN p ON w = lower(string_split(description, ' ')[1]))"
FOUND = """SELECT id, 'quantity_sanity' AS rule, 'warning' AS severity, 'Cantidad inusualmente alta (>10,000 unidades)' AS message FROM c WHERE qty_final > 10000 AND unit = 'un'
UNION ALL SELECT id, 'price_outlier', 'warning', 'Precio 3x superior al promedio (' || CAST(floor(peer_price + 0.5) AS BIGINT) || ' CLP)' FROM c WHERE unit_price_ref <> 0 AND peers >= 2 AND unit_price_ref > peer_price * 3
UNION ALL SELECT id, 'unit_consistency', 'error', 'Falta factor de altura para conversión a m²' FROM c WHERE unit = 'm2' AND height_factor IS NULL
UNION ALL SELECT id, 'missing_quantity', 'error', 'Cantidad final no puede ser cero' FROM c WHERE qty_final IS NULL
UNION ALL SELECT id, 'low_confidence', 'warning', 'Confianza de matching baja (' || CAST(floor(match_confidence * 100 + 0.5) AS BIGINT) || '%)' FROM c WHERE match_confidence < 0.4 AND n_sources > 0
UNION ALL SELECT id, 'missing_price', 'info', 'Ítem aprobado sin precio de referencia' FROM c WHERE unit_price_ref IS NULL AND status = 'approved'"""


def _rows(s: DataFrame, b: DataFrame) -> DataFrame:
    return s.join(b.select(F.col("row_index").alias("id"), "description", "unit"), "id")


@register("udf1_rule_findings", f"WITH {ROWS}, {PEERS} {FOUND}", "staging_rows", "bill_items")
def _(s, b):
    return RuleSet().validate(_rows(s, b)).select("id", "rule", "severity", "message")


@register("udf4_added_bounds", f"""WITH {ROWS}
SELECT id, 'bounds_m2' AS rule, 'warning' AS severity, 'qty_final fuera de rango (30-800)' AS message, qty_final AS value FROM r WHERE unit = 'm2' AND (qty_final < 30 OR qty_final > 800)
UNION ALL SELECT id, 'bounds_un_muro|puerta', 'error', 'qty_final fuera de rango (1-600)', qty_final FROM r WHERE unit = 'un' AND regexp_matches(lower(description), 'muro|puerta') AND (qty_final < 1 OR qty_final > 600)""", "staging_rows", "bill_items")
def _(s, b):
    rules = RuleSet([]).add_bounds("m2", 30, 800).add_bounds("un", 1, 600, "muro|puerta", "error")
    found = rules.validate(_rows(s, b))
    return found.select("id", "rule", "severity", "message", F.get_json_object("details", "$.value").cast("double").alias("value"))


@register("qty22_custom_rules", f"""WITH {ROWS} SELECT id, 'conf' AS rule, 'info' AS severity, 'match_confidence fuera de rango (0.45-0.95)' AS message FROM r WHERE match_confidence < 0.45 OR match_confidence > 0.95
UNION ALL SELECT id, 'qty', 'error', 'qty_final fuera de rango (100-900)' FROM r WHERE qty_final < 100 OR qty_final > 900""", "staging_rows", "bill_items")
def _(s, b):
    table = [
        ("qty", "range", '{"field": "qty_final", "min": 100, "max": 900}', "error", True), ("conf", "range", '{"field": "match_confidence", "min": 0.45, "max": 0.95}', "info", True),
        ("off", "range", '{"field": "qty_final", "min": 1, "max": 2}', "error", False), ("ratio", "ratio", '{"field": "qty_final"}', "error", True),
    ]
    custom = s.sparkSession.createDataFrame(table, "id string, rule_type string, config string, severity string, enabled boolean")
    return RuleSet([]).validate(_rows(s, b), custom).select("id", "rule", "severity", "message")


KIND = "CASE event_type WHEN 'signup' THEN 'queue' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'touch' END"
LIMIT = timedelta(hours=12)


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are jobs, their events what happens to these; the table is read as a stream."""
    from mensura.streaming.phases import replay

    events = read_stream(spark, sf_dir, "events")
    return replay(events.selectExpr("user_id AS job", f"{KIND} AS kind", "CAST(ts AS TIMESTAMP) AS at"), shared_folder(spark), LIMIT).drop("late")


QUERIES["stm4_job_phases"] = _replay
_US = LIMIT // timedelta(microseconds=1)
SQL["stm4_job_phases"] = f"""WITH RECURSIVE e AS (SELECT user_id AS job, {KIND} AS kind, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, {KIND}) AS rn FROM events),
s AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT) AS rn, 0 AS phase, 'queued' AS status, 0 AS attempts, CAST(0 AS BIGINT) AS locked, 0 AS conflicts, 0 AS retries, 0 AS timeouts, 0 AS steps FROM e
  UNION ALL
  SELECT job, rn, CASE WHEN done AND phase < 3 THEN phase + 1 WHEN again AND status = 'completed' THEN 0 ELSE phase END,
    CASE WHEN starts THEN 'processing' WHEN done THEN CASE WHEN phase = 3 THEN 'completed' ELSE 'queued' END WHEN fails THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END WHEN again THEN 'queued' ELSE status END,
    CASE WHEN starts THEN attempts + 1 WHEN done AND phase < 3 OR again THEN 0 ELSE attempts END, CASE WHEN starts THEN us WHEN done OR fails THEN 0 ELSE locked END,
    conflicts + CASE WHEN kind = 'start' AND status = 'processing' THEN 1 ELSE 0 END, retries + CASE WHEN fails AND attempts < 3 THEN 1 ELSE 0 END, timeouts, steps + CASE WHEN starts OR done OR fails OR again THEN 1 ELSE 0 END
  FROM (SELECT *, kind = 'start' AND status = 'queued' AS starts, kind = 'finish' AND status = 'processing' AS done, kind = 'fail' AND status = 'processing' AS fails, kind = 'queue' AND status IN ('failed', 'completed') AS again
    FROM (SELECT job, rn, kind, us, phase, CASE WHEN NOT old THEN status WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status, attempts, CASE WHEN old THEN 0 ELSE locked END AS locked, conflicts,
        retries + CASE WHEN old AND attempts < 3 THEN 1 ELSE 0 END AS retries, timeouts + CASE WHEN old THEN 1 ELSE 0 END AS timeouts, steps + CASE WHEN old THEN 1 ELSE 0 END AS steps
      FROM (SELECT e.job, e.rn, e.kind, e.us, s.phase, s.status, s.attempts, s.locked, s.conflicts, s.retries, s.timeouts, s.steps, s.status = 'processing' AND e.us > s.locked + {_US} AS old FROM s JOIN e ON e.job = s.job AND e.rn = s.rn + 1)))
), n AS (SELECT job, max(rn) AS rn FROM e GROUP BY job), f AS (SELECT s.*, s.status = 'processing' AND (SELECT max(us) FROM e) > locked + {_US} AS old FROM s JOIN n ON n.job = s.job AND n.rn = s.rn)
SELECT job, list_extract(['CONVERT', 'EXTRACT', 'MAP', 'GENERATE'], phase + 1) AS phase, CASE WHEN NOT old THEN status WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status, attempts, CAST(conflicts AS BIGINT) AS conflicts,
  CAST(retries + CASE WHEN old AND attempts < 3 THEN 1 ELSE 0 END AS BIGINT) AS retries, CAST(timeouts + CASE WHEN old THEN 1 ELSE 0 END AS BIGINT) AS timeouts, CAST(steps + CASE WHEN old THEN 1 ELSE 0 END AS BIGINT) AS steps FROM f"""
