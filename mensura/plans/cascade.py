"""Quantities, statuses, reasons and alternatives of bill items beside the drawing items of their part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators import cascade as C
from mensura.operators import quality as Q
from mensura.operators import versions as R
from mensura.plans.records import NAME
from mensura.plans.registry import register, rounded
from mensura.plans.scalar import ORIENT, SANITY, WORDS
from mensura.sources.adapters import ORDINAL

KEYS = ", ".join(ORDINAL)
#: Each drawing item is a match of the bill line of its part; one in 25 is none.
SAID = "description || CASE row_index % 5 WHEN 0 THEN ' sala' WHEN 1 THEN ' h=2,8' WHEN 2 THEN ' cocina' ELSE '' END"
CALC = "CASE WHEN l_suppkey % 10 = 3 THEN 'COUNT' WHEN unit = 'm2' THEN 'AREA' WHEN unit = 'ml' THEN 'LENGTH' WHEN unit = 'un' THEN 'COUNT' WHEN unit = 'm3' THEN 'VOLUME' ELSE 'GLOBAL' END"
KIND = "CASE WHEN unit = 'm2' THEN 'area' WHEN unit = 'ml' THEN 'length' WHEN unit = 'un' THEN 'count' WHEN unit = 'm3' THEN 'volume' ELSE 'other' END"
ZONE = "CASE l_suppkey % 4 WHEN 0 THEN 'Sala' WHEN 1 THEN 'Cocina' ELSE '' END"
FIELDS = [
    *ORDINAL, "row_index", f"{SAID} AS description", "unit", "b.qty AS bill_qty", f"{CALC} AS calc", f"{KIND} AS measure", "'unit' AS calc_reason", "0.2 + l_suppkey % 9 * 0.1 AS confidence",
    "CASE WHEN l_suppkey % 25 <> 0 THEN type END AS match_type", "CASE WHEN l_partkey % 8 = 0 THEN value_si / 1000 ELSE value_si END AS value_si", "CASE WHEN l_partkey % 3 = 0 THEN 1.5 END AS block_area", f"{NAME} AS name_raw", "i.layer", "total_area", "total_length",
]
ROWS = f"""p AS (SELECT layer, coalesce(sum(value_si) FILTER (type = 'area' AND l_suppkey % 3 = 0), 0.0) AS total_area, coalesce(sum(value_si) FILTER (type = 'length' AND l_suppkey % 3 = 1), 0.0) AS total_length FROM cad_items GROUP BY layer),
z AS (SELECT upper({ZONE}) AS zone_key, max(value_si) AS zone_area FROM cad_items WHERE type = 'area' AND {ZONE} <> '' AND value_si > 0 GROUP BY 1),
m AS (SELECT {', '.join(FIELDS)} FROM cad_items i JOIN bill_items b ON row_index = l_partkey JOIN p ON p.layer = i.layer),
r AS (SELECT m.*, zone_area, lower(m.description) AS text, coalesce({ORIENT.replace('description', 'm.description')}, 'unknown') AS turned, CASE WHEN row_index % 5 = 1 THEN 2.8 ELSE 2.4 END AS hh FROM m LEFT JOIN z ON zone_key = CASE row_index % 5 WHEN 0 THEN 'SALA' WHEN 2 THEN 'COCINA' END)"""
_TRUSTED = f"(regexp_matches(name_raw, '{R.TRUSTED_BLOCKS}') OR regexp_matches(name_raw, '{R.TRUSTED_CODES}'))"
TRUST = f"confidence * CASE WHEN regexp_matches(name_raw, '{R.GENERIC_BLOCKS}') THEN 0 WHEN lower(trim(layer)) IN ({', '.join(repr(x) for x in R.UNTRUSTED_LAYERS)}) AND NOT {_TRUSTED} THEN 0.2 ELSE 1 END"
WALL, LEVEL = WORDS("text", C.WALL_WORDS), WORDS("text", C.LEVEL_WORDS)
COUNTED = "CASE WHEN value_si <> 0 THEN value_si ELSE 1.0 END"
AREA_LENGTH = "calc = 'AREA' AND match_type = 'length'"
AREA_OTHER = "calc = 'AREA' AND match_type IN ('block', 'text')"
#: (condition, qty, method, evidence, confidence, height) as SQL, in order.
BRANCHES = [
    ("match_type IS NULL", "bill_qty", "NULL", "'none'", "confidence", "NULL"), ("calc = 'COUNT' AND match_type = 'length'", "1.0", "NULL", "'length'", "0.2", "NULL"),
    ("calc = 'COUNT' AND unit IN ('un', 'gl') AND match_type <> 'block'", "0.0", "NULL", "match_type", "0.3", "NULL"),
    ("calc = 'COUNT' AND match_type = 'block' AND block_area > 0 AND unit = 'm2'", f"{COUNTED} * block_area", "'block_area_times_count'", "'block'", TRUST, "NULL"),
    ("calc = 'COUNT' AND match_type = 'block'", COUNTED, "NULL", "'block'", TRUST, "NULL"), ("calc = 'COUNT'", "0.0", "NULL", "match_type", "confidence", "NULL"), ("calc = 'LENGTH'", "value_si", "NULL", "'length'", "confidence", "NULL"),
    (f"{AREA_LENGTH} AND value_si > 0 AND turned = 'vertical'", "value_si * hh", "'length_x_height'", "'length'", "confidence", "hh"), (f"{AREA_LENGTH} AND turned = 'horizontal' AND total_area > 0", "total_area", "'profile_area_horizontal'", "'area'", "confidence", "NULL"),
    (f"{AREA_LENGTH} AND turned = 'horizontal'", "0.0", "NULL", "'none'", "confidence", "NULL"), (f"{AREA_LENGTH} AND {LEVEL}", "0.0", "'fallback_blocked_3d_horizontal'", "'none'", "confidence", "NULL"),
    (AREA_LENGTH, "value_si * 2.4", "'length_x_height_default'", "'length'", "confidence", "2.4"), ("calc = 'AREA' AND match_type = 'area'", "value_si", "'direct_area'", "'area'", "confidence", "NULL"),
    (f"{AREA_OTHER} AND total_area > 0", "total_area", "'profile_area_from_block_layer'", "'area'", "confidence", "NULL"), (f"{AREA_OTHER} AND total_length > 0 AND {WALL}", "total_length * 2.4", "'profile_length_x_height_from_block_layer'", "'length'", "confidence", "2.4"),
    (AREA_OTHER, "NULL", "'invalid_type_for_area'", "match_type", "confidence", "NULL"), ("calc = 'VOLUME'", "value_si * CASE WHEN match_type = 'length' THEN 2.4 ELSE 1 END * 0.1", "NULL", "'none'", "confidence", "NULL"), ("TRUE", "value_si", "NULL", "'none'", "confidence", "NULL"),
]
_COLUMN = lambda k: "CASE " + " ".join(f"WHEN {b[0]} THEN {b[k]}" for b in BRANCHES) + " END"
CASCADE = f"""{ROWS}, b0 AS (SELECT *, CAST({_COLUMN(1)} AS DOUBLE) AS q0, CAST({_COLUMN(2)} AS VARCHAR) AS m0, CAST({_COLUMN(3)} AS VARCHAR) AS e0, CAST({_COLUMN(4)} AS DOUBLE) AS c0, CAST({_COLUMN(5)} AS DOUBLE) AS height FROM r),
b1 AS (SELECT *, calc = 'AREA' AND coalesce(q0, 0) <= 0.1 AND zone_area > 0 AS zoned, m0 IS NULL AND match_type IS NOT NULL AND calc IN ('AREA', 'LENGTH', 'COUNT') AS bare FROM b0),
b2 AS (SELECT * EXCLUDE (confidence), CASE WHEN zoned THEN zone_area ELSE q0 END AS q1, CASE WHEN zoned THEN 'spatial_zone_area' WHEN bare THEN CASE calc WHEN 'AREA' THEN 'direct_area' WHEN 'LENGTH' THEN 'direct_length' ELSE 'count_blocks' END ELSE m0 END AS method,
  CASE WHEN zoned THEN 'area' WHEN bare THEN CASE calc WHEN 'AREA' THEN 'area' WHEN 'LENGTH' THEN 'length' ELSE 'block' END ELSE e0 END AS evidence, CASE WHEN zoned THEN 0.95 ELSE c0 END AS c1 FROM b1),
b3 AS (SELECT *, unit IN ('un', 'gl') AND evidence <> 'block' AS blocked FROM b2), b4 AS (SELECT *, CASE WHEN blocked THEN 0.0 ELSE q1 END AS qty, CASE WHEN blocked THEN least(c1, 0.3) ELSE c1 END AS c2 FROM b3),
b5 AS (SELECT *, unit = 'm2' AND {WORDS('text', C.SMALL_WORDS)} AND qty > 0 AND qty < 5 AND coalesce(contains(method, 'profile_area'), false) AS small, {SANITY.replace('kind', 'measure').replace(' q ', ' qty ').replace('(q ', '(qty ').replace('floor(q)', 'floor(qty)')} AS severity FROM b4),
f AS (SELECT *, CASE WHEN severity = 'error' THEN least(c2, 0.3) WHEN small THEN least(c2, 0.5) ELSE c2 END AS confidence FROM b5)"""


def _rows(items: DataFrame, bill: DataFrame) -> DataFrame:
    some = lambda kind, k: F.coalesce(F.sum(F.when((F.col("type") == kind) & (F.col("l_suppkey") % 3 == k), F.col("value_si"))), F.lit(0.0))
    profiles = items.groupBy("layer").agg(some("area", 0).alias("total_area"), some("length", 1).alias("total_length"))
    registry = C.zone_registry(items.withColumn("zone", F.expr(ZONE)))
    own = items.alias("i").join(bill.alias("b"), F.col("l_partkey") == F.col("row_index")).join(profiles.withColumnRenamed("layer", "_l"), F.col("i.layer") == F.col("_l"))
    return C.with_zone_area(own.selectExpr(*FIELDS), registry)


@register("qty3_quantities", f"WITH {CASCADE} SELECT {KEYS}, round(qty, 6) AS qty, method, evidence, round(confidence, 6) AS confidence, height FROM f", "cad_items", "bill_items")
def _(items, bill):
    return rounded(C.quantities(_rows(items, bill)).select(*ORDINAL, "qty", "method", "evidence", "confidence", "height"), "qty", "confidence")


EXPECTED = "CASE calc WHEN 'COUNT' THEN 'BLOCK' ELSE calc END"
STATUS = f"""CASE WHEN match_type IS NULL THEN CASE calc WHEN 'AREA' THEN 'pending_needs_layer_pick' WHEN 'GLOBAL' THEN 'pending_semantics' ELSE 'pending_no_match' END WHEN {AREA_LENGTH} AND coalesce(height, 0) IN (0, 2.4) THEN 'pending_needs_height'
  WHEN coalesce(qty, 0) = 0 THEN CASE calc WHEN 'AREA' THEN 'pending_needs_layer_pick' ELSE 'pending_no_geometry' END WHEN calc IN ('AREA', 'LENGTH', 'COUNT') AND NOT (upper(match_type) = {EXPECTED} OR {AREA_LENGTH}) THEN 'pending_semantics'
  WHEN confidence >= 0.7 THEN 'approved' WHEN confidence >= 0.4 THEN 'pending' ELSE 'pending_semantics' END"""
PERCENT = "' (' || CAST(floor(round(confidence * 100, 9) + 0.5) AS BIGINT) || '%)'"


@register("qty12_status_reasons", f"""WITH {CASCADE}, s AS (SELECT *, {STATUS} AS status FROM f)
SELECT {KEYS}, status, CASE status WHEN 'approved' THEN 'High confidence match' || {PERCENT} WHEN 'pending' THEN 'Medium confidence - review recommended' || {PERCENT} WHEN 'pending_no_geometry' THEN 'No geometry found or quantity is zero' WHEN 'pending_no_match' THEN 'No matching CAD items found'
  WHEN 'pending_semantics' THEN 'Type or semantic mismatch - unit' WHEN 'pending_needs_layer_pick' THEN 'No suitable area layers found - please select a layer manually' ELSE 'Wall/surface requires height to calculate m² - please configure height or approve default (2.4m)' END AS status_reason FROM s""", "cad_items", "bill_items")
def _(items, bill):
    return C.statuses(C.quantities(_rows(items, bill))).select(*ORDINAL, "status", "status_reason")


FITS = f"upper(type) = {EXPECTED} OR calc = 'AREA' AND type = 'length'"


@register("qty13_suggestions", f"""WITH c AS (SELECT row_index, {CALC} AS calc, type, layer, name_raw, value_si, l_suppkey % 11 * 0.1 AS score FROM cad_items JOIN bill_items ON row_index = l_partkey),
d AS (SELECT *, {EXPECTED} AS expected FROM c), t AS (SELECT row_index, layer, name_raw, type, value_si, calc, expected, max(score) AS score FROM d GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY score DESC, layer, name_raw, type, calc, value_si) AS rn FROM t),
u AS (SELECT row_index, rn, 'Use "' || name_raw || '" from layer "' || layer || '"' AS label, CASE WHEN score > 0.6 THEN 'high' WHEN score > 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM o WHERE rn <= 3
  UNION ALL SELECT row_index, 4, 'Enter quantity manually', 'medium' FROM o GROUP BY row_index HAVING max(score) < 0.3), v AS (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY rn) AS k FROM u)
SELECT row_index, string_agg(label || ':' || confidence, ';' ORDER BY k) AS suggestions FROM v WHERE k <= 3 GROUP BY row_index""", "cad_items", "bill_items")
def _(items, bill):
    # A decimal 0.1, as in the SQL: 3 and 6 times the double are above the thresholds 0.3 and 0.6.
    own = items.join(bill, F.col("l_partkey") == F.col("row_index")).select("row_index", F.expr(CALC).alias("calc"), F.col("type").alias("match_type"), "layer", "name_raw", "value_si", F.expr("CAST(l_suppkey % 11 * 0.1 AS DOUBLE)").alias("score"))
    own = own.groupBy("row_index", "layer", "name_raw", "match_type", "value_si", "calc").agg(F.max("score").alias("score")).withColumns({"expected": F.expr(EXPECTED), "unit_raw": F.lit("m")})
    found = C.suggestions(own)
    return found.select("row_index", F.array_join(F.transform("suggestions", lambda s: F.concat(s["label"], F.lit(":"), s["confidence"])), ";").alias("suggestions"))


@register("qty10_gate_suggestions", """WITH g AS (SELECT id, unnest(list_filter([CASE WHEN match_confidence < 0.4 THEN 1 END, CASE WHEN id % 3 = 0 THEN 2 END, CASE WHEN qty_final = 0 THEN 3 END, CASE WHEN qty_final > 1000 THEN 4 END, CASE WHEN id % 13 = 0 THEN 5 END], lambda x: x IS NOT NULL)) AS k FROM staging_rows)
SELECT id, list_extract(['quality_low_confidence', 'quality_type_mismatch', 'quality_zero_quantity', 'quality_outlier', 'quality_layer_zero'], k) AS gate, 'REVIEW_QUALITY' AS action,
  list_extract(['Review: low_confidence', 'Select a layer with the expected geometry type', 'Review: zero_quantity', 'Verify the quantity', 'Select a named layer'], k) AS label, list_extract(['medium', 'high', 'high', 'medium', 'medium'], k) AS confidence FROM g""", "staging_rows")
def _(s):
    failed = Q.gates(F.col("match_confidence"), F.col("id") % 3 != 0, F.col("qty_final"), F.when(F.col("id") % 13 == 0, "0").otherwise("a"), F.when(F.col("qty_final") > 1000, "error").otherwise("ok"))
    return s.select(F.col("id").alias("_id"), F.inline(C.gate_suggestions(failed))).toDF("id", "gate", "action", "label", "confidence")
