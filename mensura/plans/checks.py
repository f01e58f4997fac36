"""JSON columns with faults, items of the main plan, footprints by layer, versions, regions of both kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import validators as V
from mensura.plans.registry import register, rounded
from mensura.sources.adapters import ORDINAL

KEYS = ", ".join(ORDINAL)
#: One source item for each drawing item: every 7th of some field is wrong, some are no JSON, some null.
ITEM = f"""CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN '{{{{' WHEN l_partkey % 37 = 0 THEN '{{"id": "a"}}' ELSE '[{{"id": ' || CASE WHEN l_suppkey % 7 = 1 THEN '12' ELSE '"i' || CAST(l_partkey AS VARCHAR(20)) || '"' END || ', "type": "' || CASE WHEN l_suppkey % 7 = 2 THEN 'arc' ELSE type END
  || '", "value_m": ' || CASE WHEN l_suppkey % 7 = 3 THEN '-1.5' WHEN l_suppkey % 7 = 4 THEN '"2"' ELSE CAST(l_partkey AS VARCHAR(20)) END || CASE WHEN l_suppkey % 7 = 5 THEN '' ELSE ', "evidence": "e"' END
  || ', "name_raw": "n", "unit_raw": "m", "layer_raw": "l", "value_raw": 1.5, "layer_normalized": ' || CASE WHEN l_suppkey % 7 = 6 THEN 'null' ELSE '"l"' END || '}}]' END""".replace("{{", "{").replace("}}", "}")  # fmt: skip
_FIELD = lambda k, ok: f"CASE WHEN NOT coalesce({ok.format(k=k)}, false) THEN '0.{k}' END"
_STRING, _NUM = "json_type(js, '$[0].{k}') = 'VARCHAR'", "json_type(js, '$[0].{k}') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
_TESTS = {k: {"S": _STRING, "K": _STRING + " AND json_extract_string(js, '$[0].{k}') IN ('block', 'length', 'area', 'text')", "N": _NUM, "+": _NUM + " AND TRY_CAST(json_extract_string(js, '$[0].{k}') AS DOUBLE) >= 0"}[r] for k, r in V.SOURCE_ITEM.items()}
FAULTS = f"CASE WHEN t IS NULL THEN '' WHEN js IS NULL OR json_type(js) <> 'ARRAY' THEN 'json' ELSE concat_ws(',', {', '.join(_FIELD(k, v) for k, v in _TESTS.items())}) END"


@register("flt28_source_items", f"WITH t AS (SELECT {KEYS}, {ITEM} AS t FROM cad_items), j AS (SELECT *, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS js FROM t), f AS (SELECT *, {FAULTS} AS faults FROM j) SELECT {KEYS}, faults = '' AS valid, faults, CASE WHEN faults = '' AND t IS NOT NULL THEN TRY_CAST(json_extract_string(js, '$[0].value_m') AS DOUBLE) END AS value_m FROM f", "cad_items")
def _(items):
    c = items.select(*ORDINAL, V.checked(F.expr(ITEM), V.SOURCE_ITEM).alias("c"))
    return c.select(*ORDINAL, "c.valid", F.array_join("c.faults", ",").alias("faults"), F.get("c.records", 0)["value_m"].alias("value_m"))


PRICE = """CASE WHEN l_partkey % 17 = 0 THEN '[1]' ELSE '{"url": ' || CASE WHEN l_suppkey % 6 = 0 THEN '3' WHEN l_suppkey % 6 = 1 THEN '"no address"' ELSE '"http://s.example/a"' END || ', "price": ' || CASE WHEN l_suppkey % 5 = 0 THEN '"9"' ELSE CAST(l_partkey AS VARCHAR(20)) END || ', "title": "t", "vendor": "v"}' END"""


@register("flt29_price_guards", f"""WITH t AS (SELECT {KEYS}, {PRICE} AS t FROM cad_items), j AS (SELECT *, CAST(t AS JSON) AS js FROM t)
SELECT {KEYS}, json_type(js) = 'OBJECT' AND coalesce(json_type(js, '$.url') = 'VARCHAR', false) AND coalesce(json_type(js, '$.price') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), false) AS is_source, json_type(js) = 'OBJECT' AND coalesce(json_type(js, '$.url') = 'VARCHAR' AND json_extract_string(js, '$.url') LIKE 'http%', false) AND coalesce(json_type(js, '$.price') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), false) AS valid FROM j""", "cad_items")
def _(items):
    t = F.expr(PRICE)
    return items.select(*ORDINAL, V.guarded(t, V.PRICE_GUARD).alias("is_source"), V.guarded(t, V.PRICE_SOURCE).alias("valid"))


@register("flt9_main_plan_items", f"SELECT {KEYS} FROM (SELECT *, CASE WHEN l_partkey % 6 <> 0 THEN x END AS px, CASE WHEN l_partkey % 6 <> 0 THEN y END AS py FROM cad_items) WHERE px IS NULL OR (py BETWEEN 20 AND 70 AND px BETWEEN 10 AND 90)", "cad_items")
def _(items):
    from mensura.operators.takeoff import main_plan_items

    at = items.withColumn("position", F.when(F.col("l_partkey") % 6 != 0, F.struct("x", "y")))
    return main_plan_items(at, (20.0, 70.0), (10.0, 90.0)).select(*ORDINAL)


@register("agg11_footprint_scores", "WITH f AS (SELECT layer, sum(value_si) AS a FROM cad_items WHERE type = 'area' GROUP BY layer), s AS (SELECT layer, least(1.0, a / 2000)::DOUBLE AS score FROM f WHERE a > 300) SELECT DISTINCT c.layer, round(coalesce(score, 0), 6)::DOUBLE AS score, coalesce(score >= 0.3, false) AS good FROM cad_items c LEFT JOIN s ON s.layer = c.layer", "cad_items")
def _(items):
    from mensura.operators.takeoff import footprint_lookup

    found = items.where("type = 'area'").groupBy("layer").agg(F.sum("value_si").alias("a")).where("a > 300").select("layer", F.least(F.lit(1.0), F.col("a") / 2000).alias("score"))
    return rounded(footprint_lookup(items.select("layer").distinct(), found), "score")
