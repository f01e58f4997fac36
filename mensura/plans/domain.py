"""Aggregations, joins, windows and reports over the logical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.functions import units as U
from mensura.operators import matching as M
from mensura.operators import reports as R
from mensura.operators import takeoff as K
from mensura.plans.registry import register, rounded
from mensura.sources.adapters import ORDINAL

ORD = ", ".join(ORDINAL)
AREA = "CASE WHEN (name IN ('Hatch', 'Circle') OR (name IN ('Polyline', 'LwPolyline', 'Region') AND closed)) AND area > 0 THEN area * cnt END"
LENGTH = "CASE WHEN name IN ('Line', 'Polyline', 'LwPolyline', 'Arc', 'Spline', 'Circle') AND length > 0 THEN length * cnt END"
INDEX = f"""SELECT layer, sum(cnt) AS entity_count, coalesce(sum({AREA}), 0.0) AS raw_area, coalesce(sum({LENGTH}), 0.0) AS raw_length,
  coalesce(sum({AREA}), 0.0) AS total_area, coalesce(sum({LENGTH}), 0.0) AS total_length,
  string_agg(DISTINCT name, ',' ORDER BY name) AS entity_types, count({AREA}) > 0 AS has_area, count({LENGTH}) > 0 AS has_length
FROM takeoff_rows GROUP BY layer"""
IDX_OUT = "layer, entity_count, round(raw_area, 6) AS raw_area, round(raw_length, 6) AS raw_length, round(total_area, 6) AS total_area, round(total_length, 6) AS total_length, entity_types, has_area, has_length"
UPPER = lambda c, d: f"floor({c} * {10**d} + 0.5) / {10**d}"
ANNOTATION = r"regexp_matches(lower(layer), '^(dimen|defpoints$|text|cotas?|anno|dim|mv[_-]?text|ejes?|marco|viewport|xref|title|border)')"
NON_MEASURABLE = "(" + " OR ".join(f"contains(lower(layer), '{w}')" for w in U.NON_MEASURABLE) + ")"


@register("agg1_layer_takeoff_index", f"WITH i AS ({INDEX}) SELECT {IDX_OUT} FROM i", "takeoff_rows")
def _(rows):
    return rounded(K.layer_index(rows), "raw_area", "raw_length", "total_area", "total_length")


@register("agg1_color_breakdown", f"SELECT layer, lower(coalesce(nullif(color, ''), 'ByLayer')) AS color, sum(cnt) AS cnt, round(coalesce(sum({AREA}), 0.0), 6) AS area, round(coalesce(sum({LENGTH}), 0.0), 6) AS length FROM takeoff_rows GROUP BY 1, 2", "takeoff_rows")
def _(rows):
    return rounded(K.color_breakdown(rows), "area", "length")


@register("agg2_detect_unit", """WITH v AS (SELECT area * cnt AS v, row_number() OVER (ORDER BY area * cnt) AS rn, count(*) OVER () AS n FROM takeoff_rows WHERE area > 0),
m AS (SELECT max(v) AS median FROM v WHERE rn = floor(n / 2) + 1)
SELECT round(median, 6) AS median, CASE WHEN median > 1000000 THEN 'mm' WHEN median > 1000 THEN 'cm' ELSE 'm' END AS unit,
  CASE WHEN median IS NULL THEN 0.0 WHEN median > 1000000 THEN 0.9 WHEN median > 1000 THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence FROM m""", "takeoff_rows")
def _(rows):
    return K.detect_unit(rows)


@register("agg3_takeoff_summary", f"""WITH i AS ({INDEX}) SELECT count(*) AS layers, count(*) FILTER (has_area) AS with_area, count(*) FILTER (has_length) AS with_length, sum(entity_count) AS entities,
  count(*) FILTER (total_area > 10000) AS huge, coalesce(bool_or(layer = '0' AND entity_count > 0.1 * (SELECT count(*) FROM takeoff_rows)), false) AS crowded_zero FROM i""", "takeoff_rows")
def _(rows):
    index = K.layer_index(rows)
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    return index.join(n).agg(
        F.count("*").alias("layers"), F.count_if("has_area").alias("with_area"), F.count_if("has_length").alias("with_length"), F.sum("entity_count").alias("entities"),
        F.count_if(F.col("total_area") > 10000).alias("huge"), F.coalesce(F.bool_or((F.col("layer") == "0") & (F.col("entity_count") > 0.1 * F.col("n"))), F.lit(False)).alias("crowded_zero"),
    )


@register("agg3_entity_histogram", "SELECT name, sum(cnt) AS cnt FROM takeoff_rows GROUP BY name", "takeoff_rows")
def _(rows):
    return rows.groupBy("name").agg(F.sum("cnt").alias("cnt"))


for _kind, _where in (("area", "has_area AND total_area > 0"), ("length", "has_length AND total_length > 0"), ("count", "entity_count > 0")):

    @register(f"flt15_candidates_{_kind}", f"WITH i AS ({INDEX}) SELECT layer FROM i WHERE {_where}", "takeoff_rows")
    def _(rows, kind=_kind):
        return K.candidates(K.layer_index(rows), kind).select("layer")


@register("flt16_quantity_from_index", f"""WITH i AS ({INDEX}) SELECT layer, kind, round(CASE WHEN kind = 'area' AND has_area THEN total_area WHEN kind = 'length' AND has_length THEN total_length WHEN kind = 'count' THEN entity_count END, 6) AS qty
FROM i, (VALUES ('area'), ('length'), ('count'), ('service')) k(kind)""", "takeoff_rows")
def _(rows):
    out = K.layer_index(rows).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("area", "length", "count", "service")])))
    return out.select("layer", "kind", F.round(K.quantity(F.col("kind")), 6).alias("qty"))


@register("unt15_index_in_metres", f"WITH i AS ({INDEX}) SELECT layer, round(total_area * 0.0001, 6) AS total_area, round(total_length * 0.01, 6) AS total_length FROM i", "takeoff_rows")
def _(rows):
    return rounded(K.layer_index(rows, "cm").select("layer", "total_area", "total_length"), "total_area", "total_length")


@register("srt5_top_layers_by_area", f"WITH i AS ({INDEX}) SELECT layer, round(total_area, 6) AS total_area FROM i WHERE has_area ORDER BY i.total_area DESC, layer LIMIT 5", "takeoff_rows")
def _(rows):
    return rounded(K.layer_index(rows).where("has_area").orderBy(F.desc("total_area"), "layer").limit(5).select("layer", "total_area"), "total_area")


PROFILE = """SELECT layer, coalesce(sum(value_si) FILTER (type = 'area'), 0.0) AS total_area, coalesce(sum(value_si) FILTER (type = 'length'), 0.0) AS total_length, coalesce(sum(value_si) FILTER (type = 'block'), 0.0) AS block_count,
  count(*) FILTER (type = 'area' AND contains(coalesce(evidence, ''), 'HATCH')) AS hatch_count, count(*) FILTER (type = 'area' AND contains(coalesce(evidence, ''), 'closed')) AS closed_poly_count, count(*) FILTER (type = 'text') AS text_count,
  string_agg(DISTINCT type, ',' ORDER BY type) AS entity_types, bool_or(type = 'area') AS has_area, bool_or(type = 'length') AS has_length, bool_or(type = 'block') AS has_block FROM cad_items GROUP BY layer"""


@register("agg4_layer_profiles", f"WITH p AS ({PROFILE}) SELECT * REPLACE (round(total_area, 6) AS total_area, round(total_length, 6) AS total_length, round(block_count, 6) AS block_count) FROM p", "cad_items")
def _(items):
    return rounded(K.layer_profiles(items), "total_area", "total_length", "block_count")


@register("flt14_geometry_support", f"""WITH p AS ({PROFILE}) SELECT layer,
  (has_area AND total_area > 0.01) OR (has_length AND total_length > 0) AS area_ok, CASE WHEN has_area AND total_area > 0.01 THEN NULL WHEN has_length AND total_length > 0 THEN 'convert_length_to_area' WHEN has_block THEN 'explode_blocks' END AS area_fallback,
  has_length AND total_length > 0 AS length_ok, has_block AND block_count > 0 AS block_ok, false AS volume_ok, true AS global_ok FROM p""", "cad_items")
def _(items):
    p = K.layer_profiles(items)
    return p.select("layer", K.support("AREA")["supported"].alias("area_ok"), K.support("AREA")["fallback"].alias("area_fallback"), K.support("LENGTH")["supported"].alias("length_ok"), K.support("BLOCK")["supported"].alias("block_ok"), K.support("VOLUME")["supported"].alias("volume_ok"), K.support("GLOBAL")["supported"].alias("global_ok"))


@register("agg4_layer_samples", f"SELECT {ORD}, layer, type, rn FROM (SELECT *, row_number() OVER (PARTITION BY layer, type ORDER BY {ORD}) AS rn FROM cad_items) WHERE rn <= 3", "cad_items")
def _(items):
    return K.samples(items).select(*ORDINAL, "layer", "type", F.col("rn").cast("long").alias("rn"))


@register("agg5_aggregate_items", f"SELECT type, name_raw, layer, round(sum(value_si), 6) AS value_si, arg_min(zone, ({ORD})) AS zone, count(*) AS n_items FROM cad_items WHERE type <> 'text' GROUP BY 1, 2, 3", "cad_items")
def _(items):
    return rounded(K.aggregate_items(items), "value_si")


@register("agg7_layer_zone_totals", "SELECT layer, zone, type, round(sum(value_si), 6) AS value_si FROM cad_items WHERE type IN ('area', 'length') GROUP BY 1, 2, 3", "cad_items")
def _(items):
    return rounded(K.by_layer_and_zone(items), "value_si")


@register("agg9_zone_registry", "SELECT upper(zone) AS zone, round(max(value_si), 6) AS area FROM cad_items WHERE type = 'area' AND value_si > 0 AND zone IS NOT NULL GROUP BY 1", "cad_items")
def _(items):
    return rounded(K.zone_registry(items), "area")


@register("agg10_footprints", """WITH b AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) AS box FROM cad_items WHERE type = 'area'), g AS (SELECT layer, sum(value_si) AS area, max(value_si) AS largest, count(*) AS n FROM cad_items WHERE type = 'area' GROUP BY layer)
SELECT layer, round(area, 6) AS area, round(largest, 6) AS largest, n AS polygons, round(least(1.0, area / 1000) * 0.4 + CASE WHEN box > 0 THEN area / box ELSE 0 END * 0.3 + (1 - least(1.0, n / 10)) * 0.2 + CASE WHEN area > 0 THEN largest / area ELSE 0 END * 0.1, 6) AS score FROM g, b""", "cad_items")
def _(items):
    return rounded(K.footprints(items), "area", "largest", "score")


@register("agg12_bounding_box", "SELECT coalesce(min(x), 0.0) AS min_x, coalesce(max(x), 100.0) AS max_x, coalesce(min(y), 0.0) AS min_y, coalesce(max(y), 100.0) AS max_y, round(sqrt(power(coalesce(max(x), 100.0) - coalesce(min(x), 0.0), 2) + power(coalesce(max(y), 100.0) - coalesce(min(y), 0.0), 2)), 6) AS diagonal FROM cad_items", "cad_items")
def _(items):
    return rounded(K.bounding_box(items), "diagonal")


@register("agg15_layer_distribution", """SELECT layer, quantile_disc(value_si, 0.5) AS p50, quantile_disc(value_si, 0.9) AS p90, min(value_si) AS lo, max(value_si) AS hi, round(avg(value_si), 6) AS mean,
  round(count(*) FILTER (value_si < 20) / count(*), 6) AS short_ratio, count(DISTINCT (floor(x / 10), floor(y / 10))) AS cells FROM cad_items WHERE type = 'length' GROUP BY layer""", "cad_items")
def _(items):
    return items.where("type = 'length'").groupBy("layer").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value_si)").alias("p50"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value_si)").alias("p90"), F.min("value_si").alias("lo"), F.max("value_si").alias("hi"),
        F.round(F.avg("value_si"), 6).alias("mean"), F.round(F.count_if(F.col("value_si") < 20) / F.count("*"), 6).alias("short_ratio"), F.count_distinct(F.floor(F.col("x") / 10), F.floor(F.col("y") / 10)).alias("cells"),
    )


@register("agg18_health", """WITH g AS (SELECT layer, sum(value_si) FILTER (type = 'area') AS a, sum(value_si) FILTER (type = 'length') AS l, max(value_si) FILTER (type = 'area') AS m FROM cad_items GROUP BY layer),
t AS (SELECT coalesce(sum(a), 0.0) AS total_area, coalesce(max(a), 0.0) AS top_area, coalesce(max(l), 0.0) AS top_length, coalesce(max(m), 0.0) AS footprint FROM g),
b AS (SELECT sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS d FROM cad_items)
SELECT round(total_area, 6) AS total_area, round(top_area, 6) AS top_area, round(top_length, 6) AS top_length, round(footprint, 6) AS footprint,
  CASE WHEN total_area > 1000000 THEN 'warning' WHEN d < 1 OR NOT (top_area > 10 OR top_length > 20) OR (footprint < 5 AND total_area < 5) THEN 'critical' WHEN d > 5000 THEN 'warning' ELSE 'healthy' END AS status FROM t, b""", "cad_items")
def _(items):
    return rounded(K.health(items).select("total_area", "top_area", "top_length", "footprint", "status"), "total_area", "top_area", "top_length", "footprint")


for _kind in ("area", "length"):

    @register(f"srt4_top_{_kind}_layers", f"SELECT layer, round(sum(value_si), 6) AS total, count(*) AS n FROM cad_items WHERE type = '{_kind}' GROUP BY layer ORDER BY sum(value_si) DESC, layer LIMIT 3", "cad_items")
    def _(items, kind=_kind):
        return rounded(K.top_layers(items, kind), "total")


@register("agg19_footprint", "SELECT round(coalesce(max(value_si), 0.0), 6) AS footprint FROM cad_items WHERE type = 'area'", "cad_items")
def _(items):
    return items.where("type = 'area'").agg(F.round(F.coalesce(F.max("value_si"), F.lit(0.0)), 6).alias("footprint"))


@register("agg33_block_counts", "SELECT layer, name_raw, count(*) AS n FROM cad_items WHERE type = 'block' GROUP BY 1, 2", "cad_items")
def _(items):
    return items.where("type = 'block'").groupBy("layer", "name_raw").agg(F.count("*").alias("n"))


@register("agg45_layer_inventory", "SELECT layer, type, count(*) AS n, round(sum(value_si), 6) AS total, round(CASE WHEN type = 'length' THEN sum(value_si) * 2.4 END, 6) AS wall_area FROM cad_items GROUP BY 1, 2", "cad_items")
def _(items):
    g = items.groupBy("layer", "type").agg(F.count("*").alias("n"), F.sum("value_si").alias("total"))
    return rounded(g.withColumn("wall_area", F.when(F.col("type") == "length", F.col("total") * 2.4)), "total", "wall_area")


@register("flt22_micro_lengths", f"SELECT {ORD}, layer, {UPPER('value_si', 3)} AS rounded, count(*) OVER (PARTITION BY layer, {UPPER('value_si', 3)}) > 20 AS suspect FROM cad_items WHERE type = 'length' AND value_si < 50", "cad_items")
def _(items):
    return K.micro_lengths(items)


@register("flt1_geometry_only", f"SELECT {ORD}, layer FROM cad_items WHERE NOT {ANNOTATION}", "cad_items")
def _(items):
    return items.where(~U.is_annotation(F.col("layer"))).select(*ORDINAL, "layer")


@register("flt1_excluded_by_layer", f"SELECT layer, count(*) AS n FROM cad_items WHERE {ANNOTATION} GROUP BY layer", "cad_items")
def _(items):
    return items.where(U.is_annotation(F.col("layer"))).groupBy("layer").agg(F.count("*").alias("n"))


@register("flt4_layer_penalty", f"SELECT DISTINCT layer, CASE WHEN {NON_MEASURABLE} THEN 0.5 WHEN layer = '0' THEN 0.4 ELSE 0 END::DOUBLE AS area_penalty, CASE WHEN {NON_MEASURABLE} THEN 0.5 ELSE 0 END::DOUBLE AS length_penalty FROM cad_items", "cad_items")
def _(items):
    return items.select("layer").distinct().select("layer", U.layer_penalty(F.col("layer"), F.lit("AREA")).alias("area_penalty"), U.layer_penalty(F.col("layer"), F.lit("LENGTH")).alias("length_penalty"))


@register("flt6_main_view", """WITH b AS (SELECT floor(y / 10) AS bin, count(*) AS n FROM cad_items GROUP BY 1), p AS (SELECT arg_max(bin, (n, -bin)) AS peak, max(n) AS most FROM b)
SELECT CAST(any_value(peak) AS BIGINT) AS peak, CAST((min(bin) - 1) * 10 AS DOUBLE) AS min_y, CAST((max(bin) + 2) * 10 AS DOUBLE) AS max_y FROM b, p WHERE abs(bin - peak) <= 5 AND n > most * 0.1""", "cad_items")
def _(items):
    return K.histogram_view(items)


@register("flt7_in_main_view", f"""WITH b AS (SELECT floor(y / 10) AS bin, count(*) AS n FROM cad_items GROUP BY 1), p AS (SELECT arg_max(bin, (n, -bin)) AS peak, max(n) AS most FROM b),
v AS (SELECT (min(bin) - 1) * 10 AS lo, (max(bin) + 2) * 10 AS hi FROM b, p WHERE abs(bin - peak) <= 5 AND n > most * 0.1) SELECT {ORD}, y FROM cad_items, v WHERE y BETWEEN lo AND hi""", "cad_items")
def _(items):
    return K.in_view(items, K.histogram_view(items)).select(*ORDINAL, "y")


@register("flt10_candidate_pool", f"SELECT {ORD} FROM cad_items WHERE type <> 'text'", "cad_items")
def _(items):
    return items.where("type <> 'text'").select(*ORDINAL)


@register("flt20_systematic_sample", f"SELECT {ORD} FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY {ORD}) AS rn FROM cad_items) WHERE (rn - 1) % 10 = 0", "cad_items")
def _(items):
    from pyspark.sql import Window

    w = Window.partitionBy("layer").orderBy(*ORDINAL)
    return items.withColumn("rn", F.row_number().over(w)).where("(rn - 1) % 10 = 0").select(*ORDINAL)


@register("dst1_deduplicate_areas", f"""WITH a AS (SELECT *, {UPPER('value_si', 2)} AS area2, {NON_MEASURABLE} AS note, row_number() OVER (PARTITION BY layer, {UPPER('value_si', 2)}, {UPPER('x', 1)}, {UPPER('y', 1)} ORDER BY {ORD}) AS rn FROM cad_items WHERE type = 'area'),
f AS (SELECT *, bool_or(NOT note) OVER (PARTITION BY area2) AS measured FROM a WHERE rn = 1) SELECT {ORD}, layer, area2 FROM f WHERE NOT (note AND measured)""", "cad_items")
def _(items):
    return K.deduplicate_areas(items, U.is_non_measurable(F.col("layer"))).select(*ORDINAL, "layer", "area2")


@register("dst4_blocks_by_name", "SELECT name_raw, layer, round(sum(value_si), 6) AS value_si, count(*) AS n FROM cad_items WHERE type = 'block' GROUP BY 1, 2", "cad_items")
def _(items):
    return rounded(items.where("type = 'block'").groupBy("name_raw", "layer").agg(F.sum("value_si").alias("value_si"), F.count("*").alias("n")), "value_si")


@register("dst5_first_per_key", f"SELECT {ORD}, k FROM (SELECT *, layer || '::' || type AS k, row_number() OVER (PARTITION BY layer, type ORDER BY {ORD}) AS rn FROM cad_items) WHERE rn = 1", "cad_items")
def _(items):
    first = items.groupBy("layer", "type").agg(F.min(F.struct(*ORDINAL)).alias("o"))
    return first.select("o.*", F.concat_ws("::", "layer", "type").alias("k"))


@register("win9_majority_layer", "SELECT zone, layer, n FROM (SELECT zone, layer, count(*) AS n, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, layer) AS rn FROM cad_items GROUP BY 1, 2) WHERE rn = 1", "cad_items")
def _(items):
    n = items.groupBy("zone", "layer").agg(F.count("*").alias("n"))
    return n.groupBy("zone").agg(F.min(F.struct((-F.col("n")).alias("m"), "layer")).alias("b")).select("zone", "b.layer", (-F.col("b.m")).alias("n"))


RELATED = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(w) for w in v)}]" for k, v in T.related().items()) + "}"
NORM = lambda c: rf"trim(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda t: length(t) > 2))"
GROUP = lambda c, groups, start=False: "CASE " + " ".join(f"WHEN {' OR '.join(f'''{'starts_with' if start else 'contains'}({c}, '{w}')''' for w in ws)} THEN '{g}'" for g, ws in groups.items()) + " ELSE 'UNKNOWN' END"
KIND = """CASE WHEN contains(u, 'm2') OR contains(u, 'm²') OR contains(u, 'mt2') OR contains(u, 'metro2') OR contains(u, 'metros cuadrados') THEN 'area'
  WHEN u IN ('m', 'ml', 'mt', 'metro', 'metros lineales') OR starts_with(u, 'm ') OR starts_with(u, 'ml ') OR starts_with(u, 'mt ') OR starts_with(u, 'metro ') OR starts_with(u, 'metros lineales ') THEN 'length'
  WHEN u IN ('un', 'u', 'pza', 'pieza', 'und', 'unidad') THEN 'count' WHEN u IN ('gl', 'global', 'sg') THEN 'service' ELSE 'unknown' END"""
HEADER = r"(unit IS NULL OR trim(unit) = '' OR length(description) < 5 OR regexp_matches(trim(description), '^[0-9.]+\s*$'))"
SCORED = rf"""idx AS ({INDEX}), m AS (SELECT {RELATED} AS m),
i0 AS (SELECT *, {NORM('description')} AS norm, lower(trim(unit)) AS u FROM bill_items), i1 AS (SELECT *, {KIND} AS kind, {TOKENS('norm')} AS a, {GROUP('norm', U.ITEM_TRADES)} AS item_trade FROM i0),
i2 AS (SELECT i1.*, list_distinct(list_concat(a, flatten(list_transform(a, lambda t: coalesce(m[t], []))))) AS ea, len(list_filter(string_split(norm, ' '), lambda t: length(t) > 3)) > 2 AS specific FROM i1, m),
l0 AS (SELECT *, {NORM('layer')} AS lnorm FROM idx), l1 AS (SELECT *, {TOKENS('lnorm')} AS b, {GROUP('lnorm', U.LAYER_TRADES, True)} AS layer_trade FROM l0),
l2 AS (SELECT l1.*, list_distinct(list_concat(b, flatten(list_transform(b, lambda t: coalesce(m[t], []))))) AS eb FROM l1, m),
p AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE least(len(list_intersect(ea, eb)) / len(list_distinct(list_concat(a, b))) * 0.8 + CASE WHEN len(list_intersect(a, b)) > 0 THEN 0.1 ELSE 0.0 END, 1.0) END AS similarity,
    CASE WHEN kind = 'area' AND has_area THEN total_area WHEN kind = 'length' AND has_length THEN total_length WHEN kind = 'count' THEN entity_count END AS qty_used
  FROM i2 JOIN l2 ON CASE WHEN kind = 'area' THEN has_area AND total_area > 0 WHEN kind = 'length' THEN has_length AND total_length > 0 WHEN kind = 'count' THEN entity_count > 0 ELSE true END
  WHERE NOT {HEADER} AND kind <> 'service'),
s1 AS (SELECT *, least(similarity * 0.5 + similarity * 0.1, 1.0) AS s FROM p), s2 AS (SELECT * REPLACE (CASE WHEN lnorm IN ({', '.join(repr(x) for x in M.GENERIC_LAYERS)}) THEN greatest(s - 0.7, 0.0) ELSE s END AS s) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN item_trade <> 'UNKNOWN' AND layer_trade <> 'UNKNOWN' AND item_trade <> layer_trade THEN greatest(s - 0.5, 0.0) ELSE s END AS s) FROM s2),
s4 AS (SELECT *, round(CASE WHEN kind = 'area' AND qty_used > 5000 AND specific THEN greatest(s - 0.3, 0.0) ELSE s END, 9) AS score FROM s3),
t AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next_score FROM s4 WINDOW w AS (PARTITION BY row_index ORDER BY score DESC, layer))"""


@register("jn1_best_matches", f"WITH {SCORED} SELECT row_index, rank, layer, score, round(qty_used, 6) AS qty_used FROM t WHERE rank <= 5", "bill_items", "takeoff_rows")
def _(bill, rows):
    items = M.prepare_items(bill).where(~M.is_header(F.col("description"), F.col("unit")) & (F.col("kind") != "service"))
    best = M.best_layers(items, M.prepare_layers(K.layer_index(rows)))
    return rounded(best.select("row_index", F.col("rank").cast("long").alias("rank"), "layer", "score", "qty_used"), "qty_used")


@register("win2_match_status", f"""WITH {SCORED}, b AS (SELECT * FROM t WHERE rank = 1), j AS (SELECT i2.row_index, i2.description, i2.unit, i2.kind, b.layer, b.score, b.next_score, b.qty_used, {HEADER.replace('unit', 'i2.unit').replace('description', 'i2.description')} AS header,
    coalesce(b.score >= 0.3 AND round(b.score - b.next_score, 9) < 0.1, false) AS amb, coalesce(b.score >= 0.3 AND b.qty_used IS NOT NULL, false) AS good FROM i2 LEFT JOIN b USING (row_index))
SELECT row_index, CASE WHEN header THEN 'title' WHEN kind = 'service' THEN 'approved' WHEN amb THEN 'pending_needs_layer_pick' WHEN good AND score >= 0.6 THEN 'approved' WHEN good THEN 'pending' WHEN score IS NOT NULL THEN 'pending_needs_layer_pick' ELSE 'pending_no_match' END AS status,
  CASE WHEN header THEN 'low' WHEN kind = 'service' THEN 'high' WHEN amb THEN 'medium' WHEN good AND score >= 0.6 THEN 'high' WHEN good AND score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence,
  round(CASE WHEN header THEN NULL WHEN kind = 'service' THEN 1.0 WHEN amb OR good THEN qty_used END, 6) AS qty_final, CASE WHEN NOT header AND kind <> 'service' AND (amb OR good) THEN layer END AS layer FROM j""", "bill_items", "takeoff_rows")
def _(bill, rows):
    return rounded(M.match(bill, K.layer_index(rows)), "qty_final")


GOLDEN = """g AS (SELECT p.row_index, p.qty AS predicted, e.qty AS expected, abs(p.qty - e.qty) AS gap FROM golden_predicted p LEFT JOIN golden_expected e USING (row_index) WHERE e.qty IS NULL OR e.qty >= 0.01),
r AS (SELECT row_index, coalesce(expected, 0.0) AS expected, predicted, CASE WHEN expected IS NULL THEN 0.0 WHEN predicted IS NULL THEN expected ELSE gap END AS abs_error, CASE WHEN expected IS NULL THEN 0.0 WHEN predicted IS NULL THEN 100.0 ELSE gap / expected * 100 END AS pct_error,
  CASE WHEN expected IS NULL THEN 'missing_expected' WHEN predicted IS NULL THEN 'missing_prediction' WHEN gap / expected * 100 <= 10.000001 OR gap / expected <= 0.01 THEN 'pass' ELSE 'fail' END AS status FROM g)"""


@register("jn15_golden_rows", f"WITH {GOLDEN} SELECT row_index, round(expected, 6) AS expected, predicted, round(abs_error, 6) AS abs_error, round(pct_error, 6) AS pct_error, status FROM r", "golden_predicted", "golden_expected")
def _(p, e):
    return rounded(R.golden_rows(p, e, most_pct=10.000001), "expected", "abs_error", "pct_error")


@register("agg22_golden_summary", f"""WITH {GOLDEN}, a AS (SELECT count(*) AS total_rows, count(*) FILTER (status IN ('pass', 'fail')) AS matched_rows, count(*) FILTER (status = 'pass') AS passed_rows, count(*) FILTER (status = 'fail') AS failed_rows, count(*) FILTER (status = 'missing_prediction') AS missing_predictions,
  round(avg(abs_error) FILTER (status IN ('pass', 'fail')), 6) AS avg_abs_error, round(avg(pct_error) FILTER (status IN ('pass', 'fail')), 6) AS avg_pct_error, round(max(pct_error) FILTER (status IN ('pass', 'fail')), 6) AS max_pct_error, round(median(pct_error) FILTER (status IN ('pass', 'fail')), 6) AS median_pct_error FROM r)
SELECT *, CASE WHEN passed_rows / matched_rows >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS quality_gate FROM a""", "golden_predicted", "golden_expected")
def _(p, e):
    return rounded(R.golden_summary(R.golden_rows(p, e, most_pct=10.000001)), "avg_abs_error", "avg_pct_error", "max_pct_error", "median_pct_error")


@register("srt2_golden_worst", f"WITH {GOLDEN} SELECT row_index, round(pct_error, 6) AS pct_error, status FROM r WHERE status IN ('fail', 'missing_prediction') ORDER BY round(r.pct_error, 6) DESC, row_index LIMIT 20", "golden_predicted", "golden_expected")
def _(p, e):
    return R.golden_worst(rounded(R.golden_rows(p, e, most_pct=10.000001), "pct_error")).select("row_index", "pct_error", "status")


@register("agg24_regression", "SELECT s.id, s.status, round(abs(s.qty_final - e.qty), 6) AS abs_error, round(CASE WHEN e.qty <> 0 THEN abs(s.qty_final - e.qty) / e.qty * 100 END, 6) AS pct_error, coalesce(abs(s.qty_final - e.qty) > 50, false) AS outlier FROM staging_rows s LEFT JOIN golden_expected e ON s.id = e.row_index", "staging_rows", "golden_expected")
def _(s, e):
    return rounded(R.regression(s, e), "abs_error", "pct_error")


@register("agg25_diagnostic", """SELECT count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'pending_no_match') AS no_match, count(*) FILTER (status = 'pending_semantics') AS semantics, count(*) FILTER (qty_final IS NULL) AS null_qty, count(*) FILTER (qty_final = 0) AS zero_qty, count(*) FILTER (unit_price_ref IS NULL) AS no_price,
  count(*) FILTER (height_factor IS NOT NULL) AS with_height, count(*) FILTER (status = 'approved' AND qty_final IS NULL) AS approved_without_qty, count(*) FILTER (match_confidence > 0.8 AND status <> 'approved') AS sure_but_open, round(CAST(avg(match_confidence) AS DOUBLE), 6) AS avg_confidence FROM staging_rows""", "staging_rows")
def _(s):
    return rounded(R.diagnostic(s.withColumn("match_confidence", F.col("match_confidence").cast("double"))), "avg_confidence")


@register("agg43_review_stats", "SELECT count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (starts_with(status, 'pending')) AS pending, count(*) FILTER (status IN ('ignored', 'rejected')) AS hidden, count(*) FILTER (match_confidence < 0.5) AS low_confidence FROM staging_rows", "staging_rows")
def _(s):
    return R.review_stats(s)


@register("agg50_confidence_buckets", "SELECT CASE WHEN match_confidence > 0.8 THEN 'high' WHEN match_confidence > 0.4 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM staging_rows GROUP BY 1", "staging_rows")
def _(s):
    return s.groupBy(R.confidence_bucket(F.col("match_confidence")).alias("bucket")).agg(F.count("*").alias("n"))


for _which, _where in (("pending", "starts_with(status, 'pending')"), ("low", "match_confidence < 0.5"), ("zero", "coalesce(qty_final, 0) = 0 AND n_sources > 0"), ("rejected", "status = 'rejected'")):

    @register(f"flt24_review_{_which}", f"SELECT id, status FROM staging_rows WHERE {_where}", "staging_rows")
    def _(s, which=_which):
        return R.review_filter(s, which).select("id", "status")


@register("srt6_review_sort", "SELECT id, qty FROM (SELECT id, coalesce(qty_final, 0.0) AS qty FROM staging_rows) ORDER BY qty, id", "staging_rows")
def _(s):
    return s.select("id", F.coalesce("qty_final", F.lit(0.0)).alias("qty")).orderBy("qty", "id")


@register("flt26_pricing_work_list", "SELECT id FROM staging_rows WHERE status IN ('approved', 'pending') AND unit_price_ref IS NULL", "staging_rows")
def _(s):
    return s.where("status IN ('approved', 'pending') AND unit_price_ref IS NULL").select("id")


CHANGED = [f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in R.TRACKED]
DIFF = f"""d AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN concat_ws(',', {', '.join(CHANGED)}) <> '' THEN 'modified' END AS change,
  CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN concat_ws(',', {', '.join(CHANGED)}) ELSE '' END AS fields, coalesce(b.unit_price_ref, 0) * coalesce(b.qty_final, 0) - coalesce(a.unit_price_ref, 0) * coalesce(a.qty_final, 0) AS price_impact, coalesce(b.qty_final, 0) - coalesce(a.qty_final, 0) AS qty_impact
  FROM snapshot_a a FULL OUTER JOIN snapshot_b b ON a.id = b.id)"""


@register("jn17_version_diff", f"WITH {DIFF} SELECT id, change, fields, round(price_impact, 4) AS price_impact, round(qty_impact, 6) AS qty_impact FROM d WHERE change IS NOT NULL", "snapshot_a", "snapshot_b")
def _(a, b):
    return rounded(rounded(R.diff(a, b), "price_impact", digits=4), "qty_impact")


@register("qty24_diff_impact", f"WITH {DIFF} SELECT change, count(*) AS n, round(sum(price_impact), 2) AS price_impact, round(sum(qty_impact), 6) AS qty_impact FROM d WHERE change IS NOT NULL GROUP BY change", "snapshot_a", "snapshot_b")
def _(a, b):
    return rounded(rounded(R.diff_summary(R.diff(a, b)), "price_impact", digits=2), "qty_impact")


@register("jn18_layer_check", "WITH l AS (SELECT DISTINCT layer FROM takeoff_rows WHERE name <> 'Hatch' AND layer < 'i'), r AS (SELECT DISTINCT layer FROM cad_items WHERE layer > 'd') SELECT layer, 'left' AS side FROM l WHERE layer NOT IN (SELECT layer FROM r) UNION ALL SELECT layer, 'right' FROM r WHERE layer NOT IN (SELECT layer FROM l)", "takeoff_rows", "cad_items")
def _(rows, items):
    return R.layer_check(rows.where("name <> 'Hatch' AND layer < 'i'"), items.where("layer > 'd'"))


@register("jn19_coverage", f"WITH i AS ({INDEX}), u AS (SELECT DISTINCT layer FROM cad_items WHERE type = 'area' AND value_si > 100) SELECT i.layer, i.entity_count, u.layer IS NOT NULL AS used FROM i LEFT JOIN u ON i.layer = u.layer", "takeoff_rows", "cad_items")
def _(rows, items):
    return R.coverage(K.layer_index(rows), items.where("type = 'area' AND value_si > 100"))


@register("jn20_service_match", "SELECT b.row_index, coalesce(p.qty, b.qty) AS qty FROM bill_items b LEFT JOIN golden_predicted p USING (row_index)", "bill_items", "golden_predicted")
def _(bill, p):
    return bill.select("row_index", "qty").join(p.withColumnRenamed("qty", "q"), "row_index", "left").select("row_index", F.coalesce("q", "qty").alias("qty"))


@register("jn21_latest_feedback", "SELECT item_text, target, round(confidence, 6) AS confidence, created_at FROM (SELECT *, row_number() OVER (PARTITION BY item_text ORDER BY created_at DESC, id DESC) AS rn FROM matching_feedback WHERE correction IN ('accept', 'modify', 'manual')) WHERE rn = 1", "matching_feedback")
def _(f):
    return rounded(R.latest_feedback(f), "confidence")


@register("agg28_similar_matches", "WITH n AS (SELECT * FROM matching_feedback WHERE correction = 'accept' AND contains(item_text, 'sign') ORDER BY created_at DESC, id DESC LIMIT 100) SELECT target, count(*) AS n, round(avg(confidence), 6) AS confidence FROM n GROUP BY target", "matching_feedback")
def _(f):
    return rounded(R.similar_matches(f, "sign"), "confidence")


@register("agg29_feedback_accuracy", "SELECT count(*) AS n, round(avg(confidence), 6) AS avg_confidence, round(100.0 * avg(CASE WHEN correction = 'accept' THEN 1.0 ELSE 0.0 END), 6) AS accept_pct, min(created_at) AS first, max(created_at) AS last FROM matching_feedback", "matching_feedback")
def _(f):
    return rounded(R.feedback_accuracy(f), "avg_confidence", "accept_pct")


@register("agg30_metrics_by_day", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, round(CAST(avg(accuracy) AS DOUBLE), 6) AS avg_accuracy, round(sum(cost), 6) AS cost, count(*) AS batches FROM batch_metrics GROUP BY 1", "batch_metrics")
def _(m):
    return rounded(R.metrics_by_day(m).withColumn("day", F.col("day").cast("string")), "avg_accuracy", "cost")


@register("agg31_metrics_alerts", "WITH r AS (SELECT * FROM batch_metrics ORDER BY created_at DESC, batch_id LIMIT 10), o AS (SELECT avg(accuracy) AS a, avg(cost) AS c, avg(time_ms) AS t FROM r) SELECT 'low_accuracy' AS alert FROM o WHERE a < 70 UNION ALL SELECT 'high_cost' FROM o WHERE c > 100 UNION ALL SELECT 'slow' FROM o WHERE t > 300000", "batch_metrics")
def _(m):
    return R.metrics_alerts(m)


@register("agg27_learning_stats", "SELECT layer, CAST(sum(times_used) AS BIGINT) AS times_used, count(*) AS n FROM learned_mappings GROUP BY layer ORDER BY sum(times_used) DESC, layer LIMIT 10", "learned_mappings")
def _(m):
    return R.learning_stats(m)


@register("jn22_learned_lookup", "SELECT layer, times_used FROM learned_mappings WHERE user_id = 'BUILDING' AND contains(item_text, 'item 3') ORDER BY times_used DESC, confidence DESC, layer LIMIT 5", "learned_mappings")
def _(m):
    return R.learned_lookup(m, "BUILDING", "item 3").select("layer", "times_used")


@register("jn23_upsert_mappings", """WITH n AS (SELECT user_id, layer, item_text, 1 AS times_used, confidence, last_used FROM learned_mappings WHERE times_used % 2 = 0 UNION ALL SELECT * FROM (SELECT user_id, layer, item_text, times_used, confidence, last_used FROM learned_mappings))
SELECT user_id, item_text, layer, CAST(sum(times_used) AS BIGINT) AS times_used, round(max(confidence), 6) AS confidence, max(last_used) AS last_used FROM n GROUP BY 1, 2, 3""", "learned_mappings")
def _(m):
    return rounded(R.upsert_mappings(m, m.where("times_used % 2 = 0").withColumn("times_used", F.lit(1).cast("long"))), "confidence")


@register("sta_fresh_mappings", "SELECT user_id, item_text, layer FROM learned_mappings WHERE last_used >= DATE '2001-12-31' - INTERVAL 180 DAY", "learned_mappings")
def _(m):
    return R.fresh_mappings(m, F.lit("2001-12-31").cast("date")).select("user_id", "item_text", "layer")


OK_URL = "url IS NOT NULL AND trim(url) <> '' AND lower(url) <> 'null' AND starts_with(url, 'http')"


@register("agg42_prices", f"""WITH p AS (SELECT item, min(price) AS lo, avg(price) AS av, max(price) AS hi, count(*) AS n, count(*) FILTER ({OK_URL}) AS n_valid FROM price_sources GROUP BY item)
SELECT item, round(lo, 6) AS min_price, round(av, 6) AS avg_price, round(hi, 6) AS max_price, n, n_valid, CASE WHEN n_valid = 0 THEN 'low' WHEN n_valid < n OR n = 1 THEN 'medium' ELSE 'high' END AS confidence FROM p""", "price_sources")
def _(p):
    return rounded(R.prices(p), "min_price", "avg_price", "max_price")


@register("flt27_valid_sources", f"SELECT item, vendor, price FROM price_sources WHERE {OK_URL}", "price_sources")
def _(p):
    ok = F.col("url").isNotNull() & (F.trim("url") != "") & (F.lower("url") != "null") & F.col("url").startswith("http")
    return p.where(ok).select("item", "vendor", "price")


@register("jn33_price_outliers", """WITH w AS (SELECT row_index, string_split(description, ' ')[1] AS word, price FROM bill_items), n AS (SELECT *, count(price) OVER (PARTITION BY word) - 1 AS n, sum(price) OVER (PARTITION BY word) - price AS s FROM w)
SELECT row_index, word, price, round(s / n, 4) AS peer_avg FROM n WHERE n >= 2 AND price > 1.05 * s / n""", "bill_items")
def _(bill):
    return rounded(R.price_outliers(bill, times=1.05), "peer_avg", digits=4)


@register("snk1_write_bill", "SELECT b.row_index, b.description, b.unit, coalesce(s.qty_final, b.qty) AS qty, round(coalesce(s.unit_price_ref, b.price), 6) AS price FROM bill_items b LEFT JOIN (SELECT * FROM staging_rows WHERE status NOT IN ('ignored', 'rejected')) s ON s.id = b.row_index", "staging_rows", "bill_items")
def _(s, bill):
    from mensura.sources.files import write_bill

    return rounded(write_bill(s, bill), "price")


@register("snk4_heatmap_colors", "SELECT id, CASE WHEN status = 'approved' THEN 'green' WHEN match_confidence <= 0.4 THEN 'red' ELSE 'orange' END AS color FROM staging_rows", "staging_rows")
def _(s):
    return s.select("id", F.when(F.col("status") == "approved", "green").when(F.col("match_confidence") <= 0.4, "red").otherwise("orange").alias("color"))


@register("stm1_next_job", "SELECT id FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1", "jobs")
def _(j):
    from mensura.streaming.jobs import next_job

    return next_job(j).select("id")


@register("stm3_batch_barrier", "SELECT batch_id, count(*) AS jobs, bool_and(status <> 'queued') AS ready, bool_or(status = 'failed') AS failed FROM jobs GROUP BY batch_id", "jobs")
def _(j):
    from mensura.streaming.jobs import batch_barrier

    return batch_barrier(j)


@register("win4_next_version", "SELECT batch_id, coalesce(max(n), 0) + 1 AS next_version FROM (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, id) AS n FROM jobs) GROUP BY batch_id", "jobs")
def _(j):
    from pyspark.sql import Window

    w = Window.partitionBy("batch_id").orderBy("created_at", "id")
    return R.next_version(j.withColumn("version_number", F.row_number().over(w).cast("long")))


@register("set1_union_items", f"SELECT {ORD}, type FROM cad_items WHERE type = 'area' UNION ALL SELECT {ORD}, type FROM cad_items WHERE type = 'length'", "cad_items")
def _(items):
    keep = items.select(*ORDINAL, "type")
    return keep.where("type = 'area'").unionByName(keep.where("type = 'length'"))
