"""Further operators over the logical tables: service checks, names, sessions of work, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import units as U
from mensura.operators import service as V
from mensura.plans.domain import GROUP, NON_MEASURABLE, NORM, ORD
from mensura.plans.registry import register, rounded
from mensura.plans.scalar import CHECKED, QTY, WORDS, _checked
from mensura.sources.adapters import ORDINAL

RANGE = lambda k: "CASE lower(trim(unit)) " + " ".join(f"WHEN '{u}' THEN {r[k]}" for u, r in V.RANGES.items()) + f" ELSE {V.RANGES['m2'][k]} END"


def _q(b):
    return _checked(b).select("row_index", "description", "unit", "q", "expected_qty", "severity")


@register("qty15_range_checks", f"""WITH c AS (SELECT row_index, unit, expected_qty AS e, {QTY} AS q FROM bill_items)
SELECT row_index, CASE WHEN q < {RANGE(0)} THEN 'absolute_min' WHEN q > {RANGE(1)} THEN 'absolute_max' END AS absolute, CASE WHEN q < {RANGE(2)} THEN 'typical_min' WHEN q > {RANGE(3)} THEN 'typical_max' END AS typical,
  CASE WHEN e IS NULL OR e <= 0 OR q IS NULL OR abs(q / e - 1) <= 0.2 THEN NULL WHEN abs(q / e - 1) * 100 > 50 THEN 'error' ELSE 'warning' END AS expected FROM c""", "bill_items")
def _(b):
    q, u = F.col("q"), F.col("unit")
    return _q(b).select("row_index", V.absolute_issue(q, u).alias("absolute"), V.typical_issue(q, u).alias("typical"), F.when(q.isNotNull(), V.expected_issue(q, F.col("expected_qty"))).alias("expected"))


@register("qty16_hatch_and_parent", "SELECT row_index, coalesce(row_index % 2 = 0 AND qty > 50 * 0.8, false) AS hatch, coalesce(qty > expected_qty * 0.9 * 1.1, false) AS parent FROM bill_items", "bill_items")
def _(b):
    source = F.when(F.col("row_index") % 2 == 0, "hatch").otherwise("line")
    return b.select("row_index", F.coalesce(V.hatch_issue(F.col("qty"), F.lit(50.0), source), F.lit(False)).alias("hatch"), F.coalesce(V.parent_issue(F.col("qty"), F.col("expected_qty") * 0.9), F.lit(False)).alias("parent"))


@register("qty17_issue_counts", f"""WITH c AS (SELECT unit, expected_qty AS e, {QTY} AS q FROM bill_items), i AS (SELECT unit, q < {RANGE(0)} OR q > {RANGE(1)} AS a, q < {RANGE(2)} OR q > {RANGE(3)} AS t, e > 0 AND abs(q / e - 1) > 0.2 AS x FROM c WHERE q IS NOT NULL)
SELECT unit, count(*) FILTER (a) AS absolute, count(*) FILTER (t) AS typical, count(*) FILTER (x) AS expected FROM i GROUP BY unit""", "bill_items")
def _(b):
    i = _q(b).where("q IS NOT NULL").select("unit", V.issues(F.col("q"), F.col("unit"), F.col("expected_qty")).alias("i"))
    n = lambda s: F.count_if(F.exists("i", lambda x: x.startswith(s)))
    return i.groupBy("unit").agg(n("absolute").alias("absolute"), n("typical").alias("typical"), n("expected").alias("expected"))


FACTORS = """t AS (SELECT row_index, CASE WHEN row_index % 10 >= 9 THEN 1.0 WHEN row_index % 10 >= 7 THEN 0.8 WHEN row_index % 10 >= 5 THEN 0.6 ELSE 0.3 END AS f1,
  CASE row_index % 4 WHEN 0 THEN 1.0 WHEN 1 THEN greatest(0.3, 1 - row_index % 7 / 5) WHEN 2 THEN 0.6 ELSE 0.3 END AS f2,
  CASE WHEN expected_qty IS NULL OR expected_qty <= 0 THEN 0.5 WHEN q / expected_qty BETWEEN 0.9 AND 1.1 THEN 1.0 WHEN q / expected_qty BETWEEN 0.8 AND 1.2 THEN 0.9 WHEN q / expected_qty BETWEEN 0.7 AND 1.4 THEN 0.7 WHEN q / expected_qty BETWEEN 0.5 AND 2.0 THEN 0.4 ELSE 0.1 END AS f4,
  least(1.0, 0.5 + 0.1 + CASE WHEN qty BETWEEN 1 AND 200 THEN 0.2 WHEN qty BETWEEN 0.5 AND 500 THEN 0.1 ELSE 0 END) AS f3 FROM (SELECT *, qty * (0.5 + row_index % 13 * 0.1) AS q FROM bill_items))"""


def _factors(b):
    r = F.col("row_index")
    how = F.when(r % 4 == 0, "inside").when(r % 4 == 1, "near_centroid").when(r % 4 == 2, "directional").otherwise("none")
    q = F.col("qty") * (F.lit(0.5) + r % 13 * 0.1)
    return b.select("row_index", V.text_factor(r % 10 / 10).alias("f1"), V.spatial_factor(how, r % 7).alias("f2"), V.geometry_factor(F.col("qty"), F.lit(None).cast("double")).alias("f3"), V.expected_factor(q, F.col("expected_qty")).alias("f4"))


@register("qty19_confidence_factors", f"WITH {FACTORS} SELECT row_index, round(f1::DOUBLE, 6) AS f1, round(f2::DOUBLE, 6) AS f2, round(f3::DOUBLE, 6) AS f3, round(f4::DOUBLE, 6) AS f4 FROM t", "bill_items")
def _(b):
    return rounded(_factors(b), "f1", "f2", "f3", "f4")


@register("qty18_confidence", f"WITH {FACTORS}, c AS (SELECT *, f1 * 0.20 + f2 * 0.25 + f3 * 0.20 + f4 * 0.25 + 0.5 * 0.10 AS base FROM t) SELECT row_index, round(round(base * CASE WHEN row_index % 5 = 0 THEN 0.5 ELSE 1 - row_index % 3 * 0.1 END, 9), 3) AS confidence FROM c", "bill_items")
def _(b):
    f = _factors(b)
    r = F.col("row_index")
    c = V.confidence(F.col("f1"), F.col("f2"), F.col("f3"), F.col("f4"), F.lit(0.5), r % 5 == 0, r % 3)
    return f.select("row_index", c.alias("confidence"))


@register("flt18_keep_layer", f"SELECT DISTINCT layer, NOT {WORDS('upper(layer)', V.NOISE_LAYERS)} AS keep FROM cad_items", "cad_items")
def _(items):
    return items.select("layer").distinct().select("layer", V.keep_layer(F.col("layer")).alias("keep"))


@register("flt19_kept_items", f"SELECT {ORD} FROM cad_items WHERE NOT {WORDS('upper(layer)', V.NOISE_LAYERS)}", "cad_items")
def _(items):
    return items.where(V.keep_layer(F.col("layer"))).select(*ORDINAL)


@register("flt21_annotation_halves", f"SELECT {NON_MEASURABLE} AS annotation, type, count(*) AS n FROM cad_items GROUP BY 1, 2", "cad_items")
def _(items):
    return items.groupBy(U.is_non_measurable(F.col("layer")).alias("annotation"), "type").agg(F.count("*").alias("n"))


@register("str15_zone_intent", "SELECT row_index, CASE row_index % 5 WHEN 0 THEN 'SALA' WHEN 1 THEN NULL WHEN 2 THEN 'BAÑO' WHEN 3 THEN 'BODEGA' END AS zone FROM bill_items", "bill_items")
def _(b):
    word = F.get(F.array(*[F.lit(w) for w in (" Sala", " salada", " bano 2", " en bodega.", " xhallx")]), (F.col("row_index") % 5).cast("int"))
    return b.select("row_index", V.zone_intent(F.concat(F.col("description"), word)).alias("zone"))


@register("str13_label_code", "SELECT row_index, CASE row_index % 3 WHEN 0 THEN 'TAB' || row_index % 100 WHEN 1 THEN 'P' || row_index % 100 END AS code FROM bill_items", "bill_items")
def _(b):
    n = (F.col("row_index") % 100).cast("string")
    text = F.concat("description", F.when(F.col("row_index") % 3 == 0, F.concat(F.lit(" tab-"), n)).when(F.col("row_index") % 3 == 1, F.concat(F.lit(" (P "), n, F.lit(")"))).otherwise(""))
    return b.select("row_index", V.label_code(text).alias("code"))


@register("str14_tab_id", "SELECT row_index, CASE WHEN row_index % 2 = 0 THEN 'TAB' || lpad(CAST(row_index % 100 AS VARCHAR), 2, '0') END AS tab FROM bill_items", "bill_items")
def _(b):
    text = F.concat("description", F.when(F.col("row_index") % 2 == 0, F.concat(F.lit(" Tab "), (F.col("row_index") % 100).cast("string"))).otherwise(""))
    return b.select("row_index", V.tab_id(text).alias("tab"))


@register("cat5_file_discipline", f"SELECT DISTINCT layer, {GROUP('lower(layer)', V.FILE_DISCIPLINES)} AS discipline FROM cad_items", "cad_items")
def _(items):
    return items.select("layer").distinct().select("layer", V.file_discipline(F.col("layer")).alias("discipline"))


@register("flt11_discipline_match", f"WITH l AS (SELECT DISTINCT {GROUP('lower(layer)', V.FILE_DISCIPLINES)} AS d FROM cad_items) SELECT a.d AS a, b.d AS b, a.d = 'UNKNOWN' OR b.d = 'UNKNOWN' OR a.d = b.d AS ok FROM l a, l b", "cad_items")
def _(items):
    d = items.select(V.file_discipline(F.col("layer")).alias("a")).distinct()
    return d.join(F.broadcast(d.select(F.col("a").alias("b")))).select("a", "b", V.same_discipline(F.col("a"), F.col("b")).alias("ok"))


@register("agg36_layer_votes", f"WITH v AS (SELECT trade, count(*) AS n FROM (SELECT DISTINCT layer, {GROUP('lower(layer)', V.FILE_DISCIPLINES)} AS trade FROM cad_items) WHERE trade <> 'UNKNOWN' GROUP BY trade) SELECT trade, round(n / sum(n) OVER (), 6) AS share, CASE WHEN n / sum(n) OVER () >= 0.7 THEN 'high' WHEN n / sum(n) OVER () >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM v QUALIFY row_number() OVER (ORDER BY n DESC, trade) = 1", "cad_items")
def _(items):
    return rounded(V.layer_votes(items, "layer", V.file_discipline(F.col("layer"))), "share")


@register("unt11_drawing_unit", "SELECT row_index, CASE WHEN row_index % 7 = 1 THEN 0.0254 WHEN row_index % 7 = 2 THEN 0.3048 WHEN row_index % 7 = 4 THEN 0.001 WHEN row_index % 7 = 5 THEN 0.01 WHEN row_index % 7 = 6 THEN 1.0 WHEN row_index % 3 = 0 THEN 0.01 WHEN row_index % 1000 * 30 > 20000 THEN 0.001 WHEN row_index % 1000 * 30 > 200 THEN 0.01 ELSE 1.0 END::DOUBLE AS to_metres, CASE WHEN row_index % 7 IN (1, 2, 4, 5, 6) THEN 'INSUNITS' WHEN row_index % 3 = 0 THEN 'PREFERENCE' WHEN row_index % 1000 > 0 THEN 'HEURISTIC' ELSE 'DEFAULT' END AS source FROM bill_items", "bill_items")
def _(b):
    r = F.col("row_index")
    u = V.unit_from_header(r % 7, F.when(r % 3 == 0, "cm"), (r % 1000 * 30).cast("double"))
    return b.select("row_index", u["to_metres"].alias("to_metres"), u["source"].alias("source"))


@register("unt12_unit_by_diagonal", "SELECT row_index, CASE WHEN qty * 1000 > 20000 THEN 'mm' WHEN qty * 1000 > 200 THEN 'cm' ELSE 'm' END AS unit FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", U.unit_of_diagonal(F.col("qty") * 1000).alias("unit"))


@register("str12_normalize_words", r"SELECT row_index, trim(regexp_replace(regexp_replace(lower(description), '[^\w\sáéíóúñ]', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", V.normalize_words(F.col("description")).alias("words"))


@register("sim8_family", "SELECT DISTINCT w AS word, CASE WHEN w IN (" + "".join(f"{', '.join(repr(w) for w in (k, *ws))}) THEN '{k}' WHEN w IN (" for k, ws in V.FAMILIES.items())[: -len(" WHEN w IN (")] + " END AS family FROM (SELECT unnest(string_split(lower(description), ' ')) AS w FROM bill_items)", "bill_items")
def _(b):
    words = b.select(F.explode(F.split(F.lower("description"), " ")).alias("word")).distinct()
    return words.select("word", F.get(V.family(F.col("word")), 0).alias("family"))


@register("sim6_fuzzy_pairs", None, "bill_items", "takeoff_rows")
def _(b, rows):
    left = b.select(V.normalize_words(F.col("description")).alias("l")).distinct()
    right = rows.select("layer").distinct().select(V.normalize_words(F.col("layer")).alias("r"))
    return rounded(V.fuzzy_pairs(left, right, 0.5).select(F.col("l").alias("d"), F.col("r").alias("layer"), "score"), "score")


@register("sim7_semantic_matches", None, "bill_items", "takeoff_rows")
def _(b, rows):
    terms = b.select(F.explode(F.split(F.lower("description"), " ")).alias("term")).distinct()
    return rounded(V.semantic_matches(terms, rows.select(F.col("layer").alias("name")).distinct()), "score")


AREA = "value_si / 10"
ASPECT = "(1 + l_partkey % 60) / 10"


def _category_sql():
    part = lambda b, x: f"CASE WHEN {b} THEN {x} ELSE 0 END"
    named = lambda starts, words: f"{part('regexp_matches(layer, $$^(' + '|'.join(starts) + ')$$)', 0.35)} + {part(WORDS('layer', words), 0.25)}"
    large = "CASE WHEN a > 10 THEN 0.25 WHEN a > 5 THEN 0.15 ELSE 0 END"
    small = "CASE WHEN a < 1 THEN 0.25 WHEN a < 5 THEN 0.15 ELSE 0 END"
    flat, wide = part("s BETWEEN 0.3 AND 3.0", 0.1), part("s BETWEEN 0.2 AND 5.0", 0.2)
    return ", ".join(f"round(least({x}, 1.0), 9) AS {n}" for n, x in {
        "floor": f"{large} + {wide} + {flat} + {named(['fa_0', 'floor', 'piso', 'losa'], ['pavimento', 'piso', 'losa'])}",
        "wall": f"{part('s BETWEEN 3.0 AND 50.0', 0.2)} + {part('s > 3', 0.15)} + {part('s > 3 OR s < 0.3', 0.1)} + {named(['fa_muro', 'wall', 'muro', 'tab'], ['muro', 'tabique', 'wall'])}",
        "ceiling": f"{large} + {wide} + {flat} + {named(['fa_cielo', 'ceiling', 'cielo'], ['cielo', 'raso', 'ceiling', 'volcanita'])}",
        "fixture": f"{small} + {part('s BETWEEN 0.1 AND 10.0', 0.2)} + {named(['door', 'window', 'furniture', 'fixture'], ['puerta', 'ventana', 'mobiliario'])}",
        "note": f"{part('a < 0.01', 0.3)} + {named(['dim', 'text', 'note', 'anno'], ['text', 'dim', 'cota', 'nota', 'seccion'])}",
    }.items())


@register("cat10_region_category", f"""WITH r AS (SELECT {ORD}, lower(layer) AS layer, {AREA} AS a, {ASPECT} AS s FROM cad_items WHERE type = 'area'), c AS (SELECT {ORD}, {_category_sql()} FROM r), b AS (SELECT *, greatest(floor, wall, ceiling, fixture, note) AS best FROM c)
SELECT {ORD}, CASE WHEN best < 0.3 THEN 'UNKNOWN' WHEN floor = best THEN 'FLOOR' WHEN wall = best THEN 'WALL' WHEN ceiling = best THEN 'CEILING' WHEN fixture = best THEN 'FIXTURE' ELSE 'ANNOTATION' END AS category FROM b""", "cad_items")
def _(items):
    aspect = (F.col("l_partkey") % 60 + 1) / 10
    return items.where("type = 'area'").select(*ORDINAL, V.region_category(F.col("value_si") / 10, aspect, F.col("layer")).alias("category"))


@register("jn16_prefix_match", f"""WITH t AS (SELECT DISTINCT description AS text FROM bill_items), r AS (SELECT DISTINCT layer AS r, layer AS ord FROM takeoff_rows UNION SELECT name_raw, 'z' || name_raw FROM cad_items), j AS (SELECT text, r, row_number() OVER (PARTITION BY text ORDER BY ord) AS rn FROM t JOIN r ON contains(r, substr(text, 1, 20)) OR contains(text, substr(r, 1, 20)))
SELECT text, r FROM j WHERE rn = 1""", "bill_items", "takeoff_rows", "cad_items")
def _(b, rows, items):
    t = b.select(F.col("description").alias("text")).distinct()
    names = rows.select(F.col("layer").alias("text"), F.col("layer").alias("ord")).unionByName(items.select(F.col("name_raw").alias("text"), F.concat(F.lit("z"), "name_raw").alias("ord")))
    return V.first_prefix_match(t, names.distinct())


@register("agg26_matching_stats", f"WITH {CHECKED} SELECT count(*) AS total, count(*) FILTER (severity = 'ok') AS ok, count(*) FILTER (unit = '') AS headers, count(*) FILTER (q IS NULL) AS open FROM s", "bill_items")
def _(b):
    return _q(b).agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "ok").alias("ok"), F.count_if(F.col("unit") == "").alias("headers"), F.count_if(F.col("q").isNull()).alias("open"))


@register("agg46_health_audit", "SELECT CASE WHEN status = 'approved' THEN 'ok' WHEN qty_final IS NULL THEN 'no_quantity' WHEN unit_price_ref IS NULL THEN 'no_price' ELSE 'open' END AS category, count(*) AS n, count(*) FILTER (match_confidence > 0.8) AS sure FROM staging_rows GROUP BY 1", "staging_rows")
def _(s):
    c = F.when(F.col("status") == "approved", "ok").when(F.col("qty_final").isNull(), "no_quantity").when(F.col("unit_price_ref").isNull(), "no_price").otherwise("open")
    return s.groupBy(c.alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("match_confidence") > 0.8).alias("sure"))


@register("agg35_block_measures", "SELECT layer, name_raw, round(sum(value_si), 6) AS total, round(max(x) - min(x), 6) AS width, round(max(y) - min(y), 6) AS height FROM cad_items WHERE type = 'block' GROUP BY 1, 2", "cad_items")
def _(items):
    g = items.where("type = 'block'").groupBy("layer", "name_raw")
    return rounded(g.agg(F.sum("value_si").alias("total"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height")), "total", "width", "height")


@register("agg44_tab_area", "SELECT layer, zone, round(sum(value_si) * 2.4, 6) AS area FROM cad_items WHERE type = 'length' AND zone LIKE '%_1%' GROUP BY 1, 2", "cad_items")
def _(items):
    g = items.where("type = 'length' AND zone LIKE '%_1%'").groupBy("layer", "zone").agg((F.sum("value_si") * 2.4).alias("area"))
    return rounded(g, "area")


@register("agg41_supported_units", "SELECT * FROM (VALUES " + ", ".join(f"('{u}', {len(ws)}, '{sorted(ws)[0]}')" for u, (_, ws) in U.UNITS.items()) + ") t(unit, n, first)", "jobs")
def _(j):
    spark = j.sparkSession
    rows = [(u, w) for u, (_, ws) in U.UNITS.items() for w in ws]
    return spark.createDataFrame(rows, "unit string, w string").groupBy("unit").agg(F.count("*").cast("int").alias("n"), F.min("w").alias("first"))


@register("flt25_updatable_fields", "SELECT id, qty_final, unit_price_ref, status, CAST(height_factor AS DOUBLE) AS height_factor FROM staging_rows", "staging_rows")
def _(s):
    return s.select("id", "qty_final", "unit_price_ref", "status", F.col("height_factor").cast("double").alias("height_factor"))


@register("flt30_owned_rows", "SELECT j.id FROM jobs j WHERE j.batch_id IN (SELECT batch_id FROM batch_metrics WHERE accuracy > 20)", "jobs", "batch_metrics")
def _(j, m):
    return j.join(m.where("accuracy > 20").select("batch_id"), "batch_id", "left_semi").select("id")


@register("snk10_batch_reset", "SELECT id, batch_id FROM jobs WHERE batch_id NOT IN (SELECT batch_id FROM batch_metrics WHERE accuracy < 15)", "jobs", "batch_metrics")
def _(j, m):
    return j.join(m.where("accuracy < 15").select("batch_id"), "batch_id", "left_anti").select("id", "batch_id")


@register("set3_token_sets", rf"WITH t AS (SELECT row_index, list_distinct(string_split({NORM('description')}, ' ')) AS a FROM bill_items) SELECT row_index, len(list_intersect(a, ['muro', 'piso', 'red', 'bolt'])) AS shared, len(list_distinct(list_concat(a, ['muro', 'piso', 'red', 'bolt']))) AS all_ FROM t", "bill_items")
def _(b):
    from mensura.functions.text import normalize_text

    a = F.array_distinct(F.split(normalize_text(F.col("description")), " "))
    w = F.array(*[F.lit(x) for x in ("muro", "piso", "red", "bolt")])
    return b.select("row_index", F.size(F.array_intersect(a, w)).cast("long").alias("shared"), F.size(F.array_union(a, w)).cast("long").alias("all_"))


@register("set4_layer_difference", "SELECT DISTINCT layer FROM takeoff_rows WHERE name = 'Arc' EXCEPT SELECT layer FROM cad_items WHERE type = 'area' AND value_si > 104.9", "takeoff_rows", "cad_items")
def _(rows, items):
    return rows.where("name = 'Arc'").select("layer").subtract(items.where("type = 'area' AND value_si > 104.9").select("layer"))


@register("srt8_version_order", "SELECT batch_id, max(created_at) AS latest FROM jobs GROUP BY batch_id ORDER BY latest DESC, batch_id", "jobs")
def _(j):
    return j.groupBy("batch_id").agg(F.max("created_at").alias("latest")).orderBy(F.desc("latest"), "batch_id")


@register("srt10_areas_in_range", f"SELECT {ORD}, value_si FROM cad_items WHERE type = 'area' AND value_si BETWEEN 20 AND 21 ", "cad_items")
def _(items):
    return items.where("type = 'area' AND value_si BETWEEN 20 AND 21").select(*ORDINAL, "value_si")


@register("geo9_minimum_lengths", f"SELECT {ORD}, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length FROM segments WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 1.5", "segments")
def _(s):
    from mensura.operators.spatial import distance

    d = distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return rounded(s.withColumn("length", d).where("length >= 1.5").select(*ORDINAL, "length"), "length")


@register("agg48_y_bins", "SELECT CAST(floor(y / 10) AS BIGINT) AS bin, count(*) AS n, count(DISTINCT layer) AS layers FROM cad_items GROUP BY 1", "cad_items")
def _(items):
    return items.groupBy(F.floor(F.col("y") / 10).alias("bin")).agg(F.count("*").alias("n"), F.count_distinct("layer").alias("layers"))
