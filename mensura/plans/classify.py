"""Keywords, units, gates and scores over the logical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.functions import units as U
from mensura.operators import classify as C
from mensura.operators import quality as Q
from mensura.operators import spatial as P
from mensura.plans.domain import ORD
from mensura.plans.registry import register, rounded
from mensura.plans.scalar import WORDS
from mensura.plans.space import SQUARES, ZONES, _squares
from mensura.sources.adapters import ORDINAL

KIND = "CASE unit WHEN 'm2' THEN 'AREA' WHEN 'ml' THEN 'LENGTH' WHEN 'un' THEN 'BLOCK' ELSE 'GLOBAL' END"
FOLD = lambda c: f"trim(strip_accents(lower({c})))"
VALUES = lambda rows: ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
KEYS = VALUES([(k, s, i, w.replace("ñ", "n")) for k, t in C.SUBTYPES.items() for i, (s, ws) in enumerate(t.items()) for w in ws])
LEVEL = r"CASE WHEN list_contains(regexp_split_to_array(t, '\s+'), kw) THEN 3 WHEN contains(t, kw) THEN 2 WHEN len(list_filter(string_split(kw, ' '), lambda w: NOT contains(t, w))) = 0 THEN 1 ELSE 0 END"


def _kind(b):
    return b.withColumn("kind", F.expr(KIND))


@register("cat1_subtypes", f"""WITH k(kind, subtype, ord, kw) AS (VALUES {KEYS}), b AS (SELECT row_index, {KIND} AS kind, {FOLD('description')} AS t FROM bill_items),
m AS (SELECT row_index, subtype, ord, max({LEVEL}) AS level, count(*) FILTER ({LEVEL} > 0) AS n FROM b JOIN k USING (kind) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY level DESC, n DESC, ord) AS rn FROM m WHERE level > 0)
SELECT row_index, coalesce(max(subtype) FILTER (rn = 1), CASE kind WHEN 'LENGTH' THEN 'generic_length' WHEN 'BLOCK' THEN 'generic_block' ELSE 'generic_area' END) AS subtype,
  CASE max(level) FILTER (rn = 1) WHEN 3 THEN 0.95 WHEN 2 THEN 0.85 WHEN 1 THEN 0.75 ELSE 0.3 END::DOUBLE AS confidence, coalesce(string_agg(subtype, ',' ORDER BY rn) FILTER (rn IN (2, 3)), '') AS alternatives
FROM b LEFT JOIN r USING (row_index) GROUP BY row_index, kind""", "bill_items")
def _(b):
    s = _kind(b).select("row_index", C.subtype(F.col("description"), F.col("kind")).alias("s"))
    return s.select("row_index", "s.subtype", "s.confidence", F.array_join("s.alternatives", ",").alias("alternatives"))


@register("cat2_keyword_levels", f"""WITH b AS (SELECT DISTINCT {FOLD('description')} AS t FROM bill_items), k(kw) AS (VALUES ('piso'), ('tabiqu'), ('ceramico blue'), ('acero viga')) SELECT t, kw, {LEVEL} AS level FROM b, k""", "bill_items")
def _(b):
    t = b.select(C.folded(F.col("description")).alias("t")).distinct().withColumn("w", F.split("t", r"\s+"))
    rows = F.array(*[F.struct(F.lit(k).alias("kw"), C.keyword_level(F.col("t"), F.col("w"), k).alias("level")) for k in ("piso", "tabiqu", "ceramico blue", "acero viga")])
    return t.select("t", F.inline(rows))


SHEET = "CASE " + " ".join(f"WHEN regexp_matches(trim(lower(name)), '{'|'.join(p)}') THEN '{d}'" for d, p in C.SHEETS.items()) + " END"
ITEM_KEYS = VALUES([(d, i, k) for i, (d, k) in enumerate((d, k) for d, ks in C.DISCIPLINES.items() for k in ks)])
PREFIX = "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with(lower(layer), '{p}')" for p in ps) + f" THEN '{d}'" for d, ps in C.LAYER_PREFIXES.items()) + " ELSE 'UNKNOWN' END"


@register("cat7_sheet_discipline", f"SELECT DISTINCT name, {SHEET} AS discipline FROM (SELECT layer AS name FROM takeoff_rows UNION SELECT description FROM bill_items)", "takeoff_rows", "bill_items")
def _(rows, b):
    names = rows.select(F.col("layer").alias("name")).unionByName(b.select(F.col("description").alias("name"))).distinct()
    return names.select("name", C.sheet_discipline(F.col("name")).alias("discipline"))


ITEM_DISCIPLINE = f"""k(discipline, ord, kw) AS (VALUES {ITEM_KEYS}), i AS (SELECT row_index, discipline, kw, row_number() OVER (PARTITION BY row_index ORDER BY length(kw) DESC, ord) AS rn FROM bill_items JOIN k ON contains(strip_accents(lower(description)), kw))"""


@register("cat7_item_discipline", f"WITH {ITEM_DISCIPLINE} SELECT row_index, discipline, CASE WHEN length(kw) > 8 THEN 'high' ELSE 'medium' END AS confidence, kw AS keyword FROM i WHERE rn = 1", "bill_items")
def _(b):
    return b.select("row_index", C.item_discipline(F.col("description")).alias("d")).where("d IS NOT NULL").select("row_index", "d.*")


@register("cat6_inferred_discipline", f"""WITH {ITEM_DISCIPLINE}, s AS (SELECT row_index, description, CASE WHEN row_index % 4 = 0 THEN 'Hoja ' || description END AS name, CASE WHEN row_index % 3 = 0 THEN 'arq-' || unit ELSE unit END AS layer FROM bill_items),
d AS (SELECT s.row_index, {SHEET} AS sheet, i.discipline AS item, i.kw, nullif({PREFIX}, 'UNKNOWN') AS lay FROM s LEFT JOIN i ON s.row_index = i.row_index AND rn = 1)
SELECT row_index, coalesce(sheet, item, lay, 'UNKNOWN') AS discipline, CASE WHEN sheet IS NOT NULL THEN 'high' WHEN item IS NOT NULL THEN CASE WHEN length(kw) > 8 THEN 'high' ELSE 'medium' END WHEN lay IS NOT NULL THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN sheet IS NOT NULL THEN 'sheet_name' WHEN item IS NOT NULL THEN 'item_keywords' WHEN lay IS NOT NULL THEN 'layer_patterns' ELSE 'fallback' END AS source FROM d""", "bill_items")
def _(b):
    sheet = F.when(F.col("row_index") % 4 == 0, F.concat(F.lit("Hoja "), "description"))
    layer = F.when(F.col("row_index") % 3 == 0, F.concat(F.lit("arq-"), "unit")).otherwise(F.col("unit"))
    return b.select("row_index", C.infer_discipline(sheet, F.col("description"), layer).alias("d")).select("row_index", "d.*")


@register("agg36_layer_discipline_votes", f"WITH l AS (SELECT DISTINCT layer FROM takeoff_rows) SELECT {PREFIX} AS discipline, count(*) AS n FROM l GROUP BY 1", "takeoff_rows")
def _(rows):
    return rows.select("layer").distinct().groupBy(C.layer_discipline(F.col("layer")).alias("discipline")).agg(F.count("*").alias("n"))


WRITTEN = "CASE row_index % 6 WHEN 0 THEN upper(unit) WHEN 1 THEN unit || '.' WHEN 2 THEN ' ' || unit || ' ' WHEN 3 THEN replace(unit, 'm', 'm ,') WHEN 4 THEN unit || ';' ELSE nullif(unit, '') END"
UNIT_VALUES = VALUES(sorted(C.unit_table().items()))


@register("unt3_validated_units", rf"""WITH u(w, unit) AS (VALUES {UNIT_VALUES}), b AS (SELECT row_index, {WRITTEN} AS raw FROM bill_items), s AS (SELECT *, regexp_replace(trim(lower(raw)), '\s+', ' ', 'g') AS own FROM b), p AS (SELECT *, regexp_replace(own, '[.,;:]', '', 'g') AS plain FROM s),
h AS (SELECT row_index, raw, own, a.unit AS a, c.unit AS c, d.unit AS d FROM p LEFT JOIN u a ON a.w = own LEFT JOIN u c ON c.w = plain LEFT JOIN u d ON d.w = replace(plain, ' ', ''))
SELECT row_index, coalesce(a, c, d) AS unit, CASE WHEN a IS NOT NULL THEN 1.0 WHEN c IS NOT NULL THEN 0.95 WHEN d IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN raw IS NULL OR raw = '' THEN 'no_unit' WHEN coalesce(a, c, d) IS NOT NULL THEN NULL WHEN regexp_matches(own, '^[a-z]{{1,4}}[0-9²³]?[.]?$') THEN 'invalid_unit' WHEN own = '' OR length(own) > 30 THEN 'no_unit' ELSE 'invalid_unit' END AS skip_reason FROM h""", "bill_items")
def _(b):
    return b.select("row_index", C.validate_unit(F.expr(WRITTEN)).alias("v")).select("row_index", "v.*")


@register("unt4_unit_variants", f"WITH u(w, unit) AS (VALUES {UNIT_VALUES}), b AS (SELECT DISTINCT unit AS own FROM bill_items) SELECT unit, count(*) AS variants, count(own) AS used FROM u LEFT JOIN b ON own = w GROUP BY unit", "bill_items")
def _(b):
    table = b.sparkSession.createDataFrame(sorted(C.unit_table().items()), "w string, unit string")  # a fixed dictionary
    return table.join(b.select(F.col("unit").alias("w"), F.lit(1).alias("one")).distinct(), "w", "left").groupBy("unit").agg(F.count("*").alias("variants"), F.count("one").alias("used"))


TYPE = "CASE unit WHEN 'm2' THEN 'AREA' WHEN 'ml' THEN 'LENGTH' WHEN 'm3' THEN 'VOLUME' WHEN 'un' THEN 'BLOCK' WHEN 'gl' THEN 'GLOBAL' ELSE 'UNKNOWN' END"


@register("unt9_type_matches", f"WITH k(kind) AS (VALUES ('BLOCK'), ('LENGTH'), ('TEXT'), ('AREA'), ('VOLUME')) SELECT row_index, {TYPE} AS expected, kind, CASE {TYPE} WHEN 'UNKNOWN' THEN true WHEN 'GLOBAL' THEN false ELSE kind = {TYPE} END AS ok FROM bill_items, k", "bill_items")
def _(b):
    e = b.select("row_index", C.expected_type(F.col("unit")).alias("expected"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("BLOCK", "LENGTH", "TEXT", "AREA", "VOLUME")]))
    return e.withColumn("kind", kinds).withColumn("ok", C.type_matches(F.col("kind"), F.col("expected")))


@register("unt7_compatible_types", f"SELECT {ORD}, type = 'block' AS count_, type = 'length' AS length_, type IN ('area', 'length') AS area_, false AS global_ FROM cad_items", "cad_items")
def _(items):
    ok = lambda m: F.coalesce(C.is_compatible(F.col("type"), F.lit(m)), F.lit(False)).alias(f"{m.lower()}_")
    return items.select(*ORDINAL, *[ok(m) for m in ("COUNT", "LENGTH", "AREA", "GLOBAL")])


@register("unt13_converted", f"SELECT {ORD}, round(value_si * 0.0254, 6) AS metres, round(value_si * 0.00064516, 6) AS square, round(value_si * 0.0254 * 0.0254 * 0.0254, 9) AS cubic FROM cad_items", "cad_items")
def _(items):
    f = F.lit(0.0254)
    out = items.select(*ORDINAL, (F.col("value_si") * f).alias("metres"), (F.col("value_si") * F.lit(0.00064516)).alias("square"), (F.col("value_si") * f * f * f).alias("cubic"))
    return rounded(rounded(out, "metres", "square"), "cubic", digits=9)


@register("unt14_conversion_issues", f"""WITH c AS (SELECT {ORD}, value_si * 1000 AS raw, CASE WHEN l_partkey % 5 = 0 THEN value_si ELSE value_si * 1000 * CASE l_linenumber % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 0.000001 ELSE 0.001 * 0.001 * 0.001 END END * CASE WHEN l_partkey % 7 = 0 THEN 1.02 ELSE 1 END AS si, CASE l_linenumber % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'area' ELSE 'volume' END AS kind FROM cad_items WHERE value_si > 0),
r AS (SELECT *, CASE kind WHEN 'length' THEN 0.001 WHEN 'area' THEN 0.001 * 0.001 ELSE 0.001 * 0.001 * 0.001 END AS want FROM c) SELECT {ORD}, CASE WHEN abs(si / raw - want) > 0.01 * want THEN 'mismatch' WHEN kind = 'length' AND si > 100000 THEN 'large' WHEN kind = 'area' AND si > 10000000 THEN 'large' END AS issue FROM r""", "cad_items")
def _(items):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "length").when(F.col("l_linenumber") % 3 == 1, "area").otherwise("volume")
    raw, f = F.col("value_si") * 1000, F.lit(0.001)
    power = F.when(kind == "length", f).when(kind == "area", F.lit(0.000001)).otherwise(f * f * f)
    si = F.when(F.col("l_partkey") % 5 == 0, F.col("value_si")).otherwise(raw * power) * F.when(F.col("l_partkey") % 7 == 0, 1.02).otherwise(1.0)
    return items.where("value_si > 0").select(*ORDINAL, C.conversion_issue(raw, si, kind, f).alias("issue"))


UNIT_NAMES = ["Millimeters", "mm", "Centimetres", "CM", "Meters", "Inches", "in", "Foot", "ft", "parsec"]


@register("unt17_unit_codes", "SELECT row_index, CASE row_index % 10 WHEN 0 THEN 'mm' WHEN 1 THEN 'mm' WHEN 2 THEN 'cm' WHEN 3 THEN 'cm' WHEN 5 THEN 'in' WHEN 6 THEN 'in' WHEN 7 THEN 'ft' WHEN 8 THEN 'ft' ELSE 'm' END AS code FROM bill_items", "bill_items")
def _(b):
    name = F.get(F.array(*[F.lit(n) for n in UNIT_NAMES]), (F.col("row_index") % 10).cast("int"))
    return b.select("row_index", C.unit_code(name).alias("code"))


@register("flt23_evaluated_lengths", f"""WITH s AS (SELECT {ORD}, (l_partkey % 60) / 100.0 AS len, l_linenumber % 2 = 0 AS note, (l_suppkey % 20) / 10.0 AS med, (l_orderkey % 10) / 10.0 AS short, l_suppkey % 3 = 0 AS sole, CASE l_partkey % 4 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'LENGTH' ELSE 'AREA' END AS method FROM cad_items),
t AS (SELECT *, NOT note AND med > 1.0 AS real, CASE WHEN NOT note AND med > 1.0 THEN 0.10 WHEN method = 'LENGTH' THEN 0.10 WHEN NOT note AND short < 0.5 THEN 0.25 ELSE 0.5 END AS lim FROM s)
SELECT {ORD}, method = 'GLOBAL' OR len >= lim OR (sole AND len >= 0.01) OR (real AND len >= 0.05) AS valid, method <> 'GLOBAL' AND len < lim AND ((sole AND len >= 0.01) OR (real AND len >= 0.05)) AS suspect, CASE WHEN method = 'GLOBAL' THEN 0.0 ELSE lim END::DOUBLE AS threshold FROM t""", "cad_items")
def _(items):
    c = F.col
    method = F.when(c("l_partkey") % 4 == 0, "GLOBAL").when(c("l_partkey") % 4 == 1, "LENGTH").otherwise("AREA")
    e = C.evaluate_length(c("l_partkey") % 60 / 100, c("l_linenumber") % 2 == 0, c("l_suppkey") % 20 / 10, c("l_orderkey") % 10 / 10, c("l_suppkey") % 3 == 0, method)
    return items.select(*ORDINAL, e.alias("e")).select(*ORDINAL, "e.*")


@register("flt31_wall_fallback", f"SELECT row_index, NOT row_index % 5 = 0 AND NOT {WORDS('lower(description)', C.HORIZONTAL_WORDS)} AS ok FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", C.wall_fallback(F.when(F.col("row_index") % 5 == 0, "HORIZONTAL"), F.col("description")).alias("ok"))


GATE = "CASE row_index % 4 WHEN 0 THEN 'area' WHEN 1 THEN 'length' WHEN 2 THEN 'block' ELSE 'text' END AS e, CASE row_index % 3 WHEN 0 THEN 'direct_area' WHEN 1 THEN 'length_x_height' END AS m"


@register("qty14_approval_gates", f"WITH g AS (SELECT row_index, unit, {GATE} FROM bill_items) SELECT row_index, coalesce(CASE WHEN unit = 'm2' THEN (e = 'area' AND m = 'direct_area') OR (e = 'length' AND m = 'length_x_height') WHEN unit = 'un' THEN e = 'block' WHEN unit = 'ml' THEN e = 'length' ELSE true END, false) AS approved FROM g", "bill_items")
def _(b):
    r = F.col("row_index")
    e = F.when(r % 4 == 0, "area").when(r % 4 == 1, "length").when(r % 4 == 2, "block").otherwise("text")
    m = F.when(r % 3 == 0, "direct_area").when(r % 3 == 1, "length_x_height")
    return b.select("row_index", C.approval_gate(F.col("unit"), e, m).alias("approved"))


@register("cat14_service_scope", f"SELECT row_index, CASE WHEN {WORDS('lower(description)', ['instalacion', 'instalación', 'tramite', 'trámite', 'legaliz'])} THEN 0.95 WHEN row_index % 9 = 0 THEN 0.9 END::DOUBLE AS confidence FROM bill_items", "bill_items")
def _(b):
    unit = F.when(F.col("row_index") % 9 == 0, "por Mandante").otherwise(F.col("unit"))
    return b.select("row_index", C.service_scope(F.col("description"), unit).alias("confidence"))


@register("qty23_length_sanity", "SELECT id, CASE WHEN qty_final / 20 < 0.5 THEN 'pending_no_geometry' WHEN qty_final / 20 < 2.0 OR qty_final / 20 > 5000 THEN 'pending' WHEN qty_final / 20 >= 1.0 THEN 'approved' ELSE status END AS status FROM staging_rows", "staging_rows")
def _(s):
    return s.select("id", C.length_sanity(F.col("status"), F.col("qty_final") / 20).alias("status"))


@register("qty2_derived_area_possible", "SELECT DISTINCT description, true AS ok FROM bill_items WHERE (contains(lower(description), 'muro') OR contains(lower(description), 'tabique')) AND NOT contains(lower(description), 'piso') AND NOT contains(lower(description), 'cielo')", "bill_items")
def _(b):
    d = F.lower("description")
    own = b.where((d.contains("muro") | d.contains("tabique")) & ~d.contains("piso") & ~d.contains("cielo")).select("description").distinct()
    return own.select("description", (Q.orientation(F.col("description")) == "vertical").alias("ok"))


@register("agg16_annotation_scores", f"""WITH p AS (SELECT layer, avg(CASE WHEN value_si < 40 THEN 1.0 ELSE 0.0 END) AS short, min(value_si) AS med, avg(CASE WHEN type = 'text' THEN 1.0 ELSE 0.0 END) AS texts, count(DISTINCT floor(x / 10))::DOUBLE / count(*) AS clusters, sum(value_si) / 100 AS total FROM cad_items GROUP BY layer),
f AS (SELECT layer, CASE WHEN short > 0.7 THEN 0.3 ELSE 0 END AS w1, CASE WHEN med < 10 THEN 0.25 ELSE 0 END AS w2, CASE WHEN texts > 0.3 THEN 0.2 ELSE 0 END AS w3, CASE WHEN clusters > 0.5 THEN 0.15 ELSE 0 END AS w4, CASE WHEN total < 60 THEN 0.1 ELSE 0 END AS w5, * FROM p)
SELECT layer, round(CASE WHEN w1 + w2 + w3 + w4 + w5 > 0 THEN (w1 * short + w2 * (1 - med / 10) + w3 * texts + w4 * clusters + w5 * (1 - total / 60)) / (w1 + w2 + w3 + w4 + w5) ELSE 0.5 END, 6)::DOUBLE AS score FROM f""", "cad_items")
def _(items):
    ratio = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    p = items.groupBy("layer").agg(ratio(F.col("value_si") < 40).alias("short"), F.min("value_si").alias("med"), ratio(F.col("type") == "text").alias("texts"), (F.count_distinct(F.floor(F.col("x") / 10)) / F.count("*")).alias("clusters"), (F.sum("value_si") / 100).alias("total"))
    return rounded(p.select("layer", C.annotation_score(F.col("short"), F.col("med"), F.col("texts"), F.col("clusters"), F.col("total"), F.lit(30.0)).alias("score")), "score")


@register("agg14_extents", "SELECT layer, round(max(x) - min(x), 6) AS width, round(max(y) - min(y), 6) AS height, round(sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))), 6) AS diagonal FROM cad_items GROUP BY layer", "cad_items")
def _(items):
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return rounded(items.groupBy("layer").agg(w.alias("width"), h.alias("height"), F.sqrt(w * w + h * h).alias("diagonal")), "width", "height", "diagonal")


@register("cat12_orientation", f"SELECT {ORD}, CASE WHEN l_linenumber % 3 = 0 AND l_partkey % 2 = 1 THEN 'vertical' WHEN l_linenumber % 3 = 1 THEN 'horizontal' WHEN l_linenumber % 3 = 2 THEN CASE WHEN l_partkey % 2 = 1 THEN 'vertical' ELSE 'horizontal' END ELSE 'unknown' END AS orientation FROM segments", "segments")
def _(s):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "LINE").when(F.col("l_linenumber") % 3 == 1, "HATCH").otherwise("3DFACE")
    return s.select(*ORDINAL, C.orientation_of(kind, F.lit(0.0), (F.col("l_partkey") % 2).cast("double")).alias("orientation"))


@register("str7_layer_words", f"SELECT DISTINCT layer, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(layer), '[-_.\\s]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in C.NOISE)})))), ' ') AS words FROM cad_items", "cad_items")
def _(items):
    return items.select("layer").distinct().select("layer", F.array_join(F.array_sort(C.layer_words(F.col("layer"))), " ").alias("words"))


@register("str11_feedback_text", r"SELECT row_index, strip_accents(regexp_replace(trim(lower(description)), '\s+', ' ', 'g')) AS words FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", C.feedback_text(F.concat(F.lit("  "), "description")).alias("words"))


@register("str5_fixed_encoding", "SELECT row_index, row_index % 3 = 0 AS broken, description AS fixed FROM bill_items", "bill_items")
def _(b):
    t = F.when(F.col("row_index") % 3 == 0, F.concat(F.lit("�"), "description", F.lit("\u0085"))).otherwise(F.col("description"))
    return b.select("row_index", T.has_encoding_issues(t).alias("broken"), C.fix_encoding(t).alias("fixed"))


RECT = "sqrt(power(greatest(x0 - x, 0, x - x1), 2) + power(greatest(y0 - y, 0, y - y1), 2))"


@register("jn9_nearest_polygon", f"WITH {SQUARES}, d AS (SELECT p.id, zone, {RECT} AS dist FROM points p, z WHERE p.id % 25 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist, 9), zone) AS rn FROM d WHERE dist <= 4) SELECT id, zone, round(dist, 6) AS dist FROM r WHERE rn = 1", "points")
def _(p):
    return rounded(P.nearest_polygon(p.where(f"NOT ({ZONES})").select("id", "x", "y"), _squares(p), "id", 4.0), "dist")


TEXTS = f"""{SQUARES}, d AS (SELECT zone, p.id, {RECT} AS edge, sqrt(power(x - (x0 + x1) / 2, 2) + power(y - (y0 + y1) / 2, 2)) AS mid FROM points p, z WHERE p.id % 25 <> 0),
k AS (SELECT zone, id, CASE WHEN edge = 0 THEN 'inside' WHEN mid <= 5 THEN 'near_centroid' ELSE 'near_boundary' END AS how, CASE WHEN edge = 0 THEN 1.0 WHEN mid <= 5 THEN 1 / (1 + mid) ELSE 1 / (1 + edge) END AS relevance FROM d WHERE edge = 0 OR mid <= 5 OR edge <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY round(relevance, 9) DESC, id) AS rn FROM k)"""


@register("jn10_texts_of_regions", f"WITH {TEXTS} SELECT zone, id, how, round(relevance, 6) AS relevance FROM r WHERE rn <= 10", "points")
def _(p):
    return rounded(P.texts_of_regions(_squares(p), p.where(f"NOT ({ZONES})").select("id", "x", "y"), 5.0).select("zone", "id", "how", "relevance"), "relevance")


@register("agg47_text_coverage", f"WITH {TEXTS}, n AS (SELECT z.zone, count(id) FILTER (rn <= 10) AS n FROM z LEFT JOIN r USING (zone) GROUP BY 1) SELECT count(*) AS regions, count(*) FILTER (n > 0) AS covered, round(avg(n), 6) AS mean FROM n", "points")
def _(p):
    zones = _squares(p)
    own = P.texts_of_regions(zones, p.where(f"NOT ({ZONES})").select("id", "x", "y"), 5.0).groupBy("zone").agg(F.count("*").alias("n"))
    n = zones.select("zone").join(own, "zone", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rounded(n.agg(F.count("*").alias("regions"), F.count_if(F.col("n") > 0).alias("covered"), F.avg("n").alias("mean")), "mean")


@register("qty21_best_region", f"""WITH {SQUARES}, d AS (SELECT p.id, zone, {RECT} AS dist, (x1 - x0) * (y1 - y0) AS area FROM points p, z WHERE p.id % 25 <> 0), s AS (SELECT id, zone, CASE WHEN dist = 0 THEN 0.4 ELSE greatest(0.0, 0.3 * (1 - dist / 5)) END
  + CASE WHEN area / 31 BETWEEN 0.8 AND 1.2 THEN 0.3 WHEN area / 31 BETWEEN 0.5 AND 2.0 THEN 0.15 WHEN area / 31 BETWEEN 0.2 AND 5 THEN 0.05 ELSE 0 END + 0.2 + CASE WHEN area BETWEEN 1 AND 200 THEN 0.1 WHEN area BETWEEN 0.5 AND 500 THEN 0.05 ELSE 0 END AS score FROM d WHERE dist <= 5)
SELECT id, arg_min(zone, (-round(score, 6), zone)) AS zone, round(max(score), 6)::DOUBLE AS score FROM s WHERE score >= 0.3 GROUP BY id""", "points")
def _(p):
    area = P.shoelace(F.col("vertices"))
    best = P.best_polygon(p.where(f"NOT ({ZONES})").select("id", "x", "y"), _squares(p), "id", 5.0, lambda inside, dist: C.region_score(inside, dist, area, F.lit(31.0), F.lit(1.0)))
    return best.where("score >= 0.3").select("id", "zone", F.round("score", 6).alias("score"))


@register("jn32_region_layers", f"WITH {SQUARES}, n AS (SELECT zone, layer, count(*) AS n FROM z JOIN segments ON (s0 + s1) / 2 BETWEEN x0 AND x1 AND (t0 + t1) / 2 BETWEEN y0 AND y1 GROUP BY ALL) SELECT zone, arg_min(layer, (-n, layer)) AS layer, max(n) AS n FROM n GROUP BY zone".replace("JOIN segments ON", "JOIN (SELECT x1 / 4 AS s0, x2 / 4 AS s1, y1 / 4 AS t0, y2 / 4 AS t1, layer FROM segments) s ON"), "points", "segments")
def _(p, s):
    mid = s.select("layer", ((F.col("x1") + F.col("x2")) / 8).alias("x"), ((F.col("y1") + F.col("y2")) / 8).alias("y"))
    at = mid.groupBy("x", "y", "layer").agg(F.count("*").alias("m"))
    met = P.near_polygons(at, _squares(p), 0.0).groupBy("zone", "layer").agg(F.sum("m").alias("n"))
    return met.groupBy("zone").agg(F.min_by("layer", F.struct((-F.col("n")).alias("m"), "layer")).alias("layer"), F.max("n").alias("n"))


@register("dst7_regions_by_area", f"WITH {SQUARES}, a AS (SELECT zone, (x1 - x0) * (y1 - y0) AS area FROM z) SELECT round(area, 2) AS area, min(zone) AS zone FROM a GROUP BY 1", "points")
def _(p):
    return _squares(p).groupBy(F.round(P.shoelace(F.col("vertices")), 2).alias("area")).agg(F.min("zone").alias("zone"))


@register("geo3_hatch_area", f"WITH {SQUARES} SELECT zone, round(greatest((x1 - x0) * (y1 - y0) - 1.0, 0), 6)::DOUBLE AS area FROM z", "points")
def _(p):
    hole = F.transform(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]), lambda v: v)
    return rounded(_squares(p).select("zone", P.ring_area(F.array("vertices", hole)).alias("area")), "area")


@register("geo7_insert_transforms", f"SELECT {ORD}, x1 AS x, y1 AS y, CASE WHEN l_partkey % 3 = 0 THEN 1.0 ELSE (l_partkey % 3)::DOUBLE END AS sx, 1.0::DOUBLE AS sy, (l_suppkey % 360)::DOUBLE AS rotation FROM segments", "segments")
def _(s):
    t = P.insert_transform(F.col("x1"), F.col("y1"), (F.col("l_suppkey") % 360).cast("double"), (F.col("l_partkey") % 3).cast("double"), F.lit(None).cast("double"))
    return s.select(*ORDINAL, t.alias("t")).select(*ORDINAL, "t.x", "t.y", "t.sx", "t.sy", "t.rotation")


@register("jn3_first_samples", f"WITH r AS (SELECT layer, type, name_raw, {ORD}, row_number() OVER (PARTITION BY layer ORDER BY {ORD}) AS rn FROM cad_items WHERE type <> 'text') SELECT layer, type, name_raw FROM r WHERE rn = 1", "cad_items")
def _(items):
    return items.where("type <> 'text'").groupBy("layer").agg(F.min_by(F.struct("type", "name_raw"), F.struct(*ORDINAL)).alias("s")).select("layer", "s.*")


@register("jn36_selected_alternative", "WITH s AS (SELECT layer, sum(CASE WHEN type = 'area' THEN value_si ELSE 0 END) AS a, sum(CASE WHEN type = 'length' THEN value_si ELSE 0 END) AS l, sum(CASE WHEN type = 'block' THEN value_si ELSE 0 END) AS b FROM cad_items GROUP BY layer), t AS (SELECT DISTINCT layer FROM takeoff_rows) SELECT layer, round(coalesce(nullif(a, 0), nullif(l, 0), b), 6) AS qty FROM s JOIN t USING (layer)", "cad_items", "takeoff_rows")
def _(items, rows):
    total = lambda k: F.sum(F.when(F.col("type") == k, F.col("value_si")).otherwise(0.0))
    s = items.groupBy("layer").agg(total("area").alias("a"), total("length").alias("l"), total("block").alias("b"))
    return rounded(s.join(rows.select("layer").distinct(), "layer").select("layer", F.coalesce(F.nullif("a", F.lit(0.0)), F.nullif("l", F.lit(0.0)), "b").alias("qty")), "qty")


@register("qty4_zone_override", "WITH z AS (SELECT zone, sum(value_si) AS area FROM cad_items WHERE type = 'area' GROUP BY zone) SELECT row_index, round(CASE WHEN qty % 3 = 0 THEN area ELSE qty END, 6) AS qty, CASE WHEN qty % 3 = 0 THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT row_index, qty, (['FRANCE', 'CHINA', 'PERU'])[1 + row_index % 3] AS zone FROM bill_items) LEFT JOIN z USING (zone)", "bill_items", "cad_items")
def _(b, items):
    z = items.where("type = 'area'").groupBy("zone").agg(F.sum("value_si").alias("area"))
    own = b.withColumn("zone", F.get(F.array(F.lit("FRANCE"), F.lit("CHINA"), F.lit("PERU")), (F.col("row_index") % 3).cast("int"))).join(z, "zone", "left")
    small = F.col("qty") % 3 == 0
    return rounded(own.select("row_index", F.when(small, F.col("area")).otherwise(F.col("qty")).alias("qty"), F.when(small, 0.95).otherwise(0.5).alias("confidence")), "qty")


@register("agg6_exploded_totals", "SELECT layer, name_raw, type, CASE WHEN type IN ('block', 'text') THEN count(*)::DOUBLE ELSE round(sum(value_si), 6) END AS total FROM cad_items GROUP BY layer, name_raw, type", "cad_items")
def _(items):
    total = F.when(F.col("type").isin("block", "text"), F.count("*").cast("double")).otherwise(F.round(F.sum("value_si"), 6))
    return items.groupBy("layer", "name_raw", "type").agg(total.alias("total"))


@register("agg8_loose_lines", "SELECT layer, zone, round(sum(value_si), 6) AS total, bool_or(value_si < 5) AS suspect FROM cad_items WHERE type = 'length' GROUP BY 1, 2", "cad_items")
def _(items):
    return rounded(items.where("type = 'length'").groupBy("layer", "zone").agg(F.sum("value_si").alias("total"), F.bool_or(F.col("value_si") < 5).alias("suspect")), "total")


@register("agg17_layer_profiles", "SELECT layer, count(*) AS entities, round(sum(value_si), 6) AS total, count(*) FILTER (value_si < 10) AS short FROM cad_items GROUP BY layer", "cad_items")
def _(items):
    return rounded(items.groupBy("layer").agg(F.count("*").alias("entities"), F.sum("value_si").alias("total"), F.count_if(F.col("value_si") < 10).alias("short")), "total")


@register("agg38_validation_stats", "SELECT unit, count(*) AS n, count(*) FILTER (qty > 40) AS errors, round(avg(qty), 6) AS mean, round(100.0 * count(*) FILTER (qty > 40) / count(*), 6)::DOUBLE AS error_rate FROM bill_items GROUP BY unit", "bill_items")
def _(b):
    bad = F.count_if(F.col("qty") > 40)
    return rounded(b.groupBy("unit").agg(F.count("*").alias("n"), bad.alias("errors"), F.avg("qty").alias("mean"), (bad * 100.0 / F.count("*")).alias("error_rate")), "mean", "error_rate")


@register("srt11_coverage_by_count", "SELECT layer, n, row_number() OVER (ORDER BY n DESC, layer) AS place FROM (SELECT layer, count(*) AS n FROM cad_items GROUP BY layer)", "cad_items")
def _(items):
    # One row for each layer: the order of a report.
    return items.groupBy("layer").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "layer")).cast("long"))


@register("srt12_suggestions", "WITH r AS (SELECT layer, name_raw, count(*) AS n, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, name_raw) AS rn FROM cad_items GROUP BY layer, name_raw) SELECT layer, string_agg(name_raw, '|' ORDER BY rn) AS suggestions FROM r WHERE rn <= 3 GROUP BY layer", "cad_items")
def _(items):
    n = items.groupBy("layer", "name_raw").agg(F.count("*").alias("n"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("n"), "name_raw"))).where("rn <= 3")
    return top.groupBy("layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name_raw"))), lambda s: s["name_raw"]), "|").alias("suggestions"))


@register("snk5_coverage_csv", """SELECT layer || ',' || count(*) || ',' || (CASE WHEN max(value_si) > 50 THEN 'yes' ELSE 'no' END) AS line FROM cad_items GROUP BY layer""", "cad_items")
def _(items):
    return items.groupBy("layer").agg(F.count("*").alias("n"), F.max("value_si").alias("m")).select(F.concat_ws(",", "layer", F.col("n").cast("string"), F.when(F.col("m") > 50, "yes").otherwise("no")).alias("line"))


@register("snk6_mappings_export", """SELECT '"' || replace(item_text, '"', '""') || '",' || layer || ',' || times_used AS line FROM learned_mappings""", "learned_mappings")
def _(m):
    quoted = F.concat(F.lit('"'), F.replace("item_text", F.lit('"'), F.lit('""')), F.lit('"'))
    return m.select(F.concat_ws(",", quoted, "layer", F.col("times_used").cast("string")).alias("line"))


@register("set5_labels_and_texts", "SELECT label, count(*) AS n FROM (SELECT label FROM points UNION ALL SELECT name_raw FROM cad_items WHERE type = 'text') GROUP BY label", "points", "cad_items")
def _(p, items):
    return p.select("label").unionByName(items.where("type = 'text'").select(F.col("name_raw").alias("label"))).groupBy("label").agg(F.count("*").alias("n"))
