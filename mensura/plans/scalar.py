"""Scalar functions over the logical tables: text, units, categories, quality, rows of bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.functions import units as U
from mensura.operators import quality as Q
from mensura.plans.domain import GROUP, NORM, RELATED, TOKENS
from mensura.plans.registry import register, rounded
from mensura.sources import files as S

WORDS = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
LIST = lambda words: ", ".join(f"'{w}'" for w in words)


@register("str1_normalize_text", rf"SELECT row_index, {NORM('description')} AS norm FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", T.normalize_text(F.col("description")).alias("norm"))


@register("str2_normalize_layer", r"SELECT DISTINCT layer, trim(regexp_replace(replace(lower(strip_accents(layer)), '_', '-'), '\s+', ' ', 'g')) AS norm FROM takeoff_rows", "takeoff_rows")
def _(r):
    return r.select("layer").distinct().select("layer", T.normalize_layer(F.col("layer")).alias("norm"))


@register("str3_normalize_block", r"SELECT row_index, trim(regexp_replace(strip_accents(description), '\s+', ' ', 'g')) AS norm FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", T.normalize_block(F.col("description")).alias("norm"))


@register("str4_normalize_description", r"SELECT row_index, trim(regexp_replace(regexp_replace(strip_accents(lower(description)), '[^a-z0-9.,\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", T.normalize_description(F.col("description")).alias("norm"))


@register("str6_keywords", rf"SELECT row_index, array_to_string(list_filter(string_split({NORM('description')}, ' '), lambda t: length(t) > 2 AND t NOT IN ({LIST(T.STOPWORDS)})), ' ') AS words FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", F.array_join(T.keywords(F.col("description")), " ").alias("words"))


@register("str9_normalize_for_learning", r"SELECT DISTINCT layer, trim(regexp_replace(regexp_replace(strip_accents(lower(layer)), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM takeoff_rows", "takeoff_rows")
def _(r):
    return r.select("layer").distinct().select("layer", T.normalize_for_learning(F.col("layer")).alias("norm"))


@register("sim2_expand_tokens", rf"WITH m AS (SELECT {RELATED} AS m), a AS (SELECT row_index, {TOKENS(NORM('description'))} AS a FROM bill_items) SELECT row_index, array_to_string(list_sort(list_distinct(list_concat(a, flatten(list_transform(a, lambda t: coalesce(m[t], [])))))), ' ') AS words FROM a, m", "bill_items")
def _(b):
    return b.select("row_index", F.array_join(F.array_sort(F.array_distinct(T.expand(T.tokens(T.normalize_text(F.col("description")))))), " ").alias("words"))


@register("sim4_jaccard", rf"""WITH d AS (SELECT DISTINCT string_split(description, ' ')[1] || ' ' || string_split(description, ' ')[2] AS d FROM bill_items), l AS (SELECT DISTINCT layer FROM takeoff_rows), p AS (SELECT d, layer, {TOKENS(NORM('d'))} AS a, {TOKENS(NORM('layer'))} AS b FROM d, l)
SELECT d, layer, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS s FROM p""", "bill_items", "takeoff_rows")
def _(b, r):
    # Both sides are the distinct names of a dictionary; the pairs are its whole table.
    d = b.select(F.concat_ws(" ", F.get(F.split("description", " "), 0), F.get(F.split("description", " "), 1)).alias("d")).distinct().withColumn("a", T.tokens(T.normalize_text(F.col("d"))))
    layers = r.select("layer").distinct().withColumn("b", T.tokens(T.normalize_text(F.col("layer"))))
    return d.join(F.broadcast(layers)).select("d", "layer", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("s"))


@register("cat8_item_trade", rf"SELECT row_index, {GROUP(NORM('description'), U.ITEM_TRADES)} AS trade FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", U.item_trade(F.col("description")).alias("trade"))


@register("cat8_layer_trade", rf"SELECT DISTINCT layer, {GROUP(NORM('layer'), U.LAYER_TRADES, True)} AS trade FROM takeoff_rows", "takeoff_rows")
def _(r):
    return r.select("layer").distinct().select("layer", U.layer_trade(F.col("layer")).alias("trade"))


UNIT = "CASE " + " ".join(f"WHEN u IN ({LIST(ws)}) THEN '{{}}'".replace("{}", k) for k, (_, ws) in U.UNITS.items()) + " END"
UKIND = "CASE " + " ".join(f"WHEN u IN ({LIST(ws)}) THEN '{kind}'" for kind, ws in U.UNITS.values()) + " ELSE 'unknown' END"
CLEAN = r"regexp_replace(regexp_replace(replace(replace(replace(replace(lower(trim(unit)), '²', '2'), '³', '3'), '^2', '2'), '^3', '3'), '\s+', ' ', 'g'), '[.,;:]', '', 'g')"


@register("unt1_classify_unit", f"WITH c AS (SELECT row_index, unit, {CLEAN} AS u FROM bill_items) SELECT row_index, {UNIT} AS unit, {UKIND} AS kind, CASE WHEN {UNIT} IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN unit IS NULL OR trim(unit) = '' THEN 'no_unit' WHEN {UNIT} IS NULL THEN 'invalid_unit' END AS skip_reason FROM c", "bill_items")
def _(b):
    c = b.select("row_index", U.classify_unit(F.col("unit")).alias("c"))
    return c.select("row_index", "c.unit", "c.kind", "c.confidence", "c.skip_reason")


@register("unt2_requires_geometry", f"WITH c AS (SELECT row_index, {CLEAN} AS u FROM bill_items) SELECT row_index, {UKIND} NOT IN ('service', 'unknown') AS needed FROM c", "bill_items")
def _(b):
    return b.select("row_index", U.requires_geometry(U.classify_unit(F.col("unit"))["kind"]).alias("needed"))


@register("unt5_measure_kind", """SELECT row_index, CASE WHEN contains(lower(trim(unit)), 'm2') THEN 'area' WHEN lower(trim(unit)) IN ('m', 'ml', 'mt', 'metro', 'metros lineales') THEN 'length' WHEN lower(trim(unit)) IN ('un', 'u', 'pza', 'pieza', 'und', 'unidad') THEN 'count' WHEN lower(trim(unit)) IN ('gl', 'global', 'sg') THEN 'service' ELSE 'unknown' END AS kind FROM bill_items""", "bill_items")
def _(b):
    return b.select("row_index", U.measure_kind(F.col("unit")).alias("kind"))


TYPE = "coalesce(CASE " + " ".join(f"WHEN u IN ({LIST(U.UNITS[k][1])}) THEN '{t}'" for k, t in U.TYPES.items()) + " END, " + GROUP("lower(description)", U.TYPE_WORDS) + ")"


@register("unt8_item_type", f"WITH c AS (SELECT row_index, description, {CLEAN} AS u FROM bill_items) SELECT row_index, {TYPE} AS type FROM c", "bill_items")
def _(b):
    return b.select("row_index", U.item_type(F.col("description"), F.col("unit")).alias("type"))


METHOD = "CASE " + " ".join(f"WHEN lower(trim(unit)) IN ({LIST(us)}) THEN '{m}'" for m, us in Q.METHOD_UNITS.items()) + " END"
METHOD2 = "CASE " + " ".join(f"WHEN {WORDS('lower(description)', ws)} THEN '{m}'" for m, ws in Q.METHOD_WORDS.items()) + " END"


@register("unt6_calc_method", f"SELECT row_index, coalesce({METHOD}, {METHOD2}, 'GLOBAL') AS method, CASE WHEN {METHOD} IS NOT NULL THEN 0.99 WHEN {METHOD2} IS NOT NULL THEN 0.7 ELSE 0.1 END::DOUBLE AS confidence FROM bill_items", "bill_items")
def _(b):
    c = b.select("row_index", Q.calc_method(F.col("unit"), F.col("description")).alias("c"))
    return c.select("row_index", "c.method", "c.confidence")


@register("agg37_calc_method_stats", f"WITH c AS (SELECT coalesce({METHOD}, {METHOD2}, 'GLOBAL') AS method, CASE WHEN {METHOD} IS NOT NULL THEN 0.99 WHEN {METHOD2} IS NOT NULL THEN 0.7 ELSE 0.1 END::DOUBLE AS c FROM bill_items) SELECT method, count(*) AS n, round(avg(c), 6) AS confidence, count(*) FILTER (c < 0.5) AS low FROM c GROUP BY method", "bill_items")
def _(b):
    c = b.select(Q.calc_method(F.col("unit"), F.col("description")).alias("c")).select("c.*")
    return c.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.col("confidence") < 0.5).alias("low"))


ORIENT = f"CASE WHEN {WORDS('strip_accents(lower(description))', Q.VERTICAL_WORDS)} THEN 'vertical' WHEN {WORDS('strip_accents(lower(description))', Q.HORIZONTAL_WORDS)} THEN 'horizontal' ELSE 'unknown' END"


@register("cat9_orientation", f"SELECT row_index, {ORIENT} AS orientation FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", Q.orientation(F.col("description")).alias("orientation"))


@register("qty1_derived_area", f"SELECT row_index, round(CASE WHEN qty > 0 AND {ORIENT} = 'vertical' THEN qty * coalesce(CASE WHEN row_index % 3 = 0 THEN 3.2 END, 2.4) END, 6) AS area FROM bill_items", "bill_items")
def _(b):
    text = F.concat("description", F.when(F.col("row_index") % 3 == 0, " h=3,2").otherwise(""))
    return rounded(b.select("row_index", Q.derived_area(F.col("qty"), text).alias("area")), "area")


SANITY = f"""CASE WHEN q IS NULL THEN 'ok' WHEN q < 0 THEN 'error' WHEN kind = 'length' THEN CASE WHEN q > 10000 THEN 'error' WHEN q > 1000 OR (q < 0.01 AND q > 0) THEN 'warning' ELSE 'ok' END
  WHEN kind = 'area' THEN CASE WHEN {WORDS('lower(description)', Q.FLOOR_WORDS)} AND q < 1 AND q > 0 THEN 'error' WHEN q > 100000 THEN 'error' WHEN q > 10000 OR (NOT {WORDS('lower(description)', Q.FLOOR_WORDS)} AND q < 0.01 AND q > 0) THEN 'warning' ELSE 'ok' END
  WHEN kind = 'volume' THEN CASE WHEN q > 1000000 THEN 'error' WHEN q > 10000 THEN 'warning' ELSE 'ok' END WHEN kind = 'count' THEN CASE WHEN q <> floor(q) OR q > 500 THEN 'error' ELSE 'ok' END
  WHEN kind = 'service' THEN CASE WHEN q NOT IN (0, 1) THEN 'warning' ELSE 'ok' END ELSE 'ok' END"""
QTY = "CASE row_index % 6 WHEN 0 THEN NULL WHEN 1 THEN -qty WHEN 2 THEN qty / 10000 WHEN 3 THEN qty * 30000 WHEN 4 THEN qty * 500 ELSE qty END"


def _checked(b):
    q = F.when(F.col("row_index") % 6 == 0, None).when(F.col("row_index") % 6 == 1, -F.col("qty")).when(F.col("row_index") % 6 == 2, F.col("qty") / 10000).when(F.col("row_index") % 6 == 3, F.col("qty") * 30000).when(F.col("row_index") % 6 == 4, F.col("qty") * 500).otherwise(F.col("qty"))
    return b.withColumns({"q": q, "kind": U.classify_unit(F.col("unit"))["kind"]}).withColumn("severity", Q.sanity(F.col("q"), F.col("kind"), F.col("description")))


CHECKED = f"c AS (SELECT row_index, description, unit, {CLEAN} AS u, {QTY} AS q FROM bill_items), k AS (SELECT *, {UKIND} AS kind FROM c), s AS (SELECT *, {SANITY} AS severity FROM k)"


@register("qty8_sanity", f"WITH {CHECKED} SELECT row_index, severity FROM s", "bill_items")
def _(b):
    return _checked(b).select("row_index", "severity")


@register("agg39_batch_sanity", f"WITH {CHECKED} SELECT kind, count(*) AS n, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') AS errors FROM s GROUP BY kind", "bill_items")
def _(b):
    return _checked(b).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "error").alias("errors"))


@register("qty9_quality_gates", f"""WITH {CHECKED} SELECT row_index, concat_ws(',', CASE WHEN row_index % 10 < 4 THEN 'low_confidence' END, CASE WHEN kind = 'unknown' THEN 'type_mismatch' END, CASE WHEN q = 0 THEN 'zero_quantity' END, CASE WHEN severity = 'error' THEN 'outlier' END, CASE WHEN row_index % 13 = 0 THEN 'layer_zero' END) AS failures FROM s""", "bill_items")
def _(b):
    layer = F.when(F.col("row_index") % 13 == 0, "0").otherwise("a")
    return _checked(b).select("row_index", F.array_join(Q.gates((F.col("row_index") % 10) / 10, F.col("kind") != "unknown", F.col("q"), layer, F.col("severity")), ",").alias("failures"))


@register("qty11_status", f"WITH {CHECKED} SELECT row_index, CASE WHEN kind = 'unknown' THEN 'pending_type_mismatch' WHEN q IS NULL THEN 'pending_no_geometry' WHEN row_index % 10 >= 7 THEN 'approved' WHEN row_index % 10 >= 4 THEN 'pending' ELSE 'pending_no_match' END AS status FROM s", "bill_items")
def _(b):
    return _checked(b).select("row_index", Q.row_status((F.col("row_index") % 10) / 10, F.col("kind") != "unknown", F.col("q")).alias("status"))


ONE = lambda b: f"CASE WHEN q > {b[2]} THEN 'error' WHEN q < {b[0]} OR q > {b[1]} THEN 'warning' ELSE 'ok' END"
CONTEXT = "CASE " + " ".join(rf"WHEN regexp_matches(' ' || lower(description) || ' ', '[^a-z0-9_]({w})[^a-z0-9_]') THEN '{n}'" for n, w in Q.CONTEXTS.items()) + " ELSE 'general' END"
BOUND = "CASE WHEN q IS NULL OR q < 0 THEN 'error' " + " ".join(
    f"WHEN lower(trim(unit)) = '{u}' THEN " + (f"CASE WHEN q <> floor(q) THEN 'error' ELSE {ONE(by['general'])} END" if u in Q.WHOLE_UNITS else f"CASE ctx {' '.join(f'WHEN {n!r} THEN {ONE(b)}' for n, b in by.items() if n != 'general')} ELSE {ONE(by.get('general', next(iter(by.values()))))} END" if len(by) > 1 else ONE(by["general"]))
    for u, by in Q.BOUNDS.items()
) + " ELSE 'ok' END"


@register("qty6_context", f"SELECT row_index, {CONTEXT} AS context FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", Q.context(F.col("description")).alias("context"))


@register("qty5_bounds", f"WITH {CHECKED}, n AS (SELECT *, {CONTEXT} AS ctx FROM s) SELECT row_index, {BOUND} AS severity FROM n", "bill_items")
def _(b):
    return _checked(b).select("row_index", Q.bounds_check(F.col("q"), F.col("unit"), F.col("description")).alias("severity"))


@register("cat13_pricing_mode", f"SELECT row_index, CASE WHEN lower(unit) IN ('gl', 'glb', 'global') OR {WORDS('strip_accents(lower(description))', ['instalacion', 'servicio', 'mano de obra', 'flete'])} THEN 'service' ELSE 'material' END AS mode FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", Q.pricing_mode(F.col("unit"), F.col("description")).alias("mode"))


@register("src5_classify_row", f"WITH c AS (SELECT row_index, description, unit, {CLEAN} AS u FROM bill_items) SELECT row_index, CASE WHEN regexp_matches(lower(description), '^(nota|observacion)') THEN 'note' WHEN unit IS NULL OR trim(unit) = '' THEN 'section_header' WHEN {UKIND} = 'service' THEN 'service' ELSE 'item' END AS row_type FROM c", "bill_items")
def _(b):
    return b.select("row_index", S.classify_row(F.col("description"), F.col("unit")).alias("row_type"))


@register("src6_parse_number", r"WITH t AS (SELECT row_index, '$ ' || CAST(row_index AS VARCHAR) || ',' || CAST(row_index % 100 AS VARCHAR) || ' x' AS t FROM bill_items) SELECT row_index, CAST(CAST(row_index AS VARCHAR) || '.' || CAST(row_index % 100 AS VARCHAR) AS DOUBLE) AS v FROM t", "bill_items")
def _(b):
    text = F.concat(F.lit("$ "), F.col("row_index").cast("string"), F.lit(","), (F.col("row_index") % 100).cast("string"), F.lit(" x"))
    return b.select("row_index", S.parse_number(text).alias("v"))


@register("geo18_geometry_prior", "SELECT row_index, round(least(0.2, log10(qty + 1) * 0.066), 6) AS prior FROM bill_items", "bill_items")
def _(b):
    return rounded(b.select("row_index", Q.geometry_prior(F.col("qty")).alias("prior")), "prior")


@register("agg21_computed_quantity", f"""WITH g AS (SELECT zone, layer, coalesce(sum(value_si) FILTER (type = 'area'), 0.0) AS a, coalesce(sum(value_si) FILTER (type = 'length'), 0.0) AS l, coalesce(sum(value_si) FILTER (type = 'block'), 0.0) AS b FROM cad_items GROUP BY 1, 2)
SELECT zone, layer, round(CASE WHEN contains(layer, 'muro') AND l > 0 THEN l * 2.4 ELSE a END, 6) AS m2, round(l, 6) AS m, round(b, 6) AS un, 1.0::DOUBLE AS gl, 0.0::DOUBLE AS kg FROM g""", "cad_items")
def _(items):
    total = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("value_si"))), F.lit(0.0))
    g = items.groupBy("zone", "layer").agg(total("area").alias("a"), total("length").alias("l"), total("block").alias("b"))
    return g.select("zone", "layer", *[F.round(Q.computed_quantity(F.lit(u), F.col("a"), F.col("l"), F.col("b"), F.col("layer").contains("muro")), 6).alias(u) for u in ("m2", "m", "un", "gl", "kg")])
