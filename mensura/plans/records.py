"""Cells, JSON, encodings, versions, counters, rules, names of blocks, signatures, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.functions import units as U
from mensura.operators import matching as M
from mensura.operators import spatial as P
from mensura.operators import takeoff as K
from mensura.operators import versions as V
from mensura.plans.domain import HEADER, NON_MEASURABLE
from mensura.plans.registry import SQL, register, rounded
from mensura.plans.space import SQUARES, _squares
from mensura.sources import files as S
from mensura.sources import workbook as W


def _cells(b):
    """Every bill as the cells of 20 workbooks: a note on a first sheet, the header in row 3, an item in each row from 10 on."""
    cell = lambda col, text, number=None: F.struct(F.lit(col).alias("col"), text.alias("text"), (F.lit(None).cast("double") if number is None else number).alias("number"))
    rows = b.select((F.col("row_index") % 20).cast("string").alias("file"), F.lit(1).alias("sheet_index"), F.lit("Presupuesto").alias("sheet"), (F.col("row_index") + 10).cast("int").alias("row"), F.inline(F.array(
        cell(1, F.concat(F.lit(" "), "description")), cell(2, F.col("unit")), cell(3, F.col("qty").cast("string"), F.col("qty")), cell(4, F.concat(F.lit("$ "), F.regexp_replace(F.round("price", 2).cast("string"), r"\.", ","))))))
    names = F.array(*[cell(i + 1, F.lit(n)) for i, n in enumerate(["Descripción", "Unidad", "Cantidad", "Precio"])])
    books = b.select((F.col("row_index") % 20).cast("string").alias("file")).distinct()
    head = books.select("file", F.lit(1).alias("sheet_index"), F.lit("Presupuesto").alias("sheet"), F.lit(3).alias("row"), F.inline(names))
    note = books.select("file", F.lit(0).alias("sheet_index"), F.lit("Notas").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("Descripción y unidad").alias("text"), F.lit(None).cast("double").alias("number"))
    return rows.unionByName(head).unionByName(note)


ROW_TYPE = "CASE unit WHEN '' THEN 'section_header' WHEN 'gl' THEN 'service' ELSE 'item' END"


@register("src1_bill_of_cells", f"SELECT (row_index % 20)::VARCHAR AS file, row_index + 10 AS row_index, trim(description) AS description, unit, qty, round(price, 2) AS price, {ROW_TYPE} AS row_type FROM bill_items", "bill_items")
def _(b):
    return W.bill_items(_cells(b)).select("file", F.col("row_index").cast("long").alias("row_index"), "description", "unit", "qty", F.round("price", 2).alias("price"), "row_type")


@register("src2_header_rows", "SELECT DISTINCT (row_index % 20)::VARCHAR AS file, 3 AS header, 4 AS roles FROM bill_items", "bill_items")
def _(b):
    return W.header(W.bill_sheet(_cells(b))).select("file", "header", F.size("roles").alias("roles"))


@register("src3_mapping_scores", """WITH r AS (SELECT row_index % 20 AS file, unit, row_number() OVER (PARTITION BY row_index % 20 ORDER BY row_index) AS rn FROM bill_items)
SELECT file::VARCHAR AS file, round(0.7 * avg(CASE WHEN unit IN ('', 'kg') THEN 0 ELSE 1 END) + 0.3, 6) AS score FROM r WHERE rn <= 30 GROUP BY file""", "bill_items")
def _(b):
    return rounded(W.mapping_score(W.bill_items(_cells(b))), "score")


@register("src4_unit_scores", "WITH r AS (SELECT row_index % 20 AS file, row_index % 3 = 0 AS odd, row_number() OVER (PARTITION BY row_index % 20 ORDER BY row_index) AS rn FROM bill_items WHERE unit <> '') SELECT file::VARCHAR AS file, round(100 * avg(CASE WHEN odd THEN 0 ELSE 1 END), 6) AS score FROM r WHERE rn <= 20 GROUP BY file", "bill_items")
def _(b):
    odd = b.withColumn("unit", F.when((F.col("row_index") % 3 == 0) & (F.col("unit") != ""), F.concat("unit", F.lit("?"))).otherwise(F.col("unit")))
    return rounded(W.unit_score(W.bill_items(_cells(odd))), "score")


@register("src7_excluded_items", "SELECT row_index, row_index % 3 = 0 AS excluded FROM bill_items", "bill_items")
def _(b):
    text = F.when(F.col("row_index") % 3 == 0, F.concat("description", F.lit(" (NO COTIZAR)"))).otherwise(F.col("description"))
    return b.select("row_index", W.excluded(text).alias("excluded"))


@register("src21_decoded_texts", "SELECT row_index, description || ' €' AS text FROM bill_items", "bill_items")
def _(b):
    text = F.concat("description", F.lit(" €"))
    western = F.concat(F.encode(F.col("description"), "ISO-8859-1"), F.unhex(F.lit("2080")))
    return b.select("row_index", S.decoded(F.when(F.col("row_index") % 2 == 0, F.encode(text, "UTF-8")).otherwise(western)).alias("text"))


@register("src24_items_from_json", "SELECT zone, layer, count(*) AS n, round(sum(value_si), 6) AS value FROM cad_items WHERE type = 'area' GROUP BY zone, layer", "cad_items")
def _(items):
    parts = items.where("type = 'area'").groupBy("zone", "l_orderkey").agg(F.to_json(F.collect_list(F.struct("layer", "value_si"))).alias("value"))
    files = parts.select(F.col("zone").alias("file"), "value").unionByName(parts.select(F.col("zone").alias("file"), F.lit('{"layer": "x"}').alias("value")))
    out = S.json_items(files, "layer string, value_si double").groupBy(F.col("file").alias("zone"), "layer").agg(F.count("*").alias("n"), F.sum("value_si").alias("value"))
    return rounded(out, "value")


@register("udf6_batch_snapshots", "SELECT id % 50 AS batch_id, CASE WHEN id % 50 < 10 THEN 4 ELSE 1 END AS version_number, count(*) AS n_rows FROM staging_rows GROUP BY 1, 2", "staging_rows")
def _(r):
    rows = r.withColumn("batch_id", F.col("id") % 50)
    before = rows.where("batch_id < 10").select("batch_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("version_number")).distinct()
    return V.create_snapshots(rows, before, "match", "user").select("batch_id", "version_number", "n_rows")


@register("udf7_restored_rows", "SELECT id, qty_final, round(match_confidence, 6) AS match_confidence, status FROM staging_rows", "staging_rows")
def _(r):
    rows = r.select((F.col("id") % 50).alias("batch_id"), "id", "qty_final", F.col("match_confidence").cast("double").alias("match_confidence"), "status")
    none = rows.select("batch_id", F.lit(1).alias("version_number")).limit(0)
    back = V.restore(V.create_snapshots(rows, none, "match", "user"), rows.schema).where("batch_id % 2 = 0")
    changed = rows.withColumn("status", F.when(F.col("batch_id") % 2 == 0, "changed").otherwise(F.col("status")))
    return rounded(V.replace_batches(changed, back).drop("batch_id"), "match_confidence")


@register("udf8_usage_counters", "SELECT target, any_value(CAST(target AS BIGINT) % 3) + count(*) FILTER (correction = 'accept') AS times_used FROM matching_feedback GROUP BY target", "matching_feedback")
def _(f):
    table = f.select("target").distinct().withColumn("times_used", F.col("target").cast("long") % 3)
    return V.increment(table, ["target"], "times_used", f.where("correction = 'accept'"))


@register("udf2_broken_rules", "SELECT row_index, concat_ws(',', CASE WHEN price < 950.5 OR price > 1000 THEN 'price_range' END, CASE WHEN qty < 5 OR qty > 40 THEN 'qty_range' END) AS broken FROM bill_items", "bill_items")
def _(b):
    rules = b.sparkSession.createDataFrame([("qty_range", "range", '{"field": "qty", "min": 5, "max": 40}', True), ("price_range", "range", '{"field": "price", "min": 950.5, "max": 1000}', True), ("off", "range", '{"field": "qty", "min": 99, "max": 99}', False)], "id string, rule_type string, config string, enabled boolean")
    return V.broken_rules(b.select("row_index", "qty", "price"), rules, "row_index").select("row_index", F.array_join("broken", ",").alias("broken"))


NAME = "CASE l_partkey % 5 WHEN 0 THEN '*U' || l_partkey WHEN 1 THEN 'Puerta ' || name_raw WHEN 2 THEN 'LUM_' || l_partkey WHEN 3 THEN name_raw ELSE 'ab' END"
TRUST = f"""b AS (SELECT DISTINCT {NAME} AS name, layer FROM cad_items WHERE type = 'block'),
g AS (SELECT *, regexp_matches(name, '{V.GENERIC_BLOCKS}') AS gen, regexp_matches(name, '{V.TRUSTED_BLOCKS}') OR regexp_matches(name, '{V.TRUSTED_CODES}') AS tru, lower(trim(layer)) IN ({', '.join(repr(x) for x in V.UNTRUSTED_LAYERS)}) AS poor FROM b),
t AS (SELECT name, layer, CASE WHEN gen THEN 'none' WHEN poor AND NOT tru THEN 'low' WHEN tru THEN 'high' WHEN length(name) > 2 AND NOT poor THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN gen THEN 1.0 WHEN poor AND NOT tru THEN 0.8 WHEN tru THEN 0.0 WHEN length(name) > 2 AND NOT poor THEN 0.1 ELSE 0.5 END::DOUBLE AS penalty FROM g)"""


def _trust(items):
    b = items.where("type = 'block'").select(F.expr(NAME).alias("name"), "layer").distinct()
    return b.select("name", "layer", V.block_trust(F.col("name"), F.col("layer")).alias("t")).select("name", "layer", "t.confidence", "t.penalty")


@register("cat3_block_trust", f"WITH {TRUST} SELECT * FROM t", "cad_items")
def _(items):
    return _trust(items)


@register("cat4_block_approval", f"WITH {TRUST} SELECT name, layer, confidence = 'high' AS automatic, penalty FROM t", "cad_items")
def _(items):
    return _trust(items).select("name", "layer", (F.col("confidence") == "high").alias("automatic"), "penalty")


@register("agg40_block_classes", f"WITH {TRUST} SELECT confidence, count(*) AS n, round(avg(penalty), 6) AS penalty FROM t GROUP BY confidence", "cad_items")
def _(items):
    return rounded(_trust(items).groupBy("confidence").agg(F.count("*").alias("n"), F.avg("penalty").alias("penalty")), "penalty")


NEAR = lambda c: f"floor({c} / 0.01 + 0.5)::BIGINT"


@register("dst2_polygon_signatures", f"WITH {SQUARES}, s AS (SELECT zone, list_sort([[{NEAR('x0')}, {NEAR('y0')}], [{NEAR('x0')}, {NEAR('y1')}], [{NEAR('x1')}, {NEAR('y0')}], [{NEAR('x1')}, {NEAR('y1')}]]) AS c FROM z) SELECT zone, array_to_string(list_transform(c, lambda p: p[1] || ',' || p[2]), '|') AS signature FROM s", "points")
def _(p):
    return _squares(p).select("zone", P.polygon_signature(F.col("vertices")).alias("signature"))


@register("geo5_composed_transforms", """SELECT id, round(x - 2 * y, 6) AS x, round(y + 3 * x, 6) AS y, 120.0::DOUBLE AS rotation, 2 * 0.5::DOUBLE AS sx, 3 * 0.5::DOUBLE AS sy FROM points""", "points")
def _(p):
    t = lambda x, y, r, sx, sy: F.struct(x.alias("x"), y.alias("y"), F.lit(r).alias("rotation"), F.lit(sx).alias("sx"), F.lit(sy).alias("sy"))
    out = p.select("id", P.compose(t(F.col("x"), F.col("y"), 90.0, 2.0, 3.0), t(F.col("x"), F.col("y"), 30.0, 0.5, 0.5)).alias("t")).select("id", "t.*")
    return rounded(out, "x", "y")


@register("geo6_transformed_points", "SELECT id, round(5 - 3 * y, 6) AS x, round(6 + 2 * x, 6) AS y FROM points", "points")
def _(p):
    t = F.struct(F.lit(5.0).alias("x"), F.lit(6.0).alias("y"), F.lit(90.0).alias("rotation"), F.lit(2.0).alias("sx"), F.lit(3.0).alias("sy"))
    return rounded(p.select("id", P.transform_point(F.struct("x", "y"), t).alias("q")).select("id", "q.x", "q.y"), "x", "y")


@register("flt3_non_measurable_layers", f"SELECT DISTINCT layer, {NON_MEASURABLE} AS skipped FROM takeoff_rows", "takeoff_rows")
def _(rows):
    return rows.select("layer").distinct().select("layer", U.is_non_measurable(F.col("layer")).alias("skipped"))


@register("flt17_section_headers", f"SELECT row_index, {HEADER} AS header FROM bill_items", "bill_items")
def _(b):
    return b.select("row_index", M.is_header(F.col("description"), F.col("unit")).alias("header"))


@register("str10_clean_drawing_text", "SELECT row_index, description || ' fin' AS text FROM bill_items", "bill_items")
def _(b):
    raw = F.concat(F.lit("{\\fArial|b0;"), "description", F.lit("}\\Pfin\\H2.5x; "))
    return b.select("row_index", T.clean_drawing_text(raw).alias("text"))
