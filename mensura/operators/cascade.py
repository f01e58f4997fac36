"""From a matched layer to a quantity: the whole cascade with method and evidence, then status, reason and alternatives.

The rules are ordered branches of one case expression per step; the steps are columns of one projection, so a bill is read once and nothing
moves but the rows of layers and zones, which are joined before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.operators import quality as Q
from mensura.operators import service as V
from mensura.operators import versions as R

#: Words of walls, of level surfaces (no default height), of level surfaces with small areas; units of counts; height and thickness by default.
WALL_WORDS = ["tabique", "sobretabique", "muro", "empaste", "huincha", "pintura tabique", "enlucido", "estuco", "revoco", "revestimiento muro", "ceramico muro", "ceramica muro"]
LEVEL_WORDS = ["losa", "cielo", "impermeabilizacion", "cubierta", "radier", "piso", "terraza", "techo"]
SMALL_WORDS = ["piso", "losa", "sobrelosa", "pavimento", "cielo"]
COUNT_UNITS, UNIT_ITEMS, HEIGHT, THICKNESS = ["un", "gl", "u"], ["un", "u", "gl", "und", "unidad"], 2.4, 0.1
#: Kinds of geometry that a calculation expects.
KINDS = {"AREA": "AREA", "LENGTH": "LENGTH", "COUNT": "BLOCK", "VOLUME": "VOLUME"}


def zone_registry(items: DataFrame) -> DataFrame:
    """(zone_key, zone_area): the largest area of each named zone."""
    areas = items.where("type = 'area' AND value_si > 0 AND zone <> ''")
    return areas.groupBy(F.upper("zone").alias("zone_key")).agg(F.max("value_si").alias("zone_area"))


def with_zone_area(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds zone_area of the zone that a description asks for, null without one."""
    own = rows.withColumn("_zone", F.upper(V.zone_intent(F.col("description"))))
    return own.join(registry, F.col("_zone") == F.col("zone_key"), "left").drop("_zone", "zone_key")


def _first(*branches: tuple[Column, Column, str, Column | str, Column]) -> Column:
    """struct<qty, method, evidence, confidence, height> of the first branch that holds: (condition, qty, method, evidence, confidence)."""
    out = None
    for when, qty, method, evidence, confidence, *height in branches:
        s = F.struct(
            qty.cast("double").alias("qty"), F.lit(method).alias("method"), (F.lit(evidence) if isinstance(evidence, str) else evidence).alias("evidence"),
            confidence.cast("double").alias("confidence"), (height[0] if height else F.lit(None)).cast("double").alias("height"),
        )
        out = F.when(when, s) if out is None else out.when(when, s)
    return out


def with_facts(rows: DataFrame) -> DataFrame:
    """Adds what descriptions and blocks tell: _turned, _height, _wall, _level, _small, _kept (what a block's name leaves of a confidence).

    Each different text is read once, however many rows have it, and the branches of the cascade get columns instead of pattern searches.
    """
    text = F.lower("description")
    said = rows.select("description").where("description IS NOT NULL").distinct().select(
        F.col("description").alias("_d"), Q.orientation(F.col("description")).alias("_turned"), F.coalesce(Q.wall_height(F.col("description")), F.lit(HEIGHT)).alias("_height"),
        *[T.contains_any(text, words).alias(name) for name, words in (("_wall", WALL_WORDS), ("_level", LEVEL_WORDS), ("_small", SMALL_WORDS))],
    )
    key = F.coalesce("name_raw", F.lit("")).alias("_n"), F.coalesce("layer", F.lit("")).alias("_l")
    trust = R.block_trust(F.col("_n"), F.col("_l"))
    blocks = rows.where("match_type = 'block'").select(*key).distinct().select("_n", "_l", F.when(trust["generic"], 1 - trust["penalty"]).otherwise(1.0).alias("_kept"))
    out = rows.join(said, F.col("description") == F.col("_d"), "left").drop("_d")
    out = out.join(blocks, (key[0] == F.col("_n")) & (key[1] == F.col("_l")), "left").drop("_n", "_l")
    return out.fillna({"_turned": "unknown", "_height": HEIGHT, "_wall": False, "_level": False, "_small": False, "_kept": 1.0})


def quantities(rows: DataFrame) -> DataFrame:
    """Adds qty, method, evidence, confidence and height to items beside their match.

    rows: calc (AREA, LENGTH, COUNT, VOLUME or another), description, unit, bill_qty, confidence, zone_area, and of the match: match_type (area, length,
    block, text; null without a match), value_si, block_area, name_raw, layer, total_area, total_length.
    """
    t, v, c = F.col("match_type"), F.col("value_si"), F.col("confidence")
    unit = F.lower(F.coalesce("unit", F.lit("")))
    square, area, length = unit.isin("m2", "m²"), F.coalesce("total_area", F.lit(0.0)), F.coalesce("total_length", F.lit(0.0))
    wall, level, turned, height, sure = F.col("_wall"), F.col("_level"), F.col("_turned"), F.col("_height"), c * F.col("_kept")
    one, zero, none = F.when(v != 0, v).otherwise(1.0), F.lit(0.0), F.lit(None)
    is_ = lambda calc, kind: (F.col("calc") == calc) & (t == kind)
    base = _first(
        (t.isNull(), F.col("bill_qty"), None, "none", c),
        (is_("COUNT", "length"), F.lit(1.0), None, "length", F.lit(0.2)),
        ((F.col("calc") == "COUNT") & unit.isin(COUNT_UNITS) & (t != "block"), zero, None, t, F.lit(0.3)),
        (is_("COUNT", "block") & (F.col("block_area") > 0) & square, one * F.col("block_area"), "block_area_times_count", "block", sure),
        (is_("COUNT", "block"), one, None, "block", sure),
        (F.col("calc") == "COUNT", zero, None, t, c),
        (F.col("calc") == "LENGTH", v, None, "length", c),
        (is_("AREA", "length") & (v > 0) & (turned == "vertical"), v * height, "length_x_height", "length", c, height),
        (is_("AREA", "length") & (turned == "horizontal") & (area > 0), area, "profile_area_horizontal", "area", c),
        (is_("AREA", "length") & (turned == "horizontal"), zero, None, "none", c),
        (is_("AREA", "length") & level, zero, "fallback_blocked_3d_horizontal", "none", c),
        (is_("AREA", "length"), v * HEIGHT, "length_x_height_default", "length", c, F.lit(HEIGHT)),
        (is_("AREA", "area"), v, "direct_area", "area", c),
        ((F.col("calc") == "AREA") & t.isin("block", "text") & (area > 0), area, "profile_area_from_block_layer", "area", c),
        ((F.col("calc") == "AREA") & t.isin("block", "text") & (length > 0) & wall, length * HEIGHT, "profile_length_x_height_from_block_layer", "length", c, F.lit(HEIGHT)),
        ((F.col("calc") == "AREA") & t.isin("block", "text"), none, "invalid_type_for_area", t, c),
        (F.col("calc") == "AREA", zero, "invalid_type_for_area", t, c),
        (F.col("calc") == "VOLUME", v * F.when(t == "length", HEIGHT).otherwise(1.0) * THICKNESS, None, "none", c),
        (F.lit(True), v, None, "none", c),
    )
    out = with_facts(rows).withColumn("_q", base)
    old, expected = (lambda k: F.col("_q")[k]), F.col("calc")
    # A zone's area stands in where the geometry gave none.
    zone = (expected == "AREA") & (F.coalesce(old("qty"), zero) <= 0.1) & (F.col("zone_area") > 0)
    method = {"AREA": ("direct_area", "area"), "LENGTH": ("direct_length", "length"), "COUNT": ("count_blocks", "block")}
    named = old("method").isNotNull() | t.isNull() | ~expected.isin(*method)
    pick = lambda i: F.when(expected == "AREA", method["AREA"][i]).when(expected == "LENGTH", method["LENGTH"][i]).otherwise(method["COUNT"][i])
    out = out.select(
        *[F.col(x) for x in rows.columns if x != "confidence"],
        "_small",
        F.when(zone, F.col("zone_area")).otherwise(old("qty")).alias("qty"),
        F.when(zone, "spatial_zone_area").when(named, old("method")).otherwise(pick(0)).alias("method"),
        F.when(zone, "area").when(named, old("evidence")).otherwise(pick(1)).alias("evidence"),
        F.when(zone, 0.95).otherwise(old("confidence")).alias("confidence"),
        old("height").alias("height"),
    )
    # Units are counted by blocks only; small level areas and quantities out of all bounds are doubtful.
    blocked = unit.isin(UNIT_ITEMS) & (F.col("evidence") != "block")
    out = out.withColumns({"qty": F.when(blocked, 0.0).otherwise(F.col("qty")), "confidence": F.when(blocked, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence"))})
    small = square & F.col("_small") & (F.col("qty") > 0) & (F.col("qty") < 5) & F.coalesce(F.col("method").contains("profile_area"), F.lit(False))
    wrong = Q.sanity(F.col("qty"), F.lower(F.col("measure")), F.col("description")) == "error"
    return out.withColumn("confidence", F.when(wrong, F.least("confidence", F.lit(0.3))).when(small, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence"))).drop("_small")


def fits(kind: Column, expected: Column) -> Column:
    """Whether a kind of geometry can give what is expected: lengths give areas, too."""
    return (kind == expected) | ((expected == "AREA") & (kind == "LENGTH")) | expected.isNull()


def statuses(rows: DataFrame) -> DataFrame:
    """Adds status and status_reason to rows of quantities()."""
    expected = F.when(F.col("calc") == "COUNT", "BLOCK").otherwise(F.col("calc"))
    none = F.coalesce("qty", F.lit(0.0)) == 0
    status = (
        F.when(F.col("match_type").isNull(), F.when(expected == "AREA", "pending_needs_layer_pick").when(expected == "GLOBAL", "pending_semantics").otherwise("pending_no_match"))
        .when((expected == "AREA") & (F.col("match_type") == "length") & (F.coalesce("height", F.lit(0.0)).isin(0.0, HEIGHT)), "pending_needs_height")
        .when(none, F.when(expected == "AREA", "pending_needs_layer_pick").otherwise("pending_no_geometry"))
        .when(expected.isin("AREA", "LENGTH", "BLOCK") & ~fits(F.upper("match_type"), expected), "pending_semantics")
        .when(F.col("confidence") >= 0.7, "approved").when(F.col("confidence") >= 0.4, "pending").otherwise("pending_semantics")
    )
    out = rows.withColumn("status", status)
    percent = F.concat(F.lit(" ("), F.floor(F.round(F.col("confidence") * 100, 9) + 0.5).cast("string"), F.lit("%)"))
    s = F.col("status")
    reason = (
        F.when(s == "approved", F.concat(F.lit("High confidence match"), percent)).when(s == "pending", F.concat(F.lit("Medium confidence - review recommended"), percent))
        .when(s == "pending_no_geometry", "No geometry found or quantity is zero").when(s == "pending_no_match", "No matching CAD items found")
        .when(s == "pending_semantics", F.concat(F.lit("Type or semantic mismatch - "), F.coalesce("calc_reason", F.lit(""))))
        .when(s == "pending_needs_layer_pick", "No suitable area layers found - please select a layer manually")
        .when(s == "pending_needs_height", "Wall/surface requires height to calculate m² - please configure height or approve default (2.4m)")
    )
    return out.withColumn("status_reason", reason)


def suggestions(candidates: DataFrame, most: int = 3) -> DataFrame:
    """(row_index, suggestions): up to `most` layers to use instead, by score, then a quantity by hand if none is good.

    candidates: row_index, expected, score (1 is best), layer, name_raw, match_type, value_si, unit_raw; a row without a layer stands for an item
    without candidates.  Only the best are gathered.
    """
    w = Window.partitionBy("row_index").orderBy(F.desc("score"), "layer", "name_raw", *[c for c in ("match_type", "calc", "value_si") if c in candidates.columns])
    best = candidates.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    percent = lambda x: F.floor(F.round(x * 100, 9) + 0.5).cast("string")
    kind = F.upper("match_type")
    reasons = F.array_compact(F.array(
        F.when(F.col("score") > 0.3, F.concat(F.lit("Similar name/layer ("), percent(F.col("score")), F.lit("% match)"))),
        F.when(fits(kind, F.col("expected")), F.concat(F.lit("Type matches expected ("), F.coalesce("expected", F.lit("UNKNOWN")), F.lit(")"))).otherwise(F.concat(F.lit("Type mismatch: found "), "match_type", F.lit(", expected "), "expected")),
        F.when(F.lower("layer").isin("0", "defpoints"), "Layer 0/Defpoints (High Risk)"),
        F.when(F.col("value_si") > 0, F.concat(F.lit("Qty: "), F.format_number(F.col("value_si"), 2), F.lit(" "), F.coalesce("unit_raw", F.lit("")))),
    ))
    label = F.concat(F.lit('Use "'), F.coalesce("name_raw", F.lit("")), F.lit('" from layer "'), "layer", F.lit('"'))
    sure = F.when(F.col("score") > 0.6, "high").when(F.col("score") > 0.3, "medium").otherwise("low")
    one = F.struct("rn", F.lit("SELECT_ALT_LAYER").alias("action"), label.alias("label"), sure.alias("confidence"), reasons.alias("reasons"))
    by = best.groupBy("row_index").agg(F.array_sort(F.collect_list(F.when(F.col("layer").isNotNull(), one))).alias("s"), F.max(F.when(F.col("layer").isNotNull(), F.col("score"))).alias("top"))
    hand = F.struct(F.lit(most + 1).alias("rn"), F.lit("MANUAL_QTY").alias("action"), F.lit("Enter quantity manually").alias("label"), F.lit("medium").alias("confidence"), F.array().cast("array<string>").alias("reasons"))
    every = F.when(F.coalesce("top", F.lit(0.0)) < 0.3, F.concat("s", F.array(hand))).otherwise(F.col("s"))
    return by.select("row_index", F.transform(F.slice(every, 1, most), lambda x: F.struct(x["action"].alias("action"), x["label"].alias("label"), x["confidence"].alias("confidence"), x["reasons"].alias("reasons"))).alias("suggestions"))


#: Gates with their severity and what to do.
GATE_ACTIONS = {
    "low_confidence": ("warning", "Review: low_confidence"), "type_mismatch": ("error", "Select a layer with the expected geometry type"), "zero_quantity": ("error", "Review: zero_quantity"),
    "outlier": ("warning", "Verify the quantity"), "layer_zero": ("warning", "Select a named layer"),
}


def gate_suggestions(gates: Column) -> Column:
    """array<struct<id,action,label,confidence>>: what to do about each failed gate."""

    def of(g: Column) -> Column:
        pick = lambda i, other: _case(g, {k: v[i] for k, v in GATE_ACTIONS.items()}, other)
        severity = pick(0, F.lit("info"))
        return F.struct(
            F.concat(F.lit("quality_"), g).alias("id"), F.lit("REVIEW_QUALITY").alias("action"), pick(1, F.concat(F.lit("Review: "), g)).alias("label"),
            F.when(severity == "error", "high").when(severity == "warning", "medium").otherwise("low").alias("confidence"),
        )

    return F.transform(gates, of)


def _case(c: Column, values: dict[str, str], other: Column) -> Column:
    for k, v in reversed(values.items()):
        other = F.when(c == k, v).otherwise(other)
    return other
