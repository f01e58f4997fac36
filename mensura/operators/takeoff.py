"""Takeoff index, layer profiles, health and deduplication: aggregations whose partial sums meet in one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions.units import metres_factor
from mensura.sources.adapters import ORDINAL

AREA_TYPES, CLOSED_TYPES = ["Hatch", "Circle"], ["Polyline", "LwPolyline", "Region"]
LENGTH_TYPES = ["Line", "Polyline", "LwPolyline", "Arc", "Spline", "Circle"]


def half_up(c: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def ordinal() -> Column:
    return F.struct(*ORDINAL)


def reliable_area() -> Column:
    own = F.col("name").isin(AREA_TYPES) | (F.col("name").isin(CLOSED_TYPES) & F.coalesce(F.col("closed"), F.lit(False)))
    return F.when(own & (F.col("area") > 0), F.col("area") * F.col("cnt"))


def reliable_length() -> Column:
    return F.when(F.col("name").isin(LENGTH_TYPES) & (F.col("length") > 0), F.col("length") * F.col("cnt"))


def narrowed(values: DataFrame, rank: int, most: int = 100_000, bins: int = 4096) -> tuple[DataFrame, int]:
    """The part of values (one column v) that holds the element of a rank (from 0), and its rank there.

    Each round counts values in equal bins between the bounds and keeps the bin with the rank: at most `bins` rows come to
    the driver, and no task sees more than its share until few values are left.
    """
    while True:
        n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
        if n <= most or low == high:
            return values, rank
        at = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1))
        for b, count in sorted(map(tuple, values.groupBy(at.alias("b")).count().collect())):
            if rank < count:
                break
            rank -= count
        if count == n:
            return values, rank
        values = values.where(at == b)


def detect_unit(rows: DataFrame) -> DataFrame:
    """unit and confidence from the upper median of area * count: one row."""
    positive = rows.where("area > 0").select((F.col("area") * F.col("cnt")).alias("v"))
    few, rank = narrowed(positive, positive.count() // 2)
    upto = few.groupBy("v").count().withColumn("upto", F.sum("count").over(Window.orderBy("v")))
    median = upto.where(F.col("upto") >= rank + 1).agg(F.min("v").alias("median"))
    unit = F.when(F.col("median") > 1_000_000, "mm").when(F.col("median") > 1_000, "cm").otherwise("m")
    conf = F.when(F.col("median").isNull(), 0.0).when(F.col("median") > 1_000_000, 0.9).when(F.col("median") > 1_000, 0.7).otherwise(0.8)
    return median.select(F.round("median", 6).alias("median"), unit.alias("unit"), conf.alias("confidence"))


def layer_index(rows: DataFrame, unit: str = "m") -> DataFrame:
    """Totals of each layer in metres, with what kinds of entity it has and whether its sums can be relied on."""
    area, length = reliable_area(), reliable_length()
    af, lf = metres_factor(F.lit(unit))
    return rows.groupBy("layer").agg(
        F.sum("cnt").alias("entity_count"),
        F.coalesce(F.sum(area), F.lit(0.0)).alias("raw_area"),
        F.coalesce(F.sum(length), F.lit(0.0)).alias("raw_length"),
        (F.coalesce(F.sum(area), F.lit(0.0)) * af).alias("total_area"),
        (F.coalesce(F.sum(length), F.lit(0.0)) * lf).alias("total_length"),
        F.array_join(F.array_sort(F.collect_set("name")), ",").alias("entity_types"),
        (F.count(area) > 0).alias("has_area"),
        (F.count(length) > 0).alias("has_length"),
    )


def color_breakdown(rows: DataFrame) -> DataFrame:
    color = F.lower(F.coalesce(F.nullif(F.col("color"), F.lit("")), F.lit("ByLayer")))
    return rows.groupBy("layer", color.alias("color")).agg(
        F.sum("cnt").alias("cnt"), F.coalesce(F.sum(reliable_area()), F.lit(0.0)).alias("area"), F.coalesce(F.sum(reliable_length()), F.lit(0.0)).alias("length")
    )


def candidates(index: DataFrame, kind: str) -> DataFrame:
    keep = {"area": "has_area AND total_area > 0", "length": "has_length AND total_length > 0", "count": "entity_count > 0"}
    return index.where(keep[kind]) if kind in keep else index


def quantity(kind: Column) -> Column:
    return (
        F.when((kind == "area") & F.col("has_area"), F.col("total_area"))
        .when((kind == "length") & F.col("has_length"), F.col("total_length"))
        .when(kind == "count", F.col("entity_count"))
    )


def layer_profiles(items: DataFrame) -> DataFrame:
    of = lambda t: F.col("type") == t
    total = lambda t: F.coalesce(F.sum(F.when(of(t), F.col("value_si"))), F.lit(0.0))
    evidence = F.coalesce(F.col("evidence"), F.lit(""))
    return items.groupBy("layer").agg(
        total("area").alias("total_area"),
        total("length").alias("total_length"),
        total("block").alias("block_count"),
        F.count_if(of("area") & evidence.contains("HATCH")).alias("hatch_count"),
        F.count_if(of("area") & evidence.contains("closed")).alias("closed_poly_count"),
        F.count_if(of("text")).alias("text_count"),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("entity_types"),
        F.bool_or(of("area")).alias("has_area"),
        F.bool_or(of("length")).alias("has_length"),
        F.bool_or(of("block")).alias("has_block"),
    )


def support(kind: str) -> Column:
    """Whether a layer's profile can give the kind, and what it falls back to."""
    by_length = F.col("has_length") & (F.col("total_length") > 0)
    if kind in ("UNKNOWN", "GLOBAL"):
        ok, fallback = F.lit(True), F.lit(None)
    elif kind == "AREA":
        direct = F.col("has_area") & (F.col("total_area") > 0.01)
        ok = direct | by_length
        fallback = F.when(direct, None).when(by_length, "convert_length_to_area").when(F.col("has_block"), "explode_blocks")
    elif kind == "LENGTH":
        ok, fallback = by_length, F.lit(None)
    elif kind == "BLOCK":
        ok, fallback = F.col("has_block") & (F.col("block_count") > 0), F.lit(None)
    else:
        ok, fallback = F.lit(False), F.lit(None)
    return F.struct(ok.alias("supported"), fallback.cast("string").alias("fallback"))


def samples(items: DataFrame, most: int = 3) -> DataFrame:
    """The first few items of each layer and type."""
    w = Window.partitionBy("layer", "type").orderBy(*ORDINAL)
    return items.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def aggregate_items(items: DataFrame) -> DataFrame:
    """Sums of items by type, name and layer; the first item gives the other columns; texts go."""
    return items.where("type <> 'text'").groupBy("type", "name_raw", "layer").agg(F.sum("value_si").alias("value_si"), F.min_by("zone", ordinal()).alias("zone"), F.count("*").alias("n_items"))


def by_layer_and_zone(items: DataFrame) -> DataFrame:
    return items.where("type in ('area', 'length')").groupBy("layer", "zone", "type").agg(F.sum("value_si").alias("value_si"))


def zone_registry(items: DataFrame) -> DataFrame:
    return items.where("type = 'area' AND value_si > 0 AND zone IS NOT NULL").groupBy(F.upper("zone").alias("zone")).agg(F.max("value_si").alias("area"))


def footprints(items: DataFrame) -> DataFrame:
    """Layers by how well they outline the building: large, few polygons, much of the bounding box."""
    area = items.where("type = 'area'")
    box = area.agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("box"))
    by = area.groupBy("layer").agg(F.sum("value_si").alias("area"), F.max("value_si").alias("largest"), F.count("*").alias("n"))
    coverage = F.when(F.col("box") > 0, F.col("area") / F.col("box")).otherwise(0.0)
    single = F.when(F.col("area") > 0, F.col("largest") / F.col("area")).otherwise(0.0)
    score = F.least(F.lit(1.0), F.col("area") / 1000) * 0.4 + coverage * 0.3 + (1 - F.least(F.lit(1.0), F.col("n") / 10)) * 0.2 + single * 0.1
    return by.join(F.broadcast(box)).select("layer", "area", "largest", F.col("n").alias("polygons"), score.alias("score"))


def bounding_box(items: DataFrame) -> DataFrame:
    """One row; 0 .. 100 where no item has a place."""
    out = items.agg(*[F.coalesce(f(c), F.lit(d)).alias(n) for n, f, c, d in (("min_x", F.min, "x", 0.0), ("max_x", F.max, "x", 100.0), ("min_y", F.min, "y", 0.0), ("max_y", F.max, "y", 100.0))])
    return out.withColumn("diagonal", F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))


def health(items: DataFrame) -> DataFrame:
    """Verdict on the whole drawing from its totals and largest layers: one row."""
    by = items.groupBy("layer").agg(F.sum(F.when(F.col("type") == "area", F.col("value_si"))).alias("area"), F.sum(F.when(F.col("type") == "length", F.col("value_si"))).alias("length"), F.max(F.when(F.col("type") == "area", F.col("value_si"))).alias("largest"))
    top = by.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("total_area"), F.coalesce(F.max("area"), F.lit(0.0)).alias("top_area"), F.coalesce(F.max("length"), F.lit(0.0)).alias("top_length"), F.coalesce(F.max("largest"), F.lit(0.0)).alias("footprint"), (F.count("area") > 0).alias("has_area"), (F.count("length") > 0).alias("has_length"))
    one = top.join(F.broadcast(bounding_box(items).select("diagonal")))
    small = (F.col("footprint") < 5) & (F.col("total_area") < 5)
    empty = ~((F.col("top_area") > 10) | (F.col("top_length") > 20))
    status = (
        F.when(F.col("total_area") > 1_000_000, "warning")
        .when((F.col("diagonal") < 1) | empty | (small & (F.col("has_area") | ~F.col("has_length"))), "critical")
        .when(F.col("diagonal") > 5000, "warning")
        .otherwise("healthy")
    )
    return one.withColumn("status", status)


def top_layers(items: DataFrame, kind: str, most: int = 3) -> DataFrame:
    by = items.where(F.col("type") == kind).groupBy("layer").agg(F.sum("value_si").alias("total"), F.count("*").alias("n"))
    return by.orderBy(F.desc("total"), "layer").limit(most)


def micro_lengths(items: DataFrame) -> DataFrame:
    """Lengths below 0.5 that occur more than 20 times on a layer look like symbols."""
    v = half_up(F.col("value_si"), 3)
    w = Window.partitionBy("layer", "_v")
    own = items.where("type = 'length' AND value_si < 0.5 * 100").withColumn("_v", v)
    return own.withColumn("n", F.count("*").over(w)).select(*ORDINAL, "layer", F.col("_v").alias("rounded"), (F.col("n") > 20).alias("suspect"))


def deduplicate_areas(items: DataFrame, annotation: Column) -> DataFrame:
    """First item of each (layer, area, centre); then a layer that only annotates gives way to one that measures the same area."""
    area = items.where("type = 'area'").withColumns({"_a": half_up(F.col("value_si"), 2), "_x": half_up(F.col("x"), 1), "_y": half_up(F.col("y"), 1), "_note": annotation})
    first = area.withColumn("_rn", F.row_number().over(Window.partitionBy("layer", "_a", "_x", "_y").orderBy(*ORDINAL))).where("_rn = 1")
    measured = F.max((~F.col("_note")).cast("int")).over(Window.partitionBy("_a"))
    return first.withColumn("_m", measured).where("NOT (_note AND _m = 1)").drop("_rn", "_m", "_x", "_y").withColumnRenamed("_a", "area2")


def histogram_view(items: DataFrame, size: float = 10.0, share: float = 0.1, reach: int = 5) -> DataFrame:
    """Bounds in y of the main plan: the fullest bin, widened over neighbours that hold more than a share of it."""
    bins = items.groupBy(F.floor(F.col("y") / size).alias("bin")).count()
    peak = bins.agg(F.max_by("bin", F.struct("count", (-F.col("bin")).alias("b"))).alias("peak"), F.max("count").alias("most"))
    near = bins.join(F.broadcast(peak)).where((F.abs(F.col("bin") - F.col("peak")) <= reach) & (F.col("count") > F.col("most") * share))
    return near.agg(F.first("peak").alias("peak"), ((F.min("bin") - 1) * size).alias("min_y"), ((F.max("bin") + 2) * size).alias("max_y"))


def in_view(items: DataFrame, view: DataFrame) -> DataFrame:
    return items.join(F.broadcast(view)).where("y IS NULL OR y BETWEEN min_y AND max_y").drop("peak", "min_y", "max_y")


def main_plan_items(items: DataFrame, y: tuple[float, float], x: tuple[float, float] | None = None) -> DataFrame:
    """Items of the main plan: those whose position (a struct) lies within its bounds, and those without a position."""
    inside = F.col("position.y").between(*y)
    return items.where(F.col("position").isNull() | (inside if x is None else inside & F.col("position.x").between(*x)))


def footprint_lookup(layers: DataFrame, found: DataFrame, least: float = 0.3) -> DataFrame:
    """Layers with their score as a footprint, 0 if they aren't one, and whether it is a good one."""
    out = layers.join(found.select("layer", "score"), "layer", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("good", F.col("score") >= least)
