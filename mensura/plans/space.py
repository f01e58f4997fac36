"""Distance joins, zones, blocks and shapes over the logical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import spatial as P
from mensura.plans.registry import register, rounded

DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
ITEMS, ZONES = "id % 25 <> 0", "id % 25 = 0"


def _sides(p):
    items, zones = p.where(ITEMS), p.where(ZONES)
    return items, zones.select(F.col("id").alias("zone_id"), "label", F.col("x").alias("rx"), F.col("y").alias("ry"))


@register("jn4_nearest_zone", f"""WITH d AS (SELECT a.id, b.id AS zone_id, {DIST} AS dist FROM points a JOIN points b ON a.id % 25 <> 0 AND b.id % 25 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, zone_id) AS rn FROM d WHERE dist < 5)
SELECT id, zone_id, round(dist, 6) AS dist FROM n WHERE rn = 1""", "points")
def _(p):
    items, zones = _sides(p)
    return rounded(P.nearest(items.select("id", "x", "y"), zones, 5.0, "id", "zone_id").select("id", "zone_id", "dist"), "dist")


@register("jn5_nearby_texts", f"SELECT a.id, b.id AS zone_id, round({DIST}, 6) AS dist FROM points a JOIN points b ON a.id % 25 <> 0 AND b.id % 25 = 0 AND {DIST} <= 4", "points")
def _(p):
    items, zones = _sides(p)
    return rounded(P.grid_distance_join(items.select("id", "x", "y"), zones, 4.0).select("id", "zone_id", "dist"), "dist")


@register("jn6_enriched_items", f"WITH n AS (SELECT a.id, string_agg(DISTINCT lower(b.label), ',' ORDER BY lower(b.label)) AS words FROM points a JOIN points b ON a.id % 25 <> 0 AND b.id % 25 = 0 AND {DIST} <= 4 GROUP BY a.id) SELECT p.id, coalesce(words, '') AS words FROM points p LEFT JOIN n USING (id) WHERE p.id % 25 <> 0", "points")
def _(p):
    out = P.enrich_with_texts(p.where(ITEMS), p.where(ZONES), 4.0, "id")
    return out.select("id", F.array_join("words", ",").alias("words"))


@register("jn30_two_nearest_bridges", f"WITH d AS (SELECT a.id, b.id AS other, {DIST} AS dist FROM points a JOIN points b ON a.id <> b.id), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rn FROM d WHERE dist <= 3) SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, round(dist, 6) AS dist FROM n WHERE rn <= 2", "points")
def _(p):
    return rounded(P.two_nearest_bridges(p, 3.0, "id"), "dist").distinct()


SQUARES = "z AS (SELECT id AS zone, x - 2 - id % 3 AS x0, x + 2 + id % 3 AS x1, y - 3 AS y0, y + 3 AS y1 FROM points WHERE id % 25 = 0)"


def _squares(p):
    s = lambda n, x, y: F.struct(x.alias("x"), y.alias("y"))
    w = F.col("id") % 3 + 2
    x0, x1, y0, y1 = F.col("x") - w, F.col("x") + w, F.col("y") - 3, F.col("y") + 3
    return p.where(ZONES).select(F.col("id").alias("zone"), F.array(s(0, x0, y0), s(1, x1, y0), s(2, x1, y1), s(3, x0, y1)).alias("vertices"))


@register("jn8_smallest_zone", f"WITH {SQUARES}, h AS (SELECT p.id, zone, (x1 - x0) * (y1 - y0) AS area FROM points p JOIN z ON p.x > x0 AND p.x < x1 AND p.y > y0 AND p.y < y1 WHERE p.id % 25 <> 0) SELECT id, arg_min(zone, (round(area, 6), zone)) AS zone, round(min(area), 6) AS zone_area FROM h GROUP BY id", "points")
def _(p):
    return rounded(P.smallest_zone(p.where(ITEMS).select("id", "x", "y"), _squares(p), "id", 5.0), "zone_area")


@register("geo1_polygon_measures", f"WITH {SQUARES} SELECT zone, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(2 * (x1 - x0) + 2 * (y1 - y0), 6) AS perimeter FROM z", "points")
def _(p):
    v = F.col("vertices")
    out = _squares(p).select("zone", P.shoelace(v).alias("area"), P.centroid(v)["x"].alias("cx"), P.centroid(v)["y"].alias("cy"), P.path_length(v, F.lit(True)).alias("perimeter"))
    return rounded(out, "area", "cx", "cy", "perimeter")


@register("geo4_segment_lengths", "SELECT layer, count(*) AS n, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) AS length FROM segments GROUP BY layer", "segments")
def _(s):
    return rounded(s.groupBy("layer").agg(F.count("*").alias("n"), F.sum(P.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("length")), "length")


@register("geo4_arcs_and_circles", "SELECT id, round(abs(y - x) * 2, 6) AS arc, round(2 * pi() * abs(x), 6) AS circle, round(pi() * x * x, 6) AS disc FROM points", "points")
def _(p):
    out = p.select("id", P.arc_length(F.lit(2.0), F.col("x"), F.col("y")).alias("arc"), P.circle_length(F.abs("x")).alias("circle"), P.circle_area(F.col("x")).alias("disc"))
    return rounded(out, "arc", "circle", "disc")


@register("jn29_dangling_ends", "WITH e AS (SELECT layer, x1 AS x, y1 AS y FROM segments UNION ALL SELECT layer, x2, y2 FROM segments) SELECT layer, x, y FROM e GROUP BY 1, 2, 3 HAVING count(*) = 1", "segments")
def _(s):
    ends = s.select("layer", F.inline(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))))
    return ends.groupBy("layer", "x", "y").count().where("count = 1").select("layer", "x", "y")


@register("agg34_orientation_counts", "SELECT layer, count(*) FILTER (y1 = y2) AS horizontal, count(*) FILTER (x1 = x2) AS vertical, CASE WHEN count(*) FILTER (x1 = x2) > 0 THEN 'VERTICAL' WHEN count(*) FILTER (y1 = y2) > 0.8 * count(*) THEN 'HORIZONTAL' ELSE 'MIXED' END AS verdict FROM segments GROUP BY layer", "segments")
def _(s):
    g = s.groupBy("layer").agg(F.count_if(F.col("y1") == F.col("y2")).alias("horizontal"), F.count_if(F.col("x1") == F.col("x2")).alias("vertical"), F.count("*").alias("n"))
    return g.select("layer", "horizontal", "vertical", F.when(F.col("vertical") > 0, "VERTICAL").when(F.col("horizontal") > 0.8 * F.col("n"), "HORIZONTAL").otherwise("MIXED").alias("verdict"))


@register("jn24_explode_blocks", """WITH RECURSIVE r AS (
  SELECT r_regionkey AS root, 'N' || n_nationkey AS block, r_name AS layer, 1 AS depth, CAST(n_nationkey AS DOUBLE) AS x, 0.0::DOUBLE AS y FROM region JOIN nation ON n_regionkey = r_regionkey)
SELECT r.root, 'S' || s_suppkey AS entity, CASE WHEN s_suppkey % 2 = 0 THEN r.layer ELSE 'own' END AS layer, round(r.x + 2 * (s_suppkey % 7), 6) AS x, round(r.y + 2 * (s_suppkey % 5), 6) AS y FROM r JOIN supplier ON r.block = 'N' || s_nationkey""")
def _():
    raise NotImplementedError


def _explode(spark, sf_dir):
    """Regions hold nations, nations hold suppliers: two levels of blocks with scales and places."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    t = lambda x, y, s: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("rotation"), F.lit(float(s)).alias("sx"), F.lit(float(s)).alias("sy"))
    zero = F.lit(0.0)
    roots = read("region").select(F.col("r_regionkey").alias("root"), F.concat(F.lit("R"), "r_regionkey").alias("block"), F.col("r_name").alias("layer"), t(zero, zero, 1).alias("t"))
    nations = read("nation").select(F.concat(F.lit("R"), "n_regionkey").alias("block"), F.concat(F.lit("N"), "n_nationkey").alias("child"), F.lit(None).cast("string").alias("entity"), F.lit("0").alias("layer"), t(F.col("n_nationkey"), zero, 2).alias("t"))
    own = F.when(F.col("s_suppkey") % 2 == 0, "0").otherwise("own")
    suppliers = read("supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("block"), F.lit(None).cast("string").alias("child"), F.concat(F.lit("S"), "s_suppkey").alias("entity"), own.alias("layer"), t(F.col("s_suppkey") % 7, F.col("s_suppkey") % 5, 1).alias("t"))
    out = P.explode_blocks(roots, nations.unionByName(suppliers))
    return out.select("root", "entity", "layer", F.round("t.x", 6).alias("x"), F.round("t.y", 6).alias("y"))


from mensura.plans.registry import QUERIES, SQL  # noqa: E402

QUERIES["jn24_explode_blocks"] = _explode
SQL["jn24_explode_blocks"] = SQL["jn24_explode_blocks"].removeprefix("WITH , ")
