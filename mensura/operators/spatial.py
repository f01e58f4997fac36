"""Distance joins by grid cells, nearest zones, points in polygons.

A distance predicate alone would be a nested loop.  Here the right side is put into every cell that its reach touches, so
both sides meet in an equi-join on cells; the exact distance decides afterwards.  Cells with many rows split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators.graph import checkpoint


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def grid_distance_join(left: DataFrame, right: DataFrame, radius: float, strict: bool = False, among: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows with coordinates (x, y) and (rx, ry) that are at most radius apart (below it, if strict), with their distance.

    Only rows that are equal in the columns `among` (which both sides have, and none null) meet.
    A cell is radius wide, so a left point's partners lie in its own cell or one of the eight around it.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = right.withColumn("_cx", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: cell("rx") + i)))
    near = near.withColumn("_cy", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: cell("ry") + i)))
    own = left.withColumns({"_cx": cell("x"), "_cy": cell("y")})
    d = distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))
    joined = own.join(near, ["_cx", "_cy", *among]).withColumn("dist", d).drop("_cx", "_cy")
    return joined.where(F.col("dist") < radius if strict else F.col("dist") <= radius)


def _radii(rows: DataFrame, radius: float, few: float = 8.0, steps: int = 12) -> list[float]:
    """Growing radii up to `radius`, from one that has few of the rows (rx, ry) in a cell, as a row sees it."""
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("rx") * 2**k / radius).alias("cx"), F.floor(F.col("ry") * 2**k / radius).alias("cy")) for k in range(steps)]))
    n = rows.select("rx", "ry", sizes.alias("c")).groupBy("c").agg(F.count("*").alias("n")).groupBy("c.k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).collect()  # one row for each size
    first = min((r["k"] for r in n if r["n"] <= few), default=steps - 1 if n else 0)
    return [radius / 2**k for k in range(first, 0, -1)] + [radius]


def nearest(left: DataFrame, right: DataFrame, radius: float, key: str, order: str) -> DataFrame:
    """For each left row with a partner within (strictly below) radius, the nearest one; ties go to the smallest `order`.

    Radii grow: a row that has found a partner is done, so the pairs grow with the rows and not with the product of both sides.
    The nearest is a minimum that partial aggregation can combine, so a point with many neighbours is no task of its own.
    """
    names = [c for c in right.columns if c not in ("rx", "ry")]
    right = checkpoint(right.groupBy("rx", "ry").agg(F.min_by(F.struct(*names), F.col(order)).alias("b")).select("b.*", "rx", "ry"))  # of one place, only the first can be the answer
    rest, out = checkpoint(left), None
    for r in _radii(right, radius):
        near = grid_distance_join(rest, right, r, strict=True)
        took = [c for c in near.columns if c not in left.columns]
        found = checkpoint(near.groupBy(key).agg(F.min_by(F.struct(*took), F.struct("dist", order)).alias("b")).select(key, "b.*"))
        out = found if out is None else out.unionByName(found)
        if r < radius:
            rest = checkpoint(rest.join(found, key, "left_anti"))
    return out


def enrich_with_texts(items: DataFrame, texts: DataFrame, radius: float, key: str) -> DataFrame:
    """Distinct lower-case texts near each item, sorted; items without one keep an empty list."""
    near = grid_distance_join(items.select(key, "x", "y"), texts.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.lower("label").alias("word")), radius)
    words = near.groupBy(key).agg(F.array_sort(F.collect_set("word")).alias("words"))
    return items.join(words, key, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def shoelace(vertices: Column) -> Column:
    """Area of a polygon, array<struct<x,y>>; 0 with fewer than three corners."""
    n = F.size(vertices)
    turned = F.concat(F.slice(vertices, 2, n), F.slice(vertices, 1, 1))
    twice = F.aggregate(F.zip_with(vertices, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    return F.when(n < 3, 0.0).otherwise(F.abs(twice) / 2)


def centroid(vertices: Column) -> Column:
    """Mean of the corners."""
    mean = lambda k: F.aggregate(vertices, F.lit(0.0), lambda s, v: s + v[k]) / F.size(vertices)
    return F.when(F.size(vertices) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def path_length(vertices: Column, closed: Column) -> Column:
    """Length of a polyline, with the edge back to its start if it is closed."""
    n = F.size(vertices)
    step = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    total = F.aggregate(F.zip_with(F.slice(vertices, 1, n - 1), F.slice(vertices, 2, n), step), F.lit(0.0), lambda s, v: s + v)
    last = F.when(closed & (n > 2), step(F.element_at(vertices, -1), F.element_at(vertices, 1))).otherwise(0.0)
    return F.when(n < 2, 0.0).otherwise(total + last)


def arc_length(radius: Column, start: Column, end: Column) -> Column:
    return radius * F.abs(end - start)


def circle_length(radius: Column) -> Column:
    return radius * 2 * F.lit(3.141592653589793)


def circle_area(radius: Column) -> Column:
    return radius * radius * F.lit(3.141592653589793)


def contains(vertices: Column, x: Column, y: Column) -> Column:
    """Whether a polygon has a point inside, by the number of its edges that a ray crosses."""
    n = F.size(vertices)
    turned = F.concat(F.slice(vertices, 2, n), F.slice(vertices, 1, 1))

    def crosses(a, b):
        at = a["x"] + (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) * (b["x"] - a["x"])
        return F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < at), F.lit(False)).cast("int")

    return (F.aggregate(F.zip_with(vertices, turned, crosses), F.lit(0), lambda s, v: s + v) % 2) == 1


def _bound(f, k: str) -> Column:
    return f(F.transform("vertices", lambda v: v[k]))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys to as many tasks as there are shuffle partitions: few bytes can be much work with polygons, so they must not be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def zones_in_cells(zones: DataFrame, cell: float, radius: float = 0.0) -> DataFrame:
    """The zones (zone, vertices) in each grid cell (_cx, _cy) that has a place at most radius away, with what holds for all places in the cell:
    _least and _most, bounds of their distances to the zone, and _covered, whether all lie inside.

    Distances change by no more than the way between two places, so the middle of a cell tells for the cell; 1e-6 is for rounding.
    """
    half, grid = cell * 0.7071068 + 1e-6, lambda k: F.sequence(F.floor((_bound(F.array_min, k) - radius) / cell), F.floor((_bound(F.array_max, k) + radius) / cell))
    z = spread(zones.withColumn("_cx", F.explode(grid("x"))).withColumn("_cy", F.explode(grid("y"))), "_cx", "_cy")
    middle = lambda k: (F.col(f"_c{k}") + 0.5) * cell
    z = z.withColumn("_edge", edge_distance(F.col("vertices"), middle("x"), middle("y"))).withColumn("_in", contains(F.col("vertices"), middle("x"), middle("y")))
    z = z.withColumns({"_covered": F.col("_in") & (F.col("_edge") > half), "_least": F.when(F.col("_in"), 0.0).otherwise(F.greatest(F.col("_edge") - half, F.lit(0.0)))})
    most = F.when(F.col("_covered"), 0.0).when(F.col("_in"), half).otherwise(F.col("_edge") + half)
    return spread(checkpoint(z.withColumn("_most", most).drop("_edge", "_in")).where(F.col("_least") <= radius), "_cx", "_cy")


def in_cell(points: DataFrame, cell: float) -> DataFrame:
    return spread(points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)}), "_cx", "_cy")


def smallest_zone(points: DataFrame, zones: DataFrame, key: str, cell: float) -> DataFrame:
    """For each point in a zone (columns zone, vertices), the smallest zone that contains it.

    Of the zones that cover a cell of the grid only the smallest can be the answer, and of the others only smaller ones.
    """
    size = F.struct(F.round("_area", 6).alias("a"), "zone")
    z = zones_in_cells(zones, cell / 5).withColumn("_area", shoelace(F.col("vertices"))).withColumn("_size", size)
    best = z.where("_covered").groupBy("_cx", "_cy").agg(F.min("_size").alias("_best"))
    z = z.join(best, ["_cx", "_cy"], "left").where(F.col("_best").isNull() | (F.col("_size") <= F.col("_best")))
    hit = in_cell(points, cell / 5).join(z.drop("_best"), ["_cx", "_cy"]).where(F.col("_covered") | contains(F.col("vertices"), F.col("x"), F.col("y")))
    return hit.groupBy(key).agg(F.min(F.struct("_size.a", "zone", "_area")).alias("b")).select(key, "b.zone", F.col("b._area").alias("zone_area"))


def transform_point(p: Column, t: Column) -> Column:
    """Scales, turns (degrees) and moves a point."""
    r = F.radians(t["rotation"])
    sx, sy = p["x"] * t["sx"], p["y"] * t["sy"]
    return F.struct((sx * F.cos(r) - sy * F.sin(r) + t["x"]).alias("x"), (sx * F.sin(r) + sy * F.cos(r) + t["y"]).alias("y"))


def compose(p: Column, c: Column) -> Column:
    """Transform of a block inside a block: the child's place is turned, then scaled, by the parent; turns add, scales multiply."""
    r = F.radians(p["rotation"])
    x, y = c["x"] * F.cos(r) - c["y"] * F.sin(r), c["x"] * F.sin(r) + c["y"] * F.cos(r)
    return F.struct((p["x"] + x * p["sx"]).alias("x"), (p["y"] + y * p["sy"]).alias("y"), (p["rotation"] + c["rotation"]).alias("rotation"), (p["sx"] * c["sx"]).alias("sx"), (p["sy"] * c["sy"]).alias("sy"))


def explode_blocks(roots: DataFrame, children: DataFrame, depth: int = 10) -> DataFrame:
    """Leaves that root inserts reach, with the composed transform and the inherited layer.

    roots: root, block, layer, t.  children: block, child (a block, or null for a leaf), entity, layer, t.  Each level is one
    equi-join on the block's name; a block on its own path is not entered again; layer "0" takes its parent's.
    """
    level, out = roots.withColumns({"path": F.array("block"), "depth": F.lit(0)}), None
    for _ in range(depth):
        c = children.select("block", "child", "entity", F.col("layer").alias("cl"), F.col("t").alias("ct"))
        step = level.join(c, "block").select(
            "root", "child", "entity", F.when(F.coalesce(F.nullif(F.trim("cl"), F.lit("")), F.lit("0")) == "0", F.col("layer")).otherwise(F.col("cl")).alias("layer"),
            compose(F.col("t"), F.col("ct")).alias("t"), "path", (F.col("depth") + 1).alias("depth"),
        )
        leaves = step.where("child IS NULL").select("root", "entity", "layer", "t", "depth")
        out = leaves if out is None else out.unionByName(leaves)
        level = step.where("child IS NOT NULL AND NOT array_contains(path, child)").select("root", F.col("child").alias("block"), "layer", "t", F.concat("path", F.array("child")).alias("path"), "depth")
        level = checkpoint(level)
        if level.isEmpty():
            break
    return out


def two_nearest_bridges(points: DataFrame, radius: float, key: str) -> DataFrame:
    """Unordered pairs that join each point to its two nearest others within radius.

    Radii grow: a point with two others is done.  Of one place, the three first by key have the two that count for any point.
    """
    place = Window.partitionBy("rx", "ry").orderBy("other")
    right = points.select(F.col(key).alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    right = checkpoint(right.withColumn("rn", F.row_number().over(place)).where("rn <= 3").drop("rn"))
    rest, out = checkpoint(points.select(key, "x", "y")), None
    w = Window.partitionBy(key).orderBy("dist", "other")
    for r in _radii(right, radius):
        near = grid_distance_join(rest, right, r).where(F.col(key) != F.col("other")).select(key, "other", "dist")
        two = checkpoint(near.withColumn("rn", F.row_number().over(w)).where("rn <= 2"))
        if r < radius:
            done = two.where("rn = 2").select(key)
            rest = checkpoint(rest.join(done, key, "left_anti"))
            two = two.join(done, key, "left_semi")
        out = two if out is None else out.unionByName(two)
    return out.select(F.least(key, "other").alias("a"), F.greatest(key, "other").alias("b"), "dist").distinct()


def polygon_signature(vertices: Column, tolerance: float = 0.01) -> Column:
    """Corners as multiples of the tolerance, in sorted order: equal for a polygon that starts elsewhere."""
    near = lambda c: F.floor(c / tolerance + 0.5)
    corners = F.array_sort(F.transform(vertices, lambda v: F.struct(near(v["x"]).alias("x"), near(v["y"]).alias("y"))))
    return F.array_join(F.transform(corners, lambda v: F.concat_ws(",", v["x"].cast("string"), v["y"].cast("string"))), "|")


def ring_area(rings: Column) -> Column:
    """Area of the first ring without those of the others, 0 at least."""
    first = shoelace(F.element_at(rings, 1))
    holes = F.aggregate(F.transform(F.slice(rings, 2, F.size(rings)), shoelace), F.lit(0.0), lambda s, a: s + a)
    return F.greatest(first - holes, F.lit(0.0))


def insert_transform(x: Column, y: Column, rotation: Column, sx: Column, sy: Column) -> Column:
    """Transform of an insert: a scale that is missing or 0 is 1, a missing place or angle 0."""
    one, zero = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0)), lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(zero(x).alias("x"), zero(y).alias("y"), zero(rotation).alias("rotation"), one(sx).alias("sx"), one(sy).alias("sy"))


def edge_distance(vertices: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest edge of a polygon."""
    n = F.size(vertices)
    turned = F.concat(F.slice(vertices, 2, n), F.slice(vertices, 1, 1))

    def edge(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = dx * dx + dy * dy
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(size, F.lit(0.0)))), F.lit(0.0))
        return distance(x, y, a["x"] + t * dx, a["y"] + t * dy)

    return F.array_min(F.zip_with(vertices, turned, edge))


def polygon_distance(vertices: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a polygon: 0 inside, else to its nearest edge."""
    return F.when(contains(vertices, x, y), 0.0).otherwise(edge_distance(vertices, x, y))


def near_polygons(points: DataFrame, zones: DataFrame, radius: float, cell: float = 5.0) -> DataFrame:
    """Points beside the zones (zone, vertices) that are at most radius away, with dist; both meet on grid cells."""
    bound = lambda f, k: f(F.transform("vertices", lambda v: v[k]))
    grid = lambda k: F.sequence(F.floor((bound(F.array_min, k) - radius) / cell), F.floor((bound(F.array_max, k) + radius) / cell))
    z = zones.withColumn("_cx", F.explode(grid("x"))).withColumn("_cy", F.explode(grid("y")))
    own = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)}).join(z, ["_cx", "_cy"]).drop("_cx", "_cy")
    return own.withColumn("dist", polygon_distance(F.col("vertices"), F.col("x"), F.col("y"))).where(F.col("dist") <= radius)


def nearest_polygon(points: DataFrame, zones: DataFrame, key: str, radius: float, cell: float = 1.0) -> DataFrame:
    """(key, zone, dist) of each point's nearest zone within radius; ties go to the smallest zone.

    In a cell only zones count that can be as near as the one that is nearest at most; of those that cover the cell only the smallest, and
    beside it only smaller ones.
    """
    z = zones_in_cells(zones, cell, radius)
    best = z.groupBy("_cx", "_cy").agg(F.min("_most").alias("_limit"), F.min(F.when(F.col("_covered"), F.col("zone"))).alias("_first"))
    z = z.join(best, ["_cx", "_cy"]).where((F.col("_least") <= F.col("_limit") + 1e-6) & (F.col("_first").isNull() | (F.col("zone") <= F.col("_first"))))
    near = in_cell(points, cell).join(z.select("_cx", "_cy", "zone", "vertices", "_covered"), ["_cx", "_cy"])
    near = near.withColumn("dist", F.when(F.col("_covered"), 0.0).otherwise(polygon_distance(F.col("vertices"), F.col("x"), F.col("y")))).where(F.col("dist") <= radius)
    found = near.groupBy(key).agg(F.min(F.struct(F.round("dist", 9).alias("dist"), "zone")).alias("b"))
    return found.select(key, "b.zone", "b.dist")


def best_polygon(points: DataFrame, zones: DataFrame, key: str, radius: float, score, cell: float = 1.0) -> DataFrame:
    """(key, zone, score) of the zone within radius that scores best for each point, to six digits; ties go to the smallest zone.

    score(inside, dist) is a Column over the zone's columns that is highest inside and falls with the distance, so its bounds in a cell come from
    those of the distance; zones that can't reach what another one has at least in the whole cell are left out.
    """
    ranked = lambda c: F.struct((-F.round(c, 6)).alias("s"), "zone")
    z = zones_in_cells(zones, cell, radius)
    z = z.withColumns({"_high": ranked(score(F.col("_least") == 0, F.col("_least"))), "_low": F.when(F.col("_most") <= radius, ranked(score(F.col("_covered"), F.col("_most"))))})
    best = z.groupBy("_cx", "_cy").agg(F.min("_low").alias("_best"))
    z = z.join(best, ["_cx", "_cy"]).where(F.col("_best").isNull() | (F.col("_high") <= F.col("_best"))).drop("_high", "_low", "_best")
    near = in_cell(points, cell).join(z, ["_cx", "_cy"])
    near = near.withColumn("dist", F.when(F.col("_covered"), 0.0).otherwise(polygon_distance(F.col("vertices"), F.col("x"), F.col("y")))).where(F.col("dist") <= radius)
    near = near.withColumn("score", score(F.col("dist") == 0, F.col("dist")))
    found = near.groupBy(key).agg(F.min_by(F.struct("zone", "score"), ranked(F.col("score"))).alias("b"))
    return found.select(key, "b.zone", "b.score")


def texts_of_regions(regions: DataFrame, texts: DataFrame, radius: float, most: int = 10, cell: float = 1.0) -> DataFrame:
    """(zone, id, how, relevance): the most relevant texts in or near each region: inside, near its centre, near its edge.

    Bounds of the relevance in whole grid cells, with the number of texts there, give what a region's last text has at least; cells without a better
    one are left out.  Texts in a cell are numbered by id, in blocks of 2, 4, 8 ...: of cells inside of a region the first texts are enough, of those
    on its edge the blocks up to the last id that can count.
    """
    c, half = centroid(F.col("vertices")), cell * 0.7071068 + 1e-6
    w = Window.partitionBy("_cx", "_cy").orderBy("id")
    placed = in_cell(texts.select("id", "x", "y"), cell).withColumn("_block", F.floor(F.log2(F.row_number().over(w))).cast("int"))
    placed = checkpoint(placed)
    blocks = placed.groupBy("_cx", "_cy", "_block").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    counts = blocks.groupBy("_cx", "_cy").agg(F.sum("n").alias("_n"))
    z = zones_in_cells(regions.where(F.size("vertices") > 0).select("zone", "vertices"), cell, radius).join(counts, ["_cx", "_cy"]).withColumn("_c", c)
    away = distance((F.col("_cx") + 0.5) * cell, (F.col("_cy") + 0.5) * cell, F.col("_c.x"), F.col("_c.y"))
    near_middle = F.greatest(away - half, F.lit(0.0))
    # Within radius of the polygon, a text has at least the relevance of the larger of both distances, and at most that of the smaller.
    low = F.when(F.col("_covered"), 1.0).when(F.col("_most") <= radius, 1 / (1 + F.greatest("_most", away + half))).otherwise(0.0)
    high = F.when(F.col("_least") == 0, 1.0).otherwise(1 / (1 + F.least("_least", near_middle)))
    z = checkpoint(z.select("zone", "vertices", "_cx", "_cy", "_covered", "_n", low.alias("_low"), high.alias("_high")))
    ranked = Window.partitionBy("zone").orderBy(F.desc("_low"), "_cx", "_cy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = z.withColumn("_sum", F.sum("_n").over(ranked)).where(F.col("_sum") >= most).groupBy("zone").agg(F.max("_low").alias("_limit"))
    z = z.join(limit, "zone", "left").where(F.coalesce("_limit", F.lit(0.0)) <= F.col("_high") + 1e-6)
    # Of a cell inside, the first texts by id; their ids bound those that count elsewhere, if there are enough.
    at = z.join(blocks, ["_cx", "_cy"])
    inside = at.where(F.col("_covered") & (F.col("_block") <= F.floor(F.log2(F.lit(float(most))))))
    ids = Window.partitionBy("zone").orderBy("high").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("_sum", F.sum("n").over(ids)).where(F.col("_sum") >= most).groupBy("zone").agg(F.min("high").alias("_last"))
    wanted = at.where(~F.col("_covered") | (F.col("_block") <= F.floor(F.log2(F.lit(float(most)))))).join(last, "zone", "left").where(F.col("_last").isNull() | (F.col("low") <= F.col("_last")))
    cells = "_cx", "_cy", "_block"
    near = spread(wanted.select("zone", "vertices", *cells, "_covered", "_last"), *cells).join(spread(placed, *cells), list(cells)).where(F.col("_last").isNull() | (F.col("id") <= F.col("_last"))).drop(*cells, "_last")
    near = near.withColumn("_c", c).withColumn("mid", distance(F.col("x"), F.col("y"), F.col("_c.x"), F.col("_c.y")))
    near = near.withColumn("dist", F.when(F.col("_covered"), 0.0).otherwise(polygon_distance(F.col("vertices"), F.col("x"), F.col("y")))).where(F.col("dist") <= radius).drop("_covered")
    inside, middle = F.col("dist") == 0, F.col("mid") <= radius
    near = near.withColumns({
        "how": F.when(inside, "inside").when(middle, "near_centroid").otherwise("near_boundary"),
        "relevance": F.when(inside, 1.0).when(middle, 1 / (1 + F.col("mid"))).otherwise(1 / (1 + F.col("dist"))),
    })
    w = Window.partitionBy("zone").orderBy(F.desc(F.round("relevance", 9)), "id")
    return near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
