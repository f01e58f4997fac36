"""Line work, faces, blocks that repeat, and layer matching, on cases checked by hand."""

import itertools
import random

from pyspark.sql import functions as F

from mensura.operators import cleanup as C
from mensura.operators import fuzzy as Z
from mensura.operators import graph as G
from mensura.operators import layer_matching as L
from mensura.operators import planar as P
from mensura.operators import takeoff as K
from mensura.sources.adapters import view

SEGMENTS = "id long, layer string, x1 double, y1 double, x2 double, y2 double"


def lines(spark, rows):
    return spark.createDataFrame([(i, "a", *map(float, r)) for i, r in enumerate(rows)], SEGMENTS)


def test_components(spark):
    rng = random.Random(5)
    links = [(a, rng.randrange(a)) for a in range(1, 40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 141)}}


def test_snap(spark):
    out = C.snap_vertices(lines(spark, [(0, 0, 1, 0), (1.005, 0, 2, 0), (5, 5, 5.001, 5)]), 0.01).orderBy("id").collect()
    assert len(out) == 2 and abs(out[0]["x2"] - 1.0025) < 1e-9 and out[0]["x2"] == out[1]["x1"]


def test_merge(spark):
    out = C.merge_collinear(lines(spark, [(0, 0, 1, 0), (2, 0, 1, 0), (2, 0, 2, 5)])).collect()
    assert sorted((r["x1"], r["y1"], r["x2"], r["y2"]) for r in out) == [(0, 0, 2, 0), (2, 0, 2, 5)]
    assert C.merge_collinear(lines(spark, [(0, 0, 1, 0.001), (1, 0.001, 2, 0)])).count() == 1


def test_gaps(spark):
    out = C.close_gaps(lines(spark, [(0, 0, 1, 0), (1.04, 0, 2, 0), (1.0, 0.045, 1, 3)]), 0.05).collect()
    assert {frozenset([(r["x1"], r["y1"]), (r["x2"], r["y2"])]) for r in out} == {frozenset([(1.0, 0.0), (1.04, 0.0)])}
    assert C.cleanup(lines(spark, [(0, 0, 1, 0), (1.04, 0, 2, 0)])).count() == 3


def test_faces_of_a_grid(spark):
    n = 4
    rows = [(x, y, x + 1, y) for x, y in itertools.product(range(n), range(n + 1))] + [(x, y, x, y + 1) for x, y in itertools.product(range(n + 1), range(n))]
    rows += [(20, 20, 23, 20), (23, 20, 23, 24), (23, 24, 20, 20), (50, 50, 51, 50)]
    out = P.regions(lines(spark, rows)).collect()
    assert sorted(round(r["area"], 6) for r in out) == [1.0] * (n * n) + [6.0] and abs(sum(r["perimeter"] for r in out) - 4 * n * n - 12) < 1e-9


def test_undershoots(spark):
    p = spark.createDataFrame([(1, 0.5, 0.03), (2, 0.5, 0.5), (3, 0.2, 0.0)], "pid long, x double, y double")
    (r,) = C.snap_undershoots(p, lines(spark, [(0, 0, 1, 0)]), 0.1).collect()
    assert (r["pid"], r["px"], r["py"]) == (1, 0.5, 0.0)


def test_blocks_that_repeat(spark):
    rows = [(1, "d", "a", 0.0, 0.0), (2, "d", "a", 0.08, 0.0), (3, "d", "a", 0.16, 0.0), (4, "d", "b", 0.0, 0.0), (5, "e", "a", 9.0, 9.0)]
    b = spark.createDataFrame(rows, "k long, name_raw string, layer string, x double, y double")
    assert sorted(r["k"] for r in C.deduplicate_blocks(b, 0.1, ["k"]).collect()) == [1, 3, 4, 5]


def test_resolutions(spark):
    r = spark.createDataFrame([("a", 5.001, "fine"), ("a", 5.002, "coarse"), ("a", 7.0, "fine")], "layer string, area double, resolution string")
    assert {(x["area"], x["resolution"]) for x in C.merge_resolutions(r, ["coarse", "fine"]).collect()} == {(5.002, "coarse"), (7.0, "fine")}


def test_approximate_distance(spark):
    d = spark.createDataFrame([("muro", "a muros b"), ("muro", "mxro"), ("muro", ""), ("", "x")], "p string, t string")
    assert [round(r[0], 2) for r in d.select(Z.part_distance("p", "t")).collect()] == [0.0, 0.25, 1.0, 1.0]


def test_wall_prefers_wall_layer(spark):
    profiles = spark.createDataFrame([("fa-muro", 0.0, 20.0, 0.0, False, True, False), ("cielo", 50.0, 0.0, 0.0, True, False, False)], "layer string, total_area double, total_length double, block_count double, has_area boolean, has_length boolean, has_block boolean")
    bill = spark.createDataFrame([(1, "Muro divisorio h=3", "m2"), (2, "Cielo raso", "m2"), (3, "xyzw", "m2")], "row_index long, description string, unit string")
    got = {r["row_index"]: r for r in L.match(bill, profiles).collect()}
    assert got[1]["layer"] == "fa-muro" and got[1]["qty"] == 60 and got[1]["method"] == "length_x_height" and got[1]["status"] == "approved"
    assert got[2]["layer"] == "cielo" and got[2]["qty"] == 50 and got[2]["method"] == "direct_area" and 3 not in got


def test_layer_matching_on_the_tables(spark):
    bill, items = (view(spark, "/root/testdata/sf0.001", v) for v in ("bill_items", "cad_items"))
    out = L.match(bill, K.layer_profiles(items))
    assert out.groupBy("row_index").count().where("count > 1").count() == 0 and out.where("score > 0.4 AND qty IS NULL AND method <> 'none'").count() == 0
    assert out.agg(F.count_distinct("method")).first()[0] >= 3


def test_blocks_of_other_names_do_not_meet(spark):
    """A crowded place of many names makes no more pairs than each name alone."""
    from pyspark.sql import functions as F

    from mensura.operators import cleanup as C
    from mensura.operators.spatial import grid_distance_join

    b = spark.range(400).select("id", F.concat(F.lit("n"), F.col("id") % 200).alias("name_raw"), F.lit("l").alias("layer"), (F.col("id") / 1e4).alias("x"), F.lit(0.0).alias("y"))
    right = b.select(F.col("id").alias("other"), "name_raw", "layer", F.col("x").alias("rx"), F.col("y").alias("ry"))
    assert grid_distance_join(b, right, 0.5, among=("name_raw", "layer")).count() == 800
    assert sorted(r["id"] for r in C.deduplicate_blocks(b, 0.5, ["id"]).collect()) == list(range(200))


def test_equal_segments_count_once_in_a_chain(spark, monkeypatch):
    from mensura.operators import cleanup as C

    rows = [(i + 10 * k, "a", float(i), 0.0, i + 1.0, 0.0) for i in range(3) for k in range(50)] + [(900, "a", 9.0, 9.0, 9.0, 12.0), (700, "a", 9.0, 9.0, 9.0, 12.0)]
    seen, found = [], C.components
    monkeypatch.setattr(C, "components", lambda links, *k: (seen.append(links.count()), found(links, *k))[1])
    got = sorted(map(tuple, C.merge_collinear(spark.createDataFrame(rows, "id long, layer string, x1 double, y1 double, x2 double, y2 double")).collect()))
    assert got == [(0, "a", 0.0, 0.0, 3.0, 0.0), (700, "a", 9.0, 9.0, 9.0, 12.0)] and seen[0] < 20
