"""Searches by cells give what comparing everything gives, where places repeat, polygons are concave and many cover each other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mensura.operators import spatial as P


def inside(v, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(v, v[1:] + v[:1], strict=True)) % 2 == 1


def away(v, x, y):
    def edge(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    return 0.0 if inside(v, x, y) else min(edge(a, b) for a, b in zip(v, v[1:] + v[:1], strict=True))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    zones = {}
    for k in range(60):
        x, y, s = rng.gauss(0, 3), rng.gauss(0, 3), rng.choice([0.3, 2, 2, 7])
        zones[k] = [(x, y), (x + s, y), (x + s, y + s), (x + s / 2, y + s / 4), (x, y + s)] if k % 2 else [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    places = [(rng.gauss(0, 4), rng.gauss(0, 4)) for _ in range(500)]
    points = {100 + i: rng.choice(places) for i in range(1500)}
    z = spark.createDataFrame([(k, [{"x": a, "y": b} for a, b in v]) for k, v in zones.items()], "zone long, vertices array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(k, *v) for k, v in points.items()], "id long, x double, y double")
    dist = {(i, k): away(v, *xy) for i, xy in points.items() for k, v in zones.items()}
    return zones, points, z, p, dist


def test_nearest_polygon(world):
    zones, points, z, p, dist = world
    want = {i: min((round(dist[i, k], 9), k) for k in zones) for i in points}
    got = {r["id"]: (r["dist"], r["zone"]) for r in P.nearest_polygon(p, z, "id", 1.5).collect()}
    assert set(got) == {i for i, (d, _) in want.items() if d <= 1.5} and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-8 for i in got)


def test_smallest_and_best_polygon(world):
    zones, points, z, p, dist = world
    area = {k: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(v, v[1:] + v[:1], strict=True))) / 2 for k, v in zones.items()}
    want = {i: min((round(area[k], 6), k) for k in zones if dist[i, k] == 0)[1] for i in points if any(dist[i, k] == 0 for k in zones)}
    assert {r["id"]: r["zone"] for r in P.smallest_zone(p, z, "id", 5.0).collect()} == want
    score = lambda i, k: (1.0 if dist[i, k] == 0 else 0.5 * (1 - dist[i, k] / 2)) + (k % 3) / 10
    best = {i: min((-round(score(i, k), 6), k) for k in zones if dist[i, k] <= 2) for i in points if any(dist[i, k] <= 2 for k in zones)}
    got = P.best_polygon(p, z, "id", 2.0, lambda on, d: F.when(on, 1.0).otherwise(0.5 * (1 - d / 2)) + F.col("zone") % 3 / 10)
    assert {r["id"]: r["zone"] for r in got.collect()} == {i: b[1] for i, b in best.items()}


@pytest.mark.parametrize("radius", [0.4, 3.0])
def test_texts_of_regions(world, radius):
    zones, points, z, p, dist = world

    def relevance(i, k):
        v, (x, y) = zones[k], points[i]
        mid = math.hypot(x - sum(a[0] for a in v) / len(v), y - sum(a[1] for a in v) / len(v))
        return ("inside", 1.0) if dist[i, k] == 0 else ("near_centroid", 1 / (1 + mid)) if mid <= radius else ("near_boundary", 1 / (1 + dist[i, k]))

    want = {k: [(i, relevance(i, k)[0]) for i in sorted((i for i in points if dist[i, k] <= radius), key=lambda i: (-round(relevance(i, k)[1], 9), i))[:10]] for k in zones}
    got = {k: [] for k in zones}
    for r in sorted(P.texts_of_regions(z, p, radius).collect(), key=lambda r: (r["zone"], r["rn"])):
        got[r["zone"]].append((r["id"], r["how"]))
    assert got == want


def test_nearest_and_two_nearest(world):
    _, points, _, p, _ = world
    flat = lambda a, b: math.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
    right = p.where("id % 5 = 0").select(F.col("id").alias("to"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = {i: min((flat(xy, points[j]), j) for j in points if j % 5 == 0) for i, xy in points.items() if i % 5}
    got = {r["id"]: (r["dist"], r["to"]) for r in P.nearest(p.where("id % 5 <> 0"), right, 2.0, "id", "to").collect()}
    assert got == {i: b for i, b in near.items() if b[0] < 2}
    two = {(min(i, j), max(i, j)) for i, xy in points.items() for d, j in sorted((flat(xy, o), j) for j, o in points.items() if j != i)[:2] if d <= 1}
    assert {(r["a"], r["b"]) for r in P.two_nearest_bridges(p, 1.0, "id").collect()} == two
    assert P._radii(right, 9.0)[0] < 9.0 and P.nearest(p, right.limit(0), 2.0, "id", "to").count() == 0
