"""Labels and regions, fuzzy names, rules and job phases, against hand-made cases and plain Python."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mensura.operators import association as A
from mensura.operators import fuzzy as Z
from mensura.operators import layer_matching as L
from mensura.operators import rules as R
from mensura.operators import service as V
from mensura.sources.adapters import view
from mensura.streaming import phases as J

ZONES = "zone long, vertices array<struct<x:double,y:double>>"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_labels_find_places_in_stages(spark):
    zones = spark.createDataFrame([(1, [tuple(map(float, p)) for p in box(0, 0, 10, 10)]), (2, [tuple(map(float, p)) for p in box(2, 2, 2, 2)]), (3, [tuple(map(float, p)) for p in box(50, 0, 4, 5)])], ZONES)
    labels = [(1, "Sala", 5.0, 5.0), (2, "Closet", 3.0, 3.0), (3, "Sala", 10.3, 5.0), (4, "Patio", 30.0, 30.0), (5, "Bodega", 55.5, 2.0), (6, "Nada", 90.0, 90.0), (7, "Closet", 2.5, 2.5)]
    labels = spark.createDataFrame(labels, "id long, text string, x double, y double")
    walls = [(28, 28, 33, 28), (33, 28, 33, 32), (28, 32, 28, 28), (28, 32, 28, 28), (88, 88, 92, 88)]
    walls = spark.createDataFrame([tuple(map(float, w)) for w in walls], "x1 double, y1 double, x2 double, y2 double")
    placed = A.places(labels, zones, walls)
    got = {r["id"]: (r["stage"], r["region"], r["area"], r["spatial"]) for r in placed.collect()}
    assert got == {1: ("inside_zone", 1, 100.0, 1.0), 2: ("inside_zone", 2, 4.0, 1.0), 7: ("inside_zone", 2, 4.0, 1.0), 3: ("proximity", 1, 100.0, 0.8), 4: ("fallback_estimator", None, 20.0, 1.0), 5: ("nearest_neighbor", 3, 20.0, 1.0)}
    items = [(1, "Pavimento sala", "m2"), (2, "Pintura closet", "ml"), (3, "Patio", "un"), (4, "x", "m2"), (5, "Muro", "m2"), (6, "Bodega", None)]
    items = spark.createDataFrame(items, "item long, description string, unit string")
    matches = spark.createDataFrame([(1, "Sala", 0.7), (1, "Closet", 0.6), (2, "Closet", 0.9), (3, "Patio", 1.0), (6, "Bodega", 0.2), (6, "Sala", 0.5)], "item long, text string, score double")
    out = {r["item"]: r.asDict() for r in A.associate(items, matches, labels, placed).collect()}
    assert (out[1]["regions"], out[1]["qty"], out[1]["label"], out[1]["confidence"]) == (2, 104.0, "Sala", 0.82)
    assert (out[2]["regions"], out[2]["qty"]) == (1, 8.0) and (out[3]["qty"], out[3]["stage"]) == (1.0, "fallback_estimator")
    assert 4 not in out and (out[5]["regions"], out[5]["qty"], out[5]["label"]) == (0, 0.0, None)
    assert (out[6]["regions"], out[6]["stages"]) == (1, "inside_zone")  # 0.2 is too little, 0.5 in the zone is not


def test_quantities_of_thin_regions(spark):
    rows = spark.createDataFrame([("m2", "Muro", 0.0, 5.0), ("m2", "Cielo falso", 0.0, 5.0), ("ml", "x", 3.0, 5.0), ("kg", "x", 3.0, 5.0)], "u string, d string, a double, p double")
    assert [r[0] for r in rows.select(A.quantity_of_region(F.col("u"), F.col("d"), F.col("a"), F.col("p"))).collect()] == [12.0, 0.0, 5.0, 3.0]


def names(rng, n):
    return [" ".join("".join(rng.choice("aeimorstu") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def slow_distance(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        last, row[0] = row[0], 0
        for i, d in enumerate(p, 1):
            last, row[i] = row[i], min(last + (c != d), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best / len(p) if p else 1.0


def test_the_index_loses_no_pair(spark):
    rng = random.Random(2)
    left, right = sorted({*names(rng, 60), "muro", "a", ""}), sorted({*names(rng, 90), "muros de piedra", "xyz", ""})
    l, r = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    for threshold in (0.25, 0.6):
        want = {(p, t, round(slow_distance(p, t), 9)) for p in left for t in right if p and slow_distance(p, t) <= threshold}
        rows = [(x["l"], x["r"], round(x["d"], 9)) for x in Z.near_parts(l, r, threshold).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    score = lambda pairs: spark.createDataFrame(pairs, "l string, r string").select("l", "r", V.fuzzy_score("l", "r").alias("s"))
    every = {(x["l"], x["r"]): x["s"] for x in score([(a, b) for a in left for b in right if a and b]).collect()}
    for threshold in (0.4, 0.7):
        got = {(x["l"], x["r"]): x["score"] for x in V.fuzzy_pairs(l, r, threshold).collect()}
        assert got == {k: s for k, s in every.items() if s >= threshold}
        got = {(x["term"], x["name"]) for x in V.semantic_matches(l.withColumnRenamed("l", "term"), r.withColumnRenamed("r", "name"), threshold).where("strategy = 'fuzzy'").collect()}
        from difflib import SequenceMatcher

        assert got == {(a, b) for a in left for b in right if a and b and a != b and SequenceMatcher(None, a, b).ratio() >= threshold} - {("muro", b) for b in right if "muro" in b}


def test_layer_candidates_are_those_of_the_product(spark):
    items, profiles = (view(spark, "/root/testdata/sf0.001", v) for v in ("bill_items", "cad_items"))
    from mensura.functions import text as T

    words = [r[0] for r in items.select(F.explode(T.tokens(T.normalize_text(F.col("description"))))).distinct().collect()]
    layers = [r[0] for r in profiles.select(T.normalize_text(F.col("layer"))).distinct().collect()]
    got = {(r["l"], r["r"]) for r in Z.near_parts(spark.createDataFrame([(w,) for w in words], "l string"), spark.createDataFrame([(x,) for x in layers], "r string"), L.THRESHOLD).collect()}
    pairs = [(w, x) for w in words for x in layers]
    d = Z.part_distances([w for w, _ in pairs], [x for _, x in pairs])
    assert got == {p for p, v in zip(pairs, d) if v <= L.THRESHOLD and p[0]}


def test_rules_are_compiled(spark):
    schema = "id long, description string, unit string, qty_final double, unit_price_ref double, match_confidence double, status string, height_factor double, n_sources long"
    rows = [(1, "Muro a", "un", 10001.0, 100.0, 0.9, "approved", None, 1), (2, "El muro b", "m2", 0.0, 100.0, 0.3, "pending", None, 0), (3, "muro c", "m2", 5.0, 1000.0, 0.3, "approved", 2.4, 2), (4, "Cielo", "m2", 5.0, None, 0.5, "approved", 0.0, 1), (5, None, None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    got = {(r["id"], r["rule"]) for r in R.RuleSet().validate(frame).collect()}
    assert got == {(1, "quantity_sanity"), (2, "unit_consistency"), (2, "missing_quantity"), (3, "low_confidence"), (4, "unit_consistency"), (4, "missing_price"), (5, "missing_quantity")}
    more = spark.createDataFrame([(10 + k, "muro", "un", 5.0, 100.0, 0.9, "pending", None, 1) for k in range(3)], schema)
    (hit,) = R.RuleSet().validate(frame.unionByName(more)).where("rule = 'price_outlier'").collect()
    assert hit["id"] == 3 and hit["message"] == "Precio 3x superior al promedio (250 CLP)"
    odd = R.RuleSet([]).register(R.Rule("quote", "info", "description = 'it''s'", "'it''s'")).add_bounds("m'2", 1, 2)
    assert odd.validate(frame).count() == 0 and R.RuleSet([]).validate(frame).count() == 0


def plain_state(rows, limit, end):
    job = J.Job()
    for at, kind in sorted(rows):
        job.take(kind, at, limit)
    job.expire(end, limit)
    return J.PHASES[job.phase], job.status, job.attempts, job.conflicts, job.retries, job.timeouts


def test_job_phases(spark, tmp_path):
    rng, start, minute = random.Random(1), datetime(2024, 1, 1), 60_000_000
    rows = [(job, rng.choice(["queue", "start", "start", "finish", "finish", "fail"]), k * 7 + job) for job in range(12) for k in range(40)] + [(50, "start", 0), (51, "start", 285), (52, "finish", 3)]
    frame = spark.createDataFrame([(j, k, start + timedelta(minutes=m)) for j, k, m in rows], "job long, kind string, at timestamp")
    # Three files in the order of time are three micro-batches.
    for k, (lo, hi) in enumerate([(0, 100), (100, 200), (200, 999)]):
        frame.where((F.col("at") >= F.lit(start + timedelta(minutes=lo))) & (F.col("at") < F.lit(start + timedelta(minutes=hi)))).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (file,) = (tmp_path / f"part{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["job"]: tuple(r)[1:7] for r in J.replay(stream, str(tmp_path / "shared")).collect()}
    end = max(m for _, _, m in rows)
    want = {j: plain_state([(m * minute, k) for i, k, m in rows if i == j], 25 * minute, end * minute) for j in {r[0] for r in rows}}
    assert got == want and want[50][5] == 1 and want[51][1] == "processing"


def test_json_columns_are_checked(spark):
    from mensura.operators import validators as C

    item = '{"id": "a", "type": "area", "value_m": 2, "evidence": "e", "name_raw": "n", "unit_raw": "m2", "layer_raw": "l", "value_raw": -1.5, "layer_normalized": "l"}'
    rows = [(1, f"[{item}]"), (2, "[]"), (3, None), (4, f"[{item}, {item.replace('2,', '-2,', 1)}, null]"), (5, "{}"), (6, "oops"), (7, f"[{item.replace('area', 'arc')}]")]
    got = {r["id"]: r["c"] for r in spark.createDataFrame(rows, "id int, j string").select("id", C.checked(F.col("j"), C.SOURCE_ITEM).alias("c")).collect()}
    assert got[1]["valid"] and got[1]["records"][0]["value_raw"] == -1.5 and got[2]["records"] == [] and got[3]["records"] == [] and got[3]["valid"]
    assert got[4]["records"] is None and {f.split(".")[0] for f in got[4]["faults"]} == {"1", "2"} and "1.value_m" in got[4]["faults"]
    assert got[5]["faults"] == got[6]["faults"] == ["json"] and got[7]["faults"] == ["0.type"]
    prices = [(1, '[{"vendor": "v", "price": 3.5, "score": 1}]'), (2, '[{"vendor": "v", "price": 0, "score": 0.2, "url": "http://a.example"}]'), (3, '[{"vendor": "v", "price": 1, "score": 1.2, "url": "x"}]')]
    got = {r["id"]: r["f"] for r in spark.createDataFrame(prices, "id int, j string").select("id", C.checked(F.col("j"), C.PRICE_CANDIDATE)["faults"].alias("f")).collect()}
    assert got == {1: [], 2: ["0.price"], 3: ["0.score", "0.url"]}
