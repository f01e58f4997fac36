"""Hand-checked cases, properties, files and streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.functions import units as U
from mensura.operators import drawing as D
from mensura.operators import quality as Q
from mensura.operators import reports as R
from mensura.operators import service as V
from mensura.operators import spatial as P
from mensura.operators import takeoff as K
from mensura.sources import files as S
from mensura.streaming import jobs as J


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("unit", "kind"),
    [("m", "length"), ("ml", "length"), ("mts", "length"), ("m2", "area"), ("m²", "area"), ("metros cuadrados", "area"), ("m3", "volume"), ("m³", "volume"), ("un", "count"), ("u", "count"), ("unidad", "count"), ("punto", "count"), ("gl", "service"), ("global", "service"), ("servicio", "service"), ("kg", "unknown"), ("", "unknown"), ("xyz", "unknown"), (None, "unknown"), (" M2. ", "area"), ("cm2", "area")],
)
def test_units(spark, unit, kind):
    assert one(spark, U.classify_unit(F.col("u"))["kind"], u=unit) == kind


def test_unit_beats_words(spark):
    assert one(spark, U.item_type(F.lit("cable y ducto"), F.lit("m2"))) == "AREA"
    assert one(spark, U.item_type(F.lit("cable y ducto"), F.lit("kg"))) == "LENGTH"


@pytest.mark.parametrize(("qty", "kind", "want"), [(1000.5, "length", "warning"), (10001.0, "length", "error"), (0.005, "length", "warning"), (1.5, "count", "error"), (501.0, "count", "error"), (3.0, "service", "warning"), (-1.0, "area", "error"), (0.5, "area", "error"), (100001.0, "area", "error"), (5.0, "volume", "ok")])
def test_sanity(spark, qty, kind, want):
    assert one(spark, Q.sanity(F.col("q"), F.lit(kind), F.lit("losa")), q=qty) == want


@pytest.mark.parametrize(("text", "height"), [("tabique h=2,5m", 2.5), ("muro altura: 3", 3.0), ("muro 2.7 m alto", 2.7), ("muro h=25", None), ("muro", None)])
def test_height(spark, text, height):
    assert one(spark, Q.wall_height(F.col("t")), t=text) == height


def test_zone_words(spark):
    assert one(spark, V.zone_intent(F.col("t")), t="Tabique Sala de reuniones") == "SALA"
    assert one(spark, V.zone_intent(F.col("t")), t="pared salada") is None


def test_similarity(spark):
    a, b = (T.tokens(T.normalize_text(F.lit(x))) for x in ("Tabique divisorio", "A-MURO_tabique"))
    assert one(spark, T.token_similarity(a, b, T.expand(a), T.expand(b))) > 0.5
    assert one(spark, T.normalize_text(F.lit("  Ñandú-Él_1 "))) == "nandu el 1"


def square(*corners):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])


def test_polygons(spark):
    s = square((0, 0), (10, 0), (10, 10), (0, 10))
    assert one(spark, P.shoelace(s)) == 100 and one(spark, P.path_length(s, F.lit(True))) == 40 and one(spark, P.path_length(s, F.lit(False))) == 30
    assert one(spark, P.contains(s, F.lit(5.0), F.lit(5.0))) and not one(spark, P.contains(s, F.lit(15.0), F.lit(15.0)))
    assert one(spark, P.shoelace(square((0, 0), (1, 1)))) == 0
    turned = square((10, 10), (0, 10), (0, 0), (10, 0))
    assert one(spark, P.polygon_signature(s)) == one(spark, P.polygon_signature(turned))


def test_grid_join_is_the_brute_force_join(spark):
    rows = [(i, (i * 37 % 101) / 7.0 - 6, (i * 53 % 89) / 9.0 - 4) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    right = df.select(F.col("id").alias("o"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    got = {(r["id"], r["o"]) for r in P.grid_distance_join(df, right, 1.3).collect()}
    assert got == {(a, b) for a, x, y in rows for b, u, v in rows if math.hypot(x - u, y - v) <= 1.3}


def test_nested_blocks(spark):
    t = "struct<x:double,y:double,rotation:double,sx:double,sy:double>"
    roots = spark.createDataFrame([("r", "A", "L", (1.0, 0.0, 90.0, 2.0, 2.0))], f"root string, block string, layer string, t {t}")
    children = spark.createDataFrame([("A", "B", None, "0", (1.0, 0.0, 0.0, 1.0, 1.0)), ("B", None, "e", "0", (1.0, 0.0, 0.0, 1.0, 1.0)), ("B", "A", None, "0", (0.0, 0.0, 0.0, 1.0, 1.0))], f"block string, child string, entity string, layer string, t {t}")
    (r,) = P.explode_blocks(roots, children).collect()
    assert r["layer"] == "L" and r["depth"] == 2 and abs(r["t"]["x"] - 1) < 1e-9 and abs(r["t"]["y"] - 4) < 1e-9


def test_diff_of_equal_snapshots_is_empty(spark):
    a = spark.createDataFrame([(1, 2.0, None, "x", None)], "id long, qty_final double, unit_price_ref double, status string, height_factor double")
    assert R.diff(a, a).count() == 0


def test_layer_zone_sums_add_up(spark):
    from mensura.sources.adapters import view

    items = view(spark, "/root/testdata/sf0.001", "cad_items")
    by = K.by_layer_and_zone(items).groupBy("layer").agg(F.sum("value_si").alias("a"))
    all_ = items.where("type IN ('area', 'length')").groupBy("layer").agg(F.sum("value_si").alias("b"))
    assert by.join(all_, "layer").where("abs(a - b) > 1e-6").count() == 0


def test_takeoff_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Name,Count,Layer,Area,Length,Closed\nHatch,2,"a, b",10.5,0,TRUE\nLine,0,c,,3.5,maybe\nLine,1,,1,1,false\n')
    rows = {r["layer"]: r for r in S.read_takeoff_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a, b", "c"}
    assert rows["a, b"]["cnt"] == 2 and rows["a, b"]["closed"] is True and rows["a, b"]["length"] is None
    assert rows["c"]["cnt"] == 1 and rows["c"]["closed"] is None and rows["c"]["area"] is None and rows["c"]["length"] == 3.5
    (tmp_path / "t.csv").write_text("Name,Count\nx,1\n")
    with pytest.raises(ValueError, match="layer"):
        S.read_takeoff_csv(spark, str(tmp_path))


DRAWING = ["0", "SECTION", "2", "BLOCKS", "0", "BLOCK", "2", "X", "70", "16", "0", "ENDBLK", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", "0", "LINE", "8", "muro", "10", "0", "20", "0", "11", "3", "21", "4", "0", "INSERT", "8", "muebles", "2", "silla", "10", "5", "20", "6", "67", "1", "0", "ENDSEC", "0", "EOF"]


def test_drawing(spark, tmp_path):
    (tmp_path / "d.dxf").write_text("\r\n".join(DRAWING))
    codes = S.read_group_codes(spark, str(tmp_path / "d.dxf"))
    e = {r["type"]: r for r in S.entities(codes).collect()}
    assert e["LINE"]["layer"] == "muro" and e["LINE"]["x2"] == 3 and e["INSERT"]["name"] == "silla" and e["INSERT"]["section"] == "ENTITIES"
    p = S.preflight(codes).first()
    assert (p["model_entities"], p["paper_entities"], p["xrefs"], p["blocking"]) == (1, 1, 1, True)
    assert S.block_counts(S.entities(codes)).first()["n"] == 1
    assert {r["layer"]: r["types"] for r in S.layer_geometry(S.entities(codes)).collect()} == {"muro": "LINE", "muebles": "INSERT"}


def test_header_row(spark):
    cells = [("s", 1, "Proyecto"), ("s", 3, "Partida"), ("s", 3, "Unidad"), ("s", 3, "Cantidad"), ("s", 5, "Descripción"), ("s", 5, "Unidad"), ("s", 5, "Cantidad")]
    assert S.header_row(spark.createDataFrame(cells, "sheet string, row int, text string")).first()["row"] == 3
    assert one(spark, S.parse_number(F.col("t")), t="$ 12,5 m") == 12.5 and one(spark, S.parse_number(F.col("t")), t="abc") is None


def test_job_stream(spark, tmp_path):
    jobs = spark.createDataFrame([(1, 7, "queued"), (2, 7, "completed"), (3, 8, "failed")], "id long, batch_id long, status string").withColumn("created_at", F.current_timestamp())
    jobs.write.parquet(str(tmp_path / "jobs"))
    assert {r["batch_id"]: (r["ready"], r["failed"]) for r in J.batch_barrier(jobs).collect()} == {7: (False, False), 8: (True, True)}
    seen = []
    q = J.run_queue(spark, str(tmp_path / "jobs"), str(tmp_path / "ckpt"), lambda rows, n: seen.extend(r["id"] for r in rows.collect()), 1)
    q.processAllAvailable()
    q.stop()
    assert seen == [1] and J.backoff_seconds(9) == 30


def test_empty_inputs(spark):
    from mensura.sources.adapters import view

    rows = view(spark, "/root/testdata/sf0.001", "takeoff_rows").limit(0)
    items = view(spark, "/root/testdata/sf0.001", "cad_items").limit(0)
    assert K.layer_index(rows).count() == 0 and K.detect_unit(rows).first()["unit"] == "m"
    assert K.layer_profiles(items).count() == 0 and K.footprints(items).count() == 0 and K.health(items).first()["status"] == "critical"


def test_narrowed_rank(spark):
    rows = [(float(i * i % 997),) for i in range(3000)]
    few, rank = K.narrowed(spark.createDataFrame(rows, "v double"), 1500, most=50, bins=16)
    assert few.count() <= 50 and sorted(r["v"] for r in few.collect())[rank] == sorted(v for (v,) in rows)[1500]
    same = spark.createDataFrame([(1.0,)] * 60, "v double")
    assert K.narrowed(same, 30, most=50)[1] == 30


def every_pair(items, layers, boosted=None):
    """What the matcher's pairs stand for: all eligible ones."""
    from mensura.operators import matching as M

    out = items.crossJoin(layers).where(M.eligible(F.col("kind")))
    return out if boosted is None else out.join(boosted, ["row_index", "layer"], "left")


def test_matches_are_those_of_all_pairs(spark, monkeypatch):
    from mensura.operators import matching as M

    bill = spark.createDataFrame([(1, "tabique divisorio recto", "m2"), (2, "zzz qqq vvv", "m2"), (3, "cable electrico", "m"), (4, "puerta madera", "un"), (5, "hormigon pilar", "m3"), (6, "nada comun", "m")], "row_index int, description string, unit string")
    rows = [(f"layer {i:02}", *x) for i, x in enumerate([(True, 5.0, False, 0.0, 0), (True, 0.0, True, 3.0, 2), (False, 0.0, True, 7.0, 1)] * 6)] + [("a-muro_tabique", True, 9.0, False, 0.0, 4), ("e-cable", False, 0.0, True, 8.0, 0), ("zz tabique", True, 1.0, True, 1.0, 1)]
    index = spark.createDataFrame(rows, "layer string, has_area boolean, total_area double, has_length boolean, total_length double, entity_count int")
    columns = ["row_index", "layer", "score", "rank", "next_score"]
    bill = bill.unionByName(bill.withColumn("row_index", F.col("row_index") + 100))  # descriptions that repeat are scored once
    best = lambda: sorted(map(tuple, M.best_layers(M.prepare_items(bill), M.prepare_layers(index)).select(*columns).collect()))
    states = lambda: sorted(map(tuple, M.match(bill, index).collect()), key=str)
    got = best(), states()
    monkeypatch.setattr(M, "pairs", every_pair)
    assert (best(), states()) == got and len(got[0]) == 60


HATCHED = ["0", "SECTION", "2", "BLOCKS", "0", "BLOCK", "2", "A", "0", "INSERT", "2", "B", "8", "0", "41", "2", "0", "ENDBLK", "0", "BLOCK", "2", "B", "0", "INSERT", "2", "A", "8", "0", "0", "LINE", "8", "0", "10", "0", "20", "0", "11", "1", "21", "0", "0", "ENDBLK", "0", "ENDSEC"] + [
    "0", "SECTION", "2", "ENTITIES", "0", "HATCH", "8", "muro", "10", "0", "20", "0", "91", "2", "92", "1", "93", "1", "72", "1", "10", "0", "20", "0", "11", "9", "21", "9",
    "92", "2", "93", "3", "10", "0", "20", "0", "10", "4", "20", "0", "10", "0", "20", "3", "98", "1", "10", "1", "20", "1", "0", "INSERT", "8", "Eje", "2", "A", "41", "3", "42", "3", "0", "INSERT", "8", "x", "2", "none", "0", "DIMENSION", "8", "x", "0", "ENDSEC", "0", "EOF"]


def test_items_of_a_drawing(spark):
    """Edge paths and seed points are no corners, blocks that hold each other end, unknown blocks and dimensions bring nothing."""
    e = S.entities(S.group_codes(spark.createDataFrame([("a", "\ufeff" + "\r\n".join(HATCHED)), ("b", ""), ("c", None)], "file string, value string")))
    hatch = e.where("type = 'HATCH'").first()
    assert [(p["x"], p["y"]) for p in hatch["points"]] == [(0, 0), (4, 0), (0, 3)]
    got = D.items(e, spark.createDataFrame([("a", 0.5)], "file string, factor double")).collect()
    assert {(r["type"], r["layer"], r["evidence"], r["name"]): r["value"] for r in got} == {
        ("length", "eje", "layer", None): 3.0, ("length", "eje", "insert", None): 3.0, ("block", "eje", "insert count", "A"): 2.0, ("block", "eje", "insert count", "B"): 1.0,
    }


def test_unit_factors(spark):
    rows = [(4, "m", 1.0, 0.001, "High"), (0, " CM ", 9.0, 0.01, "Medium"), (0, None, 5001.0, 0.001, "Medium"), (0, "ell", 2000.0, 1.0, "Low"), (None, None, None, 1.0, "Medium"), (9, "mm", 1.0, 1.0, "Low")]
    got = spark.createDataFrame(rows, "code int, hint string, size double, factor double, confidence string").select("factor", "confidence", D.unit_factor(F.col("code"), F.col("hint"), F.col("size")).alias("u")).collect()
    assert all(r["u"]["factor"] == r["factor"] and r["u"]["confidence"] == r["confidence"] for r in got)


def test_matches_in_context_are_those_of_all_pairs(spark, monkeypatch):
    from mensura import queries as core
    from mensura.operators import matching as M

    run = lambda: sorted(map(tuple, core.QUERIES["jn35_matches_in_context"](spark, "/root/testdata/sf0.001").collect()))
    got = run()
    monkeypatch.setattr(M, "pairs", every_pair)
    assert run() == got and got


def test_a_drawing_read_in_blocks(spark, tmp_path):
    """Borders of blocks and parts fall anywhere: between a code and its value, within corners, paths and old polylines."""
    rng = random.Random(7)
    body = []
    for k in range(120):
        body += rng.choice([
            ["0", "LINE", "8", f"l{k % 3}", "10", str(k), "20", "1", "11", "2", "21", "3"], HATCHED[HATCHED.index("HATCH") - 1 : HATCHED.index("HATCH") + 30] if "HATCH" in HATCHED else ["0", "POINT"],
            ["0", "LWPOLYLINE", "8", "a", "70", "1", *[x for i in range(9) for x in ("10", str(i), "20", str(i * i))]],
            ["0", "POLYLINE", "8", "b", *[x for i in range(5) for x in ("0", "VERTEX", "10", str(i), "20", "7")], "0", "SEQEND", "8", "b"],
            ["0", "ENDSEC", "0", "SECTION", "2", "BLOCKS", "0", "BLOCK", "2", f"b{k}", "0", "TEXT", "1", "word", "0", "ENDBLK", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"],
        ])
        body = body[: len(body) // 2 * 2]
    (tmp_path / "d.dxf").write_text("\n".join(["0", "SECTION", "2", "HEADER", "9", "$INSUNITS", "70", "4", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", *body, "0", "EOF"]))
    path, size = str(tmp_path / "d.dxf"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = S.entities(S.read_group_codes(spark, path)).drop("file")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        codes = S.split_codes(spark, path, 23)
        assert codes.select("part").distinct().count() > 20 and S.header_values(codes).first()["insunits"] == 4
        parts = S.entities(codes).drop("file")
        key = lambda r: r["entity"]
        assert sorted(parts.collect(), key=key) == sorted(whole.collect(), key=key)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_entities_of_texts_are_those_of_their_pairs(spark):
    """Odd drawings, too: corners after no polyline, nameless blocks, pairs without a code, spaces, a lone last line; and no sort or exchange."""
    rng = random.Random(5)
    pieces = [
        ["0", "LINE", "8", "l", "10", " 1.5", "20", "2", "11", "3", "21", "4"], ["0", " LINE ", " 8 ", " l ", "010", "7", "20", "x", "2", "n1", "2", "n2"], ["0", "POLYLINE", "8", "b", "67", "1", "10", "0", "20", "0"],
        ["0", "VERTEX", "10", "3", "20", "7", "42", "1"], ["0", "VERTEX", "10", "4", "30", "7", "20", "9"], ["0", "SEQEND", "8", "b"], ["0", "LWPOLYLINE", "70", "1", "10", "1", "20", "2", "abc", "zz", "10", "3", "q", "q", "20", "4", "10", "5"],
        HATCHED[HATCHED.index("HATCH") - 1 : HATCHED.index("HATCH") + 49], ["0", "HATCH", "92", "x", "10", "9", "20", "9", "92", "2", "10", "0", "20", "0", "92", "zz", "10", "5", "20", "5", "98", "1", "92", "y", "10", "6", "20", "6"],
        ["0", "SECTION", "2", "BLOCKS"], ["0", "SECTION", "2", "ENTITIES"], ["0", "SECTION"], ["0", "SECTION", "2", "A", "2", "BLOCKS"], ["0", "ENDSEC"], ["0", "BLOCK", "2", "X", "70", "0"], ["0", "BLOCK", "70", "0"], ["0", "BLOCK", "2", "", "8", "1"],
        ["0", "BLOCK", "2", "Y", "2", "Z"], ["0", "ENDBLK"], ["0", "INSERT", "2", "X", "10", "5", "20", "6"], ["x", "y"], ["0", "0"], ["70", "0"], ["0", ""], ["9", "$INSUNITS", "70", "4"], ["9", "$EXTMAX", "10", "7", "20", "8"], ["9", "$INSUNITS", "70", "6", "70", "5"],
    ]
    text = lambda: rng.choice(["\n", "\r\n", "\r"]).join([*rng.choice([[], [], ["999", "note"], ["1"]]), *[x for _ in range(rng.randrange(14)) for x in rng.choice(pieces)], *rng.choice([[], [], ["5"], [""]])])
    drawings = spark.createDataFrame([(f"f{i}", text()) for i in range(600)] + [("e", ""), ("n", None), ("z", "0"), ("b", "﻿0\nLINE\n8\n\0a")], "file string, value string")
    plain = lambda e: sorted(map(tuple, e.withColumn("points", F.transform("points", lambda p: F.struct(p["ring"], p["x"], p["y"]))).collect()), key=lambda r: r[:2])
    codes = S.group_codes(drawings)
    own = S.drawing_entities(drawings)
    assert plain(own) == plain(S.entities(codes).select(own.columns)) and own.dtypes[1:-1] == S.entities(codes).dtypes[1:-1]
    assert sorted(map(tuple, S.drawing_header(drawings).collect()), key=str) == sorted(map(tuple, S.header_values(codes).collect()), key=str)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_keywords_are_looked_up_in_a_text_that_is_folded_once(spark):
    """Each keyword used to fold the text again, in every place where its level was used."""
    from mensura.operators import classify as C

    rows = [("Tabique de yeso carton", "AREA", "wall_area", 0.95), ("Cañeria cobre", "LENGTH", "pipe_length", 0.95), ("zzz", "BLOCK", C.GENERIC["BLOCK"], 0.3), ("muro", "GLOBAL", "generic_area", 0.3)]
    df = spark.createDataFrame(rows, "d string, kind string, subtype string, confidence double").withColumn("s", C.subtype(F.col("d"), F.col("kind")))
    assert all((r["s"]["subtype"], r["s"]["confidence"]) == (r["subtype"], r["confidence"]) for r in df.collect())
    many = spark.range(4).select(C.subtype(F.concat("id", F.lit("a")), F.lit("AREA")), C.infer_discipline(F.lit(None).cast("string"), F.concat("id", F.lit("b")), F.lit("a-")))
    assert many._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 8


def test_segment_counts_are_those_of_the_segments(spark):
    body = ["0", "SECTION", "2", "ENTITIES", "0", "LINE", "8", "a", "10", "0", "20", "0", "11", "3", "21", "4", "0", "CIRCLE", "8", "a", "10", "1", "20", "1", "40", "0.5", "0", "ARC", "8", "b", "10", "1", "20", "1", "40", "7", "50", "0", "51", "90"]
    for flag, corners in (("1", 4), ("0", 4), ("1", 2), ("1", 1), ("0", 0)):
        body += ["0", "LWPOLYLINE", "8", f"p{flag}{corners}", "70", flag, *[x for i in range(corners) for x in ("10", str(i), "20", str(i * i))]]
    e = S.drawing_entities(spark.createDataFrame([("d", "\n".join([*body, "0", "CIRCLE", "8", "none", "0", "ARC", "8", "none", "40", "1", "0", "EOF"]))], "file string, value string"))
    want = D.line_segments(e).groupBy("file", "layer", "type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, D.segment_counts(e).collect())) == sorted(map(tuple, want.collect()))
