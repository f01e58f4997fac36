"""Workbooks, version store, trust of blocks, configured rules."""

import zipfile

from pyspark.sql import functions as F

from mensura.operators import reports as R
from mensura.operators import versions as V
from mensura.sources import workbook as W

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def cell(ref, v):
    return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'


def workbook(path, sheets):
    ns = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{ns}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", SHEET.format("".join(f'<row r="{r}">' + "".join(cell(f"{chr(64 + c)}{r}", v) for c, v in row.items()) + "</row>" for r, row in rows.items())))


def test_bill_from_a_workbook(spark, tmp_path):
    workbook(tmp_path / "b.xlsx", {
        "Notas": {1: {1: "x"}},
        "Presupuesto obra": {2: {1: "Proyecto"}, 4: {1: "Descripción", 2: "Unidad", 3: "Cantidad", 4: "Precio"}, 5: {1: "OBRA GRUESA"}, 6: {1: "Muro", 2: "m2", 3: 12.5, 4: "$ 3,5"}, 7: {1: "Aseo", 2: "gl", 3: 1}, 8: {1: "Puerta (no cotizar)", 2: "un", 3: 2}, 9: {1: "Total neto", 4: 99}, 10: {1: "Nota: algo", 2: "m2"}},
    })
    items = W.bill_items(W.read_cells(spark, str(tmp_path)))
    got = {r["row_index"]: r for r in items.collect()}
    assert {k: r["row_type"] for k, r in got.items()} == {5: "section_header", 6: "item", 7: "service", 8: "item", 10: "note"}
    assert got[6]["qty"] == 12.5 and got[6]["price"] == 3.5 and got[8]["expected_excluded"] and not got[6]["expected_excluded"]
    assert 0.5 < W.mapping_score(items).first()["score"] < 1


def test_snapshots_round_trip(spark):
    rows = spark.createDataFrame([("b", 1, 2.5, "x"), ("b", 2, None, "y"), ("c", 3, 1.0, "z")], "batch_id string, id long, qty double, status string")
    versions = spark.createDataFrame([("b", 4)], "batch_id string, version_number int")
    made = V.create_snapshots(rows, versions, "s", "u")
    assert {r["batch_id"]: (r["version_number"], r["n_rows"]) for r in made.collect()} == {"b": (5, 2), "c": (1, 1)}
    back = V.restore(made, rows.schema)
    assert sorted(map(tuple, back.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    changed = rows.withColumn("qty", F.lit(9.0))
    assert sorted(map(tuple, V.replace_batches(changed, back.where("batch_id = 'b'")).collect()), key=str) == sorted([("b", 1, 2.5, "x"), ("b", 2, None, "y"), ("c", 3, 9.0, "z")], key=str)
    assert R.snapshot(rows).count() == 2


def test_counters(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    assert {r["k"]: r["n"] for r in V.increment(t, ["k"], "n", spark.createDataFrame([("a",), ("a",), ("z",)], "k string")).collect()} == {"a": 3, "b": 2}


def test_block_trust(spark):
    rows = [("*U12", "muro", "none"), ("", "muro", "none"), ("silla", "0", "low"), ("Puerta 1", "0", "high"), ("silla", "muebles", "medium"), ("ab", "muebles", "low"), ("LUM_12", "temp", "high")]
    got = spark.createDataFrame(rows, "name string, layer string, want string").select("want", V.block_trust(F.col("name"), F.col("layer"))["confidence"].alias("c")).collect()
    assert all(r["want"] == r["c"] for r in got)


def test_configured_rules(spark):
    rules = spark.createDataFrame([("r1", "range", '{"field": "qty", "min": 1, "max": 5}', True), ("r2", "range", '{"field": "qty", "min": 0, "max": 1}', False), ("r3", "range", "broken", True)], "id string, rule_type string, config string, enabled boolean")
    many = rules.unionByName(spark.range(1500).selectExpr("concat('m', id) AS id", "'range' AS rule_type", """'{"field": "qty", "min": 2.5, "max": 9}' AS config""", "true AS enabled"))
    rows = spark.createDataFrame([(1, 0.5), (2, 3.0), (3, None)], "id long, qty double")
    assert [r["broken"] for r in V.broken_rules(rows, rules).orderBy("id").collect()] == [["r1"], [], []]
    assert [len(r["broken"]) for r in V.broken_rules(rows, many).orderBy("id").collect()] == [1501, 0, 0]
