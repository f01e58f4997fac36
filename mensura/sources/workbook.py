"""Workbooks as a table of cells, and bills of quantities from cells.

A workbook is a zip of XML parts; each file is one row of the binary reader and is opened where it is read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.text import contains_any, strip_accents
from mensura.functions.units import classify_unit
from mensura.sources.files import cell_role, classify_row, parse_number

CELLS = "file string, sheet_index int, sheet string, row int, col int, text string, number double"
#: Sheets that hold a bill; rows that only sum up; words that exclude an item.
BILL_SHEETS = ["presupuesto", "cotiza", "itemizado"]
SUM_ROWS = ["total neto", "subtotal"]
EXCLUDED = ["no se considera", "no cotizar", "excluido"]


def _cells(frames):
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = set(z.namelist())
                shared = []
                if "xl/sharedStrings.xml" in names:
                    shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
                links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")):
                    part = links[sheet.get(rel)].lstrip("/")
                    for c in ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}")).iter(f"{main}c"):
                        letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                        col = 0
                        for x in letters:
                            col = col * 26 + ord(x) - 64
                        v = c.find(f"{main}v")
                        if c.get("t") == "inlineStr":
                            text = "".join(t.text or "" for t in c.iter(f"{main}t"))
                        elif v is None or v.text is None:
                            continue
                        else:
                            text = shared[int(v.text)] if c.get("t") == "s" else v.text
                        number = float(v.text) if v is not None and c.get("t") in (None, "n") else None
                        rows.append((path, k, sheet.get("name"), int(row), col, text, number))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in CELLS.split(", ")])


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_cells, CELLS)


def bill_sheet(cells: DataFrame) -> DataFrame:
    """Cells of each file's bill: the first sheet whose name says so, else the first."""
    named = contains_any(F.lower("sheet"), BILL_SHEETS)
    pick = cells.groupBy("file").agg(F.min(F.struct((~named).alias("other"), "sheet_index")).alias("p")).select("file", F.col("p.sheet_index").alias("sheet_index"))
    return cells.join(pick, ["file", "sheet_index"])


def header(cells: DataFrame, first: int = 50) -> DataFrame:
    """(file, header, roles): the header row of each file and the first column of each role."""
    roles = cells.where(F.col("row") <= first).withColumn("role", cell_role(F.col("text"))).where("role IS NOT NULL")
    by = roles.groupBy("file", "row", "role").agg(F.min("col").alias("col"))
    rows = by.groupBy("file", "row").agg(F.count("*").alias("n"), F.bool_or(F.col("role") == "description").alias("d"), F.map_from_entries(F.collect_list(F.struct("role", "col"))).alias("roles"))
    return rows.where("d AND n >= 2").groupBy("file").agg(F.min_by(F.struct("row", "roles"), F.struct((-F.col("n")).alias("m"), "row")).alias("h")).select("file", F.col("h.row").alias("header"), F.col("h.roles").alias("roles"))


def excluded(description: Column) -> Column:
    return contains_any(strip_accents(F.lower(description)), EXCLUDED)


def bill_items(cells: DataFrame) -> DataFrame:
    """file, row_index, description, unit, qty, price, row_type, expected_excluded of every row below the header."""
    own = bill_sheet(cells)
    h = header(own)
    body = own.join(F.broadcast(h), "file").where(F.col("row") > F.col("header"))  # one row for each file
    at = lambda role, c: F.max(F.when(F.col("col") == F.col("roles")[role], F.col(c)))
    rows = body.groupBy("file", "row").agg(
        F.trim(at("description", "text")).alias("description"), F.trim(at("unit", "text")).alias("unit"),
        F.coalesce(at("qty", "number"), parse_number(at("qty", "text"))).alias("qty"), F.coalesce(at("price", "number"), parse_number(at("price", "text"))).alias("price"),
    )
    rows = rows.where(F.col("description").isNotNull() & (F.col("description") != "") & ~contains_any(F.lower("description"), SUM_ROWS))
    return rows.select("file", F.col("row").alias("row_index"), "description", "unit", "qty", "price", classify_row(F.col("description"), F.col("unit")).alias("row_type"), excluded(F.col("description")).alias("expected_excluded"))


#: Units that speak for a column of units: of a mapping, of the column itself.
MAPPING_UNITS = ["m", "ml", "m2", "m²", "m3", "m³", "u", "un", "und", "gl", "glb", "global"]
COLUMN_UNITS = ["m", "ml", "m2", "m²", "m3", "m³", "u", "un", "und", "unidad", "unidades", "gl", "glb", "global", "pa", "est", "kg", "ton"]


def _first(items: DataFrame, most: int) -> DataFrame:
    from pyspark.sql import Window

    return items.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("row_index"))).where(F.col("rn") <= most)


def mapping_score(items: DataFrame, most: int = 30) -> DataFrame:
    """How well the first rows of a file fit their columns: 0.7 of known units and 0.3 of quantities and prices that are numbers."""
    known = F.avg(F.coalesce(F.lower(F.trim("unit")).isin(MAPPING_UNITS), F.lit(False)).cast("double"))
    numbers = F.avg((F.col("qty").isNotNull().cast("double") + F.col("price").isNotNull().cast("double")) / 2)
    return _first(items, most).groupBy("file").agg((known * 0.7 + numbers * 0.3).alias("score"))


def unit_score(items: DataFrame, most: int = 20) -> DataFrame:
    """Percentage of units among the first cells of a file's unit column that are not empty; files without one have no row."""
    own = _first(items.where(F.trim("unit") != ""), most)
    return own.groupBy("file").agg((F.avg(F.lower(F.trim("unit")).isin(COLUMN_UNITS).cast("double")) * 100).alias("score"))
