"""File sources and sinks: takeoff CSV, drawing exchange files (group codes), cell tables of workbooks, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.functions.text import let, strip_accents
from mensura.functions.units import classify_unit
from mensura.operators.graph import checkpoint

TAKEOFF = "layer string, name string, cnt double, area double, length double, closed boolean, color string"


def read_takeoff_csv(spark: SparkSession, path: str) -> DataFrame:
    """Takeoff rows of CSV files with a header; columns are found by name, in any order and case.

    Layer and Name must be there.  A missing or zero count is 1; a zero area or length is null; rows without a layer go.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("multiLine", False).csv(path)
    by = {c.strip().lower(): c for c in raw.columns}
    for need in ("layer", "name"):
        if need not in by:
            raise ValueError(f"the file has no column {need}")
    col = lambda n: F.trim(F.col(f"`{by[n]}`")) if n in by else F.lit(None).cast("string")
    number = lambda n: F.nullif(F.regexp_extract(col(n), r"^\s*([+-]?\d*\.?\d+)", 1), F.lit("")).cast("double")
    closed = F.lower(col("closed"))
    out = raw.select(
        col("layer").alias("layer"),
        F.coalesce(col("name"), F.lit("")).alias("name"),
        F.coalesce(F.nullif(number("count"), F.lit(0.0)), F.lit(1.0)).alias("cnt"),
        F.nullif(number("area"), F.lit(0.0)).alias("area"),
        F.nullif(number("length"), F.lit(0.0)).alias("length"),
        F.when(closed == "true", True).when(closed == "false", False).alias("closed"),
        col("color").alias("color"),
    )
    return out.where("layer IS NOT NULL AND layer <> ''")


def read_group_codes(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, code, value) of drawing files; see group_codes."""
    return group_codes(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def group_codes(drawings: DataFrame) -> DataFrame:
    """(file, line, code, value) of drawings (file, value = the whole text): lines come in pairs of a code and a value.

    A byte order mark and NUL characters go, all line ends count; pairs without a numeric code are left out.
    """
    text = F.replace(F.replace("value", F.lit("\ufeff")), F.lit("\0"))
    lines = drawings.select("file", F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n").alias("l"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("l") / 2) - 1, F.lit(0))), lambda i: F.struct(i.cast("int").alias("line"), F.trim(F.get("l", (i * 2).cast("int"))).alias("code"), F.get("l", (i * 2 + 1).cast("int")).alias("value")))
    return lines.select("file", F.inline(pairs)).where(F.col("code").rlike(r"^\d+$")).withColumn("code", F.col("code").cast("int"))


def split_codes(spark: SparkSession, path: str, lines: int = 100_000) -> DataFrame:
    """(file, part, line, code, value) of drawing files that many tasks read: group_codes for drawings of any size.

    A file is read in blocks, each by one task.  How many lines the blocks before it have (one number for each block) gives a line its number,
    and so its place in a pair.  Parts of so many lines are what the windows of entities() run over.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    read = checkpoint(read)
    blocks = read.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    text = F.replace(F.replace("value", F.lit("\ufeff")), F.lit("\0"))
    numbered = read.join(offsets, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("no"), text.alias("value"))
    pairs = numbered.groupBy("file", F.floor(F.col("no") / 2).alias("line")).agg(F.max(F.when(F.col("no") % 2 == 0, F.trim("value"))).alias("code"), F.max(F.when(F.col("no") % 2 == 1, F.col("value"))).alias("value"))
    whole = pairs.where(F.col("code").rlike(r"^\d+$") & F.col("value").isNotNull())
    return whole.select("file", F.floor(F.col("line") / lines).alias("part"), F.col("line").cast("int").alias("line"), F.col("code").cast("int").alias("code"), "value")


def _running(rows: DataFrame, sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """Adds running sums and the last values so far, in the order of a file's lines.

    Where a file has parts, each is a window of its own, and what the parts before it give (one row for each part) is carried into it.
    """
    parts = [c for c in ("part",) if c in rows.columns]
    w = Window.partitionBy("file", *parts).orderBy("line")
    rows = rows.withColumns({k: F.sum(c).over(w) for k, c in sums.items()} | {k: F.last(c, True).over(w) for k, c in lasts.items()})
    if not parts:
        return rows
    rows = checkpoint(rows)
    ends = rows.groupBy("file", "part").agg(F.max_by(F.struct(*sums, *lasts), "line").alias("e"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "part", *[F.sum(f"e.{k}").over(earlier).alias(f"_{k}") for k in sums], *[F.last(f"e.{k}", True).over(earlier).alias(f"_{k}") for k in lasts])
    out = rows.join(carried, ["file", "part"])
    full = {k: F.col(k) + F.coalesce(f"_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(k, f"_{k}") for k in lasts}
    return out.withColumns(full).drop(*[f"_{k}" for k in full])


def _followed(rows: DataFrame) -> DataFrame:
    """Adds next, the code and value of the following line of a file; over the end of a part, from the first line of the next."""
    parts = [c for c in ("part",) if c in rows.columns]
    out = rows.withColumn("next", F.lead(F.struct("code", "value")).over(Window.partitionBy("file", *parts).orderBy("line")))
    if not parts:
        return out
    heads = rows.groupBy("file", "part").agg(F.min_by(F.struct("code", "value"), "line").alias("_head"))
    heads = heads.withColumn("part", F.lag("part").over(Window.partitionBy("file").orderBy("part"))).where("part IS NOT NULL")
    return out.join(heads, ["file", "part"], "left").withColumn("next", F.coalesce("next", "_head")).drop("_head")


def entities(codes: DataFrame) -> DataFrame:
    """One row for each entity: section, block, type, the first value of the codes that the engine uses, and its points.

    points are structs (line, ring, x, y) in the order of the file: the corners of a light polyline, the VERTEX rows of an old
    one (which are no entities of their own), and of a hatch the corners of its polyline paths, ring 1 being the outer one.
    Elevation and seed points of a hatch and its edge paths are no corners.  Of whole files all steps keep the partitioning by file; the codes of
    split_codes are worked on in parts, and only an entity's own lines meet.
    """
    code, value = F.col("code"), F.trim("value")
    m = _followed(codes).withColumn("y", F.when(F.col("next.code") == code + 10, F.col("next.value")).try_cast("double")).drop("next")
    m = _running(m, {"entity": (code == 0).cast("int")}, {"kind": F.when(code == 0, value)})
    hatch = F.col("kind") == "HATCH"
    m = _running(m, {"paths": (hatch & (code == 92)).cast("int")}, {
        "section": F.when((code == 2) & (F.col("kind") == "SECTION"), value), "block": F.when((code == 2) & (F.col("kind") == "BLOCK"), value),
        "line_work": F.when((code == 0) & (value == "POLYLINE"), F.col("entity")),
        "path": F.when(code == 0, 0).when(hatch & (code == 92), value.try_cast("int")).when(hatch & (code == 98), 0),
    })
    m = _running(m, {}, {"before": F.when(code == 0, F.col("paths"))})
    corner = (code == 10) & (F.col("kind").isin("LWPOLYLINE", "VERTEX") | (hatch & (F.col("path").bitwiseAND(2) > 0)))
    m = m.withColumns({
        "entity": F.when(F.col("kind").isin("VERTEX", "SEQEND"), F.coalesce("line_work", "entity")).otherwise(F.col("entity")),
        "point": F.when(corner, F.struct("line", (F.col("paths") - F.col("before")).alias("ring"), value.try_cast("double").alias("x"), "y")),
    })
    first = lambda c: F.min_by(F.when(code == c, value), F.when(code == c, F.col("line")))
    number = lambda c: first(c).try_cast("double")
    out = m.groupBy("file", "entity").agg(
        F.min_by("section", "line").alias("section"), F.min_by("block", "line").alias("block"), first(0).alias("type"), first(8).alias("layer"), first(2).alias("name"), first(1).alias("text"), first(5).alias("handle"),
        number(10).alias("x"), number(20).alias("y"), number(11).alias("x2"), number(21).alias("y2"), number(40).alias("radius"), number(41).alias("sx"), number(42).alias("sy"),
        number(50).alias("rotation"), number(51).alias("end_angle"), number(70).alias("flags"), number(67).alias("space"), F.array_sort(F.collect_list("point")).alias("points"),
    )
    out = out.withColumn("block", F.when(F.col("section") == "BLOCKS", F.when(F.col("type") == "BLOCK", F.col("name")).otherwise(F.col("block"))))
    return out.where("type NOT IN ('SECTION', 'ENDSEC', 'EOF')")


def _first(part: Column, code: int) -> Column:
    """Value of the first pair with that code in a part of _pairs; null without one."""
    at = F.instr(part, f"\n{code}\0")
    return F.when(at > 0, F.substring_index(F.substr(part, at + len(f"\n{code}\0")), "\n", 1))


def _kind(part: Column) -> Column:
    return F.substring_index(part, "\n", 1)


def _pairs(text: Column) -> Column:
    """A drawing's text with each pair of lines as newline, code, NUL, value, without what group_codes leaves out; spaces around both go."""
    own = F.replace(F.replace(text, F.lit("\ufeff")), F.lit("\0"))
    own = let(own, lambda t: F.when(t.contains("\r"), F.regexp_replace(t, "\r\n?", "\n")).otherwise(t))
    own = F.trim(let(own, lambda t: F.when(t.contains(" \n") | t.contains("\n "), F.regexp_replace(t, " *\n *", "\n")).otherwise(t)))
    own = F.regexp_replace(own, r"\G(?:(?:0*(\d+)\n([^\n]*)|[^\n]*\n[^\n]*)(?:\n|\z)|[^\n]+\z)", "\n$1\0$2")
    return F.replace(own, F.lit("\n\0"))


def _starts(parts: Column, here) -> Column:
    """(at, next) of the parts (from 1) for which `here` holds: where a group of parts begins, and the following one."""
    at = F.filter(F.transform(parts, lambda p, i: F.when(here(p), i + 1)), lambda i: i.isNotNull())
    return let(at, lambda v: F.transform(v, lambda a, k: F.struct(a.alias("at"), F.coalesce(F.get(v, k + 1), F.size(parts) + 1).alias("next"))))


def _corners(part: Column, ring: Column) -> Column:
    """(line, ring, x, y) of the pairs with code 10 in a part."""
    def one(p, i):
        after = F.get(F.split(p, "\n", 3), 1)
        return F.struct((i + 1).cast("int").alias("line"), ring.cast("long").alias("ring"), F.substring_index(p, "\n", 1).try_cast("double").alias("x"), F.when(after.startswith("20\0"), F.substr(after, F.lit(4))).try_cast("double").alias("y"))

    found = F.split(part, "\n10\0")
    return F.transform(F.slice(found, F.lit(2), F.size(found)), one)


def _hatch_corners(part: Column) -> Column:
    """Corners of a hatch's polyline paths: what follows code 92 up to code 98, if its value says so; one that is no number leaves the value before."""
    paths = F.transform(F.split(part, "\n92\0"), lambda p, i: F.struct(i.alias("ring"), F.when(i > 0, F.substring_index(p, "\n", 1).try_cast("int")).otherwise(0).alias("flag"), p.contains("\n98\0").alias("ends"), F.substring_index(p, "\n98\0", 1).alias("part")))
    before = lambda v, k: F.try_element_at(F.filter(F.transform(F.slice(v, F.lit(1), k), lambda p: F.when(p["ends"], 0).otherwise(p["flag"])), lambda f: f.isNotNull()), F.lit(-1))
    flag = lambda v, p: F.when(p["flag"].isNotNull(), p["flag"]).otherwise(before(v, p["ring"]))
    return let(paths, lambda v: F.flatten(F.transform(v, lambda p: F.when(flag(v, p).bitwiseAND(2) > 0, _corners(p["part"], p["ring"])).otherwise(F.array().cast(POINTS)))))


POINTS = "array<struct<line:int,ring:bigint,x:double,y:double>>"


def drawing_entities(drawings: DataFrame) -> DataFrame:
    """entities(group_codes(drawings)) of drawings (file, value = the whole text), without a row for each pair, a sort or an exchange.

    A text is cut where an entity begins; each of these parts is a row, whose values are looked up in it, and only those that are used.
    Here `line` of a point counts the corners of its part.  What VERTEX and SEQEND hold goes to the last old polyline before them; where
    something else lies between, which is malformed, that is searched for among all polylines of the drawing.
    """
    named = lambda p, n: (p == n) | p.startswith(f"{n}\n")
    loose = lambda p: named(p, "VERTEX") | named(p, "SEQEND")
    own = drawings.select("file", F.split(_pairs(F.col("value")), "\n0\0").alias("c"))
    # The first piece comes before any entity.
    own = own.select("file", F.slice("c", F.lit(2), F.size("c")).alias("c"))
    own = own.withColumn("heads", _starts(F.col("c"), lambda p: ~loose(p)))
    joined = lambda h: F.when(h["next"] == h["at"] + 1, F.get("c", h["at"] - 1)).otherwise(F.array_join(F.slice("c", h["at"], h["next"] - h["at"]), "\n0\0"))
    plain = F.transform("heads", lambda h: F.struct(h["at"].alias("entity"), joined(h).alias("part")))
    odd = loose(F.get("c", F.lit(0))) | F.exists("heads", lambda h: (h["next"] > h["at"] + 1) & ~named(F.get("c", h["at"] - 1), "POLYLINE"))
    numbers = F.transform("c", lambda p, i: F.struct((i + 1).alias("entity"), p.alias("part")))
    work = F.transform(F.filter(numbers, lambda p: named(p["part"], "POLYLINE")), lambda p: p["entity"])
    owned = let(work, lambda w: F.transform(numbers, lambda p: F.struct(F.when(loose(p["part"]), F.array_max(F.filter(w, lambda i: i < p["entity"]))).alias("of"), p["entity"].alias("entity"), p["part"].alias("part"))))
    strays = lambda v, p: F.transform(F.filter(v, lambda s: s["of"] == p["entity"]), lambda s: s["part"])
    whole = lambda v, p: F.struct(p["entity"].alias("entity"), F.when(named(p["part"], "POLYLINE"), F.array_join(F.concat(F.array(p["part"]), strays(v, p)), "\n0\0")).otherwise(p["part"]).alias("part"))
    mended = let(owned, lambda v: F.transform(F.filter(v, lambda p: p["of"].isNull()), lambda p: whole(v, p)))
    own = own.select("file", F.when(odd, mended).otherwise(plain).alias("e"))
    # Sections and blocks hold from their beginning on; a group begins with each of them.
    last = lambda p: F.when(p.contains("\n2\0"), F.substring_index(F.substring_index(p, "\n2\0", -1), "\n", 1))
    group = lambda p: named(p["part"], "SECTION") | named(p["part"], "BLOCK")
    heads = lambda n: F.filter(F.transform(F.filter("e", lambda p: named(p["part"], n)), lambda p: F.struct(p["entity"].alias("entity"), last(p["part"]).alias("name"))), lambda p: p["name"].isNotNull())
    own = own.withColumns({"g": _starts(F.col("e"), group), "sections": heads("SECTION"), "blocks": heads("BLOCK")})
    first = F.when(F.size("g") > 0, F.get("g", F.lit(0))["at"]).otherwise(F.size("e") + 1)
    own = own.withColumn("g", F.concat(F.array(F.struct(F.lit(1).alias("at"), first.alias("next"))), F.col("g")))
    rows = own.select("file", "e", "sections", "blocks", F.explode(F.filter("g", lambda g: g["next"] > g["at"])).alias("g")).withColumn("n", F.get("e", F.col("g.at") - 1)["entity"])
    upto = lambda c: F.try_element_at(F.filter(c, lambda s: s["entity"] <= F.col("n")), F.lit(-1))["name"]
    head = F.get("e", F.col("g.at") - 1)["part"]
    block = F.when(named(head, "BLOCK") & last(head).isNotNull(), last(head)).otherwise(upto("blocks"))
    rows = rows.select("file", upto("sections").alias("section"), block.alias("block"), F.inline(F.slice("e", F.col("g.at"), F.col("g.next") - F.col("g.at"))))
    part, kind = F.col("part"), F.col("type")
    rows = rows.withColumn("type", _kind(part)).where("type NOT IN ('SECTION', 'ENDSEC', 'EOF')")
    number = lambda c: _first(part, c).try_cast("double")
    vertices = F.flatten(F.transform(F.filter(F.split(part, "\n0\0"), lambda p: named(p, "VERTEX")), lambda p: _corners(p, F.lit(0))))
    points = F.when(kind == "LWPOLYLINE", _corners(part, F.lit(0))).when(kind == "HATCH", _hatch_corners(part)).when(kind.isin("POLYLINE", "VERTEX"), vertices).otherwise(F.array().cast(POINTS))
    return rows.select(
        "file", F.col("entity").cast("long").alias("entity"), "section", F.when(F.col("section") == "BLOCKS", F.when(kind == "BLOCK", _first(part, 2)).otherwise(F.col("block"))).alias("block"),
        "type", _first(part, 8).alias("layer"), _first(part, 2).alias("name"), _first(part, 1).alias("text"), _first(part, 5).alias("handle"),
        number(10).alias("x"), number(20).alias("y"), number(11).alias("x2"), number(21).alias("y2"), number(40).alias("radius"), number(41).alias("sx"), number(42).alias("sy"),
        number(50).alias("rotation"), number(51).alias("end_angle"), number(70).alias("flags"), number(67).alias("space"), points.alias("points"),
    )


def header_values(codes: DataFrame) -> DataFrame:
    """(file, insunits, min_x, min_y, max_x, max_y): unit code and extents that the headers of drawings state."""
    m = _running(codes, {}, {"variable": F.when(F.col("code") == 9, F.trim("value")).when(F.col("code") == 0, "")})
    at = lambda v, c: F.max(F.when((F.col("variable") == v) & (F.col("code") == c), F.trim("value"))).try_cast("double")
    return m.groupBy("file").agg(at("$INSUNITS", 70).cast("int").alias("insunits"), at("$EXTMIN", 10).alias("min_x"), at("$EXTMIN", 20).alias("min_y"), at("$EXTMAX", 10).alias("max_x"), at("$EXTMAX", 20).alias("max_y"))


def drawing_header(drawings: DataFrame) -> DataFrame:
    """header_values(group_codes(drawings)) of drawings (file, value = the whole text), looked up in their texts."""
    variables = F.transform(F.slice("v", F.lit(2), F.size("v")), lambda v: F.substring_index(v, "\n0\0", 1))
    values = lambda v, c: F.flatten(F.transform(F.filter(variables, lambda p: _kind(p) == v), lambda p: F.transform(F.slice(F.split(p, f"\n{c}\0"), F.lit(2), F.length(p)), _kind)))
    at = lambda v, c: F.array_max(values(v, c)).try_cast("double")
    own = drawings.select("file", _pairs(F.col("value")).alias("t"), "value").where((F.col("t") != "") | F.trim("value").rlike(r"^\d+$")).select("file", F.split("t", "\n9\0").alias("v"))
    return own.select("file", at("$INSUNITS", 70).cast("int").alias("insunits"), at("$EXTMIN", 10).alias("min_x"), at("$EXTMIN", 20).alias("min_y"), at("$EXTMAX", 10).alias("max_x"), at("$EXTMAX", 20).alias("max_y"))


def preflight(codes: DataFrame) -> DataFrame:
    """Counts, bounding box, external references of each drawing, and whether these stop the work."""
    return preflight_of(entities(codes))


def preflight_of(e: DataFrame) -> DataFrame:
    """preflight by the drawings' entities."""
    own = (F.col("section") == "ENTITIES")
    out = e.groupBy("file").agg(
        F.count_if(own & (F.coalesce("space", F.lit(0.0)) == 0)).alias("model_entities"), F.count_if(own & (F.col("space") == 1)).alias("paper_entities"),
        F.count_if((F.col("type") == "BLOCK") & ((F.col("flags").cast("int").bitwiseAND(16) > 0) | (F.col("flags").cast("int").bitwiseAND(32) > 0))).alias("xrefs"),
        F.min(F.when(own, F.col("x"))).alias("min_x"), F.max(F.when(own, F.col("x"))).alias("max_x"), F.min(F.when(own, F.col("y"))).alias("min_y"), F.max(F.when(own, F.col("y"))).alias("max_y"),
    )
    total = F.col("model_entities") + F.col("paper_entities")
    diagonal = F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return out.withColumns({"min_length": F.greatest(F.lit(0.001), F.coalesce(diagonal, F.lit(0.0)) * 1e-4), "blocking": (total == 0) | ((F.col("xrefs") > 0) & (total < 10))})


def layer_geometry(e: DataFrame) -> DataFrame:
    """Geometry types of each layer."""
    own = e.where("type IN ('LINE', 'LWPOLYLINE', 'POLYLINE', 'ARC', 'CIRCLE', 'HATCH', 'INSERT')")
    return own.groupBy("layer").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def block_counts(e: DataFrame) -> DataFrame:
    return e.where("type = 'INSERT'").groupBy("layer", "name").agg(F.count("*").alias("n"))


#: Words that tell what a column of a bill holds.
ROLES = {
    "description": ["descripcion", "partida", "item", "detalle", "designacion"],
    "unit": ["unidad", "und", "un.", "u.m", "ud"],
    "qty": ["cantidad", "cant", "cubicacion"],
    "price": ["precio", "p.u", "unitario", "p. unit"],
    "total": ["total", "valor"],
}


def cell_role(text: Column) -> Column:
    own = strip_accents(F.lower(F.trim(text)))
    out = F.lit(None).cast("string")
    for role, words in reversed(list(ROLES.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | own.contains(w)
        out = F.when(hit, role).otherwise(out)
    return out


def header_row(cells: DataFrame, first: int = 50) -> DataFrame:
    """(sheet, row): of the first rows of each sheet, the one with a description and most roles; the earliest wins ties."""
    roles = cells.where(F.col("row") <= first).withColumn("role", cell_role(F.col("text"))).where("role IS NOT NULL")
    score = roles.groupBy("sheet", "row").agg(F.count_distinct("role").alias("score"), F.bool_or(F.col("role") == "description").alias("described"))
    return score.where("described AND score >= 2").groupBy("sheet").agg(F.min_by("row", F.struct((-F.col("score")).alias("s"), "row")).alias("row"))


def parse_number(text: Column) -> Column:
    """A number in a cell: other signs go, the first comma is a full stop."""
    own = F.regexp_replace(text, r"[^0-9.,-]", "")
    own = F.concat(F.substring_index(own, ",", 1), F.when(own.contains(","), F.concat(F.lit("."), F.substr(own, F.instr(own, ",") + 1))).otherwise(""))
    return F.nullif(F.regexp_extract(own, r"^-?\d*\.?\d+", 0), F.lit("")).cast("double")


def classify_row(description: Column, unit: Column) -> Column:
    note = F.lower(description).rlike("^(nota|observacion)")
    return F.when(note, "note").when(unit.isNull() | (F.trim(unit) == ""), "section_header").when(classify_unit(unit)["kind"] == "service", "service").otherwise("item")


def write_bill(rows: DataFrame, bill: DataFrame) -> DataFrame:
    """The bill with the quantities and prices of rows that are neither ignored nor rejected; a unit only where none was."""
    kept = rows.where("status NOT IN ('ignored', 'rejected')").select(F.col("id").alias("row_index"), "qty_final", "unit_price_ref")
    j = bill.join(kept, "row_index", "left")
    return j.select("row_index", "description", "unit", F.coalesce("qty_final", "qty").alias("qty"), F.coalesce("unit_price_ref", "price").alias("price"))


#: Characters of windows-1252 at 80 to 9F (hexadecimal); five places hold none and stay as they are.
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if they are valid, else windows-1252, where every byte is a character."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(chr(i) for i in range(0x80, 0xA0)), WINDOWS_1252)
    return F.coalesce(F.try_validate_utf8(content.cast("string")), latin)


def json_items(files: DataFrame, fields: str) -> DataFrame:
    """Rows of files (file, value = a JSON array of objects) with the given fields; what is no array gives no rows."""
    own = files.where(F.ltrim("value").startswith("["))
    return own.select("file", F.inline(F.from_json("value", f"array<struct<{fields}>>")))
