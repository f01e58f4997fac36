"""Checks, gates, scores and quantity rules as ordered case expressions; several of one row share its scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.functions.text import contains_any, strip_accents

#: Words of floors, of vertical and horizontal surfaces, how a height is written, default wall height.
FLOOR_WORDS = ["piso", "losa", "pavimento", "sobrelosa", "radier", "fundacion", "contrapiso", "alfombra", "cerámico", "ceramica", "porcelanato", "pvc", "vinilico", "floor", "slab"]
VERTICAL_WORDS = ["tabique", "muro", "sobretabique", "pilar", "columna", "pared", "tabiqueria", "division", "divisorio", "empaste", "estuco", "enlucido", "revoque", "pintura tabique", "pintura muro", "ceramico muro", "azulejo", "enchape", "revestimiento muro", "papel mural", "viga", "pilastra", "contrafuerte"]
HORIZONTAL_WORDS = ["cielo", "cielo falso", "cielo raso", "plafon", "cupula", "boveda", "cenefa", "piso", "pavimento", "solera", "radier", "ceramica", "porcelanato", "losa", "entrepiso", "cubierta", "techumbre", "impermeabiliza", "membrana", "aislacion"]
HEIGHTS = [r"h\s*[=:]\s*(\d[\d.,]*)\s*m?", r"altura\s*[=:]\s*(\d[\d.,]*)\s*m?", r"(\d+[.,]\d+)\s*m\s*(?:alto|altura)", r"alto\s*[=:]\s*(\d[\d.,]*)\s*m?"]
WALL_HEIGHT = 2.4


def sanity(qty: Column, kind: Column, description: Column) -> Column:
    """severity (ok, warning, error) of a quantity for its measure kind; null is ok."""
    floor = contains_any(F.lower(description), FLOOR_WORDS)
    tiny = (qty < 0.01) & (qty > 0)
    length = F.when(qty > 10_000, "error").when((qty > 1000) | tiny, "warning").otherwise("ok")
    area = F.when(floor & (qty < 1) & (qty > 0), "error").when(qty > 100_000, "error").when((qty > 10_000) | (~floor & tiny), "warning").otherwise("ok")
    volume = F.when(qty > 1_000_000, "error").when(qty > 10_000, "warning").otherwise("ok")
    count = F.when((qty != F.floor(qty)) | (qty > 500), "error").otherwise("ok")
    service = F.when(~qty.isin(0.0, 1.0), "warning").otherwise("ok")
    return (
        F.when(qty.isNull() | F.isnan(qty), "ok").when(qty < 0, "error")
        .when(kind == "length", length).when(kind == "area", area).when(kind == "volume", volume).when(kind == "count", count).when(kind == "service", service)
        .otherwise("ok")
    )


def orientation(description: Column) -> Column:
    own = strip_accents(F.lower(description))
    return F.when(contains_any(own, VERTICAL_WORDS), "vertical").when(contains_any(own, HORIZONTAL_WORDS), "horizontal").otherwise("unknown")


def wall_height(description: Column) -> Column:
    """A height that the text states, if it is between 0 and 20."""
    own = F.lower(description)
    out = F.lit(None).cast("double")
    for p in reversed(HEIGHTS):
        h = F.nullif(F.regexp_extract(F.replace(F.regexp_extract(own, p, 1), F.lit(","), F.lit(".")), r"^\d+(?:\.\d+)?", 0), F.lit("")).cast("double")
        out = F.coalesce(F.when((h > 0) & (h < 20), h), out)
    return out


def derived_area(length: Column, description: Column) -> Column:
    """Area of a vertical surface from its length; null for others."""
    return F.when((length > 0) & (orientation(description) == "vertical"), length * F.coalesce(wall_height(description), F.lit(WALL_HEIGHT)))


def gates(confidence: Column, type_matches: Column, qty: Column, layer: Column, severity: Column) -> Column:
    """Names of the quality gates that a row fails."""
    return F.array_compact(F.array(
        F.when(confidence < 0.4, "low_confidence"), F.when(~type_matches, "type_mismatch"), F.when(qty == 0, "zero_quantity"),
        F.when(severity == "error", "outlier"), F.when(layer == "0", "layer_zero"),
    ))


def row_status(confidence: Column, type_matches: Column, qty: Column) -> Column:
    return F.when(~type_matches, "pending_type_mismatch").when(qty.isNull(), "pending_no_geometry").when(confidence >= 0.7, "approved").when(confidence >= 0.4, "pending").otherwise("pending_no_match")


def geometry_prior(area: Column) -> Column:
    return F.least(F.lit(0.2), F.log10(area + 1) * 0.066)


def computed_quantity(unit: Column, area: Column, length: Column, blocks: Column, wall: Column) -> Column:
    """Quantity of an item from the sums of its geometry, by its unit."""
    return (
        F.when(unit == "m2", F.when(wall & (length > 0), length * WALL_HEIGHT).otherwise(area))
        .when(unit == "m", length).when(unit == "un", blocks).when(unit == "gl", 1.0).otherwise(0.0)
    )


#: Units and words that tell how a quantity is computed.
METHOD_UNITS = {
    "COUNT": ["un", "u", "und", "unidad", "unidades", "pza", "pieza", "c/u", "num", "nº"],
    "AREA": ["m2", "m²", "mt2"],
    "VOLUME": ["m3", "m³", "mt3"],
    "LENGTH": ["m", "ml", "mts", "metro", "metros", "mt"],
    "GLOBAL": ["gl", "glb", "global", "est", "est.", "estimado", "pa"],
}
METHOD_WORDS = {"COUNT": ["punto", "tablero", "equipo"], "LENGTH": ["tubería", "canalización", "conductor"], "AREA": ["pintura", "piso"]}


def calc_method(unit: Column, description: Column) -> Column:
    """struct<method, confidence>: by the unit, else by words, else GLOBAL."""
    own = F.lower(F.trim(unit))
    by_unit = by_word = F.lit(None).cast("string")
    for m, units in reversed(list(METHOD_UNITS.items())):
        by_unit = F.when(own.isin(units), m).otherwise(by_unit)
    for m, words in reversed(list(METHOD_WORDS.items())):
        by_word = F.when(contains_any(F.lower(description), words), m).otherwise(by_word)
    return F.struct(F.coalesce(by_unit, by_word, F.lit("GLOBAL")).alias("method"), F.when(by_unit.isNotNull(), 0.99).when(by_word.isNotNull(), 0.7).otherwise(0.1).alias("confidence"))


#: Fixed values: (typical least, typical most, absolute most) by unit and context; words of the contexts.
BOUNDS = {
    "m2": {"floor": (10.0, 200.0, 2000.0), "wall": (5.0, 150.0, 1000.0), "ceiling": (10.0, 150.0, 1000.0), "small": (0.01, 10.0, 50.0)},
    "ml": {"general": (1.0, 200.0, 1000.0)},
    "m": {"general": (1.0, 200.0, 1000.0)},
    "m3": {"general": (0.1, 100.0, 1000.0)},
    "un": {"general": (1.0, 50.0, 500.0)},
    "u": {"general": (1.0, 50.0, 500.0)},
    "und": {"general": (1.0, 50.0, 500.0)},
    "gl": {"general": (1.0, 1.0, 1.0)},
}
WHOLE_UNITS = ["un", "u", "und", "gl"]
CONTEXTS = {
    "floor": "losa|sobrelosa|piso|pavimento|floor|slab|radier|contrapiso",
    "wall": "muro|muros|wall|walls|tabique|sobretabique|partition|mamposteria",
    "ceiling": "cielo|cielos|ceiling|raso|plafon|volcanita",
    "small": "puerta|door|ventana|window|fixture|detalle|impermeabilizaci[oó]n",
}


def context(description: Column) -> Column:
    out = F.lit("general")
    for name, words in reversed(list(CONTEXTS.items())):
        out = F.when(F.lower(description).rlike(rf"(?<![a-z0-9_])({words})(?![a-z0-9_])"), name).otherwise(out)
    return out


def bounds_check(qty: Column, unit: Column, description: Column) -> Column:
    """severity by the bounds of unit and context; a unit without general bounds falls back to its first."""
    own, where, out = F.lower(F.trim(unit)), context(description), F.lit("ok")
    for u, by in BOUNDS.items():
        verdict = F.lit("ok")
        for name, (low, high, most) in by.items():
            here = F.when(qty > most, "error").when((qty < low) | (qty > high), "warning").otherwise("ok")
            verdict = F.when(where == name, here).otherwise(verdict)
        fallback = by.get("general", next(iter(by.values())))
        general = F.when(qty > fallback[2], "error").when((qty < fallback[0]) | (qty > fallback[1]), "warning").otherwise("ok")
        verdict = F.when(where.isin([n for n in by if n != "general"]), verdict).otherwise(general)
        out = F.when(own == u, F.when((qty != F.floor(qty)) & F.lit(u in WHOLE_UNITS), "error").otherwise(verdict)).otherwise(out)
    return F.when(qty.isNull() | (qty < 0), "error").otherwise(out)


def pricing_mode(unit: Column, description: Column) -> Column:
    return F.when(F.lower(unit).isin("gl", "glb", "global") | contains_any(strip_accents(F.lower(description)), ["instalacion", "servicio", "mano de obra", "flete"]), "service").otherwise("material")
