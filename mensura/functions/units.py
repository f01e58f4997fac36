"""Units of measure, measure kinds, item and layer categories, as Column expressions over small constant dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.functions.text import contains_any, first_containing, normalize_text

#: Canonical unit, measure kind, and how it is written.
UNITS: dict[str, tuple[str, list[str]]] = {
    "m": ("length", ["m", "ml", "mts", "mt", "metro", "metros"]),
    "m2": ("area", ["m2", "metro cuadrado", "metros cuadrados"]),
    "m3": ("volume", ["m3", "metro cubico", "metros cubicos", "metro cúbico", "metros cúbicos"]),
    "un": ("count", ["u", "un", "und", "unid", "unidad", "unidades", "pza", "pieza", "piezas", "punto", "puntos", "pto", "ptos"]),
    "gl": ("service", ["gl", "glb", "global", "alcance", "servicio", "instalacion", "instalación", "inst", "por mandante", "mandante", "p/mandante", "pm", "est", "estimado", "pa", "paquete"]),
}
TYPES = {"m": "LENGTH", "m2": "AREA", "m3": "VOLUME", "un": "BLOCK", "gl": "GLOBAL"}

#: Words that tell the kind of an item whose unit is unknown.
TYPE_WORDS = {
    "GLOBAL": ["instalacion", "instalación", "certificado", "tramite", "trámite", "legaliza", "inscripcion", "rotulacion", "limpieza", "aseo", "capacitacion", "planos", "as built", "puesta en marcha"],
    "LENGTH": ["canalización", "canalizacion", "ducto", "tubería", "tuberia", "tubo", "cable", "conductor", "cañería", "cañeria", "bandeja", "escalerilla", "malla", "baranda", "pasamanos"],
    "BLOCK": ["tablero", "gabinete", "rack", "ups", "transformador", "generador", "cámara", "camara", "sensor", "detector", "modulo", "enchufe", "interruptor", "luminaria", "foco", "equipo", "sirena", "pulsador", "poste", "curva", "copla", "terminal", "caja"],
}

#: What makes an item or a layer part of a trade.
ITEM_TRADES = {
    "ELECTRICAL": ["enchufe", "tomacorriente", "tablero", "alumbrado", "luminaria", "iluminacion", "electrico", "canalizado", "ups", "sensor", "parlante", "interruptor", "dimmer", "emergencia"],
    "SANITARY": ["lavamanos", "inodoro", "wc", "sanitario", "griferia", "bomba", "alcantarillado", "desague", "agua potable", "ap", "ventilacion"],
    "STRUCTURAL": ["hormigon", "acero", "viga", "columna", "fundacion", "pilar", "losa", "radier", "enfierradura", "malla"],
    "ARCHITECTURAL": ["tabique", "cielo", "muro", "piso", "ceramico", "pintura", "revestimiento", "puerta", "ventana", "vitrina", "mueble"],
}
LAYER_TRADES = {
    "ELECTRICAL": ["i-ele", "ele-", "e-", "elec", "fa-ilum", "fa_ilum", "fa_sistemas elec"],
    "SANITARY": ["i-san", "san-", "s-", "sani", "ap-", "alcant"],
    "STRUCTURAL": ["i-est", "est-", "e-", "struct", "hormigon"],
    "ARCHITECTURAL": ["a-arq", "arq-", "fa-", "fa_", "arch"],
}

#: Layers that are no geometry, by how their name starts; and parts of names that can't be measured.
ANNOTATION_STARTS = r"(?i)^(dimen|defpoints$|text|cotas?|anno|dim|mv[_-]?text|ejes?|marco|viewport|xref|title|border)"
ANNOTATION_TYPES = ["DIMENSION", "LEADER", "MULTILEADER", "ATTDEF", "ATTRIB"]
NON_MEASURABLE = ["dimen", "dimension", "dim", "texto", "text", "txt", "texto_m", "a-txt", "pdf_geometry", "pdf-", "g-dim", "g-text", "g-anno", "annotation", "anno", "defpoints", "viewport", "vport", "import", "dwf", "xref", "acad_", "acadiso", "mv_textos", "mv-textos"]


def clean_unit(c: Column) -> Column:
    out = F.lower(F.trim(c))
    for a, b in (("²", "2"), ("³", "3"), ("^2", "2"), ("^3", "3")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), "[.,;:]", "")


def classify_unit(raw: Column) -> Column:
    """struct<unit, kind, confidence, factor, skip_reason>."""
    own = clean_unit(raw)
    unit, kind = F.lit(None).cast("string"), F.lit("unknown")
    for canonical, (k, words) in UNITS.items():
        unit, kind = F.when(own.isin(words), canonical).otherwise(unit), F.when(own.isin(words), k).otherwise(kind)
    square = own.contains("cuadrado")
    cm, mm = (own == "cm2") | (own.contains("centimetro") & square), (own == "mm2") | (own.contains("milimetro") & square)
    known, missing = unit.isNotNull(), raw.isNull() | (F.trim(raw) == "")
    small = F.length(raw) <= 50
    ok = small & ~missing
    scaled = ok & ~known & (cm | mm)
    return F.struct(
        F.when(ok & known, unit).when(scaled, "m2").alias("unit"),
        F.when(ok & known, kind).when(scaled, "area").otherwise("unknown").alias("kind"),
        F.when(ok & known, 1.0).when(scaled, 0.95).otherwise(0.0).alias("confidence"),
        F.when(scaled & cm, 0.0001).when(scaled, 0.000001).alias("factor"),
        F.when(missing, "no_unit").when(ok & (known | scaled), None).otherwise("invalid_unit").alias("skip_reason"),
    )


def measure_kind(unit: Column) -> Column:
    """Kind by what the unit contains (area) or is (length, count, service)."""
    own = F.lower(F.trim(unit))
    length = F.lit(False)
    for u in ("m", "ml", "mt", "metro", "metros lineales"):
        length = length | (own == u) | own.startswith(f"{u} ")
    return (
        F.when(contains_any(own, ["m2", "m²", "mt2", "metro2", "metros cuadrados"]), "area")
        .when(length, "length")
        .when(own.isin("un", "u", "pza", "pieza", "und", "unidad"), "count")
        .when(own.isin("gl", "global", "sg"), "service")
        .otherwise("unknown")
    )


def item_type(description: Column, unit: Column) -> Column:
    """Kind that an item's geometry should have: by its unit; by words only where it has none that is known."""
    own = classify_unit(unit)["unit"]
    by_unit = F.lit(None).cast("string")
    for u, t in TYPES.items():
        by_unit = F.when(own == u, t).otherwise(by_unit)
    return F.coalesce(by_unit, first_containing(F.lower(description), TYPE_WORDS))


def requires_geometry(kind: Column) -> Column:
    return ~kind.isin("service", "unknown")


def item_trade(description: Column) -> Column:
    return first_containing(normalize_text(description), ITEM_TRADES)


def layer_trade(layer: Column) -> Column:
    """By prefix of the normalised name; normalising makes hyphens spaces, so only prefixes without them can match."""
    return first_containing(normalize_text(layer), LAYER_TRADES, start=True)


def is_annotation(layer: Column) -> Column:
    return layer.rlike(ANNOTATION_STARTS)


def is_non_measurable(layer: Column) -> Column:
    return contains_any(F.lower(layer), NON_MEASURABLE)


def layer_penalty(layer: Column, kind: Column) -> Column:
    default = (layer == "0") | (F.lower(layer) == "layer0") | (layer == "")
    return F.when(is_non_measurable(layer), 0.5).when(default & (kind == "AREA"), 0.4).otherwise(0.0)


def metres_factor(unit: Column) -> tuple[Column, Column]:
    """Factors of area and length to metres."""
    return F.when(unit == "mm", 1e-6).when(unit == "cm", 1e-4).otherwise(1.0), F.when(unit == "mm", 1e-3).when(unit == "cm", 1e-2).otherwise(1.0)


def unit_of_diagonal(diagonal: Column) -> Column:
    """Drawing unit that a diagonal of this many drawing units suggests."""
    return F.when(diagonal > 20000, "mm").when(diagonal > 2000, "cm").when(diagonal > 200, "cm").otherwise("m")
