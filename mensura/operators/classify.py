"""Subtypes and disciplines by keywords, checks of units and conversions, approval gates, scores of layers and regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.functions.text import contains_any, let, strip_accents
from mensura.functions.units import TYPES, UNITS

#: Words of the subtypes of areas, lengths and blocks.
SUBTYPES = {
    "AREA": {
        "floor_area": ["piso", "pavimento", "sobrelosa", "radier", "contrapiso", "baldosa", "ceramica piso", "porcelanato", "suelo", "losa", "carpeta", "firme", "solera", "vinilico", "flotante", "parquet", "alfombra", "palmeta", "adoquin", "empedrado"],
        "ceiling_area": ["cielo", "cielorraso", "plafon", "techo falso", "cielo raso", "entretecho", "falso cielo", "yeso carton cielo", "fibrocemento cielo"],
        "wall_area": ["muro", "tabique", "pared", "tabiqu", "envigado", "panel", "division", "revestimiento", "enchape", "estuco", "enlucido", "pintura muro", "ceramica mural", "porcelanato muro", "yeso", "estuque", "guarnecido", "aislacion termica", "lana mineral", "poliestireno"],
        "roof_area": ["techo", "cubierta", "tejado", "techumbre", "impermeabilizacion", "membrana", "asfaltica", "zinc", "teja", "plancha", "sandwich"],
        "opening_area": ["ventana", "puerta", "vano", "abertura", "cristal", "vidrio", "vidriera", "cancel"],
    },
    "LENGTH": {
        "wall_length": ["muro", "tabique", "pared", "envigado", "division", "panel"],
        "beam_length": ["viga", "dintel", "cadena", "solera", "correa", "cercha"],
        "column_length": ["pilar", "columna", "poste", "pie derecho"],
        "pipe_length": ["cañeria", "tuberia", "ducto", "cañon", "caño", "tubo", "conducto", "colector"],
        "cable_length": ["cable", "conductor", "alimentador", "circuito", "tendido"],
        "border_length": ["guardapolvo", "zocalo", "cornisa", "moldura", "borde", "perimetro", "canto"],
    },
    "BLOCK": {
        "electrical": ["tablero", "enchufe", "interruptor", "tomacorriente", "caja", "toma", "switch", "breaker", "centro de carga", "panel electrico"],
        "plumbing": ["lavatorio", "lavamanos", "inodoro", "wc", "ducha", "tina", "bidet", "urinario", "llave", "grifo", "valvula", "artefacto sanitario"],
        "hvac": ["rejilla", "difusor", "extractor", "ventilador", "aire acondicionado", "calefactor", "radiador", "split", "fan coil"],
        "furniture": ["mueble", "mobiliario", "estante", "repisa", "closet", "armario", "cajonera"],
        "fixture": ["luminaria", "lampara", "aplique", "foco", "spot", "downlight", "panel led"],
        "equipment": ["equipo", "bomba", "motor", "generador", "transformador", "ups", "grupo electrogeno"],
    },
}
GENERIC = {"AREA": "generic_area", "LENGTH": "generic_length", "BLOCK": "generic_block"}

#: Patterns of sheet names, in order, and the discipline they tell.
SHEETS = {
    "ARQUITECTURA": ["oocc", "arq", "arquitectura", "obra.*gruesa", "terminaciones", "revestimientos"],
    "ESTRUCTURAS": ["estr", "estructura", "hormigon", "acero", "fundacion"],
    "ELECTRICO": ["elec", "electrico", "iluminacion", "corrientes", r"ee\.?cc", "eecc"],
    "SANITARIO": ["sanit", "sanitario", "agua", "alcantarillado", r"ss\.?cc", "sscc"],
    "CLIMA": ["clima", "hvac", "aire.*acondicionado", "ventilacion", "calefaccion"],
    "INCENDIO": ["incendio", "fire", "rociador", "extintor", "deteccion", "alarma.*incendio"],
    "GAS": ["gas", "combustible"],
    "PAISAJISMO": ["paisaj", "jardin", "exterior", "landscape"],
}
#: Words of items and the discipline they tell.
DISCIPLINES = {
    "ARQUITECTURA": ["tabique", "muro", "cielo", "piso", "puerta", "ventana", "ceramico", "pintura", "enchape", "revestimiento", "sobrelosa", "radier", "estuco", "yeso", "papel mural", "alfombra", "porcelanato", "palmeta", "baranda", "pasamano"],
    "ESTRUCTURAS": ["hormigon", "pilar", "columna", "viga", "losa", "fundacion", "moldaje", "enfierradura", "acero", "estructura metalica", "cadena", "sobrecimiento", "zapata", "dado"],
    "ELECTRICO": ["tablero", "circuito", "canalizacion", "conductor", "cable", "interruptor", "tomacorriente", "enchufe", "luminaria", "ampolleta", "bandeja", "empalme", "transformador", "ups"],
    "SANITARIO": ["wc", "inodoro", "lavamanos", "lavaplatos", "ducha", "tina", "urinario", "lavadero", "grifo", "llave paso", "valvula", "tuberia", "pvc", "cobre", "desague", "ventilacion sanitaria", "camara inspeccion", "alcantarillado"],
    "CLIMA": ["aire acondicionado", "split", "fancoil", "chiller", "bomba calor", "difusor", "rejilla", "ducto", "damper", "unidad manejadora", "termostato", "radiador", "calefactor"],
    "INCENDIO": ["rociador", "sprinkler", "extintor", "gabinete incendio", "detector", "central incendio", "manguera", "red humeda", "red seca", "bomba incendio"],
    "GAS": ["medidor gas", "regulador gas", "valvula gas", "tuberia gas", "flexible gas", "calefont"],
    "PAISAJISMO": ["pasto", "arbol", "arbusto", "planta", "jardinera", "riego", "aspersion", "goteo", "palmeta exterior"],
}
#: Prefixes of layers and the discipline they tell.
LAYER_PREFIXES = {
    "ARQUITECTURA": ["a-", "arq-", "arq_", "fa-", "fa_"], "ESTRUCTURAS": ["s-", "st-", "est-", "str-", "e-est"], "ELECTRICO": ["e-", "el-", "elec-", "ee-"], "SANITARIO": ["p-", "s-san", "san-", "ss-"],
    "CLIMA": ["m-", "hvac-", "clima-", "mec-"], "INCENDIO": ["f-", "fire-", "inc-"], "GAS": ["g-", "gas-"], "PAISAJISMO": ["l-", "land-", "pais-"],
}


def folded(c: Column) -> Column:
    return F.trim(strip_accents(F.lower(c)))


def keyword_level(text: Column, words: Column, keyword: str) -> Column:
    """3: the keyword is a word of the folded text; 2: it is a part of it; 1: each of its words is; 0: none of these."""
    plain = keyword.replace("ñ", "n")
    each = reduce(lambda a, b: a & b, [text.contains(w) for w in plain.split()])
    return F.when(F.array_contains(words, plain), 3).when(text.contains(plain), 2).when(each, 1).otherwise(0)


def subtype(description: Column, kind: Column) -> Column:
    """struct<subtype, confidence, method, alternatives>: most exact match first, then most keywords, then the order of the table.

    Text, words and levels are computed once for a row and only for the table of its kind.
    """
    out = F.struct(F.lit("generic_area").alias("subtype"), F.lit(0.3).alias("confidence"), F.lit("default").alias("method"), F.array().cast("array<string>").alias("alternatives"))

    def row(order, sub, levels):
        return let(F.array(*levels), lambda v: F.struct((-F.array_max(v)).alias("level"), (-F.size(F.filter(v, lambda x: x > 0))).alias("n"), F.lit(order).alias("order"), F.lit(sub).alias("subtype")))

    def found(name, ranked):
        first = F.get(ranked, F.lit(0))
        return F.struct(
            F.coalesce(first["subtype"], F.lit(GENERIC[name])).alias("subtype"),
            F.when(first["level"] == -3, 0.95).when(first["level"] == -2, 0.85).when(first["level"] == -1, 0.75).otherwise(0.3).alias("confidence"),
            F.when(first["level"] == -3, "keyword_exact").when(first["level"] == -2, "keyword_partial").when(first["level"] == -1, "keyword_fuzzy").otherwise("default").alias("method"),
            F.transform(F.slice(ranked, 2, 2), lambda r: r["subtype"]).alias("alternatives"),
        )

    def of(name, table):
        rows = lambda t: F.array(*[row(i, sub, [keyword_level(t["text"], t["words"], k) for k in keys]) for i, (sub, keys) in enumerate(table.items())])
        both = let(folded(description), lambda c: F.struct(c.alias("text"), F.split(c, r"\s+").alias("words")))
        ranked = let(both, lambda t: F.array_sort(F.filter(rows(t), lambda r: r["level"] < 0)))
        return let(ranked, lambda v: found(name, v))

    for name, table in SUBTYPES.items():
        out = F.when(kind == name, of(name, table)).otherwise(out)
    return out


def sheet_discipline(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for d, patterns in reversed(list(SHEETS.items())):
        out = F.when(F.trim(F.lower(name)).rlike("|".join(patterns)), d).otherwise(out)
    return out


def item_discipline(description: Column) -> Column:
    """struct<discipline, confidence, keyword> of the longest keyword, the first of equal ones; null without one."""
    table = [(-len(k), i, d, k) for i, (d, k) in enumerate((d, k) for d, ks in DISCIPLINES.items() for k in ks)]
    # In this order the first keyword is the best one.
    best = sorted(table)
    hits = lambda text: F.coalesce(*[F.when(text.contains(k), F.struct(F.lit(d).alias("discipline"), F.lit("high" if n < -8 else "medium").alias("confidence"), F.lit(k).alias("keyword"))) for n, _, d, k in best])
    return let(strip_accents(F.lower(description)), hits)


def layer_discipline(layer: Column) -> Column:
    out = F.lit("UNKNOWN")
    for d, prefixes in reversed(list(LAYER_PREFIXES.items())):
        out = F.when(reduce(lambda a, b: a | b, [F.lower(layer).startswith(p) for p in prefixes]), d).otherwise(out)
    return out


def infer_discipline(sheet: Column, description: Column, layer: Column) -> Column:
    """struct<discipline, confidence, source>: by sheet, else item, else layer, else unknown."""
    told = F.struct(sheet_discipline(sheet).alias("sheet"), item_discipline(description).alias("item"), F.nullif(layer_discipline(layer), F.lit("UNKNOWN")).alias("layer"))

    def of(t):
        by_sheet, by_item, by_layer = t["sheet"], t["item"], t["layer"]
        item = by_item["discipline"]
        return F.struct(
            F.coalesce(by_sheet, item, by_layer, F.lit("UNKNOWN")).alias("discipline"),
            F.when(by_sheet.isNotNull(), "high").when(item.isNotNull(), by_item["confidence"]).when(by_layer.isNotNull(), "high").otherwise("low").alias("confidence"),
            F.when(by_sheet.isNotNull(), "sheet_name").when(item.isNotNull(), "item_keywords").when(by_layer.isNotNull(), "layer_patterns").otherwise("fallback").alias("source"),
        )

    return let(told, of)


#: Units that stand with a full stop, and powers as signs.
DOTTED = ["m2", "m3", "u", "un", "und", "unid", "pza", "pto", "ptos", "gl", "glb", "inst", "est", "m", "ml", "mts", "mt"]
POWERS = {"m²": "m2", "m^2": "m2", "m³": "m3", "m^3": "m3"}


def unit_table() -> dict[str, str]:
    """Each way to write a unit, and the unit."""
    out = {w: u for u, (_, words) in UNITS.items() for w in words}
    out |= POWERS
    return out | {f"{w}.": out[w] for w in DOTTED} | {"m².": "m2", "m³.": "m3"}


def validate_unit(raw: Column) -> Column:
    """struct<unit, confidence, skip_reason>: as written, else without punctuation, else without spaces."""
    table = unit_table()
    own = F.regexp_replace(F.trim(F.lower(raw)), r"\s+", " ")
    plain = F.regexp_replace(own, "[.,;:]", "")
    steps = [(own, 1.0), (plain, 0.95), (F.replace(plain, F.lit(" ")), 0.9)]
    lookup = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    hits = [F.try_element_at(lookup, c) for c, _ in steps]
    missing = raw.isNull() | (raw == "")
    confidence = F.when(hits[0].isNotNull(), 1.0).when(hits[1].isNotNull(), 0.95).when(hits[2].isNotNull(), 0.9).otherwise(0.0)
    shaped = own.rlike("^[a-z]{1,4}[0-9²³]?[.]?$")
    reason = F.when(missing, "no_unit").when(confidence > 0, None).when(shaped, "invalid_unit").when((own == "") | (F.length(own) > 30), "no_unit").otherwise("invalid_unit")
    return F.struct(F.when(~missing, F.coalesce(*hits)).alias("unit"), F.when(missing, 0.0).otherwise(confidence).alias("confidence"), reason.alias("skip_reason"))


def expected_type(unit: Column) -> Column:
    out = F.lit("UNKNOWN")
    for u, t in TYPES.items():
        out = F.when(validate_unit(unit)["unit"] == u, t).otherwise(out)
    return out


def type_matches(item: Column, expected: Column) -> Column:
    return F.when(expected == "UNKNOWN", True).when(expected == "GLOBAL", False).otherwise(item == expected)


#: What kinds of geometry serve a method.
COMPATIBLE = {"COUNT": ["block"], "LENGTH": ["length"], "AREA": ["area", "length"], "VOLUME": ["area", "length"], "GLOBAL": []}


def is_compatible(kind: Column, method: Column) -> Column:
    return reduce(lambda a, b: a | b, [(method == m) & kind.isin(ks) for m, ks in COMPATIBLE.items() if ks])


def conversion_issue(raw: Column, si: Column, kind: Column, factor: Column) -> Column:
    """mismatch where the ratio is more than 1 % off, large beyond the bounds of a length or an area; null if neither."""
    want = F.when(kind == "length", factor).when(kind == "area", factor * factor).otherwise(factor * factor * factor)
    off = (factor != 1.0) & (F.abs(si / raw - want) > 0.01 * want)
    return F.when(off, "mismatch").when((kind == "length") & (si > 100_000), "large").when((kind == "area") & (si > 10_000_000), "large")


def unit_code(name: Column) -> Column:
    """Short code of a drawing unit's name; metres if nothing fits."""
    own, out = F.lower(name), F.lit("m")
    for code, part in reversed([("mm", "millim"), ("cm", "centim"), ("m", "meter"), ("in", "inch"), ("ft", "foot")]):
        out = F.when(own.contains(part) | (own == code), code).otherwise(out)
    return out


def evaluate_length(length: Column, annotation: Column, median: Column, short: Column, only: Column, method: Column) -> Column:
    """struct<valid, suspect, threshold>: 0.5, 0.25 for mixed layers, 0.1 for real ones and where a length is wanted."""
    real, mixed = ~annotation & (median > 1.0), ~annotation & (short < 0.5)
    base = F.when(real, 0.10).when(mixed, 0.25).otherwise(0.5)
    limit = F.when((method == "LENGTH") & (base > 0.10), 0.10).otherwise(base)
    anyway, long = method == "GLOBAL", length >= limit
    rescued = (only & (length >= 0.01)) | (real & (length >= 0.05))
    return F.struct((anyway | long | rescued).alias("valid"), (~anyway & ~long & rescued).alias("suspect"), F.when(anyway, 0.0).otherwise(limit).alias("threshold"))


HORIZONTAL_WORDS = ["losa", "cielo", "impermeabilizacion", "cubierta", "radier", "piso", "terraza", "techo"]


def wall_fallback(classification: Column, description: Column) -> Column:
    return ~F.coalesce(classification == "HORIZONTAL", F.lit(False)) & ~contains_any(F.lower(description), HORIZONTAL_WORDS)


def approval_gate(unit: Column, evidence: Column, method: Column) -> Column:
    """Whether evidence and method may approve a quantity of that unit; units beyond these are not checked."""
    own = F.lower(unit)
    area = ((evidence == "area") & ((method == "direct_area") | method.startswith("profile_area"))) | ((evidence == "length") & method.isin("length_x_height", "length_x_height_default"))
    out = F.when(own.contains("m2") | (own == "m²"), area).when(own.isin("un", "u", "und", "unidad"), evidence == "block").when(own.isin("ml", "m"), evidence == "length").otherwise(True)
    return F.coalesce(out, F.lit(False))


def service_scope(description: Column, unit: Column) -> Column:
    """0.95 for services by their description, 0.9 for what the client supplies by the unit, else null: both need no drawing."""
    own = F.lower(description)
    scope = contains_any(own, ["instalacion", "instalación", "tramite", "trámite", "legaliz"]) | (own.contains("certificado") & ~own.contains("rotulado"))
    return F.when(scope, 0.95).when(contains_any(F.lower(unit), ["mandante", "cliente"]), 0.9)


def length_sanity(status: Column, qty: Column) -> Column:
    return F.when(qty < 0.5, "pending_no_geometry").when((qty < 2.0) | (qty > 5000), "pending").when(qty >= 1.0, "approved").otherwise(status)


def annotation_score(short: Column, median: Column, texts: Column, clusters: Column, total: Column, least: Column) -> Column:
    """Weighted mean of the signs that a layer is annotation; 0.5 without any."""
    third, twice = least / 3, least * 2
    parts = [(short > 0.7, 0.3, short), (median < third, 0.25, 1 - median / third), (texts > 0.3, 0.2, texts), (clusters > 0.5, 0.15, clusters), (total < twice, 0.1, 1 - total / twice)]
    score = reduce(lambda a, b: a + b, [F.when(on, w * x).otherwise(0.0) for on, w, x in parts])
    weight = reduce(lambda a, b: a + b, [F.when(on, w).otherwise(0.0) for on, w, _ in parts])
    return F.when(weight > 0, score / weight).otherwise(0.5)


def orientation_of(kind: Column, low: Column, high: Column) -> Column:
    """vertical where a line or face spreads in height, horizontal for hatches and flat faces."""
    spread = F.abs(high - low) > 0.01
    return F.when((kind == "LINE") & spread, "vertical").when(kind == "HATCH", "horizontal").when(kind == "3DFACE", F.when(spread, "vertical").otherwise("horizontal")).otherwise("unknown")


def region_score(inside: Column, dist: Column, area: Column, expected: Column, convexity: Column) -> Column:
    """0.4 for the label's place, 0.3 for the expected area, 0.2 for the shape and 0.1 for the size."""
    r = area / F.when(expected > 0, expected)
    label = F.when(inside, 0.4).otherwise(F.greatest(F.lit(0.0), 0.3 * (1 - dist / 5)))
    like = F.when(r.between(0.8, 1.2), 0.3).when(r.between(0.5, 2.0), 0.15).when(r.between(0.2, 5.0), 0.05).otherwise(0.0)
    size = F.when(area.between(1, 200), 0.1).when(area.between(0.5, 500), 0.05).otherwise(0.0)
    return F.coalesce(label, F.lit(0.0)) + like + convexity * 0.2 + size


#: Words of layer names that say nothing.
NOISE = ["de", "la", "el", "los", "las", "en", "con", "para", "por", "del", "a", "y", "o", "e", "u", "the", "of", "and", "for", "to", "in", "on"]


def layer_words(layer: Column) -> Column:
    own = F.split(F.regexp_replace(F.lower(layer), r"[-_.\s]+", " "), " ")
    return F.array_distinct(F.filter(own, lambda w: (F.length(w) > 2) & ~w.isin(NOISE)))


def feedback_text(c: Column) -> Column:
    """Lower case, single spaces; vowels and ñ without their marks, all other signs stay."""
    return F.translate(F.regexp_replace(F.trim(F.lower(c)), r"\s+", " "), "áàäâéèëêíìïîóòöôúùüûñ", "aaaaeeeeiiiioooouuuun")


def fix_encoding(c: Column) -> Column:
    """Text without replacement characters and C1 controls; a null is empty."""
    return F.coalesce(F.regexp_replace(c, "[�\u0080-\u009f]", ""), F.lit(""))
