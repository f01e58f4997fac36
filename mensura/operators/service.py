"""Range checks, confidence factors, region categories, names of blocks, layers and drawings; fuzzy scores by Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mensura.functions.text import contains_any
from mensura.operators import fuzzy as Z

#: Least, most, typical least, typical most by unit; other units have those of m2.
RANGES = {"m2": (0.1, 2000.0, 1.0, 500.0), "m²": (0.1, 2000.0, 1.0, 500.0), "ml": (0.1, 1000.0, 0.5, 200.0), "m": (0.1, 1000.0, 0.5, 200.0), "un": (1.0, 1000.0, 1.0, 100.0), "gl": (0.1, 100.0, 1.0, 10.0)}
#: Parts of the names of layers that are furniture, plants, notes, patterns or system layers.
NOISE_LAYERS = ["FURN", "MUEB", "SILLA", "MESA", "SOFA", "CAM", "BED", "CLOSET", "VEG", "ARB", "TREE", "PLANT", "JARDIN", "PAISAJE", "TEXT", "TXT", "NOTA", "ANNO", "DIM", "COTA", "ETIQUETA", "LABEL", "PATT", "PATTERN", "RELLENO", "SOMBRA", "DEFPOINTS", "VIEWPORT"]
#: Zone words in order, and the zone they stand for.
ZONES = {"SALA": "SALA", "ESTAR": "SALA", "COMEDOR": "COMEDOR", "COCINA": "COCINA", "BODEGA": "BODEGA", "DORMITORIO": "DORMITORIO", "DORM": "DORMITORIO", "BAÑO": "BAÑO", "BANO": "BAÑO", "LOGGIA": "LOGGIA", "LOGIA": "LOGGIA", "PASILLO": "PASILLO", "HALL": "HALL", "OFICINA": "OFICINA", "RECEPCION": "RECEPCION", "REUNIONES": "REUNIONES"}
#: Parts of file names and the discipline they tell, in order.
FILE_DISCIPLINES = {"ELEC": ["elec", "ilum", "enchufe", "cinc", "corrientes"], "SANI": ["sani", "agua", "alcan", "desague", "plom"], "ARQUI": ["arqui", "arq", "planta", "corte", "elev"], "ESTR": ["estr", "calculo", "horm"], "CLIMA": ["clima", "hvac", "aire"], "GAS": ["gas"]}
#: Families of terms.
FAMILIES = {
    "muro": ["tabique", "murete", "wall", "pantalla", "hormigon"],
    "losa": ["radier", "sobrelosa", "slab", "floor", "piso", "pavimento"],
    "cielo": ["ceiling", "falso", "volcanita", "yeso"],
    "puerta": ["door", "acceso", "porton"],
    "ventana": ["window", "vidrio", "cristal"],
    "impermeabilizacion": ["membrana", "waterproof", "aislacion"],
    "estuco": ["revestimiento", "mortero", "plaster"],
    "ceramica": ["porcelanato", "baldoza", "tile"],
}


def _range(unit: Column, k: int) -> Column:
    out = F.lit(RANGES["m2"][k])
    for u, r in RANGES.items():
        out = F.when(F.lower(F.trim(unit)) == u, r[k]).otherwise(out)
    return out


def absolute_issue(qty: Column, unit: Column) -> Column:
    return F.when(qty < _range(unit, 0), "absolute_min").when(qty > _range(unit, 1), "absolute_max")


def typical_issue(qty: Column, unit: Column) -> Column:
    return F.when(qty < _range(unit, 2), "typical_min").when(qty > _range(unit, 3), "typical_max")


def expected_issue(qty: Column, expected: Column, tolerance: float = 0.2) -> Column:
    """error or warning where a quantity is further from its expected value than the tolerance."""
    off = F.abs(qty / expected - 1)
    return F.when(expected.isNull() | (expected <= 0) | (off <= tolerance), None).when(off * 100 > 50, "error").otherwise("warning")


def hatch_issue(qty: Column, drawing: Column, source: Column) -> Column:
    return (source == "hatch") & (qty > drawing * 0.8)


def parent_issue(area: Column, parent: Column) -> Column:
    return area > parent * 1.1


def issues(qty: Column, unit: Column, expected: Column) -> Column:
    """All issues as rule:severity."""
    e = expected_issue(qty, expected)
    return F.array_compact(F.array(F.concat(absolute_issue(qty, unit), F.lit(":error")), F.concat(typical_issue(qty, unit), F.lit(":warning")), F.concat(F.lit("expected_match:"), e)))


def text_factor(score: Column) -> Column:
    return F.when(score >= 0.9, 1.0).when(score >= 0.7, 0.8).when(score >= 0.5, 0.6).otherwise(0.3)


def spatial_factor(strategy: Column, dist: Column) -> Column:
    return F.when(strategy == "inside", 1.0).when(strategy == "near_centroid", F.greatest(F.lit(0.3), 1 - dist / 5)).when(strategy == "directional", 0.6).otherwise(0.3)


def expected_factor(calculated: Column, expected: Column) -> Column:
    r = calculated / expected
    return F.when(expected.isNull() | (expected <= 0), 0.5).when(r.between(0.9, 1.1), 1.0).when(r.between(0.8, 1.2), 0.9).when(r.between(0.7, 1.4), 0.7).when(r.between(0.5, 2.0), 0.4).otherwise(0.1)


def geometry_factor(area: Column, convexity: Column) -> Column:
    size = F.when(area.between(1, 200), 0.2).when(area.between(0.5, 500), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) + F.coalesce(convexity * 0.3, F.lit(0.1)) + size)


def confidence(text: Column, spatial: Column, geometry: Column, expected: Column, source: Column, failed: Column, warnings: Column) -> Column:
    """Weighted factors; halved after a failure, else a tenth less for each warning; three decimals."""
    base = text * 0.20 + spatial * 0.25 + geometry * 0.20 + expected * 0.25 + source * 0.10
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.when(failed, 0.5).otherwise(1 - warnings * 0.1))), 3)


def keep_layer(layer: Column) -> Column:
    return F.coalesce(layer == "", F.lit(True)) | ~contains_any(F.upper(layer), NOISE_LAYERS)


def zone_intent(description: Column) -> Column:
    """Zone of the first zone word that stands alone; a letter beyond a-z ends a word."""
    own, out = F.upper(description), F.lit(None).cast("string")
    for word, zone in reversed(list(ZONES.items())):
        out = F.when(own.rlike(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"), zone).otherwise(out)
    return out


def file_discipline(name: Column) -> Column:
    out = F.lit("UNKNOWN")
    for d, words in reversed(list(FILE_DISCIPLINES.items())):
        out = F.when(contains_any(F.lower(name), words), d).otherwise(out)
    return out


def same_discipline(a: Column, b: Column) -> Column:
    loose = ["UNKNOWN", "GENERAL"]
    return a.isNull() | b.isNull() | a.isin(loose) | b.isin(loose) | (a == b)


def tab_id(description: Column) -> Column:
    n = F.regexp_extract(description, r"(?i)TAB\s*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("TAB"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)))


def label_code(description: Column) -> Column:
    """First code of a label (TAB, P, V, C, E, PT and a number) without its spaces and hyphens."""
    code = F.regexp_extract(F.upper(description), r"(?<![A-Z0-9])((?:TAB|PT|P|V|C|E)-?\s?\d{1,3})(?![0-9])", 1)
    return F.nullif(F.regexp_replace(code, r"[\s-]", ""), F.lit(""))


def unit_from_header(code: Column, preferred: Column, diagonal: Column) -> Column:
    """Metres for one drawing unit: by the header's code, else as preferred, else by the size of the drawing."""
    known = F.when(code == 1, 0.0254).when(code == 2, 0.3048).when(code == 4, 0.001).when(code == 5, 0.01).when(code == 6, 1.0)
    liked = F.when(preferred == "mm", 0.001).when(preferred == "cm", 0.01).when(preferred.isNotNull(), 1.0)
    guessed = F.when(diagonal > 20000, 0.001).when(diagonal > 2000, 0.01).when(diagonal > 200, 0.01).when(diagonal > 0, 1.0)
    return F.struct(F.coalesce(known, liked, guessed, F.lit(1.0)).alias("to_metres"), F.when(known.isNotNull(), "INSUNITS").when(liked.isNotNull(), "PREFERENCE").when(guessed.isNotNull(), "HEURISTIC").otherwise("DEFAULT").alias("source"))


def normalize_words(c: Column) -> Column:
    """Lower case, signs to single spaces; letters with accents stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"\s+", " "))


@F.pandas_udf(DoubleType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Containment, else the sequence ratio and a bonus for shared words.  Meant for distinct pairs of short names."""
    from difflib import SequenceMatcher

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        if (len(x) < 5 and x in y) or (len(y) < 5 and y in x):
            return 1.0
        if x in y or y in x:
            return 0.9
        p, q = set(x.split()), set(y.split())
        return min(1.0, SequenceMatcher(None, x, y).ratio() + len(p & q) / max(len(p), len(q)) * 0.3)

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r, score): all pairs of normalised names with a fuzzy score of at least the threshold, above 0.3.

    Pairs without a word in common and of which none is a part of the other score their sequence ratio; that bounds their letters in common.
    """
    word = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("w")
    l, r = left.select("l").where("l <> ''").distinct(), right.select("r").where("r <> ''").distinct()
    shared = l.select("l", word("l")).join(r.select("r", word("r")), "w").select("l", "r")
    met = shared.unionByName(Z.contained(l, r)).unionByName(Z.near_ratios(l, r, threshold)).distinct()
    return met.withColumn("score", fuzzy_score("l", "r")).where(F.col("score") >= threshold)


def family(term: Column) -> Column:
    """All words of a term's family; empty for others."""
    own, out = normalize_words(term), F.array().cast("array<string>")
    for key, words in reversed(list(FAMILIES.items())):
        out = F.when(own.isin(key, *words), F.array(*[F.lit(w) for w in (key, *words)])).otherwise(out)
    return out


def semantic_matches(terms: DataFrame, names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(term, name, score, strategy): equal, by family, else fuzzy from a threshold above 0, for dictionaries of any size.

    Terms and names meet by an index of their letters that loses no pair at the threshold; equal ones and families meet on theirs.
    """
    t = terms.withColumn("t", normalize_words(F.col("term"))).withColumn("f", family(F.col("term")))
    n = names.withColumn("n", normalize_words(F.col("name")))
    exact = t.join(n, F.col("t") == F.col("n")).select("term", "name", F.lit(1.0).alias("score"), F.lit("exact").alias("strategy"))
    # Words of a family are a fixed, short list: each name is marked with those that it contains.
    words = sorted({w for k, ws in FAMILIES.items() for w in (k, *ws)})
    marked = n.withColumn("w", F.explode(F.array_compact(F.array(*[F.when(F.col("n").contains(w), F.lit(w)) for w in words]))))
    synonym = t.select("term", "t", F.explode("f").alias("w")).join(marked, "w").where("t <> n").select("term", "name").distinct()
    near = Z.near_ratios(t.select(F.col("t").alias("l")), n.select(F.col("n").alias("r")), threshold).where("l <> r")
    met = near.join(t.select("term", F.col("t").alias("l")), "l").join(n.select("name", F.col("n").alias("r")), "r").select("term", "name", F.col("l").alias("t"), F.col("r").alias("n"))
    rest = met.join(synonym, ["term", "name"], "left_anti").select("term", "name", sequence_ratio("t", "n").alias("score")).where(F.col("score") >= threshold)
    sure = exact.unionByName(synonym.select("term", "name", F.lit(0.95).alias("score"), F.lit("synonym").alias("strategy")))
    return sure.unionByName(rest.withColumn("strategy", F.lit("fuzzy")))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def region_category(area: Column, aspect: Column, layer: Column) -> Column:
    """Category of a region by its size, shape and layer: the best score of 0.3 or more, else UNKNOWN."""
    own = F.lower(layer)
    part = lambda b, x: F.when(b, x).otherwise(0.0)
    named = lambda starts, words: part(own.rlike("^(" + "|".join(starts) + ")"), 0.35) + part(contains_any(own, words), 0.25)
    large = F.when(area > 10, 0.25).when(area > 5, 0.15).otherwise(0.0)
    small = F.when(area < 1, 0.25).when(area < 5, 0.15).otherwise(0.0)
    flat = part(aspect.between(0.3, 3.0), 0.1)
    scores = {
        "FLOOR": large + part(aspect.between(0.2, 5.0), 0.2) + flat + named(["fa_0", "floor", "piso", "losa"], ["pavimento", "piso", "losa"]),
        "WALL": part(aspect.between(3.0, 50.0), 0.2) + part(aspect > 3, 0.15) + part((aspect > 3) | (aspect < 0.3), 0.1) + named(["fa_muro", "wall", "muro", "tab"], ["muro", "tabique", "wall"]),
        "CEILING": large + part(aspect.between(0.2, 5.0), 0.2) + flat + named(["fa_cielo", "ceiling", "cielo"], ["cielo", "raso", "ceiling", "volcanita"]),
        "FIXTURE": small + part(aspect.between(0.1, 10.0), 0.2) + named(["door", "window", "furniture", "fixture"], ["puerta", "ventana", "mobiliario"]),
        "ANNOTATION": part(area < 0.01, 0.3) + named(["dim", "text", "note", "anno"], ["text", "dim", "cota", "nota", "seccion"]),
    }
    best = F.greatest(*[F.least(s, F.lit(1.0)) for s in scores.values()])
    out = F.lit("UNKNOWN")
    for name, s in reversed(list(scores.items())):
        out = F.when(F.round(F.least(s, F.lit(1.0)), 9) == F.round(best, 9), name).otherwise(out)
    return F.when(F.round(best, 9) >= 0.3, out).otherwise("UNKNOWN")


def layer_votes(rows: DataFrame, layer: str, trade: Column) -> DataFrame:
    """Trade with most layers, its share and how sure that makes it: one row."""
    v = rows.select(layer, trade.alias("trade")).distinct().where("trade <> 'UNKNOWN'").groupBy("trade").count()
    one = v.agg(F.min(F.struct((-F.col("count")).alias("m"), "trade")).alias("b"), F.sum("count").alias("n"))
    share = -F.col("b.m") / F.col("n")
    return one.select(F.col("b.trade").alias("trade"), share.alias("share"), F.when(share >= 0.7, "high").when(share >= 0.4, "medium").otherwise("low").alias("confidence"))


def first_prefix_match(rows: DataFrame, reference: DataFrame, size: int = 20) -> DataFrame:
    """For each text the first reference text that has its prefix inside or is inside its own.

    A text that contains a prefix contains it at some place, so both ways are equi-joins of prefixes with all pieces of their
    length; prefixes shorter than size are looked for by the lengths that occur.
    """
    r = reference.select(F.col("text").alias("r"), "ord")

    def inside(holders: DataFrame, held: DataFrame, holder: str, part: str) -> DataFrame:
        keys = held.withColumn("_p", F.substring(part, 1, size)).withColumn("_n", F.length("_p"))
        lengths = keys.agg(F.array_sort(F.collect_set("_n")).alias("_l"))  # size + 1 values at most
        own = holders.join(F.broadcast(lengths)).withColumn("_n", F.explode("_l"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(holder) - F.col("_n") + 1, F.lit(0)))
        pieces = F.when(F.length(holder) >= F.col("_n"), F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(holder), i, F.col("_n"))))).otherwise(F.array().cast("array<string>"))
        return own.withColumn("_p", F.explode(pieces)).join(keys, ["_p", "_n"]).select("text", "r", "ord")

    both = inside(r, rows.select("text"), "r", "text").unionByName(inside(rows.select("text"), r, "text", "r"))
    return both.groupBy("text").agg(F.min_by("r", "ord").alias("r"))
