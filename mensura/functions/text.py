"""Text normalisation and similarity as Column expressions: no UDF, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin-1 letters with accents and their plain letters.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

#: Words that say nothing about an item.
STOPWORDS = ["de", "del", "la", "el", "los", "las", "en", "con", "para", "por", "y", "a", "un", "una"]

#: Construction terms and what else they are called.
SYNONYMS: dict[str, list[str]] = {
    "tabiqueria": ["tabique", "muro", "divisorio", "partition", "pared", "murillo", "sobretabique"],
    "muro": ["tabique", "tabiqueria", "pared", "wall", "murillo"],
    "pared": ["muro", "tabique", "wall"],
    "sobretabique": ["tabique", "tabiqueria", "muro"],
    "piso": ["suelo", "floor", "pavimento", "radier"],
    "cielo": ["techo", "ceiling", "cielorraso", "plafon"],
    "techo": ["cielo", "ceiling", "cubierta"],
    "losa": ["sobrelosa", "radier", "slab", "placa"],
    "sobrelosa": ["losa", "radier", "placa"],
    "radier": ["losa", "sobrelosa", "piso", "fundacion"],
    "pavimento": ["piso", "suelo", "floor", "revestimiento"],
    "bano": ["wc", "sanitario", "toilet", "restroom", "bath", "aseo"],
    "wc": ["bano", "sanitario", "toilet", "bath"],
    "lavamanos": ["lavabo", "lav", "vanity", "sink"],
    "inodoro": ["wc", "toilet", "water"],
    "ceramico": ["ceramica", "porcelanato", "tile", "baldosa", "azulejo"],
    "porcelanato": ["ceramico", "ceramica", "tile", "baldosa"],
    "marmol": ["marmol", "marble", "piedra"],
    "pintura": ["paint", "latex", "esmalte"],
    "revestimiento": ["enchape", "recubrimiento", "acabado", "finish"],
    "impermeabilizacion": ["membrana", "asfaltica", "waterproof"],
    "electrico": ["electrical", "elec", "elect"],
    "enchufe": ["tomacorriente", "outlet", "socket", "punto"],
    "interruptor": ["switch", "llave", "int"],
    "luminaria": ["lampara", "luz", "light", "lighting", "foco"],
    "tablero": ["panel", "board", "cuadro"],
    "punto": ["enchufe", "tomacorriente", "outlet"],
    "hormigon": ["concreto", "concrete", "hg"],
    "acero": ["fierro", "steel", "fe"],
    "viga": ["beam", "cadena"],
    "columna": ["pilar", "column", "col"],
    "puerta": ["door", "pta", "acceso"],
    "ventana": ["window", "vta", "vano"],
    "vitrina": ["escaparate", "showcase", "display"],
    "arq": ["arquitectura", "arquitectonico", "arch"],
    "est": ["estructura", "estructural", "struct"],
    "san": ["sanitario", "sanitary"],
    "elec": ["electrico", "electrical"],
    "ext": ["exterior", "externo"],
    "int": ["interior", "interno"],
}


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def related() -> dict[str, list[str]]:
    """Each term with all that it expands to: its synonyms, and every head word (with all its synonyms) that lists it."""
    out: dict[str, set[str]] = {}
    for head, words in SYNONYMS.items():
        out.setdefault(head, set()).update(words)
        for w in words:
            out.setdefault(w, set()).update({head, *words})
    return {k: sorted(v - {k}) for k, v in sorted(out.items())}


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalize_text(c: Column) -> Column:
    """Lower case, no accents, only a-z, 0-9 and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalize_layer(c: Column) -> Column:
    """Lower case, no accents, hyphens for underscores, single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(strip_accents(c)), F.lit("_"), F.lit("-")), r"\s+", " "))


def normalize_block(c: Column) -> Column:
    return F.trim(F.regexp_replace(strip_accents(c), r"\s+", " "))


def normalize_description(c: Column) -> Column:
    """As normalize_text(), but full stops and commas stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(c)), r"[^a-z0-9.,\s]", " "), r"\s+", " "))


def normalize_for_learning(c: Column) -> Column:
    """Special characters go without a space in their place."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(c)), r"[^a-z0-9\s]", ""), r"\s+", " "))


def clean_drawing_text(c: Column) -> Column:
    r"""Drawing text without its format codes: \P is a space, \x...; and braces go."""
    out = F.regexp_replace(c, r"\\P", " ")
    out = F.regexp_replace(out, r"\\[A-Za-z][^;]*;", "")
    return F.trim(F.regexp_replace(out, r"[{}]", ""))


def has_encoding_issues(c: Column) -> Column:
    return c.rlike("[�\u0080-\u009f]")


def tokens(c: Column, longer_than: int = 2) -> Column:
    """Distinct words of normalised text with more than so many characters."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) > longer_than))


def keywords(c: Column) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))


def expand(own: Column) -> Column:
    """Tokens with all that the dictionary relates to them."""
    table = F.create_map(*[x for k, v in related().items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    more = F.flatten(F.transform(own, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_union(own, more)


def token_similarity(a: Column, b: Column, expanded_a: Column, expanded_b: Column) -> Column:
    """Overlap of the expanded tokens over the union of the plain ones, 0.8 at most from it, 0.1 for any direct hit; 1 at most."""
    shared, union = F.size(F.array_intersect(expanded_a, expanded_b)), F.size(F.array_union(a, b))
    direct = F.when(F.size(F.array_intersect(a, b)) > 0, 0.1).otherwise(0.0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(shared / union * 0.8 + direct, F.lit(1.0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def first_containing(c: Column, groups: dict[str, list[str]], default: str = "UNKNOWN", start: bool = False) -> Column:
    """Name of the first group with a word that the text contains (or starts with)."""
    out = F.lit(default)
    for name, words in reversed(list(groups.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | (c.startswith(w) if start else c.contains(w))
        out = F.when(hit, name).otherwise(out)
    return out
