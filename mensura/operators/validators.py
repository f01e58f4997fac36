"""Checks of JSON columns: what passes as typed rows, what doesn't with the reasons beside it.

Fields are read as variants first, so a number isn't taken for a text or the other way round.  A JSON that is null is valid and empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of source items.
KINDS = ["block", "length", "area", "text"]
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+"
#: Fields of each kind of record: S a text, T a text of one letter at least, U an address, K a kind, N a number, + a number of 0 at least, P above 0, a share from 0 to 1 is 1, and ? a field that may be missing.
SOURCE_ITEM = {"id": "S", "type": "K", "value_m": "+", "evidence": "S", "name_raw": "S", "unit_raw": "S", "layer_raw": "S", "value_raw": "N", "layer_normalized": "S"}
PRICE_SOURCE = {"url": "U", "price": "P", "title": "T", "vendor": "T"}
PRICE_CANDIDATE = {"vendor": "S", "price": "P", "score": "1", "url": "U?"}
#: What the weaker guards ask of a record.
ITEM_GUARD = {"id": "S", "type": "K", "value_m": "N"}
PRICE_GUARD = {"url": "S", "price": "N", "title": "S", "vendor": "S"}


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _holds(v: Column, rule: str) -> Column:
    text, number = _text(v), _number(v)
    test = {
        "S": text.isNotNull(), "T": F.length(text) > 0, "U": text.rlike(URL), "K": text.isin(KINDS), "N": number.isNotNull(),
        "+": number >= 0, "P": number > 0, "1": number.between(0, 1),
    }[rule[0]]
    out = F.coalesce(test, F.lit(False))
    return out | (_kind(v) == "MISSING") if rule.endswith("?") else out


def checked(json: Column, fields: dict[str, str]) -> Column:
    """struct<valid, records, faults> of a JSON array of records: faults are `position.field`, or `json` for what is no such array.

    records is null if one of them is not valid, as all of a column's records are needed; it is empty for a null.
    """
    kinds = ", ".join(f"{k}: {'double' if r[0] in 'N+P1' else 'string'}" for k, r in fields.items())
    read = F.from_json(json, f"array<struct<{', '.join(f'{k}: variant' for k in fields)}>>", {"mode": "PERMISSIVE"})
    array = F.coalesce(F.schema_of_variant(F.try_parse_json(json)).startswith("ARRAY"), F.lit(False)) & read.isNotNull()
    faults = F.flatten(F.transform(read, lambda x, i: F.array_compact(F.array(*[F.when(x.isNull() | ~_holds(x[k], r), F.concat(i.cast("string"), F.lit(f".{k}"))) for k, r in fields.items()]))))
    faults = F.when(json.isNull(), F.array().cast("array<string>")).when(~array, F.array(F.lit("json"))).otherwise(faults)
    typed = F.transform(read, lambda x: F.struct(*[(_number(x[k]) if r[0] in "N+P1" else _text(x[k])).alias(k) for k, r in fields.items()]))
    valid = F.size(faults) == 0
    empty = F.array().cast(f"array<struct<{kinds}>>")
    return F.struct(valid.alias("valid"), F.when(json.isNull(), empty).when(valid, typed).alias("records"), faults.alias("faults"))


def guarded(json: Column, fields: dict[str, str]) -> Column:
    """Whether one JSON object has the fields of a guard with their types."""
    read = F.from_json(json, f"struct<{', '.join(f'{k}: variant' for k in fields)}>")
    out = F.coalesce(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), F.lit(False))
    for k, r in fields.items():
        out = out & _holds(read[k], r)
    return F.coalesce(out, F.lit(False))
