"""Validation rules as data: predicates over a row and its context, compiled to one projection.

A rule is a name, a severity and SQL texts for its condition, its message and its details.  All rules of a set are compiled into one array of
structs, so a row is read once, whatever their number.  What a rule needs to know of other rows is a context: columns that are joined to
each row first.  Range rules that users keep in a table are not compiled but joined, see versions.broken_rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators import versions as R

FOUND = "struct<rule:string,severity:string,message:string,details:string>"


@dataclass(frozen=True)
class Rule:
    """A rule fires where `when` is true; a condition that is null doesn't."""

    name: str
    severity: str
    when: str
    message: str
    details: dict[str, str] = field(default_factory=dict)


#: The built-in rules with their bounds and messages.
BUILT_IN = [
    Rule("quantity_sanity", "warning", "qty_final > 10000 AND unit = 'un'", "'Cantidad inusualmente alta (>10,000 unidades)'", {"qty": "qty_final", "unit": "unit"}),
    Rule("price_outlier", "warning", "unit_price_ref <> 0 AND peers >= 2 AND unit_price_ref > peer_price * 3", "concat('Precio 3x superior al promedio (', CAST(floor(peer_price + 0.5) AS BIGINT), ' CLP)')", {"price": "unit_price_ref", "avgPrice": "round(peer_price, 6)"}),
    Rule("unit_consistency", "error", "unit = 'm2' AND coalesce(height_factor, 0) = 0", "'Falta factor de altura para conversión a m²'", {"unit": "unit"}),
    Rule("missing_quantity", "error", "coalesce(qty_final, 0) = 0", "'Cantidad final no puede ser cero'", {"qty": "qty_final"}),
    Rule("low_confidence", "warning", "coalesce(match_confidence, 0) < 0.4 AND n_sources > 0", "concat('Confianza de matching baja (', CAST(floor(coalesce(match_confidence, 0) * 100 + 0.5) AS BIGINT), '%)')", {"confidence": "round(coalesce(match_confidence, 0), 6)"}),
    Rule("missing_price", "info", "coalesce(unit_price_ref, 0) = 0 AND status = 'approved'", "'Ítem aprobado sin precio de referencia'"),
]


class RuleSet:
    """Rules by name, in the order in which they were registered; one with a known name takes its place."""

    def __init__(self, rules: Iterable[Rule] = BUILT_IN):
        self.rules = {r.name: r for r in rules}
        self.contexts: list[Callable[[DataFrame], DataFrame]] = [with_peer_prices]

    def register(self, rule: Rule, context: Callable[[DataFrame], DataFrame] | None = None) -> RuleSet:
        """Adds a rule, and what joins the columns that it needs to the rows."""
        self.rules[rule.name] = rule
        if context is not None and context not in self.contexts:
            self.contexts.append(context)
        return self

    def add_bounds(self, unit: str, least: float, most: float, words: str = "", severity: str = "warning") -> RuleSet:
        """Bounds of the quantities in a unit, for descriptions that match the pattern `words`."""
        of = f"unit = {_quoted(unit)}" + (f" AND lower(description) RLIKE {_quoted(words)}" if words else "")
        name = f"bounds_{unit}" + (f"_{words}" if words else "")
        return self.register(Rule(name, severity, f"{of} AND (qty_final < {float(least)!r} OR qty_final > {float(most)!r})", f"concat('qty_final fuera de rango (', {_quoted(f'{least:g}-{most:g}')}, ')')", {"value": "qty_final"}))

    def compiled(self):
        """One array with a struct for each rule that fires."""
        one = []
        for r in self.rules.values():
            details = F.to_json(F.struct(*[F.expr(e).alias(k) for k, e in r.details.items()])) if r.details else F.lit("{}")
            one.append(F.when(F.expr(r.when), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.expr(r.message).alias("message"), details.alias("details"))))
        return F.array_compact(F.array(*one)) if one else F.array().cast(f"array<{FOUND}>")

    def validate(self, rows: DataFrame, custom: DataFrame | None = None, key: str = "id") -> DataFrame:
        """(key, rule, severity, message, details) for each rule that a row breaks; rows that break none have no row.

        custom: a table of range rules (id, rule_type, config, severity, enabled); its other rule types find nothing.
        """
        own = rows
        for context in self.contexts:
            own = context(own)
        found = own.select(key, F.inline(self.compiled()))
        if custom is None:
            return found
        broken = R.broken_rules(rows, custom, key).where(F.size("broken") > 0).select(key, F.explode("broken").alias("rule"))
        of = lambda k: F.get_json_object("config", f"$.{k}")
        said = F.concat(of("field"), F.lit(" fuera de rango ("), of("min"), F.lit("-"), of("max"), F.lit(")"))
        named = custom.select(F.col("id").alias("rule"), "severity", said.alias("message"))
        return found.unionByName(broken.join(named, "rule").select(key, F.col("rule").cast("string").alias("rule"), "severity", "message", F.lit("{}").alias("details")))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_peer_prices(rows: DataFrame) -> DataFrame:
    """Adds peers and peer_price: number and mean price of the rows whose description has the first word of this one's inside.

    A word that a description has inside begins there somewhere, so the pieces of three letters of each different description meet the words
    that begin with them, in an equi-join.  Prices are summed by word before they meet the rows.
    """
    first = F.split(F.lower(F.coalesce(F.col("description"), F.lit(""))), " ")[0]
    words = rows.select(first.alias("w")).where("w <> ''").distinct().withColumn("_k", F.substring("w", 1, 3))
    priced = rows.where("unit_price_ref <> 0").select(F.lower("description").alias("d"), F.col("unit_price_ref").cast("double").alias("p"))
    texts = priced.groupBy("d").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    letters = F.filter(F.split("d", ""), lambda x: x != "")
    piece = lambda n: F.transform(F.sequence(F.lit(1), F.size(letters)), lambda i: F.array_join(F.slice(letters, i, F.lit(n)), ""))
    pieces = texts.where("d <> ''").withColumn("_k", F.explode(F.array_distinct(F.concat(piece(1), piece(2), piece(3)))))
    sums = pieces.join(words, "_k").where(F.col("d").contains(F.col("w"))).groupBy("w").agg(F.sum("n").alias("peers"), (F.sum("p") / F.sum("n")).alias("peer_price"))
    return rows.withColumn("_w", first).join(sums, F.col("_w") == F.col("w"), "left").drop("_w", "w").withColumn("peers", F.coalesce("peers", F.lit(0)))
