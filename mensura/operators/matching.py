"""Bill items against layers: candidates by measure kind, a score of shared words, ranks, status.

The layer side is one row for each layer of a drawing set.  Items and layers meet on shared expanded words, and each item meets the first
eligible layers by name, which are all that can rank among its MOST best, or next to them, without a shared word.  What the score takes
from an item is its description and unit, so each different pair of these is scored once and its best layers go to all items that have it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.functions import units as U
from mensura.operators.graph import checkpoint
from mensura.operators.takeoff import quantity

MOST = 5
#: What the score takes from an item.
TOLD = ["description", "unit", "norm", "kind", "item_trade", "a", "ea", "specific"]
#: Names of layers that collect anything, and what a match with them costs.
GENERIC_LAYERS = ["0", "dimen", "g-dim", "defpoints", "fa_color 12", "fa_color 13", "fa_color 14", "fa_color 15", "mb-elev 2", "mb-elev 4", "mb-elev 0", "i-ele-alumbrado"]
GENERIC_PENALTY, TRADE_PENALTY, ABSURD_AREA, ABSURD_PENALTY = 0.7, 0.5, 5000.0, 0.3
#: What blocks on a layer add to a counted item, and what their absence costs if a drawing has more than so many.
BLOCK_BOOST, NO_BLOCK_PENALTY, ENOUGH_BLOCKS = 0.35, 0.2, 10
MEASURED = ("area", "length", "count")


def prepare_items(bill: DataFrame) -> DataFrame:
    """Bill items with what the score needs; everything of one side is computed before the sides meet."""
    norm = T.normalize_text(F.col("description"))
    out = bill.withColumns({"norm": norm, "kind": U.measure_kind(F.col("unit")), "item_trade": U.item_trade(F.col("description"))})
    out = out.withColumn("a", T.tokens(F.col("norm")))
    return out.withColumns({"ea": T.expand(F.col("a")), "specific": F.size(F.filter(F.split("norm", " "), lambda t: F.length(t) > 3)) > 2})


def prepare_layers(index: DataFrame) -> DataFrame:
    norm = T.normalize_text(F.col("layer"))
    out = index.withColumns({"lnorm": norm, "layer_trade": U.layer_trade(F.col("layer"))}).withColumn("b", T.tokens(F.col("lnorm")))
    return out.withColumn("eb", T.expand(F.col("b")))


def is_header(description: Column, unit: Column) -> Column:
    return unit.isNull() | (F.trim(unit) == "") | (F.length(description) < 5) | F.trim(description).rlike(r"^[0-9.]+\s*$")


def eligible(kind: Column) -> Column:
    return (
        F.when(kind == "area", F.col("has_area") & (F.col("total_area") > 0))
        .when(kind == "length", F.col("has_length") & (F.col("total_length") > 0))
        .when(kind == "count", F.col("entity_count") > 0)
        .otherwise(True)
    )


def pairs(items: DataFrame, layers: DataFrame, boosted: DataFrame | None = None) -> DataFrame:
    """Eligible (item, layer) pairs among which are the MOST + 1 best of each item.

    boosted (row_index, layer, text_boost, word_boost) adds what drawings say; layers then have block_count and any_blocks, too.
    """
    words = items.select("row_index", F.explode("ea").alias("w")).join(layers.select("layer", F.explode("eb").alias("w")), "w").select("row_index", "layer")
    # A pair without a shared word scores 0, so the MOST + 1 first eligible layers by name rank before any other such pair.
    group = F.when(F.col("kind").isin(*MEASURED), F.col("kind")).otherwise("").alias("group")
    first = [layers.where(eligible(F.lit(k))).orderBy("layer").limit(MOST + 1).select(F.lit(k).alias("group"), "layer") for k in (*MEASURED, "")]
    if boosted is not None:  # a count is worth more on a layer with blocks, so the first of these may rank without a word, too
        first.append(layers.where(eligible(F.lit("count")) & (F.col("block_count") > 0)).orderBy("layer").limit(MOST + 1).select(F.lit("count").alias("group"), "layer"))
        words = words.unionByName(boosted.select("row_index", "layer"))
    blank = items.select("row_index", group).join(F.broadcast(reduce(DataFrame.unionByName, first)), "group").select("row_index", "layer")
    out = items.join(words.unionByName(blank).distinct(), "row_index").join(layers, "layer").where(eligible(F.col("kind")))
    return out if boosted is None else out.join(boosted, ["row_index", "layer"], "left")


def scored(pairs_: DataFrame) -> DataFrame:
    base = T.token_similarity(F.col("a"), F.col("b"), F.col("ea"), F.col("eb"))
    out = pairs_.withColumns({"similarity": base, "qty_used": quantity(F.col("kind"))})
    s = F.least(F.col("similarity") * 0.5 + F.col("similarity") * 0.1, F.lit(1.0))
    floor = lambda c: F.greatest(c, F.lit(0.0))
    if "text_boost" in out.columns:
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        s = F.least(F.col("similarity") * 0.5 + zero("text_boost") + zero("word_boost") + F.col("similarity") * 0.1, F.lit(1.0))
        has, count = F.coalesce("block_count", F.lit(0)) > 0, F.col("kind") == "count"
        s = F.when(count & has, F.least(s + BLOCK_BOOST, F.lit(1.0))).when(count & (F.col("any_blocks") > ENOUGH_BLOCKS), floor(s - NO_BLOCK_PENALTY)).otherwise(s)
        out = out.withColumn("qty_used", F.when(count & has, F.col("block_count").cast("double")).otherwise(F.col("qty_used")))
    s = F.when(F.col("lnorm").isin(GENERIC_LAYERS), floor(s - GENERIC_PENALTY)).otherwise(s)
    clash = (F.col("item_trade") != "UNKNOWN") & (F.col("layer_trade") != "UNKNOWN") & (F.col("item_trade") != F.col("layer_trade"))
    s = F.when(clash, floor(s - TRADE_PENALTY)).otherwise(s)
    s = F.when((F.col("kind") == "area") & (F.col("qty_used") > ABSURD_AREA) & F.col("specific"), floor(s - ABSURD_PENALTY)).otherwise(s)
    return out.withColumn("score", F.round(s, 9))


def best_layers(items: DataFrame, layers: DataFrame, most: int = MOST, boosts=None) -> DataFrame:
    """The best layers of each item, with rank, score, next_score and what layers tell; items with one description and unit are scored as one."""
    key = F.xxhash64(F.col("description").isNull(), "description", F.col("unit").isNull(), "unit")
    told = checkpoint(items.groupBy(key.alias("row_index")).agg(*[F.first(c).alias(c) for c in TOLD]))
    boosted = () if boosts is None else (checkpoint(boosts(told)),)
    best = top(scored(pairs(told, checkpoint(layers), *boosted)), most).drop(*TOLD)
    return items.withColumn("_key", key).join(best.withColumnRenamed("row_index", "_key"), "_key").drop("_key")


def top(scored_: DataFrame, most: int = MOST) -> DataFrame:
    """The best layers of each item with their rank and the lead over the next one."""
    w = Window.partitionBy("row_index").orderBy(F.desc("score"), "layer")
    out = scored_.withColumn("rank", F.row_number().over(w)).withColumn("next_score", F.lead("score").over(w))
    return out.where(F.col("rank") <= most)


def status(best: DataFrame) -> DataFrame:
    """Status, confidence and quantity of each item from its best candidate (null columns: it has none)."""
    some, q = F.col("score").isNotNull(), F.col("qty_used")
    header, service = is_header(F.col("description"), F.col("unit")), F.col("kind") == "service"
    ambiguous = some & F.col("next_score").isNotNull() & (F.round(F.col("score") - F.col("next_score"), 9) < 0.1) & (F.col("score") >= 0.3)
    good = some & (F.col("score") >= 0.3) & q.isNotNull()
    return best.select(
        "row_index",
        F.when(header, "title").when(service, "approved").when(ambiguous, "pending_needs_layer_pick").when(good & (F.col("score") >= 0.6), "approved").when(good, "pending").when(some, "pending_needs_layer_pick").otherwise("pending_no_match").alias("status"),
        F.when(header, "low").when(service, "high").when(ambiguous, "medium").when(good & (F.col("score") >= 0.6), "high").when(good & (F.col("score") >= 0.4), "medium").otherwise("low").alias("confidence"),
        F.when(header, None).when(service, 1.0).when(ambiguous | good, q).alias("qty_final"),
        F.when(~header & ~service & (ambiguous | good), F.col("layer")).alias("layer"),
    )


def match(bill: DataFrame, index: DataFrame) -> DataFrame:
    items = prepare_items(bill)
    open_ = items.where(~is_header(F.col("description"), F.col("unit")) & (F.col("kind") != "service"))
    best = best_layers(open_, prepare_layers(index), 1).select("row_index", "layer", "score", "next_score", "qty_used")
    return status(items.select("row_index", "description", "unit", "kind").join(best, "row_index", "left"))


def matches_in_context(bill: DataFrame, index: DataFrame, boosts, blocks: DataFrame) -> DataFrame:
    """The best layers of each item by words, texts near layers and blocks (layer, n) on them.

    boosts(items) gives (row_index, layer, text_boost, word_boost) of items (row_index, norm, a); they depend on the description alone, so items with
    one description and unit are scored as one here, too.
    """
    items = prepare_items(bill).where(~is_header(F.col("description"), F.col("unit")) & (F.col("kind") != "service"))
    n = checkpoint(blocks.groupBy("layer").agg(F.sum("n").alias("block_count")))
    layers = prepare_layers(index).join(n, "layer", "left").join(F.broadcast(n.agg(F.sum("block_count").alias("any_blocks"))))  # one row
    return best_layers(items, layers, boosts=boosts)
