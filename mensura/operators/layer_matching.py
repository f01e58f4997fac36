"""Layer-first matching: fuzzy candidates, ordered score rules, quantity with method and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.functions import units as U
from mensura.operators import fuzzy as Z
from mensura.operators import quality as Q
from mensura.operators import service as V

THRESHOLD, ACCEPT, MOST = 0.6, 0.4, 5
WALL_WORDS = ["muro", "tabique", "pared"]


def dominant_kind() -> Column:
    return F.when(F.col("total_area") > 0, "AREA").when(F.col("total_length") > 0, "LENGTH").when(F.col("block_count") > 0, "BLOCK")


def candidates(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """Items (row_index, description, type) beside the layers that can give their type and whose name is near a word of theirs.

    Distinct words and layers meet by an index of their letters that loses no pair, so a pair of names is compared once, whatever the bill's size.
    """
    words = items.select(F.explode(T.tokens(T.normalize_text(F.col("description")))).alias("word")).distinct()
    layers = profiles.select("layer", T.normalize_text(F.col("layer")).alias("lnorm"))
    found = Z.near_parts(words.select(F.col("word").alias("l")), layers.select(F.col("lnorm").alias("r")), THRESHOLD)
    near = found.select(F.col("l").alias("word"), F.col("r").alias("lnorm"), "d").join(layers, "lnorm")
    own = items.withColumn("word", F.explode(T.tokens(T.normalize_text(F.col("description")))))
    best = own.join(near, "word").groupBy("row_index", "layer").agg(F.min("d").alias("d"))
    ok = (
        F.when(F.col("type") == "AREA", (F.col("has_area") & (F.col("total_area") > 0.01)) | (F.col("total_length") > 0))
        .when(F.col("type") == "LENGTH", F.col("total_length") > 0)
        .when(F.col("type") == "BLOCK", F.col("block_count") > 0)
        .otherwise(True)
    )
    joined = items.join(best, "row_index").join(profiles, "layer").where(ok)
    w = Window.partitionBy("row_index").orderBy("d", "layer")
    return joined.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MOST).drop("rn")


def rescored(pairs: DataFrame, zones: Column | None = None) -> DataFrame:
    """The score of each candidate by the rules in their order."""
    name, text = F.lower("layer"), F.lower("description")
    words = T.tokens(T.normalize_text(F.col("layer")))
    hit = F.size(F.filter(words, lambda w: T.normalize_text(F.col("description")).contains(w)))
    partial = F.when(F.size(words) > 0, hit / F.size(words)).otherwise(0.0)
    c = F.when(F.col("d") == 0, 1.0).otherwise(1 - F.col("d"))
    c = F.when(partial >= 1, F.greatest(c, F.lit(0.85))).when(partial > 0, F.least(F.lit(1.0), c + 0.4 * partial)).otherwise(c)
    c = F.when(F.col("type") == "AREA", c + Q.geometry_prior(F.col("total_area"))).otherwise(c)
    wall = T.contains_any(text, WALL_WORDS)
    c = F.when(wall & T.contains_any(name, WALL_WORDS), c + 0.25).otherwise(c)
    want = V.zone_intent(F.col("description"))
    if zones is not None:
        c = F.when(want.isNull(), c).when(zones.isNull(), c * 0.8).when(F.upper(zones).contains(want), c * 1.5).otherwise(c * 0.1)
    c = F.when(dominant_kind() == F.col("type"), F.least(F.lit(1.0), c * 1.1)).otherwise(c)
    c = c * (1 - U.layer_penalty(F.col("layer"), F.col("type")))
    c = F.when((Q.orientation(F.col("description")) == "horizontal") & (dominant_kind() == "LENGTH"), c * 0.2).otherwise(c)
    c = F.when(name == "defpoints", c * 0.1).otherwise(c)
    return pairs.withColumn("score", F.round(c, 9))


def quantities(best: DataFrame) -> DataFrame:
    """Quantity, method and status of each item from its best layer; the caps and gates follow in their order."""
    t, wall = F.col("type"), T.contains_any(F.lower("description"), WALL_WORDS)
    derived = Q.derived_area(F.col("total_length"), F.col("description"))
    some = F.col("score") > ACCEPT
    qty = F.when(~some, None).when((t == "AREA") & wall & derived.isNotNull(), derived).when((t == "AREA") & (F.col("total_area") > 0.01), F.col("total_area")).when(t == "AREA", derived).when(t == "LENGTH", F.col("total_length")).when(t == "BLOCK", F.col("block_count")).when(t == "GLOBAL", 1.0)
    method = F.when(~some, "none").when((t == "AREA") & wall & derived.isNotNull(), "length_x_height").when((t == "AREA") & (F.col("total_area") > 0.01), "direct_area").when((t == "AREA") & derived.isNotNull(), "length_x_height").when(t == "LENGTH", "direct_length").when(t == "BLOCK", "block_count").when(t == "GLOBAL", "global").otherwise("none")
    out = best.withColumns({"qty": qty, "method": method, "wall": wall})
    severity = Q.bounds_check(F.col("qty"), F.when(t == "AREA", "m2").when(t == "LENGTH", "m").when(t == "BLOCK", "un").otherwise("gl"), F.col("description"))
    c = F.when(F.col("qty").isNull(), 0.0).when(severity == "error", 0.1).when(severity == "warning", F.least(F.least(F.lit(1.0), F.col("score")), F.lit(0.6))).otherwise(F.least(F.lit(1.0), F.col("score")))
    out = out.withColumn("confidence", c)
    status = F.when(F.col("qty").isNull(), "pending_no_match").when(F.col("wall") & (t == "AREA") & (F.col("qty") > 500), "pending_sanity_check").when((t == "AREA") & F.col("wall") & (F.col("method") != "length_x_height"), "pending").when(F.col("confidence") >= 0.7, "approved").when(F.col("confidence") >= 0.4, "pending").otherwise("pending_no_match")
    return out.select("row_index", "layer", "score", F.round("qty", 6).alias("qty"), "method", F.round("confidence", 9).alias("confidence"), status.alias("status"))


def match(bill: DataFrame, profiles: DataFrame) -> DataFrame:
    items = bill.select("row_index", "description", U.item_type(F.col("description"), F.col("unit")).alias("type")).where("type <> 'GLOBAL'")
    w = Window.partitionBy("row_index").orderBy(F.desc("score"), "layer")
    best = rescored(candidates(items, profiles)).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return quantities(best)
