"""Context that drawings give a matcher: texts and words of layers, and what they add to a layer's score.

Words meet in dictionaries of distinct words by equi-joins on their parts, points on grid cells.  At most two texts or words
of a layer count for an item, so a minimum and a maximum, which combine before any exchange, say how many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.operators.classify import layer_words
from mensura.operators.spatial import grid_distance_join

#: Distance of a text to the centre of a layer's texts; what a text and a word add.
NEAR, TEXT_BOOST, WORD_BOOST = 50.0, 0.15, 0.1


def parts(word: Column) -> Column:
    """Distinct parts of a word with three letters or more."""
    n = F.length(word)
    by = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(word, i, k))
    return F.when(n >= 3, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(3), F.greatest(n, F.lit(3))), by)))).otherwise(F.array().cast("array<string>"))


def containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l, r) of distinct words of which one contains the other; both have three letters at least."""
    own = left.join(right.select("r", F.explode(parts(F.col("r"))).alias("l")), "l").select("l", "r")
    other = left.select("l", F.explode(parts(F.col("l"))).alias("r")).join(right, "r").select("l", "r")
    return own.unionByName(other).distinct()


def layer_texts(texts: DataFrame, layers: DataFrame, radius: float = NEAR) -> DataFrame:
    """Distinct (layer, text) of texts (layer, text, x, y) that belong to a layer.

    They lie on it, or share a word with its name (one word may contain the other), or lie closer than radius to the mean
    place of the layer's own texts.  Texts are normalised; those of fewer than two letters go.
    """
    own = texts.withColumn("text", T.normalize_text(F.col("text"))).where(F.length("text") >= 2)
    names = layers.select("layer").distinct()
    same = own.join(names, "layer", "left_semi").select("layer", "text")
    lw = names.select("layer", F.explode(layer_words(F.col("layer"))).alias("l"))
    tw = own.select("text").distinct().select("text", F.explode(layer_words(F.col("text"))).alias("r"))
    words = containing(lw.select("l").distinct(), tw.select("r").distinct())
    shared = lw.join(words, "l").select("layer", "r").distinct().join(tw, "r").select("layer", "text")
    middle = own.groupBy("layer").agg(F.avg("x").alias("rx"), F.avg("y").alias("ry")).join(names, "layer", "left_semi")
    near = grid_distance_join(own.select("text", "x", "y"), middle, radius, strict=True).select("layer", "text")
    return same.unionByName(shared).unionByName(near).distinct()


def boosts(items: DataFrame, belonging: DataFrame, layers: DataFrame) -> DataFrame:
    """(row_index, layer, text_boost, word_boost) of items (row_index, norm, a) with layers whose texts or words they share."""
    told = belonging.select("layer", "text", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("layer", "w").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    own = items.select("row_index", F.explode("a").alias("w"))
    two = lambda k: F.when(F.col("lo") == F.col("hi"), k).otherwise(2 * k)
    bounds = F.min("lo").alias("lo"), F.max("hi").alias("hi")
    by_text = own.join(told, "w").groupBy("row_index", "layer").agg(*bounds).select("row_index", "layer", two(TEXT_BOOST).alias("text_boost"), F.lit(0.0).alias("word_boost"))
    lw = layers.select("layer").distinct().select("layer", F.explode(layer_words(F.col("layer"))).alias("l"))
    every = items.select("row_index", F.explode(F.array_distinct(F.split("norm", " "))).alias("word"))
    inside = every.select("word").distinct().select("word", F.explode(parts(F.col("word"))).alias("l")).join(lw.select("l").distinct(), "l")
    named = every.join(inside, "word").select("row_index", "l").distinct().join(lw, "l").groupBy("row_index", "layer").agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    by_word = named.select("row_index", "layer", F.lit(0.0).alias("text_boost"), two(WORD_BOOST).alias("word_boost"))
    return by_text.unionByName(by_word).groupBy("row_index", "layer").agg(F.max("text_boost").alias("text_boost"), F.max("word_boost").alias("word_boost"))


def drawing_context(texts: DataFrame, layers: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each layer with geometry: its words, the number of its texts and of the blocks (layer, n) on it."""
    n = layer_texts(texts, layers).groupBy("layer").agg(F.count("*").alias("texts"))
    b = blocks.groupBy("layer").agg(F.sum("n").alias("blocks"))
    out = layers.select("layer").distinct().join(n, "layer", "left").join(b, "layer", "left")
    return out.select("layer", F.array_join(F.array_sort(layer_words(F.col("layer"))), " ").alias("words"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("blocks", F.lit(0)).alias("blocks"))
