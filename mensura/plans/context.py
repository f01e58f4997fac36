"""The matcher with the context of drawings: texts near layers, words of names, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import text as T
from mensura.operators import classify as C
from mensura.operators import context as X
from mensura.operators import matching as M
from mensura.operators import takeoff as K
from mensura.operators.graph import checkpoint
from mensura.plans.domain import NORM, SCORED, TOKENS
from mensura.plans.registry import register, rounded

WORDS_OF = lambda c: f"list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[-_.\\s]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in C.NOISE)})))"
BELONGING = f"""lay AS (SELECT DISTINCT layer FROM takeoff_rows), tx AS (SELECT layer, {NORM('name_raw')} AS text, round(x * 100) AS x, round(y * 100) AS y FROM cad_items WHERE type = 'text'),
lw AS (SELECT layer, unnest({WORDS_OF('layer')}) AS l FROM lay), tw AS (SELECT text, unnest({WORDS_OF('text')}) AS r FROM (SELECT DISTINCT text FROM tx)),
wp AS (SELECT l, r FROM (SELECT DISTINCT l FROM lw), (SELECT DISTINCT r FROM tw) WHERE contains(l, r) OR contains(r, l)),
mid AS (SELECT layer, avg(x) AS mx, avg(y) AS my FROM tx JOIN lay USING (layer) GROUP BY layer),
lt AS (SELECT layer, text FROM tx JOIN lay USING (layer) UNION SELECT lw.layer, tw.text FROM lw JOIN wp USING (l) JOIN tw USING (r) UNION SELECT mid.layer, text FROM tx JOIN mid ON sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) < 50)"""
BOOSTS = f"""it AS (SELECT row_index, {NORM('description')} AS norm, {TOKENS(NORM('description'))} AS a FROM bill_items),
ltw AS (SELECT layer, text, unnest({TOKENS('text')}) AS w FROM lt), iw AS (SELECT row_index, unnest(a) AS w FROM it),
tb AS (SELECT row_index, layer, least(count(DISTINCT text) * 0.15, 0.3)::DOUBLE AS text_boost FROM iw JOIN ltw USING (w) GROUP BY ALL),
dw AS (SELECT norm, l FROM (SELECT DISTINCT norm FROM it), (SELECT DISTINCT l FROM lw) WHERE contains(norm, l)),
wb AS (SELECT row_index, layer, least(count(DISTINCT l) * 0.1, 0.2)::DOUBLE AS word_boost FROM it JOIN dw USING (norm) JOIN lw USING (l) GROUP BY ALL),
bo AS (SELECT row_index, layer, coalesce(text_boost, 0.0)::DOUBLE AS text_boost, coalesce(word_boost, 0.0)::DOUBLE AS word_boost FROM tb FULL JOIN wb USING (row_index, layer))"""
BLOCKS = "bl AS (SELECT layer, count(*) AS n FROM cad_items WHERE type = 'block' GROUP BY layer)"
IN_CONTEXT = SCORED.replace(
    "s1 AS (SELECT *, least(similarity * 0.5 + similarity * 0.1, 1.0) AS s FROM p)",
    """s0 AS (SELECT p.*, least(similarity * 0.5 + coalesce(text_boost, 0) + coalesce(word_boost, 0) + similarity * 0.1, 1.0) AS s, n, (SELECT sum(n) FROM bl) AS anyb FROM p LEFT JOIN bo USING (row_index, layer) LEFT JOIN bl USING (layer)),
s1 AS (SELECT * REPLACE (CASE WHEN kind <> 'count' THEN s WHEN n > 0 THEN least(s + 0.35, 1.0) WHEN anyb > 10 THEN greatest(s - 0.2, 0.0) ELSE s END AS s, CASE WHEN kind = 'count' AND n > 0 THEN n ELSE qty_used END AS qty_used) FROM s0)""",
)


def _texts(items):
    return items.where("type = 'text'").select("layer", F.col("name_raw").alias("text"), F.round(F.col("x") * 100).alias("x"), F.round(F.col("y") * 100).alias("y"))


def _blocks(items):
    return items.where("type = 'block'").groupBy("layer").agg(F.count("*").alias("n"))


@register("jn7_layer_texts", f"WITH {BELONGING} SELECT layer, count(*) AS n, min(text) AS first, max(text) AS last FROM lt GROUP BY layer", "takeoff_rows", "cad_items")
def _(rows, items):
    return X.layer_texts(_texts(items), rows).groupBy("layer").agg(F.count("*").alias("n"), F.min("text").alias("first"), F.max("text").alias("last"))


@register("src20_drawing_context", f"WITH {BELONGING}, {BLOCKS} SELECT layer, array_to_string(list_sort({WORDS_OF('layer')}), ' ') AS words, (SELECT count(*) FROM lt WHERE lt.layer = lay.layer) AS texts, coalesce(n, 0) AS blocks FROM lay LEFT JOIN bl USING (layer)", "takeoff_rows", "cad_items")
def _(rows, items):
    return X.drawing_context(_texts(items), rows, _blocks(items))


def _boosts(bill, rows, items):
    norm = bill.withColumn("norm", T.normalize_text(F.col("description"))).withColumn("a", T.tokens(F.col("norm")))
    return X.boosts(norm, X.layer_texts(_texts(items), rows), rows)


@register("sim3_context_boosts", f"WITH {BELONGING}, {BOOSTS} SELECT row_index, layer, round(text_boost, 6) AS text_boost, round(word_boost, 6) AS word_boost FROM bo", "bill_items", "takeoff_rows", "cad_items")
def _(bill, rows, items):
    return rounded(_boosts(bill, rows, items), "text_boost", "word_boost")


@register("jn35_matches_in_context", f"WITH {BELONGING}, {BOOSTS}, {BLOCKS}, {IN_CONTEXT} SELECT row_index, rank, layer, score, round(qty_used, 6) AS qty_used FROM t WHERE rank <= 5", "bill_items", "takeoff_rows", "cad_items")
def _(bill, rows, items):
    texts = checkpoint(X.layer_texts(_texts(items), rows))
    best = M.matches_in_context(bill, K.layer_index(rows), lambda told: X.boosts(told, texts, rows), _blocks(items))
    return rounded(best.select("row_index", F.col("rank").cast("long").alias("rank"), "layer", "score", "qty_used"), "qty_used")


@register("sim10_layer_word_hits", f"WITH lay AS (SELECT DISTINCT layer FROM takeoff_rows), lw AS (SELECT layer, unnest({WORDS_OF('layer')}) AS l FROM lay), d AS (SELECT DISTINCT {NORM('description')} AS norm FROM bill_items) SELECT norm, l AS word, count(*) AS layers FROM d JOIN lw ON contains(norm, l) GROUP BY ALL", "bill_items", "takeoff_rows")
def _(bill, rows):
    d = bill.select(T.normalize_text(F.col("description")).alias("norm")).distinct()
    lw = rows.select("layer").distinct().select("layer", F.explode(C.layer_words(F.col("layer"))).alias("word"))
    n = lw.groupBy("word").agg(F.count("*").alias("layers"))
    words = d.select("norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("own"))
    hits = words.select("own").distinct().select("own", F.explode(X.parts(F.col("own"))).alias("word")).join(n, "word")
    return words.join(hits, "own").select("norm", "word", "layers").distinct()
