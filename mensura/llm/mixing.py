"""Mixing sources to target weights by the cube method.

A source's target gives each of its documents the same rate, target / source size.  The whole part of the rate is taken
outright; its fraction is an inclusion probability.  The flight phase moves the probabilities of three documents at a
time along the null space of two constraints, the number of documents and the number of words taken from the source,
until one of them is 0 or 1; what is left (at most two documents) is the landing problem.  Documents come in order of
descending size, so that small ones are left.

Flights run in groups of one source and at most about GROUP documents, chosen by a hash of the document, so a source with a
third of all rows is many groups.  What the groups leave meets in fewer groups, until each source has one; that one lands.
Random numbers come from the source and the group, so reruns agree.

Defined cases: a null or empty text has size 0 and counts as a document; a null source is a source and comes last; a null
doc_id takes part like any other; repeated rows are documents of their own; an empty table gives no row; other columns
are kept by mix() unless they clash with its own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import NO_ID, checkpoint, rows_with_key, tune

WEIGHTS, SHARE, MOST, GROUP = (3.0, 1.0, 2.0), 1.5, 2.0, 8192
NEXT, OPEN, TRIES, CLOSE = 256, 16, 64, 0.002
#: Rates of at most so many sources are broadcast; beyond that, both sides are dealt by source and salt.
SOURCES, SALTS = 100_000, 32


def words(text: Column) -> Column:
    """Number of words in the text."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: source, source_size.  Adds target.  Sources by code point, null last, have the weights in turn.

    Each round hands what is not yet spoken for to the sources below their bound, by weight; those that would pass it stop
    there.  A round takes one row to the driver; sources reach the bound once, so rounds end.
    """
    from pyspark.sql import Window

    # The place of each source: sorted partitions, and how many come before each of them.
    placed = checkpoint(sizes.orderBy(F.col("source").isNull(), F.col("source").cast("binary")).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before = F.create_map(*[F.lit(x) for k in sorted(counts) for x in (k, sum(n for p, n in counts.items() if p < k))]) if counts else F.create_map(F.lit(0), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    rank = inside - 1 + before[F.col("_part")]
    table = placed.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int"))).drop("_part")
    table = checkpoint(table.withColumn("_cap", F.lit(float(most)) * F.col("source_size")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, F.lit(False)
    while True:
        row = table.agg(F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_w")))).first()
        now = (share * total - row[0]) / row[1] if row[1] else 0.0
        if level is not None and now <= level:
            break
        level = now
        capped = F.col("_cap") <= F.col("_w") * level
    return table.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.lit(level)).alias("target"))


def flight(p: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves the probabilities p of documents with sizes z until at most two are neither 0 nor 1."""
    p, z, eps = p.tolist(), z.tolist(), 1e-9
    draws = iter(rng.random(len(p) + 1).tolist())
    live: list[int] = []
    for k in range(len(p)):
        if not eps < p[k] < 1 - eps:
            p[k] = float(round(p[k]))
            continue
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        # What is orthogonal to (1, 1, 1) and to the sizes; equal sizes leave two free.
        u = (z[b] - z[c], z[c] - z[a], z[a] - z[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, v in zip(live, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, -p[i] / v), min(down, (p[i] - 1) / v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(live, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
            if not eps < p[i] < 1 - eps:
                p[i] = float(round(p[i]))
        live = [i for i in live if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds the last probabilities in pairs, in a way that keeps each on average and the sum of each pair within one."""
    p = p.copy()
    while len(live := np.flatnonzero((p > 0) & (p < 1))) > 1:
        i, j = live[-2:]
        x, y = p[i], p[j]
        s = x + y  # what one of them gives the other takes, until one is 0 or 1
        if s <= 1:
            p[i], p[j] = (s, 0.0) if rng.random() * s < x else (0.0, s)
        else:
            p[i], p[j] = (1.0, s - 1) if rng.random() * (2 - s) < 1 - y else (s - 1, 1.0)
    for i in live:
        p[i] = float(rng.random() < p[i])
    return p


def settle(p: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight and landing of a source's last group, whose documents come in order of descending size.

    In triples a large document stays open to the end, as its neighbours reach 0 or 1 before, and rounding it would miss the
    words by its size.  So here each step moves the largest open document and all smaller ones against it, by the least
    change (weighted by their room) that keeps both totals, until one of them is 0 or 1.  The last OPEN documents are the
    landing problem: TRIES flights to the end and their roundings are drawn, and the one that misses the words least is taken, of those
    that miss them by less than CLOSE the one that misses the documents least.  If none comes so close, as when one document is a large
    part of a small source, twice as many documents are left open, and so on up to all.  So the flight keeps every probability on average,
    and the landing gives that up for few documents of a source, or for a small source.
    """
    due, open_ = np.array([p.sum(), p @ z]), OPEN
    near = CLOSE * max(due[1], 1.0)
    while True:
        start, best = fly(p, z, rng, open_), None
        left = int(((start > 0) & (start < 1)).sum())
        for _ in range(TRIES if left else 1):
            out = land(fly(start, z, rng, 2), rng)
            words = abs(out @ z - due[1])
            cost = max(0.0, words - near), max(0.0, abs(out.sum() - due[0]) - 1), words
            if best is None or cost < best[0]:
                best = cost, out
        if best[0][0] == 0 or left < open_ or open_ >= len(p):
            return best[1]
        open_ *= 2


def fly(p: np.ndarray, z: np.ndarray, rng: np.random.Generator, open_: int) -> np.ndarray:
    """Moves the probabilities until at most so many are open, 2 at least.  A document has the NEXT smaller ones against it."""
    p, before = np.where((p < 1e-9) | (p > 1 - 1e-9), np.round(p), p), None
    unit = max(float(z.max(initial=1.0)), 1.0)
    while True:
        live = np.flatnonzero((p > 0) & (p < 1))
        left = len(live)
        if left <= open_ or left == before:
            return p
        before = left
        while left > open_ and len(live) > 2:
            first, rest = live[0], live[1 : 1 + NEXT]
            room, size, own = p[rest] * (1 - p[rest]), z[rest] / unit, z[first] / unit
            s0, s1, s2 = room.sum(), room @ size, (room * size) @ size
            det = s0 * s2 - s1 * s1
            x, y = ((s2 - s1 * own) / det, (s0 * own - s1) / det) if det > 1e-12 * s0 * s2 else (1 / s0, 0.0)
            u = -room * (x + y * size)
            if abs(u.sum() + 1) > 1e-9 or abs(u @ size + own) > 1e-9:  # these are of one size, and can't make up for this one
                live = live[1:]
                continue
            u, own = np.append(1.0, u), live[: 1 + NEXT]
            q = p[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
                down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
            q = q + (up if rng.random() * (up + down) < down else -down) * u
            q = np.where(q < 1e-9, 0.0, np.where(q > 1 - 1e-9, 1.0, q))
            p[own] = q
            on = (q > 0) & (q < 1)
            left -= len(own) - int(on.sum())
            live = np.concatenate([own[on], live[1 + NEXT :]])


def _flyer(last: bool):
    def fly(key: tuple, frame):
        rng = np.random.default_rng([abs(int(key[0])), abs(int(key[1])), int(last)])
        frame = frame.sort_values(["size", "_id", "_th", "_n"], ascending=[False, True, True, True], kind="stable")
        frame["p"] = (settle if last else flight)(frame["p"].to_numpy(float), frame["size"].to_numpy(float), rng)
        return frame

    return fly


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, group: int = GROUP) -> DataFrame:
    """(_id, _th, _n, size, source_size, target, copies) of every row; _n numbers repeated rows."""
    tune(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), F.col("source").cast("string").alias("source"), words(text).alias("size"))
    rows = rows.groupBy("_id", "_th", "source", "size").count()  # repeated rows are one until they are numbered
    rows = checkpoint(rows)
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.sum("count").alias("_docs"))
    sizes = checkpoint(sizes)
    mark = F.xxhash64(F.col("source").isNull(), F.col("source")).alias("_src")  # no name of a source means null
    rates = targets(sizes.select("source", "source_size"), weights, share, most).withColumn("_src", mark)
    rates = rates.join(sizes.select(mark, "_docs"), "_src")
    rates = checkpoint(rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("count").withColumn("_src", mark).drop("source")
    if rates.count() <= SOURCES:
        rows = rows.join(F.broadcast(rates), "_src")
    else:  # a source's rows go to SALTS tasks, its rate to each of them
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_th", "_n"), F.lit(SALTS)).cast("int")).join(rates.withColumn("_salt", salt), ["_src", "_salt"]).drop("_salt")
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))
    fields = "_id long, _th long, _n int, _src long, size long, grp long, p double"
    sent = rows.select("_id", "_th", "_n", "_src", "size", F.pmod(F.xxhash64("_id", "_th", "_n"), F.greatest(F.lit(1), F.ceil(F.col("_docs") / group))).alias("grp"), "p")
    most_docs = rates.agg(F.max("_docs")).first()[0] or 0
    groups = max(1, math.ceil(most_docs / group))
    done = None
    while True:
        last = groups == 1
        out = sent.groupBy("_src", "grp").applyInPandas(_flyer(last), fields)
        out = checkpoint(out)
        settled = out.where("p = 0 or p = 1").select("_id", "_th", "_n", "_src", F.col("p").alias("taken"))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        groups = max(1, math.ceil(2 * groups / group))
        sent = out.where("p > 0 and p < 1").withColumn("grp", F.pmod("grp", F.lit(groups)))
    done = done.withColumnRenamed("_src", "_own")
    joined = rows.join(done, ["_id", "_th", "_n"]).where(F.col("_src") == F.col("_own"))
    return joined.select("_id", "_th", "_n", "source", "size", "source_size", "target", (F.col("whole") + F.col("taken")).cast("long").alias("copies"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = copies(docs)
    return out.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it."""
    from pyspark.sql import Window

    source = lambda c: F.xxhash64(c.isNull(), c.cast("string")).alias("_src")
    taken = copies(docs, **options).groupBy("_id", "_th", source(F.col("source"))).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    joined = rows_with_key(docs, source(F.col("source"))).join(taken.where("_all > 0"), ["_id", "_th", "_src"])
    # Equal rows share what they take: each has the mean, and the first of them the rest.  The join has dealt them by these keys.
    n = F.row_number().over(Window.partitionBy("_id", "_th", "_src").orderBy("_id"))
    times = F.floor(F.col("_all") / F.col("_rows")) + (F.col("_k") <= F.col("_all") % F.col("_rows")).cast("long")
    return joined.withColumn("_k", n).withColumn("_t", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select("_row.*")
