"""Centroid clustering of integer vectors with partial-distance search.

A vector's components become integers, floor(SCALE * x).  A distance is summed over blocks of dimensions, those of high
variance first.  After the first block the most promising centroid is finished, so that a good bound stands early; any other
centroid is abandoned for a vector once its partial sum is strictly above the best distance so far.  What survives finishes all
dimensions, so assignments and ties (to the smaller number) are exact.

Each round is one scan: tasks assign their rows and give one sum for each cluster and dimension, which Spark adds up.  The k
centroids are all that comes to the driver and goes back to the tasks.

Defined cases: vectors that are null, have another number of components, or hold a null, a non-finite component or one whose
integer needs more than 138 bits (none that a 32-bit float can hold) take no part.  A null vec_id takes part, but after all
others as a start.  Rows that repeat count each; rows with one vec_id that start are taken in the order of their vectors.  With
fewer vectors than clusters, each vector starts one.  Distances and inertias beyond 64 bits are given as the largest long;
they are compared as exact integers of any size.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import tune
from mensura.llm.vectors import matrix

SCALE, DIMS, K, ROUNDS, STEP = 1024, 64, 8, 10, 16
#: Integers up to SMALL in size have distances that fit in 64 bits: DIMS * (2 * SMALL) ** 2 < 2 ** 63.
SMALL, LONGEST = 1 << 27, (1 << 63) - 1


def usable(vectors: DataFrame, column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles that hold floor(scale * x)."""
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)
    v = F.transform(F.col(column).cast("array<double>"), whole)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**138)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where((F.size("v") == dims) & ~F.exists("v", bad))


def integers(x: np.ndarray) -> np.ndarray:
    """Doubles that hold integers as 64-bit integers where their distances fit, else as Python's."""
    return x.astype(np.int64) if np.abs(x).max(initial=0.0) <= SMALL else np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, distance) of each row of integers, and how many components were compared.

    order: dimensions in the order in which they are summed; it has no effect on the result.
    """
    wide = x.dtype == object or np.abs(centroids).max(initial=0) > SMALL
    kind = object if wide else np.int64
    x, c = x.astype(kind)[:, order], centroids.astype(kind)[:, order]
    n, k, dims = len(x), len(c), x.shape[1]
    part = np.empty((n, k), kind)
    for j in range(k):
        d = x[:, :step] - c[j, :step]
        part[:, j] = (d * d).sum(axis=1)
    first = part.argmin(axis=1)
    d = x[:, step:] - c[first, step:]
    best, cluster, used = part[np.arange(n), first] + (d * d).sum(axis=1), first.copy(), n * (k * min(step, dims) + max(dims - step, 0))
    for j in range(k):
        at = np.flatnonzero((first != j) & (part[:, j] <= best))
        sums = part[at, j]
        for s in range(step, dims, step):
            d = x[at, s : s + step] - c[j, s : s + step]
            sums = sums + (d * d).sum(axis=1)
            used += d.size
            stay = sums <= best[at]  # strictly above the best: abandoned
            at, sums = at[stay], sums[stay]
        better = (sums < best[at]) | (j < cluster[at])
        best[at[better]], cluster[at[better]] = sums[better], j
    return cluster, best, used


def _moments(batches, dims: int):
    import pyarrow as pa

    n, s, q = 0, np.zeros(dims), np.zeros(dims)
    for batch in batches:
        x = matrix(batch.column(0))
        n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(s), pa.array(q)], ["dim", "n", "s", "q"])


def by_variance(rows: DataFrame, dims: int) -> np.ndarray:
    """Dimensions, those of high variance first."""
    found = rows.select("v").mapInArrow(lambda it: _moments(it, dims), "dim int, n long, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    spread = np.zeros(dims)
    for r in found:
        spread[r["dim"]] = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 if r["n"] else 0.0
    return np.argsort(-spread, kind="stable")


def _sums(batches, centroids, order):
    """(cluster, dim, n, high, low) of one task: the sum is high * 2 ** 64 + low.  Dimension -1 has the distances."""
    import pyarrow as pa

    k, dims = centroids.shape
    counts, total = [0] * k, np.zeros((k, dims + 1), object)
    for batch in batches:
        x = integers(matrix(batch.column(0)))
        cluster, far, _ = nearest(x, centroids, order)
        for j in np.unique(cluster).tolist():
            own = cluster == j
            counts[j] += int(own.sum())
            total[j, :dims] += x[own].sum(axis=0).astype(object)  # 1000 rows of a batch: far below 64 bits
            total[j, dims] += sum(min(LONGEST, int(d)) for d in far[own])
    rows = [(j, d if d < dims else -1, counts[j], Decimal(int(total[j, d]) >> 64), Decimal(int(total[j, d]) & (1 << 64) - 1)) for j in range(k) if counts[j] for d in range(dims + 1)]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["cluster", "dim", "n", "high", "low"])


def totals(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """{(cluster, dimension): (rows, sum)} over all rows; dimension -1 sums the distances."""
    found = rows.select("v").mapInArrow(lambda it: _sums(it, centroids, order), "cluster int, dim int, n long, high decimal(38,0), low decimal(38,0)")
    added = found.groupBy("cluster", "dim").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    return {(r["cluster"], r["dim"]): (r["n"], (int(r["high"]) << 64) + int(r["low"])) for r in added}


def _assign(batches, centroids, order):
    import pyarrow as pa

    for batch in batches:
        cluster, far, _ = nearest(integers(matrix(batch.column(1))), centroids, order)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array([min(LONGEST, int(d)) for d in far], pa.int64())], ["vec_id", "cluster", "distance"])


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of each vector that takes part, and the final centroids."""
    tune(vectors.sparkSession)
    rows = usable(vectors, column, dims, scale)
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    start = rows.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    kinds = "vec_id long, cluster int, distance long"
    if not start:
        return rows.mapInArrow(lambda it: iter(()), kinds).select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia")), []
    centroids = np.array([[int(x) for x in r["v"]] for r in start], object).reshape(len(start), dims)
    order = by_variance(rows, dims)
    for _ in range(rounds):
        found, new = totals(rows, centroids, order), centroids.copy()
        for (j, d), (n, s) in found.items():
            if d >= 0:
                new[j, d] = s // n
        if (new == centroids).all():
            break  # all rounds to come would leave them as they are
        centroids = new
    far = {j: s for (j, d), (_, s) in totals(rows, centroids, order).items() if d == -1}
    own = F.array(*[F.lit(min(LONGEST, far.get(j, 0))).cast("long") for j in range(len(centroids))])
    out = rows.mapInArrow(lambda it: _assign(it, centroids, order), kinds)
    return out.withColumns({"cluster_inertia": F.element_at(own, F.col("cluster") + 1), "inertia": F.lit(min(LONGEST, sum(far.values()))).cast("long")}), centroids.tolist()


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]).cast("array<string>")
    return out.withColumn("centroid_sha256", F.get(digests, F.col("cluster")))


def op11_sql(k: int = K, rounds: int = ROUNDS) -> str:
    parts = [
        """WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), x AS MATERIALIZED (SELECT rid, unnest(range(64)) AS d, unnest(v) AS x FROM v)""",
        f"""c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS d, unnest(v) AS y
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c FROM v) WHERE c < {k})""",
    ]
    for r in range(rounds + 1):
        near = f"SELECT rid, c, sum((x - y) * (x - y)) AS dist FROM x JOIN c{r} USING (d) GROUP BY rid, c"
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM ({near}) GROUP BY rid)")
        if r < rounds:
            mean = f"SELECT c, d, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{r} JOIN x USING (rid) GROUP BY c, d"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n + n) % n)) // n, y) AS y FROM c{r} LEFT JOIN ({mean}) USING (c, d))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return ", ".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN h USING (c)"""
