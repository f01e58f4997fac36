"""Exact top-k search with a vector-approximation file.

Vectors are integers, floor(SCALE * x).  The approximation file has one byte for each component: the number of the cell, of
CELLS of equal width within a block, that it lies in.  It is all that meets the queries at first:

1. A scan of the cells gives each candidate a lower and an upper bound of its inner product with a query.  What can't reach
   the k-th largest lower bound goes, in each block and then over all blocks.
2. Exact vectors are read in the order of their upper bounds: those of the k first, and then only those whose upper bound
   reaches the k-th exact score so far.  No vector that is left could.

A block of queries meets each block of cells once.  Ties go to the smaller vec_id, so a bound that equals the k-th score is
still read.

Defined cases: see vectors.py; a vector with a component whose SCALE-fold is no finite double takes no part either.  Scores
are compared as exact integers of any size; one that no 64-bit integer holds is given as the nearest that one does.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.llm.common import checkpoint, tune
from mensura.llm.vectors import BLOCK, QUERIES, asked, best, blocks_of, dealt, gather, is_query, matrix, needed, ranked, usable

SCALE, CELLS = 256, 256
FILE = "dim int, part int, ids binary, low binary, width binary, codes binary"


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first middle, width, cell numbers) for each component; a component is within half a width of its cell's middle."""
    low = x.min(axis=0)
    width = (x.max(axis=0) / 2 - low / 2) / (CELLS - 1) * 2
    with np.errstate(over="ignore"):
        code = np.rint((x - low) / np.where(width > 0, width, 1.0))
    return low, width, np.clip(code, 0, CELLS - 1).astype(np.uint8)


def scaled(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries over twice their dimension and largest component, so that no sum of products overflows; the largest components."""
    top = np.abs(q).max(axis=1, initial=0.0)
    top = np.where(top > 0, top, 1.0)
    return q / top[:, None] / (2 * max(q.shape[1], 1)), top


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, reach) of the scaled inner products of queries and cells: a product is within reach of the middle."""
    a, _ = scaled(q)
    step = a * width
    top = np.abs(step).max(axis=1, initial=0.0)
    top = np.where(top > 0, top, 1.0)[:, None]
    own = (step / top).astype(np.float32)
    middle = (own @ code.astype(np.float32).T).astype(np.float64) * top + (a @ low)[:, None]
    rounding = np.abs(own).sum(axis=1, dtype=np.float64)[:, None] * top * (CELLS * (q.shape[1] + 4) * 2.0**-23)
    size = np.abs(a) @ (np.abs(low) + width * CELLS)
    return middle, (np.abs(a) @ (width / 2))[:, None] * (1 + 1e-6) + rounding + 1e-12 * size[:, None] + 1e-300


def _file(table, k: int):
    import pyarrow as pa

    ids, x = table.column("vec_id").to_numpy(), matrix(table.column("v"))
    at = needed(ids, x, k)
    low, width, code = approximate(x[at])
    head = [table.column(c)[:1].combine_chunks() for c in ("dim", "part")]
    return pa.Table.from_arrays([*head, *(pa.array([a.tobytes()], pa.binary()) for a in (ids[at], low, width, code))], [f.split()[0] for f in FILE.split(", ")])


def _scan(batches, k: int):
    """(key, vec_id, low, high) of the candidates whose upper bound reaches the k-th largest lower bound of their block."""
    import pyarrow as pa

    for batch in batches:
        out: list = [[], [], [], []]
        for dim, keys, own, q, ids, low, width, code in zip(*(batch.column(n).to_pylist() for n in ("dim", "key", "query_id", "q", "ids", "low", "width", "codes")), strict=True):
            keys, own, ids = (np.frombuffer(b, np.int64) for b in (keys, own, ids))
            q, low, width = np.frombuffer(q).reshape(-1, dim), np.frombuffer(low), np.frombuffer(width)
            code = np.frombuffer(code, np.uint8).reshape(-1, dim)
            for a in range(0, len(q), 64):
                middle, reach = bounds(q[a : a + 64], low, width, code)
                for i, (m, r) in enumerate(zip(middle, reach[:, 0], strict=True), a):
                    at = np.flatnonzero(ids != own[i])
                    if not len(at):
                        continue
                    m = m[at]
                    n = min(k, len(m))
                    at = at[keep := m + r >= np.partition(m, len(m) - n)[len(m) - n] - r]
                    for c, v in zip(out, (np.full(len(at), keys[i]), ids[at], m[keep] - r, m[keep] + r), strict=True):
                        c.append(v)
        types = (np.int64, np.int64, np.float64, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(out, types, strict=True)], ["key", "vec_id", "low", "high"])


def ordered(n: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (n.bit_length() + 7) // 8
    out = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return b"\1" + out if n >= 0 else b"\0" + bytes(255 - b for b in out)


def _exact(batches):
    """(key, vec_id, n, order, score, scaled) of pairs of vectors."""
    import pyarrow as pa

    for batch in batches:
        q, x = batch.column("q").to_pylist(), batch.column("v").to_pylist()
        scores, rel = [], []
        for a, b in zip(q, x, strict=True):
            top = max((abs(c) for c in a), default=0.0) or 1.0
            if top * max((abs(c) for c in b), default=0.0) * max(len(a), 1) < 2**52:
                s = int(np.dot(a, b)) if a else 0
            else:
                s = sum(int(c) * int(d) for c, d in zip(a, b, strict=True))
            scores.append(s)
            rel.append(float(Fraction(s, int(top) * 2 * max(len(a), 1))))
        long = [max(-(2**63), min(2**63 - 1, s)) for s in scores]
        own = [pa.array([ordered(s) for s in scores], pa.binary()), pa.array(long, pa.int64()), pa.array(rel, pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vec_id"), batch.column("n"), *own], ["key", "vec_id", "n", "order", "score", "scaled"])


def approximated(rows: DataFrame, k: int) -> DataFrame:
    """(key, vec_id, low, high) of the pairs that the scan of the approximation file leaves, over all blocks."""
    n = rows.agg(F.count("*"), F.count_if(is_query(F.col("vec_id")))).first()
    least = 2000 if n[0] < rows.sparkSession.sparkContext.defaultParallelism * BLOCK else BLOCK  # small tables still use all cores
    parts, groups = blocks_of(n[0], least), blocks_of(n[1], QUERIES)
    file = rows.withColumn("part", dealt("vec_id", parts)).select("dim", "part", "vec_id", "v").groupBy("dim", "part").applyInArrow(lambda t: _file(t, k), FILE)
    queries = gather(asked(rows).withColumn("grp", dealt("key", groups)), ["dim", "grp"], ["key", "query_id"], "q")
    # Every block of queries goes to every block of cells: the table of parts is made on the spot, not joined.
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    left = queries.join(file, ["dim", "part"]).mapInArrow(lambda it: _scan(it, k), "key long, vec_id long, low double, high double")
    own = Window.partitionBy("key")
    left = ranked(left, [F.desc("low")]).withColumn("floor", F.min(F.when(F.col("rank") <= k, F.col("low"))).over(own)).where("high >= floor")
    return left.groupBy("key", "vec_id").agg(F.max("high").alias("high"))  # the window has dealt them by key already


def search(vectors: DataFrame, k: int = 5, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the query rows of vectors."""
    tune(vectors.sparkSession)
    whole = lambda x: F.when(F.abs(x * SCALE) < 2.0**53, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)
    rows = usable(vectors, column).withColumn("v", F.transform("v", whole))
    rows = rows.where(~F.exists("v", lambda x: F.abs(x) == float("inf")))
    queries = asked(rows)
    left = checkpoint(ranked(approximated(rows, k), [F.desc("high"), "vec_id"]))

    def read(pairs: DataFrame) -> DataFrame:
        # Of a row that repeats, k are enough; the partial sums of this aggregate leave one of it in each task.
        own = rows.join(pairs.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
        both = pairs.select("key", "vec_id").join(own, "vec_id").join(queries, "key").select("key", "q", "vec_id", "v", "n")
        return both.mapInArrow(_exact, "key long, vec_id long, n int, order binary, score long, scaled double")

    first = checkpoint(read(left.where(F.col("rank") <= k)))
    # The k-th exact score so far; below k there is nothing more to read.
    seen = best(first, k, [F.desc("order"), "vec_id"]).groupBy("key").agg(F.min("scaled").alias("sure"))
    rest = read(left.where(F.col("rank") > k).join(seen, "key").where(F.col("high") >= F.col("sure") - F.abs("sure") * 1e-9))
    found = first.unionByName(rest).withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n")))).join(queries.select("key", "query_id"), "key")
    return best(found, k, [F.desc("order"), "vec_id"]).select("query_id", "rank", "vec_id", "score")


def op5_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), q AS (
  SELECT DISTINCT vec_id AS query_id, v AS q FROM v WHERE vec_id % 50 = 0
), p AS (
  SELECT query_id, q, vec_id, CAST(list_dot_product(q, v) AS BIGINT) AS score FROM q JOIN v ON query_id <> vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
