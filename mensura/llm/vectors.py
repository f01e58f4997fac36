"""What both vector searches share: which vectors take part, blocks of vectors, copies within a block, the best results.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, neither as query nor as
candidate; vectors are compared with vectors of the same number of components only; a null id takes no part.  Every row is
a candidate, so a repeated row can be found as often as it stands there; rows with the query's own id are no candidates of it.
A query is a different pair of id and vector: a row that repeats asks once, two vectors under one id ask each.  Other
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 16_384, 1024


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): the vectors that take part, as doubles."""
    v = F.col(column).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad)).withColumn("dim", F.size("v"))


def is_query(vec_id: Column) -> Column:
    return vec_id % 50 == 0


def asked(rows: DataFrame) -> DataFrame:
    """(key, query_id, q, dim): the different queries of the rows."""
    own = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "v"])
    return own.select(F.xxhash64("vec_id", "v").alias("key"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim")


def blocks_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def dealt(column: str, blocks) -> Column:
    return F.pmod(F.xxhash64(column), blocks if isinstance(blocks, Column) else F.lit(blocks)).cast("int")


def matrix(v) -> np.ndarray:
    """Rows of an Arrow list column whose lists have one length."""
    import pyarrow as pa

    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def needed(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block that can be among anyone's k best, in the order of their ids: of equal vectors the first by id, where a
    query skips those with its own id.  Of rows with one vector and id k are enough, of rows with one vector 2 k."""
    order = np.argsort(ids, kind="stable")
    _, vector = np.unique(x[order], axis=0, return_inverse=True)
    vector, own = vector.reshape(-1), ids[order]
    by = np.lexsort((own, vector))
    keep = np.ones(len(by), bool)
    for groups, most in (((vector[by], own[by]), k), ((vector[by],), 2 * k)):
        new = np.zeros(len(by), bool)
        new[:1] = True
        for g in groups:
            new[1:] |= g[1:] != g[:-1]
        rank = np.cumsum(keep) - keep
        start = np.maximum.accumulate(np.where(new, rank, 0))
        keep &= rank - start < most
    return np.sort(order[by[keep]])[np.argsort(ids[np.sort(order[by[keep]])], kind="stable")]


def gather(rows: DataFrame, keys: list[str], longs: list[str], v: str) -> DataFrame:
    """A row for each block: its keys (ints), the long columns and the matrix of vectors as bytes."""

    def pack(table):
        import pyarrow as pa

        head = [table.column(k)[:1].combine_chunks() for k in keys]
        own = [pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in longs]
        return pa.Table.from_arrays([*head, *own, pa.array([matrix(table.column(v)).tobytes()], pa.binary())], [*keys, *longs, v])

    return rows.select(*keys, *longs, v).groupBy(*keys).applyInArrow(pack, ", ".join([*(f"{k} int" for k in keys), *(f"{c} binary" for c in longs), f"{v} binary"]))


def ranked(found: DataFrame, order: list) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)))


def best(found: DataFrame, k: int, order: list) -> DataFrame:
    """The k first rows of each query, with their rank.  Each task keeps k rows of a query before the exchange."""
    return ranked(found, order).where(F.col("rank") <= k)
