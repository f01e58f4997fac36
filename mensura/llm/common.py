"""Shared helpers: shared-folder checkpoints, Arrow batch sizing, byte arrays of whole batches, links to components."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without a doc_id take part under this id, so they sort last; results give them null again.
NO_ID = (1 << 63) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tune(spark: SparkSession) -> None:
    """Bounds the rows and bytes of one Arrow batch and the rows that a reader holds, so that memory doesn't depend on the input.

    All operators use the same bounds, so a plan that runs later than it was made has those that it was made for.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  A temporary one serves only a local session, whose executor is the driver."""
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="mensura-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a whole Arrow string column and the offsets of its rows; a null is an empty text."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 4 << 20):
    """Runs of rows (start, end) with at most `limit` bytes, or one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of the undirected links reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014), whose edge count doesn't grow; every round is written
    to the shared folder and the one before deleted.  Links and labels stay distributed; only a count of changes comes to
    the driver.
    """
    with Tables(links.sparkSession) as table:
        edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
        edges, before, k = table(edges, "round0"), None, 0
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            down = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            k += 1
            edges = table(small, f"round{k}")
            table.drop(f"round{k - 1}")
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        labels = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        return checkpoint(labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


class Tables:
    """Parquet tables in the shared folder, for what is read more than once.  Left as a context, they are deleted."""

    def __init__(self, spark: SparkSession):
        import uuid

        self.spark, self.base = spark, f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def bitmap(bits_set: DataFrame, bits: int = 23) -> np.ndarray:
    """2 ** bits bits, 1 MB, of which those in the column b (from 0) are set."""
    at = (F.col("b") + 1).alias("b")
    found = bits_set.select(at).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    table = np.zeros((1 << bits >> 15, 4096), np.uint8)
    for r in found:
        table[r["k"] - 1] = np.frombuffer(bytes(r["m"]), np.uint8)
    return table.reshape(-1)


def split(texts: DataFrame, keys: DataFrame, bits: int = 23) -> tuple[DataFrame, DataFrame]:
    """The rows of texts (with _id and _th) that may be among keys, and those that surely aren't.

    A bitmap of hashes is broadcast.  Rows that it lets by too much cost time only, as a join follows; it spares the others
    the way through an exchange.
    """
    bit = F.pmod(F.xxhash64("_id", "_th"), F.lit(1 << bits))
    table = bitmap(keys.select(bit.alias("b")), bits)
    shared = texts.sparkSession.sparkContext.broadcast(table)
    names = texts.columns

    def keep(wanted):
        def rows(batches):
            import pyarrow as pa

            for batch in batches:
                at = batch.column(len(names)).to_numpy()
                on = (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1) == wanted
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(on))

        return texts.withColumn("_bit", bit).mapInArrow(lean(rows), texts.schema)

    return keep(1), keep(0)


def possible(texts: DataFrame, keys: DataFrame) -> DataFrame:
    return split(texts, keys)[0]


def rows_with_key(docs: DataFrame, *more) -> DataFrame:
    """_row (the whole row, so that names can't clash), _id, _th and the columns given."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key, F.xxhash64(F.col("text").cast("string")).alias("_th"), *more)


_RESIDENT: dict = {}


def resident(key, make):
    """What a Python worker keeps from task to task: one object, so that the memory of one stage isn't there in the next."""
    if key not in _RESIDENT:
        if _RESIDENT:
            _RESIDENT.clear()
            give_back()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def lean(rows):
    """rows (batches to batches) without anything resident in its worker; what it leaves free goes back to the system."""

    def run(batches):
        resident(None, lambda: None)
        yield from rows(batches)
        give_back(False)

    return run


def give_back(collect: bool = True) -> None:
    """Returns what is free in this process to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
