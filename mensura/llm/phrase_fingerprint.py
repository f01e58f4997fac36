"""Document fingerprints from Lempel-Ziv phrases.

Each text is parsed as LZ78 does: a phrase is the shortest run of code points that isn't in the text's dictionary yet, and goes
into it.  Texts that share passages share phrases, as they would help each other's compression.  Phrases are hashed to 32 bits;
the fingerprint is the K smallest different hashes in ascending order, as hexadecimal digits.  The likeness of two fingerprints is
the share of the K smallest hashes of both together that both have: an estimate of the Jaccard similarity of the phrase sets,
exact (but for collisions) while both sets together have at most K phrases.

The dictionary is cleared when it has DICTIONARY phrases, as in common compressors, so a text of any length needs bounded memory.

Neighbours by doc_id come from one exchange: rows are dealt to ranges of doc_id and sorted, and the first document of each
range goes to the range before it, too.  A task then streams over its rows, each beside its successor.

Defined cases: a null text is empty; an empty text has no phrase and an empty fingerprint, alike (1.0) to itself only; a null doc_id
comes first in descending order; rows with one doc_id are ordered by text, so repeated rows follow each other; a single
document is its own successor; an empty table gives no row; other columns are ignored.  Rows with one doc_id pass one task,
as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import NO_ID, mix, partitions, powers, tune

K, DICTIONARY, BLOCK = 128, 1 << 20, 1 << 18
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def phrases(text: str, known: set[str], open_: str = "") -> tuple[list[int], str]:
    """(lengths of the phrases that end in text, the open phrase behind them); known and open_ are what came before."""
    out: list[int] = []
    put, add, cur = known.add, out.append, open_
    for c in text:
        cur += c
        if cur not in known:
            put(cur)
            add(len(cur))
            cur = ""
            if len(known) == DICTIONARY:
                known.clear()
    return out, cur


def _blocks(pieces):
    """Runs of (piece, text, lengths) of about BLOCK code points; texts end with their last phrase, long ones are cut between phrases."""
    run, size = [], 0
    for k, (text, lengths) in enumerate(pieces):
        ends = np.cumsum(lengths, dtype=np.int64)
        a = 0
        while a < len(lengths):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + BLOCK - size, "right")))
            run.append((k, text[done : int(ends[b - 1])], lengths[a:b]))
            size += len(run[-1][1])
            a = b
            if size >= BLOCK:
                yield run
                run, size = [], 0
    if run:
        yield run


_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def minima(pieces: list[tuple[str, list[int]]], k: int = K) -> list[np.ndarray]:
    """The k smallest different hashes of each piece's phrases, ascending."""
    out = [np.zeros(0, np.uint32)] * len(pieces)
    for run in _blocks(pieces):
        codes = np.frombuffer("".join(t for _, t, _ in run).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) >= len(_POWERS[0]):
            _POWERS[:] = powers(BASE, len(codes) * 5 // 4), powers(UNBASE, len(codes) * 5 // 4)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(BASE)) * _POWERS[0][: len(codes)], out=sums[1:])
        ends = np.cumsum(np.concatenate([n for _, _, n in run]), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        own = (mix((sums[ends] - sums[starts]) * _POWERS[1][starts]) >> np.uint64(32)).astype(np.uint32)
        at = 0
        for p, _, lengths in run:
            out[p] = np.unique(np.concatenate([out[p], own[at : at + len(lengths)]]))[:k]
            at += len(lengths)
    return out


def together(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    both = np.sort(np.concatenate([a, b]))
    twice = np.flatnonzero(both[1:] == both[:-1])
    total = len(both) - len(twice)
    if total <= k:
        return len(twice) / total if total else 1.0
    # Of the k smallest different values, those that stand twice: the i-th repeat is the value number at - i.
    return int((twice - np.arange(len(twice)) < k).sum()) / k


def text_of(mins: np.ndarray) -> str:
    return mins.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> np.ndarray:
    lengths, _ = phrases(text or "", set())
    return minima([(text or "", lengths)])[0]


def edited(text: str, following: str) -> tuple[int, str]:
    """(how much of the text stays, what replaces its last third)."""
    n = len(text) // 3
    return len(text) - n, following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(_row, fingerprint) for documents: the whole row as a struct, so that names can't clash."""
    tune(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))

    def own(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = minima([(t, phrases(t, set())[0]) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(m) for m in found], pa.string())], ["_row", "fingerprint"])

    return rows.mapInArrow(own, f"_row {rows.schema['_row'].dataType.simpleString()}, fingerprint string")


def _deal(batches, bounds: np.ndarray):
    """(bucket, guest, id, doc_id, text): each row in the bucket of its range; the first of a range is a guest in the one before."""
    import pyarrow as pa

    up = bounds[::-1]
    for batch in batches:
        ids = batch.column("id").to_numpy()
        bucket = len(bounds) - np.searchsorted(up, ids, "left") - 1
        first = np.flatnonzero(bounds[bucket] == ids)
        for at, guest, own in ((np.arange(len(ids)), 0, bucket), (first, 1, (bucket[first] - 1) % len(bounds))):
            if len(at):
                part = batch if not guest else batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(at), guest), pa.int32()), *part.columns], ["bucket", "guest", *batch.schema.names])


def _beside(batches):
    """SCHEMA for rows that are followed by their successors; guests only serve as such."""
    import pyarrow as pa

    carry = None
    for batch in batches:
        new = list(zip(*(batch.column(c).to_pylist() for c in ("guest", "doc_id", "text")), strict=True))
        rows = new if carry is None else [carry, *new]
        carry = rows[-1]
        # Per row: what stays of it with the phrases in it, the rest of it, and what replaces that rest.
        pieces, parts, digests = [], [], []
        for i, (guest, _, text) in enumerate(rows):
            known: set[str] = set()
            if guest or i == len(rows) - 1:
                parts.append((len(pieces),))
                pieces.append((text, phrases(text, known)[0]))
                continue
            stays, instead = edited(text, rows[i + 1][2])
            head, open_ = phrases(text[:stays], known)
            tail, _ = phrases(text[stays:], known.copy(), open_)
            new_tail, _ = phrases(instead, known, open_)
            parts.append((len(pieces), len(pieces) + 1, len(pieces) + 2))
            pieces += [(text[:stays], head), (open_ + text[stays:], tail), (open_ + instead, new_tail)]
            digests.append(hashlib.sha256((text[:stays] + instead).encode()).hexdigest())
        mins = minima(pieces)
        own = [mins[p[0]] if len(p) == 1 else together(mins[p[0]], mins[p[1]]) for p in parts]
        out = []
        for i, p in enumerate(parts):
            if len(p) > 1:
                other = together(mins[p[0]], mins[p[2]])
                out.append((rows[i][1], len(rows[i][2]), digests[len(out)], text_of(own[i]), text_of(other), likeness(own[i], other), likeness(own[i], own[i + 1])))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def beside_next(docs: DataFrame) -> DataFrame:
    """SCHEMA: each document's fingerprint beside that of its edited text and of its successor by descending doc_id."""
    spark = docs.sparkSession
    tune(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")
    rows = docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = 8 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("id", [(i + 1) / n for i in range(n)], 20 * n).alias("c"), F.max("id").alias("m")).first()
    bounds = np.unique(np.array([*(cuts["c"] or []), *([] if cuts["m"] is None else [cuts["m"]])], np.int64))[::-1]
    if not len(bounds):
        return spark.createDataFrame([], SCHEMA)
    dealt = rows.mapInArrow(lambda it: _deal(it, bounds), "bucket int, guest int, id long, doc_id long, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), "text").mapInArrow(_beside, SCHEMA)


def op13_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
