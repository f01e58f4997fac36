"""Approximate nearest neighbours by learned partitions.

The index is learned on at most SAMPLE rows, drawn by a hash of vec_id: their neighbour graph is cut into balanced parts
(bisection by sweeps along the graph's smooth directions, then moves of vertices that gain edges while sizes stay in
bounds), and a softmax classifier on the vector learns the part of a vertex from its own and its neighbours' parts.  There are
about as many parts as the root of the number of rows: up to TOP of them at once; beyond TOP * BLOCK rows each part is cut
again in the same way, by a classifier of its own, which Spark learns for all parts side by side.

The classifier sends every row of the table to its most probable part, and each query to its most probable parts.  How many
is learned, too: HELD rows of the sample are held out as queries, and each query goes on until the probability behind it is
what held-out ones needed to meet TARGET of their neighbours.  So vectors in clusters need a few parts and vectors without any
structure most of them.  The candidates found there are reranked by exact cosine on the original vectors, in double precision.

Blocks: a part with more rows than BLOCK is dealt to several blocks by a hash of vec_id, so no part, whatever its share, is
one task.  A block of queries goes only to the blocks of the parts that its queries probe.

Defined cases: see vectors.py; a zero vector takes no part either.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import checkpoint, tune
from mensura.llm.vectors import BLOCK, asked, best, blocks_of, dealt, gather, is_query, matrix, needed, usable

SAMPLE, HELD, TOP, NEIGHBOURS, TARGET, SLACK = 6000, 1000, 64, 10, 0.95, 1.1


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest other rows of each row, by cosine."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, slack: float = SLACK, sweeps: int = 12) -> np.ndarray:
    """Part of each vertex.  Each bisection sorts by a smooth vector of the graph and cuts in the middle; then vertices move
    to the part that most of their neighbours have, best gains first, as long as no part grows beyond slack * mean."""
    n = len(near)
    rng = np.random.default_rng(7)
    part = np.zeros(n, np.int64)
    for _ in range(max(0, int(np.ceil(np.log2(parts))))):
        smooth = rng.standard_normal(n)
        for _ in range(60):  # averages over neighbours of the same part
            same = part[near] == part[:, None]
            smooth = 0.5 * smooth + 0.5 * np.where(same.any(axis=1), (smooth[near] * same).sum(axis=1) / np.maximum(same.sum(axis=1), 1), smooth)
            mean = np.bincount(part, smooth) / np.maximum(np.bincount(part), 1)
            smooth -= mean[part]
            smooth /= np.abs(smooth).max() + 1e-300
        order = np.lexsort((np.arange(n), smooth, part))
        sizes = np.bincount(part)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = 2 * part + (rank >= (sizes[part] + 1) // 2)
    part %= parts
    most = int(np.ceil(slack * n / parts))
    rows = np.repeat(np.arange(n), near.shape[1])
    for _ in range(sweeps):
        votes = np.zeros((n, parts))
        np.add.at(votes, (rows, part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), part[rows]), 1)
        to = votes.argmax(axis=1)
        gain = votes[np.arange(n), to] - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[to[i]] < most:
                sizes[part[i]] -= 1
                sizes[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, part: np.ndarray, near: np.ndarray, parts: int, rounds: int = 300) -> np.ndarray:
    """Weights of a softmax classifier, (components + 1) x parts; its labels are the parts of a vertex and its neighbours."""
    y = np.zeros((len(x), parts))
    y[np.arange(len(x)), part] = 1.0
    soft = 0.5 * y + 0.5 * y[near].mean(axis=1) if near.shape[1] else y
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, m, v = np.zeros((a.shape[1], parts)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = a @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = a.T @ (p - soft) / len(a) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def route(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Probabilities of the parts."""
    z = x @ w[:-1] + w[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def learn(sample: np.ndarray, parts: int) -> np.ndarray:
    """Weights of the classifier for at most so many parts, of 64 rows of the sample at least."""
    x = unit(sample)
    parts = int(min(parts, max(1, len(x) // 64)))
    if parts == 1:
        return np.zeros((x.shape[1] + 1, 1))
    near = neighbour_graph(x)
    return fit_router(x, balanced_parts(near, parts), near, parts)


class Index:
    """The classifiers of vectors of one dimension, and how far queries go."""

    def __init__(self, outer: np.ndarray, inner: dict[int, np.ndarray]):
        self.outer, self.inner, self.mass = outer, inner, 1.0
        self.width = max([w.shape[1] for w in inner.values()], default=1)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The part of each row: part * width + part in it."""
        first = route(x, self.outer).argmax(axis=1)
        out = first * self.width
        for p in np.unique(first).tolist():
            if p in self.inner:
                at = np.flatnonzero(first == p)
                out[at] += route(x[at], self.inner[p]).argmax(axis=1)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        outer = route(x, self.outer)
        out = np.zeros((len(x), outer.shape[1], self.width))
        for p in range(outer.shape[1]):
            w = self.inner.get(p)
            own = route(x, w) if w is not None else np.ones((len(x), 1))
            out[:, p, : own.shape[1]] = outer[:, p : p + 1] * own
        return out.reshape(len(x), -1)

    def before(self, x: np.ndarray) -> np.ndarray:
        """The probability of all parts that come before each part, for each row; above 1 for parts that don't exist."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        own = np.take_along_axis(p, order, axis=1)
        out = np.empty_like(p)
        np.put_along_axis(out, order, np.cumsum(own, axis=1) - own, axis=1)
        return np.where(p > 0, out, 2.0)

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of the parts that each row asks."""
        return np.nonzero(self.before(x) <= self.mass)

    def calibrate(self, held: np.ndarray, rest: np.ndarray, k: int = 5) -> None:
        """Sets how far queries go, by where the k nearest other rows of held-out ones are."""
        held, rest = unit(held), unit(rest)
        k = min(k, len(rest))
        if not len(held) or not k:
            return
        parts, needs = self.parts(rest), []
        for a in range(0, len(held), 256):
            x = held[a : a + 256]
            near = np.argpartition(-(x @ rest.T), k - 1, axis=1)[:, :k]
            needs.append(np.take_along_axis(self.before(x), parts[near], axis=1).ravel())
        self.mass = float(np.quantile(np.concatenate(needs), TARGET, method="higher")) + 1e-12


def drawn(rows: DataFrame, n: int, most: int, *salt: int) -> DataFrame:
    """At most so many of the n rows, by a hash of vec_id."""
    h = F.xxhash64("vec_id", *[F.lit(s) for s in salt])
    return rows.where(F.pmod(h, F.lit(1 << 20)) < math.ceil(min(1.0, 1.5 * most / max(n, 1)) * (1 << 20))).orderBy(h, "vec_id").limit(most)


def build(rows: DataFrame, n: int, top: int = TOP, block: int = BLOCK) -> dict[int, Index]:
    """The index of the vectors of each dimension, learned on bounded samples of the n rows."""
    by_dim: dict[int, list] = {}
    for r in drawn(rows, n, SAMPLE, 11).collect():
        by_dim.setdefault(r["dim"], []).append(r["v"])
    parts, out, samples = math.ceil(math.sqrt(n)), {}, {}
    for d, v in by_dim.items():
        x = np.array(v, float)
        cut = min(HELD, len(x) // 6)
        samples[d] = x[:cut], x[cut:]
        out[d] = Index(learn(x[cut:], min(parts, top)), {})
    if n > top * block:
        outer = rows.sparkSession.sparkContext.broadcast(pickle.dumps(out))
        more = min(top, math.ceil(parts / top))
        share = 1.5 * SAMPLE * top / n  # rows of each part, most of them at least
        some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(1 << 20)) < math.ceil(min(1.0, share) * (1 << 20)))
        assigned = some.mapInArrow(lambda it: _assign(it, outer, False), ASSIGNED)
        spread = assigned.withColumn("rn", F.row_number().over(_by_hash())).where(F.col("rn") <= SAMPLE)

        def second(table):
            import pyarrow as pa

            w = learn(matrix(table.column("v")), more)
            head = [table.column(c)[:1].combine_chunks() for c in ("dim", "part")]
            return pa.Table.from_arrays([*head, pa.array([w.shape[1]], pa.int32()), pa.array([w.tobytes()], pa.binary())], ["dim", "part", "n", "w"])

        found = spread.select("dim", "part", "v").groupBy("dim", "part").applyInArrow(second, "dim int, part int, n int, w binary").collect()  # TOP rows for each dimension
        for d, index in out.items():
            out[d] = Index(index.outer, {r["part"]: np.frombuffer(r["w"]).reshape(-1, r["n"]) for r in found if r["dim"] == d})
    for d, (held, rest) in samples.items():
        out[d].calibrate(held, rest)
    return out


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("dim", "part").orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id")


ASSIGNED = "vec_id long, v array<double>, dim int, part int"
PROBES = "key long, query_id long, q array<double>, dim int, part int"


def _assign(batches, shared, probes: bool):
    """Rows with their part, or with each part that they probe."""
    import pyarrow as pa

    indexes = pickle.loads(shared.value)
    for batch in batches:
        table = pa.Table.from_batches([batch])
        names = [c for c in table.column_names if c != "dim"]
        dims = table.column("dim").to_numpy()
        row, part = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            index = indexes.get(dim)
            if index is None:  # no row of this dimension was drawn: they are one part
                a, p = np.arange(len(at)), np.zeros(len(at), np.int64)
            else:
                x = unit(matrix(table.column(names[-1]).take(pa.array(at))))
                a, p = index.probed(x) if probes else (np.arange(len(at)), index.parts(x))
            row.append(at[a])
            part.append(p)
        row, part = np.concatenate(row), np.concatenate(part)
        own = [table.column(c).take(pa.array(row)).combine_chunks() for c in names]
        own = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own]
        yield pa.RecordBatch.from_arrays([*own, pa.array(dims[row], pa.int32()), pa.array(part, pa.int32())], [*names, "dim", "part"])


def _search(batches, k: int):
    import pyarrow as pa

    for batch in batches:
        out: list = [[], [], [], []]
        for dim, keys, own, qm, xi, xm in zip(*(batch.column(n).to_pylist() for n in ("dim", "key", "query_id", "q", "vec_id", "v")), strict=True):
            keys, q_ids, x_ids = (np.frombuffer(b, np.int64) for b in (keys, own, xi))
            x = np.frombuffer(xm, np.float64).reshape(-1, dim)
            at = needed(x_ids, x, k)
            x_ids, xu, qu = x_ids[at], unit(x[at]), unit(np.frombuffer(qm, np.float64).reshape(-1, dim))
            for a in range(0, len(qu), 64):
                s = qu[a : a + 64] @ xu.T
                for i in range(a, min(a + 64, len(qu))):
                    row = s[i - a]
                    row[x_ids == q_ids[i]] = -np.inf
                    m = min(k, len(row))
                    cut = np.partition(row, len(row) - m)[len(row) - m]
                    at = np.flatnonzero((row >= cut - 1e-9) & np.isfinite(row))
                    # The score again, in an order of additions that doesn't depend on the block.
                    exact = (xu[at] * qu[i]).sum(axis=1)
                    first = np.lexsort((x_ids[at], -exact))[:k]
                    for c, v in zip(out, (np.full(len(first), keys[i]), np.full(len(first), q_ids[i]), x_ids[at[first]], exact[first]), strict=True):
                        c.append(v)
        types = (np.int64, np.int64, np.int64, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(out, types, strict=True)], ["key", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, k: int = 5, column: str = "embedding", scanned: list | None = None, **options) -> DataFrame:
    """(query_id, rank, vec_id, score) for the query rows of vectors.

    scanned, if given, takes (pairs of query and row that are compared, all such pairs).
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = usable(vectors, column).where(F.exists("v", lambda x: x != 0))
    n = rows.count()
    shared = spark.sparkContext.broadcast(pickle.dumps(build(rows, n, **options)))  # TOP * TOP classifiers at most
    assigned = checkpoint(rows.mapInArrow(lambda it: _assign(it, shared, False), ASSIGNED))
    sizes = assigned.groupBy("dim", "part").count()
    probing = asked(rows).select("key", "query_id", "q", "dim").mapInArrow(lambda it: _assign(it, shared, True), PROBES)
    if scanned is not None:
        met = probing.groupBy("dim", "part").agg(F.count("*").alias("q")).join(sizes, ["dim", "part"]).agg(F.sum(F.col("q") * F.col("count"))).first()[0]
        scanned.append((met or 0, asked(rows).count() * n))
    salts = F.broadcast(sizes.select("dim", "part", F.ceil(F.col("count") / BLOCK).cast("int").alias("salts")))  # a row for each part
    data = gather(assigned.join(salts, ["dim", "part"]).withColumn("salt", dealt("vec_id", F.col("salts"))), ["dim", "part", "salt"], ["vec_id"], "v")
    groups = blocks_of(rows.where(is_query(F.col("vec_id"))).count(), 4096)
    queries = gather(probing.withColumn("grp", dealt("key", groups)), ["dim", "part", "grp"], ["key", "query_id"], "q")
    queries = queries.join(salts, ["dim", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    partial = queries.join(data, ["dim", "part", "salt"]).mapInArrow(lambda it: _search(it, k), "key long, query_id long, vec_id long, score double")
    return best(checkpoint(partial), k, [F.desc("score"), "vec_id"]).select("query_id", "rank", "vec_id", "score")


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
