"""Jaccard join on word n-grams by PartEnum signatures: exact links between texts, and their components.

Texts become sets of 64-bit hashes of their distinct shingles; equal sets are one node.  Two sets of sizes r and s with
Jaccard similarity >= 0.8 differ in at most (r + s) / 9 elements.  Sizes fall into bands whose ends are 5/4 apart, so the
larger set of a linked pair has the smaller one in its own band or the one below; a set has signatures for its own band and
for the next one.  For a band with largest size R, the domain of hashes is cut into n1 > k = floor(2 R / 9) partitions: at
least n1 - k of them hold the same elements in both sets.  A signature is the content of one occupied partition.  n1 is
chosen so that nearly every set occupies more than k partitions, and then one of its equal partitions is occupied; a
set that doesn't also has a signature for each choice of n1 - k of its empty partitions.  Sets of at most TINY elements use
every element as a partition of its own: their signatures are the set without up to two elements.

Groups that share a signature are never paired out.  Up to PAIRED members, all pairs are candidates; in a larger group all
members are compared with one of them, and only where the verified links leave such a group in several components are
members of different components compared, in blocks: each with its nearest at first, all with all at last.  A group that is
large within one batch counts as large whatever other batches add to it.  Candidates first pass a bound: the distance between two histograms of
the hashes never exceeds the number of elements in which the sets differ.  What passes is counted exactly on whole sets.

Defined cases: a text that is null or has no word has an empty set and is linked with nothing; a text with fewer than five
words has its whole sequence as the one shingle; repeated rows are linked with each other; a null doc_id takes part as the
largest id and is given back as null; texts of any length are read whole; other columns are ignored; an empty table gives
no row.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import NO_ID, Tables, checkpoint, chunks, components, lean, mix, possible, powers, rows_with_key, split, text_buffers, tune

SHINGLE, TINY, PAIRED, HIST, HOT, PIVOTS = 5, 12, 4, 128, 64, 512
U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_STEPS = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_SPACE = np.array([i == 32 or 9 <= i <= 13 for i in range(256)])
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE)) | U(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, n), powers(_INVERSE, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and how many words come before each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = ~_SPACE[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[inner - 1] = letter[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(int(len(data)).bit_length(), 20)
    up, down = _powers(size)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[_LOWER[data]] * up[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)), np.searchsorted(s, offsets)


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within each, and the offsets of the texts."""
    data, offsets = text_buffers(column)
    sets: list[np.ndarray] = []
    empty = np.zeros(0, np.uint64)
    for i, j in chunks(offsets, 1 << 20):
        at = offsets[i : j + 1] - offsets[i]
        w, upto = word_hashes(data[offsets[i] : offsets[j]], at)
        full = empty
        if len(w) >= SHINGLE:
            n = len(w) - SHINGLE + 1
            full = w[:n] * _STEPS[0]
            for k in range(1, SHINGLE):
                full = full + w[k : n + k] * _STEPS[k]
            full = mix(full + U(SHINGLE))
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                sets.append(np.unique(full[a : b - SHINGLE + 1]))
            elif b > a:
                sets.append(mix(np.array([sum(int(x) * int(c) for x, c in zip(w[a:b], _STEPS, strict=False)) + (b - a) & 2**64 - 1], np.uint64)))
            else:
                sets.append(empty)
    return np.concatenate(sets) if sets else empty, np.cumsum([0, *map(len, sets)])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def fingerprints(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return mix(_sums(mix(h ^ U(0x5851F42D4C957F2D)), offsets) + np.diff(offsets).astype(np.uint64) * U(_BASE)).view(np.int64)


def histograms(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HIST bytes for each set: how many elements fall into each part, 255 at most."""
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    counts = np.bincount(own * HIST + (h & U(HIST - 1)).astype(np.int64), minlength=(len(offsets) - 1) * HIST)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, HIST)


@lru_cache(maxsize=None)
def bands(most: int) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, k, n1) of each band up to one that holds `most`."""
    out, low = [], TINY + 1
    while True:
        high = low * 5 // 4
        k, least = 2 * high // 9, -(-4 * low // 5)
        n1 = k + 1
        while True:
            a, b = (1 - 1 / n1) ** least, (1 - 2 / n1) ** least
            mean, var = n1 * (1 - a), n1 * (n1 - 1) * b + n1 * a - (n1 * a) ** 2
            if mean - 4 * max(var, 0.0) ** 0.5 >= k + 1:
                break
            n1 += 1
        out.append((low, high, k, n1))
        if high >= most:
            return out
        low = high + 1


def signatures(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of all sets that aren't empty."""
    sizes = np.diff(offsets)
    v = mix(h ^ U(0x2545F4914F6CDD1D))
    who: list[np.ndarray] = []
    sig: list[np.ndarray] = []
    odd: list[np.ndarray] = []
    table = bands(max(int(sizes.max(initial=0)) * 5 // 4, TINY + 1))
    lows = np.array([b[0] for b in table])
    own = np.searchsorted(lows, sizes, "right") - 1
    partner = np.searchsorted(lows, sizes * 5 // 4, "right") - 1
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    element = np.repeat(np.arange(len(sizes)), sizes)
    for tags in (own, np.where(partner > own, partner, -1)):
        on = tags >= 0
        if not on.any():
            continue
        n1s = np.array([b[3] for b in table], np.uint64)[np.maximum(tags, 0)]
        part = ((h >> U(32)) * n1s[element]) >> U(32)  # rises with h, so a partition's elements are neighbours
        change = np.ones(len(h), bool)
        change[1:] = (part[1:] != part[:-1]) | (element[1:] != element[:-1])
        start = np.flatnonzero(change)
        start = start[on[element[start]]]
        ends = np.append(np.flatnonzero(change), len(h))
        end = ends[np.searchsorted(ends, start, "right")]
        e = element[start]
        key = (tags[e].astype(np.uint64) << U(40)) + part[start] + U(1)
        who.append(e)
        odd.append(tags[e] & 1)
        sig.append(mix(total[end] - total[start] + mix(key * U(_BASE))))
        occupied = np.bincount(e, minlength=len(sizes))
        ks = np.array([b[2] for b in table])[np.maximum(tags, 0)]
        for i in np.flatnonzero(on & (sizes > 0) & (occupied <= ks)).tolist():
            _, _, k, n1 = table[tags[i]]
            empty = sorted(set(range(n1)) - set(part[offsets[i] : offsets[i + 1]].tolist()))
            marks = mix(np.array(empty, np.uint64) + U(0xA24BAED4963EE407))
            few = [int(marks[list(c)].sum()) for c in itertools.combinations(range(len(empty)), n1 - k)]
            who.append(np.full(len(few), i))
            odd.append(np.full(len(few), tags[i] & 1))
            sig.append(mix(np.array(few, np.uint64) + mix(np.array([(int(tags[i]) << 40) * 3 + 7], np.uint64))))
    for i in np.flatnonzero((sizes > 0) & (sizes <= TINY)).tolist():
        x = v[offsets[i] : offsets[i + 1]]
        whole = int(x.sum(dtype=np.uint64))
        few = [whole]
        if sizes[i] >= 4:
            few += [(whole - y) % 2**64 for y in x.tolist()]
        if sizes[i] >= 9:
            few += [(whole - a - b) % 2**64 for a, b in itertools.combinations(x.tolist(), 2)]
        who.append(np.full(len(few), i))
        odd.append(np.zeros(len(few), np.int64))
        sig.append(mix(np.array(few, np.uint64) + U(0x9FB21C651E98DF25)))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # 47 bits and whether the band is odd; strangers that share 47 bits only cost a comparison.
    return np.concatenate(who), (np.concatenate(sig) & U(0xFFFFFFFFFFFE)) | np.concatenate(odd).astype(np.uint64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal values."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


def _pairs_of(sig: np.ndarray, fp: np.ndarray, hot: np.ndarray | None = None):
    """Candidate pairs (smaller, larger) of groups, and (sig, fp) of the groups that were not paired out.

    Groups of the signatures in hot have further members elsewhere, so they are listed whatever their size here.

    The star of a large group only serves to find its components early; what it leaves apart is compared later.  Two sets of
    one band meet in an even and in an odd one, so groups of odd bands have no star.
    """
    order = np.lexsort((fp, sig))
    sig, fp = sig[order], fp[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
    sig, fp = sig[keep], fp[keep]
    start, size = _runs(sig)
    a, b = [], []
    for n in range(2, PAIRED + 1):
        s = start[size == n]
        for i, j in itertools.combinations(range(n), 2):
            a.append(fp[s + i])
            b.append(fp[s + j])
    large = size > PAIRED
    if hot is not None:
        large |= np.isin(sig[start], hot)
    s, n = start[large], size[large]
    rows = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) if len(s) else np.zeros(0, np.int64)
    pivot = np.repeat(fp[s], n)
    other = (fp[rows] != pivot) & ((sig[rows] & U(1)) == 0)
    a.append(pivot[other])
    b.append(fp[rows][other])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        a, b = a[new], b[new]
    return a, b, sig[rows], fp[rows]


def _map(batches, buckets: int):
    """Blobs for each bucket of signatures, of documents (-1 - bucket), and of groups that are large within a batch."""
    import pyarrow as pa

    for batch in batches:
        ids, ths = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
        h, offsets = shingle_sets(batch.column(2))
        fp, hist, sizes = fingerprints(h, offsets), histograms(h, offsets), np.diff(offsets)
        rows = []
        to = (mix(fp.view(np.uint64)) % U(buckets)).astype(np.int64)
        for k in np.unique(to).tolist():
            m = to == k
            rows.append((-1 - k, ids[m].tobytes(), ths[m].tobytes(), fp[m].tobytes(), sizes[m].astype(np.int64).tobytes(), hist[m].tobytes()))
        _, once = np.unique(fp, return_index=True)
        once = once[sizes[once] > 0]
        if len(once):
            own = np.concatenate([h[offsets[i] : offsets[i + 1]] for i in once])
            who, sig = signatures(own, np.cumsum(np.append(0, sizes[once])))
            node = fp[once][who]
            bucket = ((sig >> U(20)) % U(buckets)).astype(np.int64)
            order = np.lexsort((node, sig, bucket))
            bucket, sig, node = bucket[order], sig[order], node[order]
            start, size = _runs(sig)
            hot = size >= HOT
            if hot.any():  # a group this large in one batch leaves it as one member, and its star and list beside
                inside = np.repeat(hot, size)
                a, b, s, f = _pairs_of(sig[inside], node[inside])
                k = int(abs(int(fp[0])) % buckets)
                rows.append((k, b"", b"", a.tobytes(), b.tobytes(), b"p"))
                rows.append((k, b"", b"", s.tobytes(), f.tobytes(), b"m"))
                to, marked = bucket[start[hot]], sig[start[hot]]  # that member's group may be small where it goes
                for k in np.unique(to).tolist():
                    rows.append((k, b"", b"", marked[to == k].tobytes(), b"", b"h"))
                first = np.zeros(len(sig), bool)
                first[start] = True
                rest = ~inside | first
                # The list needs the member that goes on, too: it has it, as _pairs_of lists whole groups.
                bucket, sig, node = bucket[rest], sig[rest], node[rest]
            start, size = _runs(bucket)
            for s, n in zip(start.tolist(), size.tolist(), strict=True):
                x = sig[s : s + n]
                used, index = np.unique(node[s : s + n], return_inverse=True)
                rows.append((int(bucket[s]), x.astype(np.uint32).tobytes(), (x >> U(32)).astype(np.uint16).tobytes(), used.tobytes(), index.astype(np.uint16).tobytes(), b""))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "a", "b", "c", "d", "e"])


#: kind 0: x doc, y text hash, z node, w size, h histogram.  kind 1: x, y candidate pair.  kind 2: x signature, y member.
ROWS = "kind int, x long, y long, z long, w long, h binary"


def _reduce(table):
    import pyarrow as pa

    cols = {n: table.column(n).to_pylist() for n in table.schema.names}
    longs = lambda n, t=np.int64: np.frombuffer(b"".join(cols[n]), t)
    kinds, x, y, z, w, hist = [], [], [], [], [], None
    if not table.num_rows:
        pass
    elif cols["bucket"][0] < 0:
        x, y, z, w = (longs(n) for n in "abcd")
        hist = np.frombuffer(b"".join(cols["e"]), np.uint8).reshape(-1, HIST)
        kinds = np.zeros(len(x), np.int32)
    else:
        own = [i for i, m in enumerate(cols["e"]) if not m]
        low, high = (np.frombuffer(b"".join(cols[n][i] for i in own), t).astype(np.uint64) for n, t in (("a", np.uint32), ("b", np.uint16)))
        fp = [np.frombuffer(cols["c"][i], np.int64)[np.frombuffer(cols["d"][i], np.uint16)] for i in own]
        hot = np.frombuffer(b"".join(cols["c"][i] for i, m in enumerate(cols["e"]) if m == b"h"), U)
        a, b, sig, fp = _pairs_of(low | high << U(32), np.concatenate(fp) if fp else np.zeros(0, np.int64), hot)
        pairs = [i for i, m in enumerate(cols["e"]) if m == b"p"]
        a = np.concatenate([a, np.frombuffer(b"".join(cols["c"][i] for i in pairs), np.int64)])
        b = np.concatenate([b, np.frombuffer(b"".join(cols["d"][i] for i in pairs), np.int64)])
        lists = [i for i, m in enumerate(cols["e"]) if m == b"m"]
        sig = np.concatenate([sig.view(np.int64), np.frombuffer(b"".join(cols["c"][i] for i in lists), np.int64)])
        fp = np.concatenate([fp, np.frombuffer(b"".join(cols["d"][i] for i in lists), np.int64)])
        x, y = np.concatenate([a, sig]), np.concatenate([b, fp])
        kinds = np.repeat(np.array([1, 2], np.int32), [len(a), len(sig)])
        z = w = None
    n = len(x)
    col = lambda v: pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64())
    h = pa.nulls(n, pa.binary()) if hist is None else pa.array([r.tobytes() for r in hist], pa.binary())
    return pa.Table.from_arrays([pa.array(kinds, pa.int32()), col(x), col(y), col(z), col(w), h], ["kind", "x", "y", "z", "w", "h"])


def _bounded(batches):
    """Pairs whose sizes and histograms allow a link."""
    import pyarrow as pa

    for batch in batches:
        a, b, na, nb = (np.array(batch.column(i).to_pylist(), np.int64) for i in range(4))
        ha, hb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HIST).astype(np.int16) for i in (4, 5))
        ok = 9 * np.abs(ha - hb).sum(axis=1) <= na + nb if len(a) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def _packed(h: np.ndarray) -> bytes:
    """The upper 40 bits of each hash, 5 bytes: on the way to a comparison, two of a pair's elements meet by chance in one of
    about 2 ** 40 / (r * s) pairs, and then change its count by one."""
    h = h >> U(24)
    return (h >> U(8)).astype(np.uint32).tobytes() + h.astype(np.uint8).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) << U(8) | np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64)


def _sets(batches):
    """(key, sub, node, against, whole set): a set goes once to each group of pivots that it is compared with.

    against lists these pivots; it is empty in the row of a pivot itself.
    """
    import pyarrow as pa

    for batch in batches:
        h, offsets = shingle_sets(batch.column(0))
        nodes, groups = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i in range(0, len(nodes), 64):  # what goes out at once stays small
            rows = [(g["key"], g["sub"], nodes[k], g["against"], _packed(h[offsets[k] : offsets[k + 1]])) for k in range(i, min(i + 64, len(nodes))) for g in groups[k]]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "sub", "node", "against", "hashes"])


def _compare(batches):
    """Links of each group's pivots; rows come sorted by group, the pivots' own first."""
    import pyarrow as pa

    now, pivots = None, {}
    for batch in batches:
        a, b = [], []
        for key, sub, node, against, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            x = _unpacked(blob)
            if (key, sub) != now:
                now, pivots = (key, sub), {}
            if not against:
                pivots[node] = x
            for p in against:
                own = pivots[p]
                both = len(np.intersect1d(own, x, assume_unique=True))
                if 100 * both >= 80 * (len(own) + len(x) - both):
                    a.append(p)
                    b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked.  nodes: node, w, h, _id, _th (a text of the node).  texts: _id, _th, text.

    Only texts of nodes in pairs that pass the bound are read again.  Pivots with the same least partner form a group, at most
    about PIVOTS in one task, so that in a dense cluster each set travels once and not once for each pair.
    """
    left = nodes.select(F.col("node").alias("a"), F.col("w").alias("na"), F.col("h").alias("ha"))
    right = nodes.select(F.col("node").alias("b"), F.col("w").alias("nb"), F.col("h").alias("hb"))
    sized = pairs.join(left, "a").join(right, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    found = checkpoint(sized.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(lean(_bounded), "a long, b long"))
    low = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("low"))
    pivots = found.select("a").distinct().join(low, "a").select("a", F.least("a", "low").alias("key"))
    many = pivots.groupBy("key").agg(F.ceil(F.count("*") / PIVOTS).alias("n"))
    pivots = pivots.join(many, "key").select("a", "key", F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("sub"))
    others = found.join(pivots, "a").groupBy(F.col("b").alias("node"), "key", "sub").agg(F.collect_set("a").alias("against"))
    own = pivots.select(F.col("a").alias("node"), "key", "sub", F.array().cast("array<long>").alias("against"))
    to = others.unionByName(own).groupBy("node").agg(F.collect_list(F.struct("key", "sub", "against")).alias("groups"))
    to = checkpoint(to.join(nodes.select("node", "_id", "_th"), "node"))
    sets = possible(texts, to).join(to, ["_id", "_th"]).select("text", "node", "groups").mapInArrow(lean(_sets), "key long, sub int, node long, against array<long>, hashes binary")
    sets = sets.repartition("key", "sub").sortWithinPartitions("key", "sub", F.size("against") > 0, "node")
    return sets.mapInArrow(lean(_compare), "a long, b long")


def _group_pairs(rows: list, nearest: bool) -> set[tuple[int, int]]:
    """Pairs of members of different components whose sizes and histograms allow a link; if nearest, only those of each
    member with its nearest one."""
    fp, comp, n = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:3])
    hist = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, HIST).astype(np.int16)
    order = np.argsort(n, kind="stable")
    fp, comp, n, hist = fp[order], comp[order], n[order], hist[order]
    out: set[tuple[int, int]] = set()
    least, partner = np.full(len(fp), np.iinfo(np.int64).max), np.full(len(fp), -1)
    for i in range(len(fp)):
        j = np.arange(i + 1, np.searchsorted(n, n[i] * 5 // 4, "right"))
        j = j[comp[j] != comp[i]]
        for k in range(0, len(j), 4096):
            at = j[k : k + 4096]
            d = np.abs(hist[at] - hist[i]).sum(axis=1).astype(np.int64)
            ok = 9 * d <= n[at] + n[i]
            at, d = at[ok], d[ok]
            if nearest and len(at):
                b = int(d.argmin())
                if d[b] < least[i]:
                    least[i], partner[i] = d[b], at[b]
                closer = d < least[at]
                least[at[closer]], partner[at[closer]] = d[closer], i
            elif not nearest:
                out.update((min(int(fp[i]), b), max(int(fp[i]), b)) for b in fp[at].tolist())
    for i in np.flatnonzero(partner >= 0).tolist():
        a, b = int(fp[i]), int(fp[partner[i]])
        out.add((min(a, b), max(a, b)))
    return out


PAIRS = "bucket int, a binary, b binary"


def _across(batches, nearest: bool, buckets: int):
    """_group_pairs() of groups that are in several components, as blobs by a hash of the pair; rows come sorted by signature."""
    import pyarrow as pa

    def out(found):
        a, b = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ((), ())))
        to = (mix(a.view(np.uint64) * U(3) + b.view(np.uint64)) % U(buckets)).astype(np.int64)
        ks = np.unique(to).tolist()
        return pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array([a[to == k].tobytes() for k in ks], pa.binary()), pa.array([b[to == k].tobytes() for k in ks], pa.binary())], ["bucket", "a", "b"])

    now, rows, found = None, [], set()
    for batch in batches:
        for sig, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if sig != now:
                if len({r[1] for r in rows}) > 1:
                    found |= _group_pairs(rows, nearest)
                now, rows = sig, []
            rows.append(row)
        if len(found) > 100_000:
            yield out(found)
            found = set()
    if len({r[1] for r in rows}) > 1:
        found |= _group_pairs(rows, nearest)
    yield out(found)


def _distinct(table):
    import pyarrow as pa

    a, b = (np.frombuffer(b"".join(table.column(n).to_pylist()), np.int64) for n in ("a", "b"))
    pairs = np.unique(np.stack([a, b]), axis=1)
    return pa.Table.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])


def classes(docs: DataFrame) -> DataFrame:
    """(_id, _th, n_shingles, component, group, rows) of every different document.

    component is the smallest _id that it reaches; group numbers what is linked (rows with one doc_id and several texts can
    be in several groups with one component).
    """
    spark = docs.sparkSession
    tune(spark)
    text = F.col("text").cast("string")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, int(volume * 5e-8))
    with Tables(spark) as table:
        rows = texts.mapInArrow(lean(lambda it: _map(it, buckets)), "bucket int, a binary, b binary, c binary, d binary, e binary")
        rows = table(rows.groupBy("bucket").applyInArrow(_reduce, ROWS), "rows")
        copies = rows.where("kind = 0").groupBy("x", "y", "z", "w").agg(F.count("*").alias("rows"), F.first("h").alias("h"))
        nodes = copies.where("w > 0").groupBy(F.col("z").alias("node")).agg(F.min(F.struct(F.col("x").alias("_id"), F.col("y").alias("_th"))).alias("_r"), F.first("w").alias("w"), F.first("h").alias("h"))
        nodes = table(nodes.select("node", "w", "h", "_r._id", "_r._th"), "nodes")
        links = table(verify(rows.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), nodes, texts), "links")
        members = table(rows.where("kind = 2").select(F.col("x").alias("sig"), F.col("y").alias("node")).distinct(), "members")
        # Members of different components are compared: first each with its nearest, which joins what is dense, then all.
        tested = None
        for number, nearest in enumerate((True, False)):
            parts = components(links)
            placed = members.join(parts, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
            open_ = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
            across = placed.join(open_, "sig").join(nodes.select("node", "w", "h"), "node").select("sig", "node", "component", "w", "h")
            blobs = across.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(lean(lambda it, nearest=nearest: _across(it, nearest, buckets)), PAIRS)
            across = blobs.groupBy("bucket").applyInArrow(_distinct, "a long, b long")
            across = table(across if tested is None else across.join(tested, ["a", "b"], "left_anti"), f"across{number}")
            more = table(verify(across, nodes, texts), f"more{number}")
            links, tested = links.unionByName(more), across
        parts = components(links)
        ids = copies.join(parts.select(F.col("node").alias("z"), "component"), "z", "left")
        ids = ids.select(F.col("x").alias("_id"), F.col("y").alias("_th"), F.col("w").alias("n_shingles"), "rows", F.when(F.col("w") > 0, F.coalesce("component", "z")).alias("_c"))
        ids = table(ids, "ids")
        least = ids.where("_c is not null").groupBy("_c").agg(F.min("_id").alias("component"))
        return checkpoint(ids.join(least, "_c", "left").select("_id", "_th", "n_shingles", F.coalesce("component", "_id").alias("component"), F.col("_c").alias("group"), "rows"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    found = found.withColumn("_r", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return found.select(null("_id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), null("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each group of linked ones, its smallest doc_id, and one of each row that repeats.

    Documents without a shingle are linked with nothing and all stay.  Only documents of groups and repeated rows go through
    an exchange; all others pass by.
    """
    found = checkpoint(classes(docs).where("n_shingles > 0"))
    first = found.groupBy("group").agg(F.min(F.struct("_id", "_th")).alias("f")).select("f._id", "f._th", F.lit(True).alias("first"))
    marked = checkpoint(found.join(first, ["_id", "_th"], "left").where("rows > 1 OR first IS NULL").select("_id", "_th", F.lit(True).alias("listed"), "first"))
    touched, rest = split(rows_with_key(docs), marked)
    touched = touched.join(marked, ["_id", "_th"], "left")
    once = touched.where("first").groupBy("_id", "_th").agg(F.first("_row").alias("_row"))
    return rest.select("_row.*").unionByName(touched.where("listed IS NULL").select("_row.*")).unionByName(once.select("_row.*"))
