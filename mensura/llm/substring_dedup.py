"""Exact removal of repeated substrings by common-prefix intervals of an enhanced suffix array.

A suffix array of a whole corpus fits no machine, and only its intervals with a common prefix of LENGTH bytes matter.  So
it is built in parts that hold whole intervals.  Of all KGRAM-byte strings in a window of LENGTH bytes, the one with the
least hash is the window's anchor: equal windows have equal anchors at equal places, so all suffixes of an interval have the
same anchor and meet in one part.

1. Every anchor of a text, with a hash of its surroundings (up to LENGTH - KGRAM bytes on either side), goes to the part of
   its hash.  Anchors with equal surroundings are one: all but the earliest are repeated as far as they reach.  This also
   happens in each batch before the exchange, so copies and shared passages leave it once.
2. Where an anchor has different surroundings, these are fetched from the texts.  They are sorted by what follows the
   anchor; common prefixes of neighbours make up the interval tree, found by a scan with a stack.  In an interval, what
   stands left of the anchor tells which members repeat each other: members with the same left extension of n bytes and a
   common prefix of LENGTH - n after the anchor's start share a window, and all but the earliest give theirs up.
3. The spans of each document are united, and its remaining bytes hashed.

Order is by doc_id, then text hash, then place.

Defined cases: a null text is empty; a null doc_id comes last and is given back as null; rows with equal doc_id and text
are one document and get the same result; a doc_id with two texts is two documents; texts below LENGTH bytes keep all;
texts of any length are read whole; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import NO_ID, Tables, chunks, mix, possible, powers, text_buffers, tune

LENGTH, KGRAM = 100, 40
SIDE = LENGTH - KGRAM
U = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, n), powers(_INVERSE, n)


def _slide(v: np.ndarray, width: int, f) -> np.ndarray:
    """f over v[i : i + width] for each i that has so many."""
    out, done = v, 1
    while 2 * done <= width:
        out = f(out[:-done], out[done:])
        done *= 2
    return f(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(text, place, hash, hash of the surroundings, bytes left, bytes right of the anchor) of all anchors of the texts."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    up, down = _powers(1 << max(n.bit_length(), 20))
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    v = mix((total[KGRAM:] - total[:-KGRAM]) * down[: n - KGRAM + 1])
    v |= U(1)  # 0 stands for no window
    least = _slide(v, SIDE + 1, np.minimum)  # of the windows that start at 0 .. n - LENGTH
    sizes = np.diff(offsets)
    own = np.repeat(np.arange(len(sizes)), sizes)
    least[own[: n - LENGTH + 1] != own[LENGTH - 1 :]] = 0
    wide = np.zeros(n - KGRAM + 1 + SIDE, np.uint64)
    wide[SIDE : SIDE + len(least)] = least
    at = np.flatnonzero(_slide(wide, SIDE + 1, np.maximum) == v)
    text = own[at]
    left = np.minimum(at - offsets[text], SIDE)
    right = np.minimum(offsets[text + 1] - at - KGRAM, SIDE)
    s, e = at - left, at + KGRAM + right
    around = mix((total[e] - total[s]) * down[s] + (left * 64 + right).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return text, at - offsets[text], v[at], around, left, right


#: Blobs.  kind 0: hash, surroundings, document, place, left, right.  kind 1: spans (document, start, end).  kind 2: open anchors (document, hash, place).
FIELDS = "kind int, bucket int, ids binary, ths binary, doc binary, a binary, b binary, c binary, d binary"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def _blobs(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
    return [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]]


def _dealt(kind: int, to: np.ndarray, ids, ths, doc: np.ndarray, *values) -> list[tuple]:
    """Rows of one kind: doc counts into ids and ths, which each row repeats as far as it needs them."""
    rows = []
    order = np.argsort(to, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(to[order]) != 0)) if len(order) else []
    for s, e in zip(start, np.append(start[1:], len(order)), strict=True) if len(order) else ():
        m = order[s:e]
        used, inner = np.unique(doc[m], return_inverse=True)
        rows.append((kind, int(to[m[0]]), ids[used].tobytes(), ths[used].tobytes(), inner.astype(np.int32).tobytes(), *[x[m].tobytes() for x in values], *[b""] * (4 - len(values))))
    return rows


def _doc_bucket(ids: np.ndarray, ths: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) * U(0x9E3779B97F4A7C15) ^ ths.view(np.uint64)) % U(buckets)).astype(np.int64)


def _opened(cols: dict, at: list[int], types):
    """ids, ths and the values of several blob rows, one entry for each value."""
    ids, ths, out = [], [], [[] for _ in types]
    for i in at:
        doc = np.frombuffer(cols["doc"][i], np.int32)
        ids.append(np.frombuffer(cols["ids"][i], np.int64)[doc])
        ths.append(np.frombuffer(cols["ths"][i], np.int64)[doc])
        for k, (n, t) in enumerate(zip("abcd", types, strict=False)):
            out[k].append(np.frombuffer(cols[n][i], t))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(ids, np.int64), join(ths, np.int64), *[join(x, t) for x, t in zip(out, types, strict=True)]


def _map(batches, buckets: int):
    import pyarrow as pa

    for batch in batches:
        ids, ths = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
        if len(once := np.unique(np.stack([ids, ths]), axis=1, return_index=True)[1]) < len(ids):  # a row that repeats is one document
            batch = batch.take(pa.array(np.sort(once)))
            ids, ths = ids[np.sort(once)], ths[np.sort(once)]
        data, offsets = text_buffers(batch.column(2))
        rows = []
        for i, j in chunks(offsets, 1 << 20):
            text, place, h, around, left, right = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            text = text + i
            order = np.lexsort((place, ths[text], ids[text], around, h))
            same = np.zeros(len(order), bool)
            same[1:] = (h[order[1:]] == h[order[:-1]]) & (around[order[1:]] == around[order[:-1]])
            again, keep = order[same], order[~same]
            keep = keep[np.lexsort((place[keep], text[keep]))]
            sides = (left * 64 + right).astype(np.uint16)
            rows += _dealt(0, ((h[keep] >> U(20)) % U(buckets)).astype(np.int64), ids, ths, text[keep], h[keep], around[keep], place[keep].astype(np.int32), sides[keep])
            t = text[again]
            rows += _dealt(1, _doc_bucket(ids[t], ths[t], buckets), ids, ths, t, (place[again] - left[again]).astype(np.int64), (place[again] + KGRAM + right[again]).astype(np.int64))
        yield pa.RecordBatch.from_arrays(_blobs(rows), NAMES)


def _indexed(ids: np.ndarray, ths: np.ndarray):
    """Different documents and which of them each entry has."""
    order = np.lexsort((ths, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (ths[order[1:]] != ths[order[:-1]])
    doc = np.empty(len(order), np.int64)
    doc[order] = np.cumsum(new) - 1
    return ids[order[new]], ths[order[new]], doc


def _spans_of(ids, ths, start, end, buckets: int) -> list[tuple]:
    if not len(ids):
        return []
    one, two, doc = _indexed(ids, ths)
    return _dealt(1, _doc_bucket(ids, ths, buckets), one, two, doc, start.astype(np.int64), end.astype(np.int64))


def _meet(table, buckets: int):
    """Of anchors with equal surroundings, all but the earliest are repeated; anchors with different ones stay open."""
    import pyarrow as pa

    cols = {n: table.column(n).to_pylist() for n in NAMES}
    passed = [tuple(cols[n][i] for n in NAMES) for i, k in enumerate(cols["kind"]) if k == 1]
    ids, ths, h, around, place, sides = _opened(cols, [i for i, k in enumerate(cols["kind"]) if k == 0], (np.uint64, np.uint64, np.int32, np.uint16))
    del cols
    order = np.lexsort((place, ths, ids, around, h))
    if len(order):  # the same place twice comes from a row that repeats
        x = np.stack([h.view(np.int64), around.view(np.int64), ids, ths, place.astype(np.int64)])[:, order]
        order = order[np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0))]
    h, around, ids, ths, place, sides = h[order], around[order], ids[order], ths[order], place[order].astype(np.int64), sides[order].astype(np.int64)
    same_h = np.zeros(len(h), bool)
    same_h[1:] = h[1:] == h[:-1]
    same = same_h.copy()
    same[1:] &= around[1:] == around[:-1]
    rows = _spans_of(ids[same], ths[same], place[same] - (sides[same] >> 6), place[same] + KGRAM + (sides[same] & 63), buckets)
    group = np.cumsum(~same_h) - 1
    kinds = np.bincount(group, weights=~same) if len(h) else np.zeros(0)
    open_ = ~same & (kinds[group] > 1) if len(h) else same
    if open_.any():
        one, two, doc = _indexed(ids[open_], ths[open_])
        rows += _dealt(2, _doc_bucket(ids[open_], ths[open_], buckets), one, two, doc, h[open_], place[open_])
    return pa.Table.from_arrays(_blobs(passed + rows), NAMES)


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


DOCS = "_id long, _th long, starts binary, ends binary, hashes binary, places binary"


def _by_doc(table):
    """One row for each document that has spans or open anchors."""
    import pyarrow as pa

    cols = {n: table.column(n).to_pylist() for n in NAMES}
    i1, t1, s, e = _opened(cols, [i for i, k in enumerate(cols["kind"]) if k == 1], (np.int64, np.int64))
    i2, t2, h, p = _opened(cols, [i for i, k in enumerate(cols["kind"]) if k == 2], (np.uint64, np.int64))
    ids, ths, doc = _indexed(np.concatenate([i1, i2]), np.concatenate([t1, t2]))
    d1, d2 = doc[: len(i1)], doc[len(i1) :]
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    n1, n2 = np.searchsorted(d1[o1], np.arange(len(ids) + 1)), np.searchsorted(d2[o2], np.arange(len(ids) + 1))
    s, e, h, p = s[o1], e[o1], h[o2], p[o2]
    cols = [[], [], [], []]
    for k in range(len(ids)):
        a, b = n1[k], n1[k + 1]
        x, y = _union(s[a:b], e[a:b]) if b > a else (s[:0], e[:0])
        for c, v in zip(cols, (x, y, h[n2[k] : n2[k + 1]], p[n2[k] : n2[k + 1]]), strict=True):
            c.append(v.tobytes())
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], ["_id", "_th", "starts", "ends", "hashes", "places"])


def _fetch(batches, buckets: int):
    """Surroundings of open anchors, LENGTH + SIDE bytes each with the anchor at SIDE, by the part of their hash."""
    import pyarrow as pa

    for batch in batches:
        ids, ths = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
        data, offsets = text_buffers(batch.column(2))
        hashes, places = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        doc, h, p = [], [], []
        for i, (x, y) in enumerate(zip(hashes, places, strict=True)):
            h.append(np.frombuffer(x, np.uint64))
            p.append(np.frombuffer(y, np.int64))
            doc.append(np.full(len(p[-1]), i))
        doc, h, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, h, p))
        rows = []
        for k in range(0, len(doc), 50_000):
            d, q, g = doc[k : k + 50_000], p[k : k + 50_000], h[k : k + 50_000]
            left = np.minimum(q, SIDE)
            right = np.minimum(offsets[d + 1] - offsets[d] - q - KGRAM, SIDE)
            col = np.arange(-SIDE, LENGTH)
            at = (offsets[d] + q)[:, None] + col
            inside = (col >= -left[:, None]) & (col < KGRAM + right[:, None])
            text = np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)
            rows += _dealt(0, ((g >> U(20)) % U(buckets)).astype(np.int64), ids, ths, d, g, q, (left * 64 + right).astype(np.uint16), text)
        yield pa.RecordBatch.from_arrays(_blobs(rows), NAMES)


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, depth, parent's depth) of all intervals of two or more suffixes, by a scan with a stack.

    lcp[i] is the common prefix of the sorted suffixes i - 1 and i; -1 where they have nothing in common, as at 0.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []  # depth, first
    values = lcp.tolist() + [-1]
    for i in range(1, len(values)):
        x, first = values[i], i - 1
        while stack and stack[-1][0] > x:
            depth, first = stack.pop()
            out.append((first, i - 1, depth, max(x, stack[-1][0] if stack else -1)))
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True))


def repeats(h, ids, ths, place, left, right, text):
    """Yields (members, n, class, is_first): for each left extension n, the members of common-prefix intervals that share a
    window starting n bytes left of their anchor with an other one; equal classes share it, the earliest comes first."""
    after = np.zeros((len(h), 64), np.uint8)
    after[:, :SIDE] = text[:, LENGTH:]
    words = after.view(">u8")
    order = np.lexsort((right, *[words[:, k] for k in range(7, -1, -1)], h))
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((place, ths, ids))] = np.arange(len(h))
    after, hs, r, lft = after[order, :SIDE], h[order], right[order], left[order]
    differ = after[1:] != after[:-1]
    lcp = np.full(len(h), -1, np.int64)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(r[1:], r[:-1]))
    lcp[1:][hs[1:] != hs[:-1]] = -1
    first, last, depth, parent = lcp_intervals(lcp)
    lh = np.zeros(len(h), np.uint64)
    rows = np.arange(len(h))
    for n in range(SIDE + 1):
        need = SIDE - n
        if n:
            lh = lh * U(_BASE) + text[order, SIDE - n].astype(np.uint64) + U(1)
        alive = (parent < need) & (need <= depth)
        a, size = first[alive], last[alive] - first[alive] + 1
        if not len(a):
            continue
        m = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        node = np.repeat(a, size)
        ok = (lft[m] >= n) & (r[m] >= need)
        m, node = m[ok], node[ok]
        by = np.lexsort((rank[order[m]], lh[m], node))
        m, node = m[by], node[by]
        new = np.ones(len(m), bool)
        new[1:] = (node[1:] != node[:-1]) | (lh[m[1:]] != lh[m[:-1]])
        yield order[rows[m]], n, np.cumsum(new) - 1, new


def _kernel(table, buckets: int):
    import pyarrow as pa

    cols = {n: table.column(n).to_pylist() for n in NAMES}
    ids, ths, h, place, sides, text = _opened(cols, list(range(table.num_rows)), (np.uint64, np.int64, np.uint16, np.uint8))
    text = text.reshape(-1, LENGTH + SIDE)
    out: list = [[], [], [], []]
    if len(h):
        for m, n, _, new in repeats(h, ids, ths, place, (sides >> 6).astype(np.int64), (sides & 63).astype(np.int64), text):
            m = m[~new]
            for c, v in zip(out, (ids[m], ths[m], place[m] - n, place[m] - n + LENGTH), strict=True):
                c.append(v)
    out = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.Table.from_arrays(_blobs(_spans_of(*out, buckets)), NAMES)


def _finish(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0)
        rows: list = [[], [], [], []]
        for text, s, e in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            text = (text or "").encode()
            n, removed, spans = len(text), 0, 0
            if s:
                a, b = np.frombuffer(s, np.int64), np.frombuffer(e, np.int64)
                removed, spans = int((b - a).sum()), len(a)
                cuts = zip([0, *b.tolist()], [*a.tolist(), n], strict=True)
                text = b"".join(text[x:y] for x, y in cuts)
            for c, v in zip(rows, (n, removed, spans, hashlib.sha256(text).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in rows[:3]], pa.array(rows[3], pa.string())], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text"))


def repeated_spans(docs: DataFrame, table: Tables) -> DataFrame:
    """(_id, _th, starts, ends): for each document that has any, the united byte spans that also start earlier."""
    tune(docs.sparkSession)
    texts = keyed(docs)
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, int(volume * 5e-8))
    parts = texts.mapInArrow(lambda it: _map(it, buckets), FIELDS)
    # Spans that a batch has found go with the anchors of the part of their document's number, and pass through.
    met = parts.groupBy("bucket").applyInArrow(lambda t: _meet(t, buckets), FIELDS)
    by_doc = table(met.groupBy("bucket").applyInArrow(_by_doc, DOCS), "by_doc")
    open_ = by_doc.where("octet_length(hashes) > 0").select("_id", "_th", "hashes", "places")
    fetched = possible(texts, open_).dropDuplicates(["_id", "_th"]).join(open_, ["_id", "_th"]).select("_id", "_th", "text", "hashes", "places")
    more = fetched.mapInArrow(lambda it: _fetch(it, buckets), FIELDS).groupBy("bucket").applyInArrow(lambda t: _kernel(t, buckets), FIELDS)
    more = more.groupBy("bucket").applyInArrow(_by_doc, DOCS)
    both = by_doc.where("octet_length(starts) > 0").select("_id", "_th", "starts", "ends").unionByName(more.select("_id", "_th", "starts", "ends"))
    lists = both.groupBy("_id", "_th").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))

    def unite(batches):
        import pyarrow as pa

        for batch in batches:
            s, e = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = _union(np.frombuffer(b"".join(x), np.int64), np.frombuffer(b"".join(y), np.int64))
                s.append(a.tobytes())
                e.append(b.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.binary()), pa.array(e, pa.binary())], ["_id", "_th", "starts", "ends"])

    return table(lists.mapInArrow(unite, "_id long, _th long, starts binary, ends binary"), "spans")


def dedup(docs: DataFrame) -> DataFrame:
    """_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    from mensura.llm.common import checkpoint

    fields = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    with Tables(docs.sparkSession) as table:
        spans = repeated_spans(docs, table)
        texts = keyed(docs)
        joined = texts.join(spans, ["_id", "_th"], "left").select("_id", "text", "starts", "ends")
        return checkpoint(joined.mapInArrow(_finish, fields))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
