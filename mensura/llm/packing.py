"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read.  Whole windows of a long document are sequences of their own; what is left
of each document (less than a window) goes to a group of about GROUP documents, chosen by a hash of the row.  In a group,
multiway differencing starts with one partial partition per item and again and again merges the two partials of largest
spread, the largest window of one with the smallest of the other, so that opposing imbalances cancel.  If a window
exceeds the capacity, the window count rises and the differencing runs again; once the count is SLACK above the least
possible one, what exceeds is cut off and put where room is left (documents may be cut freely), so padding stays small.

Defined cases: a null text is empty and has only its end mark; repeated rows are packed each; a null doc_id stays null;
other columns are ignored; an empty table gives no row; a text of any length is tokenised whole.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import resident, tune

GROUP, SLACK = 512, 0.01
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words(dict):
    """Ids of words, found when they are asked for.  What is not used while half of the cache fills is forgotten."""

    #: Words and characters of words in each half.
    LIMIT, CHARS = 150_000, 4 << 20

    def __init__(self, pieces: re.Pattern, encode):
        self.pieces, self.encode, self.old, self.chars = pieces, encode, {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            pieces = [] if word.isalpha() else self.pieces.findall(word)
            ids = b"".join(map(self.__getitem__, pieces)) if len(pieces) > 1 else self.encode(word)
        self[word] = ids
        self.chars += len(word)
        return ids

    def forget(self) -> None:
        if len(self) > self.LIMIT or self.chars > self.CHARS:
            self.old, self.chars = dict(self), 0
            self.clear()


class Encoder:
    """The public tokenizer with a cache of words.

    Its pre-tokens lie between white space and are encoded independently of each other.  So a text made of ASCII and Latin-1 letters
    is split into words, these are cut by an equivalent pattern and encoded by the tokenizer's model, and the text is put together from
    their ids.  Any other text goes to the tokenizer as a whole, and so does every text if its steps are others than these.
    """

    PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    #: The pre-tokenizer's pattern, for the characters of PLAIN.
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    #: The steps that PIECES stands for.
    STEPS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    }
    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("u2" if self.tokenizer.get_vocab_size() <= 65536 else "u4")
        steps = json.loads(self.tokenizer.to_str())
        self.by_words = all(steps[k] == v for k, v in self.STEPS.items()) and all(t["content"].startswith("<|") for t in steps["added_tokens"])
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {x: level.pre_tokenize_str(chr(x))[0][0] for x in range(0xC0, 0x100)}  # as the model writes letters that aren't ASCII
        self.words = Words(self.PIECES, self.word)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, word: str) -> bytes:
        """Ids of a pre-token."""
        return array(self.dtype.char, [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes))]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if not self.by_words or not self.PLAIN.fullmatch(t) or "<|" in t]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        for i, t in enumerate(texts):
            if out[i] is None:
                self.words.forget()
                out[i] = b"".join(map(self.words.__getitem__, t.lower().split()))
        return out


def encoder(name: str) -> Encoder:
    import os

    import public_tokenizers

    return resident(("encoder", name), lambda: Encoder(name if os.sep in name else public_tokenizers.path(name)))


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Items of each of m windows, by the multiway differencing method."""
    n = len(sizes)
    if m <= 1 or n <= m:
        windows = [[i] for i in range(n)] if m > 1 else [list(range(n))]
        return windows + [[] for _ in range(m - len(windows))]
    # A partial is its sums in descending order without the zeros at the end, and for each of them the items.
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {i: np.array([s], np.int64) for i, s in enumerate(sizes)}
    items: dict[int, list] = {i: [i] for i in range(n)}  # nested pairs, opened at the end
    for new in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y, p, q = sums.pop(a), sums.pop(b), items.pop(a), items.pop(b)
        over = len(x) + len(y) - m
        if over <= 0:
            s, t = np.concatenate([x, y]), p + q
        else:  # x's smallest meet y's largest: positions m-len(y) .. len(x)-1 of x take those of y from its end
            at, k = m - len(y), len(y)
            s = np.concatenate([x, np.zeros(m - len(x), np.int64)])
            s[at:] += y[::-1]
            t = p + [None] * (m - len(x))
            for j in range(k):
                own, other = t[at + j], q[k - 1 - j]
                t[at + j] = other if own is None else (own, other)
        order = np.argsort(-s, kind="stable")
        sums[new], items[new] = s[order], [t[i] for i in order]
        spread = int(s.max()) - (int(s.min()) if len(s) == m else 0)
        heapq.heappush(heap, (-spread, new))
    (root,) = items.values()
    windows = []
    for tree in root:
        stack, own = [tree], []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                own.append(x)
        windows.append(own)
    return windows + [[] for _ in range(m - len(windows))]


def windows_of(sizes: list[int], capacity: int, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """(item, start, length) of each window; no window exceeds the capacity and every token lies in exactly one piece."""
    total = sum(sizes)
    if not total:
        return []
    least = m = max(1, math.ceil(total / capacity))
    most = math.ceil(least * (1 + slack))
    while True:
        found = differencing(sizes, m)
        loads = [sum(sizes[i] for i in w) for w in found]
        if max(loads) <= capacity or m >= most:
            break
        m += max(1, (most - m) // 2)
    out, spare = [], []
    for own, load in zip(found, loads, strict=True):
        pieces = [(i, 0, sizes[i]) for i in sorted(own, key=lambda i: (-sizes[i], i))]
        while load > capacity:  # the tail of the last piece goes elsewhere
            i, s, n = pieces.pop()
            cut = min(n, load - capacity)
            if cut < n:
                pieces.append((i, s, n - cut))
            spare.append((i, s + n - cut, cut))
            load -= cut
        out.append((pieces, capacity - load))
    spare.sort(key=lambda p: -p[2])
    done = []
    for pieces, room in sorted(out, key=lambda w: w[1]):
        while room and spare:
            i, s, n = spare.pop()
            take = min(n, room)
            pieces.append((i, s, take))
            room -= take
            if take < n:
                spare.append((i, s + take, n - take))
        done.append(pieces)
    return [w for w in done if w]


def _tokens(batches, name: str, end: int, capacity: int, groups: int):
    import pyarrow as pa

    from mensura.llm.common import mix

    enc = encoder(name)
    size = enc.dtype.itemsize
    tail = np.array([end], enc.dtype).tobytes()
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows: list = []
        seen: dict = {}
        for doc, text, ids in zip(batch.column(0).to_pylist(), texts, enc(texts), strict=True):
            ids += tail
            n = len(ids) // size
            key = (doc or 0, zlib.crc32(ids))
            seen[key] = again = seen.get(key, -1) + 1
            group = int(mix(np.array([(key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xD1B54A32D192ED03 + again) % 2**64], np.uint64))[0] % np.uint64(groups))
            full = n // capacity * capacity
            for s in range(0, full, capacity):
                rows.append((group, doc, s, n, zlib.crc32(np.frombuffer(ids, enc.dtype, capacity, s * size).astype("<u4").tobytes()), None))
            if full < n:
                rows.append((group, doc, full, n, None, ids[full * size :]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["grp", "doc_id", "start", "doc_tokens", "crc", "ids"])


def _pack(table, dtype: str, capacity: int, with_ids: bool):
    import pyarrow as pa

    dtype = np.dtype(dtype)
    grp, docs, starts, totals, crcs, ids = (c.to_pylist() for c in table.columns)
    base, rows, k = (grp[0] << 31) if grp else 0, [], 0
    for i in range(len(docs)):
        if ids[i] is None:
            rows.append((docs[i], starts[i], capacity, crcs[i], totals[i], base + k, 0, None))
            k += 1
    rest = [i for i in range(len(docs)) if ids[i] is not None]
    rest.sort(key=lambda i: (-len(ids[i]), docs[i] is None, docs[i] or 0, ids[i]))
    arrays = [np.frombuffer(ids[i], dtype) for i in rest]
    for pieces in windows_of([len(a) for a in arrays], capacity):
        at = 0
        for item, s, n in pieces:
            i, own = rest[item], arrays[item][s : s + n].astype("<u4").tobytes()
            rows.append((docs[i], starts[i] + s, n, zlib.crc32(own), totals[i], base + k, at, own if with_ids else None))
            at += n
        k += 1
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
    if with_ids:
        return pa.Table.from_arrays([*arrays, pa.array(cols[7], pa.binary())], [*names, "ids"])
    return pa.Table.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 2, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    One exchange, of what is left of each document.  A group's size doesn't depend on the input's: the number of groups does.
    """
    tune(docs.sparkSession)
    groups = max(1, math.ceil(docs.count() / GROUP))
    dtype = encoder(tokenizer).dtype.str
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda it: _tokens(it, tokenizer, end, capacity, groups), "grp int, doc_id long, start long, doc_tokens long, crc long, ids binary"
    )
    # A task has about 64 groups, so that the result isn't many small files.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(groups / 64))
    return rows.repartition(parts, "grp").groupBy("grp").applyInArrow(lambda t: _pack(t, dtype, capacity, False), SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
