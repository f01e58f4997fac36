"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels the spans.

The model: hashed character n-grams (1 to 4, with word edges) of the words of labelled texts, counted per language.  It is
fitted on at most TRAIN_DOCS documents of each language, drawn by a hash of doc_id; all other documents are only read by
the prediction.  A word's score for a language is the mean log probability of its n-grams, scaled by the root of their
number.  Languages that don't use the word's script (less than SCRIPT_SHARE of their training letters) are no candidates.
Viterbi finds the labelling of all words of a text that is best after SWITCH is paid for each change of language.

The best single language is proved best without the full recursion where no run of words gains SWITCH by leaving it;
only the other texts run the recursion.  Both give the same labels.

Defined cases: a text that is null or without a letter gets ``und`` and score 0; with no training row every text does;
ties go to the language first by name; repeated rows are judged each; a null doc_id is not held out and trains nothing;
texts are judged whole, in pieces of the same recursion, and other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import mix, resident, tune

TRAIN_DOCS, BUCKETS, ORDER, SWITCH, SCRIPT_SHARE, UND = 3000, 1 << 15, 4, 8.0, 0.02, "und"
#: Letters and numerals (as in fractions or Roman ones), which count as word characters but are neither letters, digits nor underscores.
WORD = re.compile(r"[^\W\d_]+")
#: Code-point ranges of scripts.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Index into SCRIPTS of each code point, len(SCRIPTS) where none fits."""
    at = np.searchsorted(np.array([low for _, low, _ in SCRIPTS]), points, "right") - 1
    highs = np.array([high for _, _, high in SCRIPTS])
    return np.where((at >= 0) & (points <= highs[np.maximum(at, 0)]), at, len(SCRIPTS))


def words_at(text: str | None) -> tuple[list[str], list[int]]:
    """The words of a text in lower case, runs of letters, and where each starts."""
    found = list(WORD.finditer((text or "").lower()))
    words, starts = [m.group() for m in found], [m.start() for m in found]
    if all(map(str.isalpha, words)):
        return words, starts
    whole, words, starts = zip(words, starts, strict=True), [], []
    for run, at in whole:  # rare: numerals cut a run
        for letters, own in itertools.groupby(enumerate(run), lambda x: x[1].isalpha()):
            own = list(own)
            if letters:
                words.append("".join(c for _, c in own))
                starts.append(at + own[0][0])
    return words, starts


def words_of(text: str | None) -> list[str]:
    words = WORD.findall((text or "").lower())
    return words if "".join(words).isalpha() or not words else words_at(text)[0]


NAMES = [*(name for name, _, _ in SCRIPTS), "other"]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and bucket of each n-gram of the words, with their edges; code point of each word's first letter."""
    points = np.frombuffer(f"\x02{'\x03\x02'.join(words)}\x03".encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.cumsum(points == 2) - 1
    x, ids, hashes = points.astype(np.uint64), [], []
    h = np.zeros(len(x), np.uint64)
    for n in range(ORDER):
        h = h[: len(x) - n] * np.uint64(0x9E3779B97F4A7C15) + x[n:] + np.uint64(1)
        same = own[: len(x) - n] == own[n:]
        ids.append(own[: len(x) - n][same])
        hashes.append(mix(h[same] + np.uint64(n)) & np.uint64(BUCKETS - 1))
    return np.concatenate(ids), np.concatenate(hashes).astype(np.int64), points[np.flatnonzero(points == 2) + 1]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Log probabilities by language and bucket, and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: list[Counter]):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.log((counts + 0.05) / (total + 0.05 * BUCKETS)).astype(np.float64).T.copy() if langs else np.zeros((BUCKETS, 0))
        self.scripts = {}
        for name in {n for c in letters for n in c}:
            self.scripts[name] = np.array([c[name] > SCRIPT_SHARE * sum(c.values()) for c in letters], bool)

    def scores(self, words: list[str]) -> np.ndarray:
        """Words x languages; 0 for the best."""
        ids, buckets, first = ngrams(words)
        n = np.bincount(ids, minlength=len(words))
        s = np.stack([np.bincount(ids, self.logp[buckets, k], len(words)) for k in range(len(self.langs))], axis=1) / np.sqrt(n)[:, None]
        at = scripts_of(first)
        for k in np.unique(at).tolist():
            own = self.scripts.get(NAMES[k])
            if own is not None and own.any() and not own.all():
                rows = np.flatnonzero(at == k)
                s[np.ix_(rows, np.flatnonzero(~own))] = s[rows].min(axis=1, keepdims=True) - SWITCH
        return s - s.max(axis=1, keepdims=True)


def _count(batches):
    import pyarrow as pa

    counts: dict[str, np.ndarray] = {}
    letters: dict[str, Counter] = {}
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in words.items():
            if not c:
                continue
            ids, buckets, first = ngrams(list(c))
            n = np.fromiter(c.values(), np.float64, len(c))
            counts[lang] = counts.get(lang, 0) + np.bincount(buckets, n[ids], BUCKETS)
            for k, m in enumerate(np.bincount(scripts_of(first), n * np.fromiter(map(len, c), np.int64, len(c)), len(NAMES)).tolist()):
                letters.setdefault(lang, Counter())[NAMES[k]] += int(m)
    langs = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array([counts[x].tobytes() for x in langs], pa.binary()), pa.array([";".join(f"{k}:{v}" for k, v in letters.get(x, {}).items()) for x in langs], pa.string())],
        ["lang", "counts", "letters"],
    )


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """docs: text and lang of the documents to learn from (and doc_id, by which the bounded sample is drawn)."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null and doc_id is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    share = F.coalesce(_share(sizes, per_language), F.lit(0.0))
    sample = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)) < share)
    found = sample.select("lang", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(_count, "lang string, counts binary, letters string").collect() if sizes else []
    langs = sorted({r[0] for r in found})
    counts, letters = np.zeros((len(langs), BUCKETS)), [Counter() for _ in langs]
    for lang, c, own in found:
        counts[langs.index(lang)] += np.frombuffer(c)
        for x in filter(None, own.split(";")):
            k, _, v = x.rpartition(":")
            letters[langs.index(lang)][k] += int(v)
    return Model(langs, counts, letters)


def _share(sizes: dict[str, int], most: int) -> Column:
    out = F.lit(None).cast("double")
    for k, n in sorted(sizes.items()):
        out = F.when(F.col("lang") == k, min(1.0, most / n)).otherwise(out)
    return out


def viterbi(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of the words of several texts: text i has the rows starts[i] .. starts[i] + sizes[i] of s.

    A step works on one word of every text that still has one; ties stay, else go to the first language.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    own = np.arange(s.shape[1], dtype=np.int8)
    back, out = np.zeros(s.shape, np.int8), np.zeros(len(s), np.int64)
    best = s[starts].copy()
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right").tolist()  # texts with at least t + 1 words
    for t in range(1, int(sizes[0])):
        n = active[t]
        at, b = starts[:n] + t, best[:n]
        top = b.argmax(axis=1)
        leave = (b[np.arange(n), top] - switch)[:, None]
        stay = b >= leave
        back[at] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, b, leave) + s[at]
    now = best.argmax(axis=1)
    out[starts + sizes - 1] = now
    for t in range(int(sizes[0]) - 1, 0, -1):
        n = active[t]
        at = starts[:n] + t
        now[:n] = back[at, now[:n]]
        out[at - 1] = now[:n]
    return out


def label(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """As viterbi(), without the recursion for texts whose best single language is proved best.  Every text has a word."""
    out, todo = np.zeros(len(s), np.int64), []
    if s.shape[1] == 1:
        return out
    two = np.partition(s, -2, axis=1)[:, -2]
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        own = s[a : a + n]
        top = int(own.sum(axis=0).argmax())
        mine = own[:, top]
        gain = np.cumsum(np.where(mine < 0, 0.0, two[a : a + n]) - mine)  # the best other language has 0 or the second score
        if (gain - np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))).max() < switch:
            out[a : a + n] = top
        else:
            todo.append(i)
    if todo:
        found = viterbi(s, starts[todo], sizes[todo], switch)
        for i in todo:
            out[starts[i] : starts[i] + sizes[i]] = found[starts[i] : starts[i] + sizes[i]]
    return out


class Labeller:
    """Scores of words, kept while there is room."""

    LIMIT = 300_000

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        get = self.rows.get
        at = [get(w, -1) for w in words]
        if -1 in at:
            if len(self.rows) > self.LIMIT:
                self.rows.clear()
            new = list(dict.fromkeys(w for w in words if w not in self.rows))
            while len(self.table) < len(self.rows) + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            k = len(self.rows)
            self.table[k : k + len(new)] = self.model.scores(new)
            self.rows.update(zip(new, range(k, k + len(new)), strict=True))
            at = [self.rows[w] for w in words]
        return self.table[at]

    def spans(self, texts: list[str | None], switch: float = SWITCH):
        """(number of words of each text, labels of all words, their scores)."""
        sizes, parts, words = [], [], []
        for t in texts:
            own = words_of(t) if self.model.langs else []
            sizes.append(len(own))
            words += own
            if len(words) > 50_000:
                parts.append(self.score(words))
                words = []
        if words:
            parts.append(self.score(words))
        sizes = np.array(sizes, np.int64)
        s = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, len(self.model.langs)))
        full = np.flatnonzero(sizes)
        starts = np.cumsum(sizes) - sizes
        return sizes, label(s, starts[full], sizes[full], switch) if len(full) else np.zeros(0, np.int64), s

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of most words, and its share of them times how surely it beats the next one."""
        sizes, labels, s = self.spans(texts)
        out, at, k = [], 0, len(self.model.langs)
        for n in sizes.tolist():
            if not n:
                out.append((UND, 0.0))
                continue
            own, votes = s[at : at + n], np.bincount(labels[at : at + n], minlength=k)
            top = int(votes.argmax())
            if votes[top] < n:
                own = own[labels[at : at + n] == top]
            mean = own.mean(axis=0)
            margin = mean[top] - max((x for i, x in enumerate(mean.tolist()) if i != top), default=-10.0)
            out.append((self.model.langs[top], float(votes[top] / n / (1 + np.exp(-margin * min(len(own), 20))))))
            at += n
        return out


def _predict(batches, blob: bytes):
    import pickle

    import pyarrow as pa

    labeller = resident(("labeller", len(blob), zlib.crc32(blob)), lambda: Labeller(pickle.loads(blob)))
    for batch in batches:
        at = batch.schema.get_field_index("text")
        found = labeller.predict(batch.column(at).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            [*batch.schema.names, "lang_pred", "score"],
        )


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (column text) with lang_pred and score, which take the place of columns so named.

    The model travels as a broadcast of BUCKETS rows for each language.
    """
    import pickle

    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = docs.select(*[F.col(f"`{c}`").cast("string") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(lambda it: _predict(it, shared.value), schema)


SPANS = "array<struct<start:int,end:int,lang:string>>"


def _spans(batches, blob: bytes):
    import pickle

    import pyarrow as pa

    labeller = resident(("labeller", len(blob), zlib.crc32(blob)), lambda: Labeller(pickle.loads(blob)))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        sizes, labels, _ = labeller.spans(texts)
        rows, at = [], 0
        for text, n in zip(texts, sizes.tolist(), strict=True):
            own, spans = labels[at : at + n].tolist(), []
            at += n
            for k, word, start in zip(own, *words_at(text), strict=False):
                lang = labeller.model.langs[k]
                if spans and spans[-1]["lang"] == lang:
                    spans[-1]["end"] = start + len(word)
                else:
                    spans.append({"start": start, "end": start + len(word), "lang": lang})
            rows.append(spans)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "spans"])


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with spans: the runs of words of one language, as code points of the lower-cased text, in order.

    A text without a letter has none.  spans takes the place of a column so named.
    """
    import pickle

    from pyspark.sql.types import StructType, _parse_datatype_string

    docs = docs.select(*[F.col(f"`{c}`").cast("string") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "spans"])
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = StructType([*docs.schema.fields]).add("spans", _parse_datatype_string(SPANS))
    return docs.mapInArrow(lambda it: _spans(it, shared.value), schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
