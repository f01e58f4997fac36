"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card numbers and phone numbers that patterns find, on three
levels: the value itself, its group (domain, network of 24 bits, issuer's six digits, four leading digits) and its kind.  A
word of a text with an entity discloses it as far as the corpus says so: the share of the entity's information that the word
gives away is pmi(word; entity) / information(entity), where pmi = log(n(word, entity) * N / (n(word) * n(entity))) and
information = -log(n(entity) / N).  All counts are numbers of different texts: n(entity) of those with the entity, n(word) of
those with the word (e-mail addresses are no words), n(word, entity) of those with both, N of all.  Entities and pairs count
from SUPPORT texts.  A word whose share reaches DISCLOSURE is removed wherever it stands in a text with the entity.  From
GENERALISE to DISCLOSURE it is generalised to the class of all words with its first STEM letters, if that class, measured in
the same way, stays below GENERALISE; else it is removed, too.  An entity that all texts have has no information to give away.

Counts cover all documents.  Pairs and words leave each Python batch already summed; only entities of SUPPORT texts have
pairs.  Texts are exchanged only where they have such an entity or may be copies.  Of the places of words only those leave a
batch whose pair may be a disclosing one, by a bitmap of these.

Defined cases: a null text is empty; repeated rows are treated each; a null doc_id stays null; a text of any length is read
whole; other columns are kept by sanitise(); an empty table gives no row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import NO_ID, bitmap, checkpoint, possible, rows_with_key, split, tune

KINDS = ("email", "ip", "card", "phone")
SUPPORT, GENERALISE, DISCLOSURE, STEM, BITS = 3, 0.6, 0.8, 3, 23
#: The patterns.  An e-mail address is looked for from its @; digits start where no digit stands before.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{2,}")


def emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in AT.finditer(text):
        s = m.start()
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        if s < m.start():
            out.append((s, m.end()))
            last = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted.  Leftmost matches that don't overlap, of each kind; those that fail their test go."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and (not x or int(x) <= 255) for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def entities_of(text: str, s: int, kind: int, e: int) -> list[str]:
    """The value of a base span, its group and its kind."""
    name = KINDS[kind]
    if kind == 0:
        value = text[s:e].lower()
        group = value[value.index("@") :]
    elif kind == 1:
        value = ".".join(p.lstrip("0") or "0" for p in text[s:e].split("."))
        group = value.rpartition(".")[0] + "."
    else:
        value = re.sub(r"[^0-9]", "", text[s:e])
        group = f"{value[: 6 if kind == 2 else 4]}*"
    return [name, f"{name}:{group}", f"{name}:{value}"]


def words(text: str):
    """Matches of the words of a text; base spans are no words, and of these only e-mail addresses have letters."""
    if "@" in text:
        parts, at = [], 0
        for s, e in emails(text):
            parts += [text[at:s], " " * (e - s)]
            at = e
        text = "".join([*parts, text[at:]])
    return WORD.finditer(text)


def stem(word: str) -> str:
    """The class of a word; no word has a star."""
    return f"{word[:STEM]}*"


def with_classes(text: str) -> set[str]:
    own = {m[0].lower() for m in words(text)}
    return own | {stem(w) for w in own}


def _find(batches):
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    for batch in batches:
        spans, entities = [], []
        for text in batch.column(2).to_pylist():
            found = base_spans(text) if text else []
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            entities.append(sorted({n for x in found for n in entities_of(text, *x)}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span), pa.array(entities, pa.list_(pa.string()))], ["_id", "_th", "base", "entities"])


def _count(batches):
    """In how many texts each word is, given out when they are many; the number of texts stands under the empty word."""
    from collections import Counter

    import pyarrow as pa

    out = lambda c: pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["word", "n"])
    total: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total.update(with_classes(text or "") | {""})
            if len(total) > 300_000:
                yield out(total)
                total = Counter()
    yield out(total)


def _pairs(batches):
    """In how many texts each word is together with each of the entities, given out when they are many."""
    from collections import Counter

    import pyarrow as pa

    def out(c):
        cols = list(zip(*c, strict=True)) if c else [[], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(c.values(), pa.int64())], ["entity", "word", "n"])

    total: Counter = Counter()
    for batch in batches:
        for text, entities in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = with_classes(text)
            for n in entities:
                total.update((n, w) for w in own)
                if len(total) > 100_000:
                    yield out(total)
                    total = Counter()
    yield out(total)


def _places(batches, shared):
    """A row for each entity and word of a text that may be a disclosing pair, with all places of the word."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    table, mask = shared.value, (1 << BITS) - 1

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), span)

    def out(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["d", "h", "entity", "word", "at"])

    for batch in batches:
        rows = []
        for d, h, text, entities in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own: dict = {}
            for m in words(text):
                own.setdefault(m[0].lower(), []).append({"start": m.start(), "end": m.end()})
            for n in entities:
                for w, at in own.items():
                    bit = xxh64_intdigest(f"{n}\0{w}".encode(), 42) & mask  # Spark's xxhash64 of that string
                    if table[bit >> 3] >> (bit & 7) & 1:
                        rows.append((d, h, n, w, at))
                    if len(rows) >= 20_000:
                        yield out(rows)
                        rows = []
        yield out(rows)


FOUND = "_id long, _th long, base array<struct<start:long,kind:int,end:long>>, entities array<string>"
TERMS = "array<struct<start:long,end:long,kind:string>>"


def _with_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """keys with the text of each, once."""
    own = possible(texts, keys).groupBy("_id", "_th").agg(F.first("text").alias("text"))
    return own.join(keys, ["_id", "_th"])


def find(docs: DataFrame) -> DataFrame:
    """(_id, _th, rows, base, terms): the spans of each different document, and how many rows have it."""
    tune(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    texts = rows_with_key(docs, text).select("_id", "_th", "text")
    found = texts.mapInArrow(_find, FOUND)
    found = checkpoint(found.groupBy("_id", "_th").agg(F.count("*").alias("rows"), F.first("base").alias("base"), F.first("entities").alias("entities")))
    none = found.select("_id", "_th", "rows", "base", F.array().cast(TERMS).alias("terms"))
    seen = found.select("_id", "_th", F.explode("entities").alias("entity"))
    entities = seen.select("entity", "_th").distinct().groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    entities = checkpoint(entities)
    if entities.isEmpty():
        return none
    holders = checkpoint(seen.join(entities, "entity", "left_semi").groupBy("_id", "_th").agg(F.collect_list("entity").alias("entities")))
    once = holders.groupBy("_th").agg(F.min("_id").alias("_id"), F.first("entities").alias("entities"))
    pairs = _with_texts(texts, once).select("text", "entities").mapInArrow(_pairs, "entity string, word string, n long")
    pairs = checkpoint(pairs.groupBy("entity", "word").agg(F.sum("n").alias("both")).where(F.col("both") >= SUPPORT))
    if pairs.isEmpty():
        return none
    wanted = pairs.select("word").distinct().union(pairs.sparkSession.range(1).select(F.lit("").alias("word")))
    many = found.groupBy("_th").agg(F.sum("rows").alias("n")).where("n > 1")
    copies, alone = split(texts, found.select("_id", "_th").join(many, "_th", "left_semi"))
    different = alone.select("text").unionByName(copies.groupBy("_th").agg(F.first("text").alias("text")).select("text"))
    counted = different.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n_word"))
    counted = checkpoint(counted.join(wanted, "word", "left_semi"))
    n = F.lit(float(counted.where("word = ''").first()["n_word"]))
    share = F.log(F.col("both") * n / (F.col("n_word") * F.col("n_entity"))) / F.log(n / F.col("n_entity"))
    told = pairs.join(entities.where(F.col("n_entity") < n), "entity").join(counted, "word")
    told = checkpoint(told.select("entity", "word", share.alias("share")))
    classes = told.where(F.col("word").endswith("*")).select("entity", F.col("word").alias("class"), F.col("share").alias("class_share"))
    strong = told.where(~F.col("word").endswith("*") & (F.col("share") >= GENERALISE)).withColumn("class", F.concat(F.substring("word", 1, STEM), F.lit("*")))
    kind = F.when((F.col("share") >= DISCLOSURE) | (F.col("class_share") >= GENERALISE), "term").otherwise("general")
    strong = checkpoint(strong.join(classes, ["entity", "class"]).select("entity", "word", kind.alias("kind")))
    listed = holders.select("_id", "_th", F.explode("entities").alias("entity")).join(strong.select("entity").distinct(), "entity", "left_semi")
    listed = checkpoint(listed.groupBy("_id", "_th").agg(F.collect_list("entity").alias("entities")))
    pair = F.xxhash64(F.concat("entity", F.lit("\0"), "word"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(strong.select(F.pmod(pair, F.lit(1 << BITS)).alias("b")), BITS))
    places = _with_texts(texts, listed).select("_id", "_th", "text", "entities").mapInArrow(lambda it: _places(it, shared), "d long, h long, entity string, word string, at array<struct<start:long,end:long>>")
    places = places.join(strong, ["entity", "word"])
    terms = places.select(F.col("d").alias("_id"), F.col("h").alias("_th"), F.inline("at"), "kind").groupBy("_id", "_th", "start", "end").agg(F.max("kind").alias("kind"))  # term is after general
    terms = terms.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("terms"))
    return found.join(terms, ["_id", "_th"], "left").select("_id", "_th", "rows", "base", F.coalesce("terms", F.array().cast(TERMS)).alias("terms"))


def _replace(batches):
    import pyarrow as pa

    names = [f"[{k.upper()}]" for k in KINDS]
    for batch in batches:
        out = []
        for text, base, terms in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            spans = sorted([(b["start"], b["end"], names[b["kind"]]) for b in base or ()] + [(t["start"], t["end"], "" if t["kind"] == "term" else stem(text[t["start"] : t["end"]])) for t in terms or ()])
            parts, at = [], 0
            for s, e, mark in spans:
                if s >= at:
                    parts += [text[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, text[at:]]) if spans else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "_text"])


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of docs with sanitised texts: base spans become [EMAIL] and so on, disclosing words go or become their class, as in Bar*.

    A null text stays null, repeated rows stay, other columns are kept whatever their names; an empty table gives no row.

    Only documents that may have a span go through an exchange.
    """
    from pyspark.sql.types import StringType, StructType

    spans = checkpoint(find(docs).where("size(base) > 0 or size(terms) > 0").select("_id", "_th", "base", "terms"))
    touched, rest = split(rows_with_key(docs), spans)
    text = F.col("_row.text").cast("string").alias("_text")
    joined = touched.join(spans, ["_id", "_th"], "left").select("_row", text, "base", "terms")
    done = joined.mapInArrow(_replace, StructType([joined.schema["_row"]]).add("_text", StringType()))
    both = done.unionByName(rest.select("_row", text))
    return both.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    show = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("order"), show(F.get(names, b["kind"]), b).alias("text")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("order"), show(t["kind"], t).alias("text")))
    join = lambda a: F.array_join(F.transform(F.sort_array(a), lambda x: x["text"]), ",")
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    rows = found.withColumn("_r", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return rows.select(
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"),
        *[count(k) for k in range(len(KINDS))],
        F.sha2(F.array_join(F.transform("base", lambda b: show(F.get(names, b["kind"]), b)), ","), 256).alias("base_sha256"),
        join(F.concat(base, terms)).alias("spans"),
    )
