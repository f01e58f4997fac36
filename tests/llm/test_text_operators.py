"""The text operators against brute force, round trips and held-out accuracy, with the edge cases that they define."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import chat_format, common, language_id, mixing, packing, pii, shingle_join, substring_dedup, url_filter

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, _id string, rows int, node string"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, s, "x", 7, None) for i, t, s in rows], DOCS).repartition(3)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.choice([1, 3, 5, 6, 9, 13, 17, 40, 90, 300]), 4000) for _ in range(40)]
    rows = []
    for i in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w) if rng.random() < 0.7 else " ".join(w).upper() + "\n"))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, rows[3][1]), (203, rows[3][1]), (204, rows[3][1] + " tail"), (None, rows[3][1]), (205, "x" * 50_000), (206, words(rng, 30_000, 9000))]
    return [(i, t, f"s{k % 3}" if k % 7 else None) for k, (i, t) in enumerate(rows)]


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join_is_the_brute_force_join(spark, corpus):
    rows = [(common.NO_ID if i is None else i, t) for i, t, _ in corpus]
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    want = sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))
    found = shingle_join.classes(docs(spark, corpus)).withColumn("r", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    assert sorted((r["_id"], r["n_shingles"], r["component"]) for r in found.collect()) == want
    kept = shingle_join.keep_one(docs(spark, corpus))
    assert kept.columns == ["doc_id", "text", "lang", "source", "_id", "rows", "node"] or set(kept.columns) == {x.split()[0] for x in DOCS.split(", ")}
    assert kept.count() == len({c for _, n, c in want if n}) + sum(not n for _, n, _ in want)


def test_signatures_meet_for_every_linked_pair():
    """No pair at or above the threshold lacks a common signature."""
    rng = np.random.default_rng(3)
    for n in [4, 5, 8, 9, 11, 12, 13, 16, 17, 21, 40, 77, 130, 400, 900] * 6:
        union = common.mix(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(n * 0.2)
        cut = rng.permutation(n)[:drop]
        side = rng.random(drop) < rng.random()
        a, b = np.delete(union, cut[side]), np.delete(union, cut[~side])
        a, b = np.sort(a), np.sort(b)
        who, sig = shingle_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()), n


def test_a_group_hot_in_one_batch_meets_its_few_members_of_another(spark):
    shared = " ".join(f"t{i}" for i in range(17))
    hot = [(i, f"{shared} a{i} b{i} c{i}") for i in range(1, 200)] + [(200, f"{shared} d")]
    first, second = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (hot, [(201, f"{shared} e")]))
    both = first.coalesce(1).unionByName(second)
    assert both.groupBy(F.spark_partition_id()).count().count() == 2
    found = {r["_id"]: r["component"] for r in shingle_join.classes(both).collect()}
    assert found == {i: 200 if i == 201 else i for i in range(1, 202)}  # 200 and 201 share 13 shingles of 15


def naive_dedup(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cover[p : p + 100] = b"\x01" * 100
            seen.add(w)
        runs = len(re.findall(b"\x01+", bytes(cover)))
        out[i] = (len(b), sum(cover), runs, hashlib.sha256(bytes(c for c, v in zip(b, cover) if not v)).hexdigest())
    return out


def test_substring_dedup_is_the_brute_force_one(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ab cé") for _ in range(1500))
    rows = [(i, "".join(base[(a := rng.randint(0, 1400)) : a + rng.randint(1, 180)] + rng.choice("xyz") * rng.choice([0, 1, 3, 130]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a" * 99), (103, "a" * 100), (104, "a" * 5000), (105, base), (106, base), (107, base[7:]), (108, "\x00" * 300), (109, "q" + "\x00" * 250)]
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.dedup(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got == naive_dedup(rows)


def test_substring_dedup_of_repeated_rows(spark):
    text = "z" * 10 + "".join(chr(97 + i % 26) + str(i) for i in range(200))
    got = sorted(tuple(r)[:3] for r in substring_dedup.dedup(docs(spark, [(1, text, None), (1, text, None), (None, text, None)])).collect())
    n = len(text)
    assert got == [(1, n, 0), (1, n, 0), (common.NO_ID, n, n)]


def test_lcp_intervals():
    first, last, depth, parent = substring_dedup.lcp_intervals(np.array([-1, 2, 5, 5, 1, -1, 3]))
    assert {(a, b, d, p) for a, b, d, p in zip(first.tolist(), last.tolist(), depth.tolist(), parent.tolist())} == {(1, 3, 5, 2), (0, 3, 2, 1), (0, 4, 1, -1), (5, 6, 3, -1)}


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive_spans(t):
    out = []
    for k, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@- +(25b") for _ in range(rng.randint(0, 40)))
        assert naive_spans(t) == pii.base_spans(t), t
    assert pii.base_spans("é 4111 1111 1111 1111, +1 (504) 555-0292") == [(2, 2, 21), (23, 3, 40)]
    assert len(pii.base_spans("1" * 9000 + ".1.1.1")) == 0


def test_disclosing_words_go(spark):
    rng = random.Random(2)
    fill = lambda n: words(rng, n, 50).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, f"{fill(20)} Zorbulon ann@mail.example.com {fill(20)}", None) for i in range(6)] + [(i, fill(400), None) for i in range(6, 60)] + [(70, None, None), (71, "", None), (71, "", None)]
    found = {r["_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    for i in range(6):
        text = rows[i][1]
        assert [text[t["start"] : t["end"]] for t in found[i]["terms"] if t["kind"] == "term"] == ["Zorbulon"]
    assert found[71]["rows"] == 2 and not found[70]["base"] and all(not found[i]["terms"] for i in range(6, 60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "[EMAIL]" in clean[0] and "Zorbulon" not in clean[0] and clean[7] == rows[7][1] and clean[70] is None


def letters(n):
    return "".join(chr(97 + int(c)) for c in str(n))


@pytest.mark.parametrize("gap", ["one two three four five six", "| " * 200, "1" * 200, "q" * 200])
def test_disclosing_words_go_wherever_they_stand_in_the_text(spark, gap):
    rows = [(i, f"Zorbulon fill {gap} ann@mail.example.com. Later zorbulon{letters(i)} met ZORBULON", None) for i in range(5)]
    rows += [(i, f"fill one two three four five six later met {gap} text{letters(i)}", None) for i in range(5, 60)] + [(70, "Zorbulon", None)]
    found = {r["_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    for i in range(5):
        assert [rows[i][1][t["start"] : t["end"]] for t in found[i]["terms"] if t["kind"] == "term"] == ["Zorbulon", "ZORBULON"]
    assert all(not found[i]["terms"] for i in (*range(5, 60), 70))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "ZORBULON" not in clean[0] and "[EMAIL]" in clean[0] and clean[70] == "Zorbulon"


def naive_pii(rows):
    """The op2 columns of (doc_id, text) rows, by plain loops over all texts, entities and words."""
    texts = sorted({t or "" for _, t in rows})
    own, having, counts, both = {}, {}, {}, {}
    for t in texts:
        base = naive_spans(t)
        plain = re.sub(KINDS["email"], lambda m: " " * len(m[0]), t)
        own[t] = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{2,}", plain)]
        having[t] = {n for s, k, e in base for n in pii.entities_of(t, s, k, e)}
        w = {x[2] for x in own[t]}
        for x in w | {f"{x[:3]}*" for x in w}:
            counts[x] = counts.get(x, 0) + 1
            for n in having[t]:
                both[n, x] = both.get((n, x), 0) + 1
    entities = {}
    for t in texts:
        for n in having[t]:
            entities[n] = entities.get(n, 0) + 1

    def share(n, x):
        if both.get((n, x), 0) < 3 or entities[n] < 3 or entities[n] == len(texts):
            return 0.0
        return np.log(both[n, x] * len(texts) / (counts[x] * entities[n])) / np.log(len(texts) / entities[n])

    out = []
    for i, t in rows:
        t = t or ""
        base = naive_spans(t)
        spans = [(s, k, f"{list(KINDS)[k]}:{s}:{e}") for s, k, e in base]
        for s, e, w in own[t]:
            kinds = ["term" if share(n, w) >= 0.8 or share(n, f"{w[:3]}*") >= 0.6 else "general" for n in having[t] if share(n, w) >= 0.6]
            if kinds:
                spans.append((s, 4, f"{max(kinds)}:{s}:{e}"))
        listed = ",".join(f"{list(KINDS)[k]}:{s}:{e}" for s, k, e in base)
        out.append((i, *(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), ",".join(x[2] for x in sorted(spans))))
    return out


def test_registered_pii_query_is_the_brute_force_one(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    rows = []
    for i in range(260):
        w = [rng.choice(vocabulary[:100]) for _ in range(rng.randint(0, 30))]
        if i % 9 == 0:
            w.insert(rng.randint(0, len(w)), f"u{rng.randrange(4)}@m{rng.randrange(2)}.example.com")
            w += [rng.choice(vocabulary[100:108])] * rng.randint(0, 2)
        if i % 11 == 0:
            w.insert(rng.randint(0, len(w)), f"10.1.{rng.randrange(2)}.{rng.randrange(3)}")
            w += [rng.choice(vocabulary[106:114]).upper()]
        w += ["Zorbulon"] * (i % 9 < 2) + ["zorro"] * (i % 2)
        rows.append((i, " ".join(w)))
    rows += [(400, None), (401, ""), (401, ""), (None, rows[9][1]), (402, rows[9][1]), (403, rows[18][1] + " +1 (504) 555-0292 4111 1111 1111 1111 " + "x" * 30_000)]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in pii.op2_pii(spark, str(tmp_path)).collect()]
    want = naive_pii(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum("term:" in r[6] for r in want) > 5 and sum("general:" in r[6] for r in want) > 2


def test_a_class_takes_the_place_of_a_word(spark):
    rows = [(i, f"Barcelona fill{letters(i)} ann@mail.example.com", None) for i in range(8)] + [(i, f"Barcelona text{letters(i)}", None) for i in range(8, 12)]
    rows += [(i, f"baron text{letters(i)}", None) for i in range(12, 60)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert clean[0] == "Bar* filla [EMAIL]" and clean[9] == rows[9][1] and clean[30] == rows[30][1]


def test_copies_do_not_hide_what_they_disclose(spark):
    secret = [f"fill Zorbulon ann@mail.example.com {letters(k)}x fill" for k in range(3)]
    rows = [(i, secret[i % 3], None) for i in range(1500)] + [(i, f"fill text {letters(i)}", None) for i in range(2000, 2060)]
    found = {r["_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    for i in (0, 1, 1499):
        assert [rows[i][1][t["start"] : t["end"]] for t in found[i]["terms"] if t["kind"] == "term"] == ["Zorbulon"]


def test_mix_reaches_its_targets(spark, corpus):
    d = docs(spark, corpus)
    got = mixing.copies(d, group=16).collect()
    assert len(got) == len(corpus)
    by = {}
    for r in got:
        assert 0 <= r["copies"] <= 2
        s = by.setdefault(r["source"], [r["target"], 0, r["source_size"], 0])
        s[1] += r["copies"] * r["size"]
        s[3] = max(s[3], r["size"])
    total = sum(s[2] for s in by.values())
    assert abs(sum(s[0] for s in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(s[1] - s[0]) <= s[3] and s[0] <= 2 * s[2] + 1e-9 for s in by.values())
    again = {(r["_id"], r["_th"], r["_n"]): r["copies"] for r in mixing.copies(d.repartition(5), group=16).collect()}
    assert again == {(r["_id"], r["_th"], r["_n"]): r["copies"] for r in got}
    out = mixing.mix(d, group=16)
    assert out.columns == d.columns and out.count() == sum(r["copies"] for r in got)


def test_small_sources_come_close_to_their_targets(spark):
    """Sources of 50 documents, of which one may be a sixth of all words."""
    rows = mixing.op1_mixing(spark, "/root/testdata/sf0.01").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert max(abs(r["k"] - r["t"]) / r["t"] for r in rows) <= 0.01


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 4)], "source string, source_size long")
    got = {r["source"]: round(r["target"], 6) for r in mixing.targets(sizes).collect()}
    rest = 1.5 * 2014 - 20 - 8
    assert got == {"a": 20.0, "b": round(rest / 3, 6), "c": round(rest * 2 / 3, 6), None: 8.0}
    many = spark.createDataFrame([(f"s{i:03}", 10 + i) for i in range(200)], "source string, source_size long").repartition(7)
    got = [r["target"] for r in mixing.targets(many).orderBy("source").collect()]
    level = [t / (3, 1, 2)[i % 3] for i, t in enumerate(got) if t < 2 * (10 + i) - 1e-6]
    assert max(level) - min(level) < 1e-6 and abs(sum(got) - 1.5 * sum(10 + i for i in range(200))) < 1e-6


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, z = rng.random(500), np.sort(rng.integers(0, 900, 500).astype(float))[::-1]
    out = mixing.flight(p, z, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ z - p @ z) < 1e-3


def test_settled_groups_keep_documents_and_words():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 40, 500, 3000):
        for _ in range(6):
            z = np.sort(np.floor(np.exp(rng.normal(5, 1.4, n))).clip(1, 20_000))[::-1]
            p = np.full(n, rng.random()) if rng.random() < 0.5 else rng.random(n)
            out = mixing.settle(p, z, rng)
            assert set(np.unique(out)) <= {0.0, 1.0}
            assert abs(out.sum() - p.sum()) <= 2 and abs(out @ z - p @ z) <= z[0]
            if n >= 500:
                assert abs(out @ z - p @ z) <= 0.002 * (p @ z)
    z = np.sort(np.exp(rng.normal(5, 1.4, 60)))[::-1]
    mean = sum(mixing.fly(np.full(60, 0.3), z, rng, 2) for _ in range(400)) / 400
    assert np.abs(mean - 0.3).max() < 0.12 and abs(mean.mean() - 0.3) < 1e-9


def naive_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_registered_mixing_query_against_plain_python(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sizes, count, largest = {}, {}, {}
    for _, s, n in rows:
        sizes[s], count[s], largest[s] = sizes.get(s, 0) + n, count.get(s, 0) + 1, max(largest.get(s, 0), n)
    want = naive_targets(sizes)
    got = mixing.op1_mixing(spark, d).collect()
    assert sorted((r["doc_id"], r["source"], r["size"]) for r in got) == sorted(rows)
    taken, docs_taken = {}, {}
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * want[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s], docs_taken[s] = taken.get(s, 0) + r["taken"], docs_taken.get(s, 0) + (r["taken"] / r["size"] if r["size"] else want[s] / sizes[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.4 * largest[s], 0.01 * want[s]), (s, taken[s], want[s])
        assert abs(docs_taken[s] - count[s] * want[s] / sizes[s]) <= 2, s


def test_a_source_may_have_the_name_of_the_null_marker(spark):
    got = mixing.copies(docs(spark, [(1, "a b", "\x00null"), (2, "c d e", None), (3, "f", "null"), (4, "g", "")])).collect()
    assert {(r["_id"], r["source"], r["source_size"]) for r in got} == {(1, "\x00null", 2), (2, None, 3), (3, "null", 1), (4, "", 1)}


def test_packing_round_trip(spark, corpus):
    d = docs(spark, corpus)
    pieces = packing.pack(d).collect()
    enc = packing.encoder("word_bpe_49k.json")
    want = {}
    for i, t, _ in corpus:
        ids = np.frombuffer(enc.whole([t or ""])[0], enc.dtype).astype("<u4")
        want.setdefault(i, np.append(ids, np.uint32(2)).astype("<u4"))
    sequences, seen = {}, {}
    for r in pieces:
        ids = want.get(r["doc_id"]) if r["doc_id"] != 203 else want[203]
        assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert sum(n for _, n in sum(seen.values(), [])) == sum(len(want[i]) for i, _, _ in corpus)


def test_differencing_balances():
    rng = random.Random(4)
    sizes = [rng.randint(1, 4000) for _ in range(400)]
    loads = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 150)]
    assert sum(loads) == sum(sizes) and max(loads) < 1.15 * sum(sizes) / 150
    windows = packing.windows_of(sizes, 4096)
    assert all(sum(n for _, _, n in w) <= 4096 for w in windows) and len(windows) <= 1.02 * sum(sizes) / 4096 + 1
    assert packing.windows_of([], 10) == [] and packing.differencing([5], 3)[0] == [0]


def test_encoder_keeps_the_words_in_use(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing.Words, "LIMIT", 50)
    enc = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encode, asked = enc.words.encode, []
    monkeypatch.setattr(enc.words, "encode", lambda w: (asked.append(w), encode(w))[1])
    texts = ["the cat, " + " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(20)) + "." for i in range(20)]
    assert enc(texts) == enc.whole(texts)
    assert sorted(asked) == sorted({p for t in texts for p in enc.PIECES.findall(t)})  # each once, though the cache fills several times


def test_encoder_of_another_tokenizer(tmp_path):
    import json

    import public_tokenizers

    steps = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    steps["normalizer"]["normalizers"].pop()  # it doesn't lower letters, for instance
    (tmp_path / "other.json").write_text(json.dumps(steps))
    enc = packing.Encoder(str(tmp_path / "other.json"))
    assert enc(["The Cat sat"]) == enc.whole(["The Cat sat"]) != packing.encoder("word_bpe_49k.json")(["The Cat sat"])


def test_near_duplicates_keep_nothing_resident():
    import pyarrow as pa

    common.resident("model", lambda: bytearray(1 << 20))
    assert list(common.lean(lambda it: it)(iter([pa.record_batch({"a": [1]})])))[0].num_rows == 1
    assert common._RESIDENT == {None: None}


def test_language_stage_sends_a_text_once(spark, monkeypatch):
    import corpus_pipeline

    seen = []
    identify = language_id.identify
    monkeypatch.setattr(language_id, "identify", lambda d, m: (seen.append(d.schema.simpleString().count("text:")), identify(d, m))[1])
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit("kept"))
    got = corpus_pipeline.identify_language(spark, d, "")
    assert seen == [1] and got.dtypes == d.dtypes
    want = {r["doc_id"]: r for r in d.collect()}
    for r in got.collect():
        w = want[r["doc_id"]]
        assert r.asDict() | {"lang": None} == w.asDict() | {"lang": None} and w["lang"] in (None, r["lang"]) and r["lang"]


def test_encoder_is_the_tokenizer():
    enc = packing.encoder("word_bpe_49k.json")
    odd = ["don't''s 'tis <|endoftext|> x", "İstanbul Ωμεγα", "a²½³ ª", "é\x85b", "x_y-z...'ll 12 345", "", "ÀÉß ÿ × ÷ x×y", "a\x0bb\x1cc", "e\u0301"]
    assert enc(odd) == enc.whole(odd)


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(d.where(~language_id.is_held_out(F.col("doc_id"))))
    got = language_id.identify(d, model).where(language_id.is_held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    n, ok = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert ok / n > 0.98
    odd = docs(spark, [(1, None, None), (2, "", None), (3, "123 !?", None), (3, "123 !?", None), (None, "the of and", None), (5, "the and of " * 30_000, None)])
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).collect()}
    assert rows[1] == rows[2] == rows[3] == ("und", 0.0) and rows[5][0] == "en" and 0 <= rows[5][1] <= 1
    signs = language_id.identify(docs(spark, [(1, "½ ² Ⅷ ①", None), (2, "٣ १ _", None), (3, "½ the of and", None)]), model)
    assert {r["doc_id"]: r["lang_pred"] for r in signs.collect()} == {1: "und", 2: "und", 3: "en"}
    assert language_id.identify(d.limit(0), model).count() == 0
    kept = language_id.identify(d.select("doc_id", "text", F.lit(1).alias("lang_pred"), F.lit(2).alias("score")), model)
    assert dict(kept.dtypes) == {"doc_id": "bigint", "text": "string", "lang_pred": "string", "score": "double"}
    none = language_id.train(d.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 40, 5)
        s = -rng.exponential(2, (sizes.sum(), 3))
        s -= s.max(axis=1, keepdims=True)
        starts = np.cumsum(sizes) - sizes
        for labels in (language_id.label(s, starts, sizes, 4.0), language_id.viterbi(s, starts, sizes, 4.0)):
            for a, n in zip(starts, sizes):
                own, q = s[a : a + n], labels[a : a + n]
                best = own[0].copy()
                for i in range(1, n):
                    best = np.array([max(best[j] - (0 if j == k else 4.0) for j in range(3)) for k in range(3)]) + own[i]
                assert abs(own[np.arange(n), q].sum() - 4.0 * (q[1:] != q[:-1]).sum() - best.max()) < 1e-9


def test_words_are_runs_of_letters_in_linear_time():
    import sys
    import time

    marks = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
    slow = re.compile(rf"[^\W\d_{re.escape(marks)}]+")
    rng = random.Random(4)
    texts = ["", None, "½", "a½b", "Ⅳ x", "12 a_b", "l’été 漢字 ²³ x²y", *("".join(rng.choice("abÉ漢½Ⅳ²①1_ .") for _ in range(60)) for _ in range(300))]
    for t in texts:
        found = list(slow.finditer((t or "").lower()))
        assert language_id.words_of(t) == [m.group() for m in found]
        assert language_id.words_at(t) == ([m.group() for m in found], [m.start() for m in found])
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_000_000))
    began = time.process_time()
    language_id.words_of(long)
    assert time.process_time() - began < 2  # 2 million characters; the slow pattern takes more


def test_mixed_text_has_spans(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(d)
    sure = language_id.identify(d.where("length(text) > 2000"), model).where("score > 0.9999 AND lang = lang_pred")
    by = {r["lang"]: r["text"] for r in sure.orderBy("doc_id").collect()}
    en, de = (language_id.words_of(by[k])[:80] for k in ("en", "de"))
    sizes, labels, _ = language_id.Labeller(model).spans([" ".join(en + de)])
    assert sizes.tolist() == [160]
    share = [(np.array([model.langs[k] for k in h]) == lang).mean() for h, lang in zip((labels[:80], labels[80:]), ("en", "de"))]
    assert min(share) > 0.85 and np.count_nonzero(np.diff(labels)) < 12
    text = " ".join(en + de)
    row = language_id.language_spans(spark.createDataFrame([(1, text, 1), (2, None, 1)], "doc_id long, text string, spans int"), model).orderBy("doc_id").collect()
    assert row[1]["spans"] == [] and len(row[0]["spans"]) == np.count_nonzero(np.diff(labels)) + 1
    assert row[0]["spans"][0]["start"] == 0 and row[0]["spans"][-1]["end"] == len(text)


def test_a_long_url_takes_linear_time(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        d = spark.createDataFrame([(1, "http://ab.org/" + "é/x" * (n // 3)), (1, "http://ab.org/" + "é/x" * (n // 3))], "page_id long, url string")
        began = time.time()
        assert len({tuple(r) for r in url_filter.judge(d).collect()}) == 1
        took.append(time.time() - began)
    assert took[1] < 4 + 6 * took[0]
    assert url_filter.judge(d.limit(0)).count() == 0


CHAT = "conv_id long, turn long, role string, text string, turns string, example int"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", " </turn>\n### user: a\\b\\\\l <b> # "), (1, 2, None, None), (1, 3, "assistant", ""), (2, 0, "user", "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (4, None, "a: b", "c"), (None, 1, "assistant", "n" * 100_000), (5, 2, "assistant", "é"), (5, 1, "system", "s")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], CHAT).repartition(3)
    ex = chat_format.expand(d)
    got = ex.select("conv_id", "example", "n_turns", chat_format.parse(F.col("text")).alias("t"), chat_format.loss_text(ex).alias("loss")).collect()
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append((r["example"], r["n_turns"], [(t["role"], t["text"]) for t in r["t"]], r["loss"]))
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        own = sorted(by[conv])
        assert own[-1][2] == turns
        ends = [i for i, t in enumerate(turns) if t[0] == "assistant"]
        assert [e[3] for e in own if e[3] is not None] == [turns[i][1] for i in ends]
        assert [e[1] for e in own] == [i + 1 for i in range(len(turns)) if i in ends or i == len(turns) - 1]


@pytest.mark.parametrize(("url", "host", "path", "rule"), [("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"), ("http://example.net/de/", "example.net", "/de/", "net/"), ("http://xexample.com/de/", "xexample.com", "/de/", None), ("x://e.org/fr/a://b", "e.org", "/fr/a://b", "org/fr/"), ("nothing", "", "", None), (None, "", "", None), ("http://h?q/en/", "h", "", None), ("ftp://net", "net", "", None), ("http://ab\ncd.net/\n/x", "ab\ncd.net", "/\n/x", "net/")])
def test_urls(spark, url, host, path, rule):
    d = spark.createDataFrame([(1, url, "x", "y")], "page_id long, url string, host string, verdict string")
    r = url_filter.judge(d).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and url_filter.split_url(url) == (host, path)
    assert r["verdict"] in ("allow", "block")


def test_url_model():
    w, b = url_filter.default_model()

    def score(u):
        f = url_filter.features(*url_filter.split_url(u))
        return b + sum(w[i] for i in f) / max(len(f), 1)

    assert all((score(u) > 0) == bool(y) for u, y in url_filter.SEED_URLS)
    assert score("http://blog.cheap-pills.example.com/fr/99") > 0 > score("https://ththat.example.com/fr/99")


@pytest.mark.parametrize("operator", [shingle_join.classes, shingle_join.keep_one, substring_dedup.dedup, pii.find, pii.sanitise, mixing.copies, mixing.mix, packing.pack])
def test_empty_tables(spark, operator):
    assert operator(docs(spark, [(1, "a", None)]).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    links = [(a, a - rng.randint(1, 3)) for a in range(1, 60) if a % 7] + [(100, 200), (200, 300), (5, 5)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for link in links for x in link if link[0] != link[1]}}
