"""Centroid clustering, conversation repair and phrase fingerprints against brute force, with the edge cases that they define."""

import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from mensura.llm import centroid_clustering as C
from mensura.llm import conversation_repair as R
from mensura.llm import phrase_fingerprint as P
from mensura.llm.queries import QUERIES, sql

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, cluster string, dim int"


# Clusters


def vectors(n=150, seed=4, size=1.0):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, 64)) * np.linspace(0.1, 2, 64) * size).astype(np.float32)
    x[20:30] = x[20]
    return [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(n), x)]


def lloyd(data, k=8, rounds=10):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(rows, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(rows, own) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [near(v) for _, v in rows]
    by = {j: sum(d for d, o in final if o == j) for j in range(len(cents))}
    big = lambda x: min(x, 2**63 - 1)
    return sorted(((i, o, big(d), big(by[o]), big(sum(by.values()))) for (i, _), (d, o) in zip(rows, final)), key=str), cents


@pytest.mark.parametrize(("size", "more"), [(1.0, True), (1e25, False)])
def test_clusters_are_lloyds(spark, size, more):
    data = vectors(size=size, n=150 if more else 40)
    if more:
        data += [(5, data[0][1]), (5, data[0][1]), (None, data[3][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64)]
    want, cents = lloyd(data)
    out, found = C.cluster(spark.createDataFrame([(i, v, "x", 1) for i, v in data], VECTORS).repartition(3))
    if more:
        assert found == cents and sorted((tuple(r) for r in out.collect()), key=str) == want
    else:  # distances beyond 64 bits are cut, but compared whole
        assert found == cents and sorted((tuple(r)[:3] for r in out.collect()), key=str) == [w[:3] for w in want]
        assert {r["inertia"] for r in out.collect()} == {2**63 - 1}


def test_few_and_no_vectors(spark):
    for data in ([], vectors()[:3]):
        out, cents = C.cluster(spark.createDataFrame([(i, v, "x", 1) for i, v in data], VECTORS))
        assert len(cents) == len(data) and sorted(r["distance"] for r in out.collect()) == [0] * len(data)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_partial_distances_are_exact_and_save_work():
    rng = np.random.default_rng(1)
    c = rng.integers(-3000, 3000, (8, 64))
    x = c[rng.integers(0, 8, 500)] + rng.integers(-300, 300, (500, 64))
    x[0] = c[3] = c[1]  # a tie
    cluster, far, used = C.nearest(x, c, np.argsort(-x.var(axis=0)))
    all_ = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (cluster == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all() and cluster[0] == 1
    assert used < 0.5 * 500 * 8 * 64


# Conversations

ROWS = "conv_id long, turn long, role string, text string, gone string, nth int"


def cheapest(rows):
    """(cost, edits, repaired) of (role, text, fault) rows by search over all edits: the least cost, then the least edits."""
    grammar = re.compile("(s?(ua)+)?")
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, edits, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in out)
        if i == len(rows) and grammar.fullmatch(initials):
            return cost, edits, "\n".join(f"{r}:{t}" for r, t in out)
        state = (i, initials[-2:] if len(initials) < 2 else "s" * (initials == "s") + initials[-1:], len(initials) > 0)
        if state in seen or not re.fullmatch("s?(ua)*u?", initials):
            continue
        seen.add(state)
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, edits + "I", i, (*out, (r, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role:  # an empty role has no initial that the grammar could have
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, (*out, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, edits + "R", i + 1, (*out, (r, text))))


def digest_of(rows):
    """The contract's columns of one conversation's rows after damage, in order."""
    seen, faults, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            n[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, edits, text = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()


def damaged(data):
    by = {}
    for conv, turn, role, text in data:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rows in by.items()}


def talk(rng, n):
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None]) if turn else rng.choice(["system", "user", "user"])
            text = rng.choice(["Yes.", "No!", "what", "x ", "Well? \n", " \t", "", None, f"t{rng.random()}.", f"t{rng.random()}"])
            rows.append((c, rng.choice([turn, turn + 2, None]) if rng.random() < 0.1 else turn, role, text))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b.\u0085"), (n + 1, None, None, None), (n + 2, 3, "user", "Hi."), (n + 2, 3, "user", "Hi."), (n + 2, 9, "assistant", "x" * 50_000 + ".")]
    return rows


def test_repair_is_the_cheapest(spark):
    data = talk(random.Random(8), 250)
    frame = spark.createDataFrame([(*r, "x", 1) for r in data], ROWS).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in R.digest(R.repair(R.damage(frame))).collect()}
    want = {c: digest_of(rows) for c, rows in damaged(data).items()}
    assert got == want
    assert {e for v in got.values() for e in v[6]} == set("DKR") and any(v[2] for v in got.values())


def test_conversations_without_rows_stay(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "a.", "x", 1)], ROWS)
    assert [tuple(r) for r in R.digest(R.repair(R.damage(frame))).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.digest(R.repair(R.damage(frame.limit(0)))).count() == 0


def test_a_long_conversation_streams(spark):
    n = 5000
    frame = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('turn ', id, '.') AS text", "false AS gone")
    rows = R.repair(frame).orderBy("at").collect()
    assert [r["edit"] for r in rows] == ["K"] * n and [r["at"] for r in rows] == list(range(n))
    again = R.repair(frame.selectExpr("conv_id", "turn", "role", "'same.' AS text"))  # all but two are repeats
    assert again.where("edit = 'D'").count() == n - 2


def test_insertions_when_they_are_cheap(monkeypatch):
    costs = R.END
    for _ in range(2):
        costs = R.before("u", None, costs)
    assert costs[0] == 1  # two users: one becomes the assistant
    monkeypatch.setattr(R, "INSERT", 0)
    assert R.inserted([0, R.FAR, R.FAR, 0]) == [0, 0, 0, 0]


# Fingerprints

DOCS = "doc_id long, text string, lang string, fingerprint string, guest int"


def lz(text):
    known, cur = set(), ""
    for c in text:
        cur += c
        if cur not in known:
            known.add(cur)
            cur = ""
    return known


def some_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé漢𝄞") for _ in range(rng.randint(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 20, 300])))) for i in range(60)]
    return rows + [(70, None), (71, ""), (72, "a"), (73, "aa"), (74, "abc"), (75, "z" * 40_000), (76, rows[5][1]), (76, rows[5][1]), (76, "other"), (None, rows[7][1]), (None, None)]


def test_fingerprints_beside_their_successors(spark):
    data = some_texts()
    rows = sorted(((P.NO_ID if i is None else i, t or "", i) for i, t in data), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (_, t, i) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 3
        e = t[: len(t) - m] + after[:m]
        a, b, c = map(P.fingerprint, (t, e, after))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), P.text_of(a), P.text_of(b), P.likeness(a, b), P.likeness(a, c)))
    got = [tuple(r) for r in P.beside_next(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in data], DOCS).repartition(4)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(0 <= x <= 1 for r in got for x in r[5:])
    assert [tuple(r)[5:] for r in P.beside_next(spark.createDataFrame([(1, "only one", "", "", 0)], DOCS)).collect()][0][1] == 1.0
    assert P.beside_next(spark.createDataFrame([], DOCS)).count() == 0


def test_likeness_estimates_the_jaccard_similarity_of_phrases():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(n)) for n in (0, 5, 40, 200, 3000, 9000)]
    texts += [t[: len(t) // 2] + texts[0] + t[::-1][: len(t) // 3] for t in texts]
    for a in texts:
        for b in texts:
            x, y = lz(a), lz(b)
            exact = len(x & y) / len(x | y) if x | y else 1.0
            found = P.likeness(P.fingerprint(a), P.fingerprint(b))
            assert abs(found - exact) < (1e-9 if len(x | y) <= P.K else 0.15)


def test_texts_cut_between_phrases_and_a_full_dictionary(monkeypatch):
    text = "".join(random.Random(2).choice("ab") for _ in range(5000))
    whole = P.fingerprint(text)
    monkeypatch.setattr(P, "BLOCK", 100)
    assert (P.fingerprint(text) == whole).all()
    monkeypatch.setattr(P, "DICTIONARY", 64)
    known = set()
    lengths, open_ = P.phrases(text, known)
    assert len(known) < 64 and sum(lengths) + len(open_) == len(text)


def test_fingerprint_column(spark):
    frame = spark.createDataFrame([(1, "one text", "x", "y", 1), (2, "one text", None, None, None), (3, None, "x", "y", 1)], DOCS)
    got = {r["_row"]["doc_id"]: r["fingerprint"] for r in P.fingerprints(frame).collect()}
    assert got[1] == got[2] == P.text_of(P.fingerprint("one text")) and got[3] == ""


# The registered queries


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_conversation_repair"])
def test_registered_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    out, want = QUERIES[name](spark, DATA), con.sql(sql()[name])
    assert sorted(out.columns) == sorted(want.columns)
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in out.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_registered_fingerprints(spark):
    rows = QUERIES["op13_phrase_fingerprint"](spark, DATA).collect()
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM read_parquet('{DATA}/documents.parquet') ORDER BY 1 DESC").fetchall()
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in docs)
    by = {r["doc_id"]: r for r in rows}
    for (d, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        m = len(t) // 3
        assert by[d]["n_chars"] == len(t) and by[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()
    long = [r for r in rows if r["n_chars"] > 200]
    assert min(r["near_edited"] for r in long) > 0.3 and sum(r["near_edited"] > r["near_next"] for r in long) >= 0.99 * len(long)
