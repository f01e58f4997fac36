"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from mensura.llm import ann_search, exact_search
from mensura.llm.queries import QUERIES, sql

SCHEMA = "vec_id long, embedding array<float>, v string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def rows(n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, dim)), 3).astype(np.float32)
    x[10:20] = x[10]  # ties
    out = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return out + [(5350, None), (5351, [1.0, None] * 4), (5400, [float("nan")] * 8), (5401, [float("inf")] * 8), (5450, [0.0] * 8), (5500, [1.0, 2.0]), (5501, [2.0, 1.0]), (None, [1.0] * 8)]


def usable(data):
    return [(i, v) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def test_exact_search_is_brute_force(spark):
    data = rows()
    own = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in usable(data)]
    want = set()
    for i, q in own:
        if i % 50 == 0:
            c = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in own if j != i and len(v) == len(q))
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(c[:5])}
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_search.search(table(spark, data)).collect()}
    assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for size in (300.0, 2.0**40, 1e300):
        x, q = np.floor(rng.standard_normal((200, 16)) * size), np.floor(rng.standard_normal((5, 16)) * size)
        x[:, 3] = x[0, 3]
        low, width, code = exact_search.approximate(x)
        middle, reach = exact_search.bounds(q, low, width, code)
        a, _ = exact_search.scaled(q)
        assert code.dtype == np.uint8 and (np.abs(a @ x.T - middle) <= reach).all()
        assert reach.max() < 0.1 * np.abs(middle).max()


def test_few_vectors_are_read_exactly(spark):
    data = rows(2000, 16, 9)
    left = exact_search.approximated(exact_search.usable(table(spark, data)).withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double"))), 5)
    queries = sum(i % 50 == 0 for i, _ in usable(data))
    assert left.count() < 0.03 * queries * len(data)


def test_repeated_rows_and_scores_beyond_64_bits(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [2.0, 5.0]), (9, [1.0, 1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_search.search(table(spark, data), 3).collect())
    one = [(0, k, i, s * 65536) for k, i, s in ((1, 7, 3), (2, 7, 3), (3, 8, 2))]
    two = [(0, k, i, s * 65536) for k, i, s in ((1, 8, 5), (2, 7, 1), (3, 7, 1))]
    assert got == sorted(one + two)
    found = {}
    for r in ann_search.search(table(spark, data), 3).collect():
        found.setdefault(r["rank"], []).append(r["vec_id"])
    assert {k: sorted(v) for k, v in found.items()} == {1: [7, 8], 2: [7, 9], 3: [7, 9]}
    big = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [3e30, 1.0]), (3, [2e30, 1.0]), (4, [1e307, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in exact_search.search(big, 3).orderBy("rank").collect()]
    assert got == [(2, 2**63 - 1), (3, 2**63 - 1), (1, 2**63 - 1)]


def test_copies_beyond_need_are_left_out():
    rng = np.random.default_rng(5)
    x, ids = rng.integers(0, 3, (400, 2)).astype(float), np.sort(rng.integers(0, 60, 400))
    at = exact_search.needed(ids, x, 3)
    assert len(at) < 60 and (np.diff(ids[at]) >= 0).all()
    for own in range(60):
        for q in rng.standard_normal((3, 2)):
            rank = lambda rows_: sorted((-(x[i] @ q), ids[i]) for i in rows_ if ids[i] != own)[:3]
            assert rank(range(400)) == rank(at)


def test_large_numbers_stay_exact(spark):
    data = [(i, [3e6 + i, -2e6, 1.5e6 * (i % 3)]) for i in range(60)]
    own = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in data]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_search.search(table(spark, data)).collect()}
    c = sorted((-sum(a * b for a, b in zip(own[0][1], v)), j) for j, v in own[1:])
    assert [got[0, k + 1] for k in range(5)] == [(j, -s) for s, j in c[:5]]


def test_approximate_search(spark):
    data = rows(3000, 16, 4)
    own = [(i, np.array(v, np.float32).astype(float)) for i, v in usable(data) if any(v)]
    got = {}
    for r in ann_search.search(table(spark, data)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = n = 0
    for i, q in own:
        if i % 50 == 0:
            c = sorted((-(q @ v) / np.sqrt((q @ q) * (v @ v)), j) for j, v in own if j != i and len(v) == len(q))[:5]
            found = sorted(got.get(i, []))
            hit += len({j for _, j in c} & {j for _, j, _ in found})
            n += len(c)
            exact = {j: (q @ v) / np.sqrt((q @ q) * (v @ v)) for j, v in own if len(v) == len(q)}
            assert all(abs(exact[j] - s) < 1e-12 for _, j, s in found) and len(found) == len(c)
            assert [x[0] for x in found] == list(range(1, len(found) + 1))
    assert hit / n >= 0.9
    assert 5450 not in got and 5400 not in got


def clusters(n, dim, groups, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((groups, dim))[rng.integers(0, groups, n)] + 0.15 * rng.standard_normal((n, dim))
    return x.astype(np.float32).astype(float)


def recall(x, found, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    by = {}
    for r in found:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for i in range(0, len(x), 50):
        s = u @ u[i]
        s[i] = -9
        hit += len(set(np.argsort(-s, kind="stable")[:k].tolist()) & by[i])
    return hit / (k * len(range(0, len(x), 50)))


def test_clustered_vectors_need_a_small_share(spark):
    x, seen = clusters(6000, 24, 40), []
    found = ann_search.search(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), scanned=seen).collect()
    assert recall(x, found) >= 0.9 and seen[0][0] <= 0.1 * seen[0][1]


def test_parts_are_cut_again_in_large_tables(spark):
    x, seen = clusters(8000, 12, 200), []
    rows_ = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    index = ann_search.build(ann_search.usable(rows_), 8000, 8, 500)[12]
    assert len(index.inner) == 8 and index.width > 4
    found = ann_search.search(rows_, scanned=seen, top=8, block=500).collect()
    assert recall(x, found) >= 0.9 and seen[0][0] <= 0.15 * seen[0][1]


def test_parts_are_balanced():
    x = ann_search.unit(np.random.default_rng(3).standard_normal((1000, 12)))
    part = ann_search.balanced_parts(ann_search.neighbour_graph(x), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(ann_search.SLACK * 1000 / 8) + 1


def test_empty_tables(spark):
    assert exact_search.search(table(spark, rows()).limit(0)).count() == 0
    assert ann_search.search(table(spark, rows()).limit(0)).count() == 0


def test_hot_vector(spark):
    data = [(i, [1.0, 0.0]) for i in range(200)] + [(i, [float(i % 7), 1.0]) for i in range(200, 300)]
    got = [r["vec_id"] for r in exact_search.search(table(spark, data)).where("query_id = 0").orderBy("rank").collect()]
    assert len(got) == 5
    got = [r["vec_id"] for r in ann_search.search(table(spark, data)).where("query_id = 50").orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]


def test_registered_queries_agree_with_their_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    for name, text in sql().items():
        df, rel = QUERIES[name](spark, d), con.sql(text)
        assert sorted(df.columns) == sorted(rel.columns), name
        pick = lambda cols, rows_: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rows_), key=str)
        assert pick(df.columns, [tuple(r) for r in df.collect()]) == pick(rel.columns, rel.fetchall()), name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.where(F.col("length") > 4096).count() == 0 and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_computes_each_stage_once(spark, monkeypatch):
    import corpus_pipeline

    passes = spark.sparkContext.accumulator(0)

    def counted(spark_, docs, sf_dir):
        def pass_by(batches):
            for b in batches:
                passes.add(b.num_rows)
                yield b

        return docs.mapInArrow(pass_by, docs.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("counted", counted), *corpus_pipeline.STAGES[1:]])
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and passes.value == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_pipeline_stages_on_odd_documents(spark):
    import corpus_pipeline

    text = "the of and in to a is that it was for on are as with his they at be this"
    rows_ = [(1, text, "en", "a", 5, "x", 1.0), (1, text, "en", "a", 5, "x", 1.0), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "x", 1.0), (None, text + " ann@mail.example.com", None, None, 9, None, 2.0)]
    rows_ += [(5, "the of and " * 30_000, None, "b", 1, "y", 1.0), (6, "and then the other words of this one are for ann@mail.example.com to have", "en", "b", 1, "y", 1.0), (7, "12 34", None, "b", 1, "y", 1.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double"
    frame = spark.createDataFrame(rows_, schema)
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            got = out.collect()
            assert bool(got) == bool(docs.take(1)), name
            if got and name == "language_id":
                assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "5", "6", "None"]
                assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 1} == {("x", 1.0)}
            if got and name == "ngram_jaccard_join":
                assert sorted(r["doc_id"] for r in got) == [1, 5, 6]  # the one without an id has 14 of 15 shingles of 1
            if got and name == "pii":
                assert not any("@" in r["text"] for r in got) and all(r["n_chars"] == len(r["text"]) for r in got)
            docs = spark.createDataFrame(got, out.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.select("doc_id").distinct().count()
