"""Operators 1, 5 and 6 against brute force."""

import math
import random
import re

import numpy as np
import pytest

from palimp.llm import ann, ngram_join, tiles, topk
from palimp.llm.components import components

from .helpers import ODD, documents, sentence


def brute_join(texts, n, a, b):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    of = {i: i for i in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and b * len(sets[i] & sets[j]) >= a * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                of[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies():
    rng = random.Random(11)
    out = [*ODD, *ODD[:8], "One two", "one TWO", "two one", "É one", "é one"]
    for size in (3, 4, 9, 10, 11, 12, 30, 31, 60, 150, 400):
        base = sentence(rng, size).split()
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [sentence(rng, 1)], [w[at], sentence(rng, 1)]])
            out.append(" ".join(w).title() if rng.random() < 0.3 else "\n".join(w))
    passage = sentence(rng, 60)
    out += [f"{passage} {sentence(rng, rng.randint(1, 25))}" for _ in range(60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n,a,b", [(3, 90, 100), (5, 80, 100)])
def test_join_equals_brute_force(spark, n, a, b):
    texts = near_copies()
    got = ngram_join.join(documents(spark, texts), n=n, similarity=(a, b)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_join(texts, n, a, b) and len(got) == len(texts)


@pytest.mark.parametrize("few", [0, 32])
def test_join_in_large_tiles(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "FEW", few)
    texts = near_copies()
    got = ngram_join.join(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_join(texts, 3, 90, 100)


def brute_links(texts, n, a, b):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return {i: sum(i != j and bool(x) and b * len(x & y) >= a * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)}


@pytest.mark.parametrize("block,size,columns", [(256, 4 << 20, 4096), (8, 4 << 20, 16), (256, 5000, 4096)])
def test_links_are_counted_whole(spark, monkeypatch, block, size, columns):
    for name, value in (("BLOCK", block), ("BLOCK_BYTES", size), ("COLUMNS", columns)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    base = sentence(rng, 80).split()
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k:]) for k in range(2, 79)]
    texts += [" ".join(base), " ".join(base), "three equal words", "three equal words", "three Equal words", "alone", None, "", *near_copies()[:40]]
    texts = [t if t is None or t.isascii() else "x" for t in texts]
    got = {r["doc_id"]: r["links"] for r in ngram_join.join(documents(spark, texts)).collect()}
    assert got == brute_links(texts, 3, 90, 100) and max(got.values()) > 70
    assert "links" not in ngram_join.join(documents(spark, texts), counted=False).columns


def test_join_of_nothing_and_repeated_ids(spark):
    none = documents(spark, ["a b c"]).limit(0)
    assert ngram_join.join(none).collect() == []
    rows = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (2, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.join(rows).collect() if r["doc_id"]) == [(2, 2), (5, 2), (5, 2)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 10), (20, 11), (20, 12), (5, 5)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for v, c in got.items():
        groups.setdefault(c, set()).add(v)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [7, 8, 9], [10, 11, 12, 20]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for k in range(0, 120, 7):
        x, y = np.unique(base), np.unique(np.r_[base[k:], rng.integers(0, 2**63, k, dtype=np.uint64)])
        sizes = np.array([len(x), len(y)])
        overlap = len(np.intersect1d(x, y))
        linked = overlap * 100 >= 90 * (len(x) + len(y) - overlap)
        ok = ngram_join.likely(sizes, ngram_join.stacked([ngram_join.bitmap(x), ngram_join.bitmap(y)]), np.arange(2), 90, 100)
        assert ok[0, 1] or not linked


def vectors(spark, n=400, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[7] = x[0]
    x[21:26] = x[20]
    rows = [(i, [float(v) for v in x[i]], 3, "clash") for i in range(n)]
    rows += [(n, None, 1, ""), (n + 1, [float("nan")] * dim, 1, ""), (n + 2, [math.inf] + [0.0] * (dim - 1), 1, ""), (n + 3, [None] * dim, 1, ""), (n + 4, [0.0] * dim, 1, ""), (n + 5, [], 1, ""), (n + 6, [1.0, 2.0], 1, ""), (8, [float(v) for v in x[8]], 9, "again")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, place string"), x.astype(float)


def test_top_k_is_exact(spark):
    df, x = vectors(spark)
    w = np.floor(256 * x).astype(int)
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 50)) | {400 - 400}
    for q, rows in got.items():
        scores = {i: int(w[i] @ w[q]) for i in range(400) if i != q} | ({404: 0} if q != 404 else {})
        best = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        assert sorted(rows) == [(k + 1, *b) for k, b in enumerate(best)]
    assert topk.top_k(df.limit(0)).collect() == []


def test_accumulation_of_sparse_rows():
    rng = np.random.default_rng(8)
    x, q = (rng.integers(-3, 4, s) * (rng.random(s) < 0.3) for s in ((50, 12), (9, 12)))
    assert (topk.accumulate(q, topk.postings(x), 50) == q @ x.T).all()


def test_terms_that_most_rows_hold_are_not_scattered():
    rng = np.random.default_rng(9)
    x = rng.integers(-300, 300, (400, 6)) * (rng.random((400, 6)) < [0.01, 0.05, 0.2, 0.9, 1, 0])
    lists = topk.postings(x)
    assert [isinstance(rows, slice) for rows, _ in lists] == [False, False, True, True, True, False]
    for scale, kind in ((1, np.int32), (1 << 20, np.int64)):
        q = rng.integers(-300, 300, (7, 6)) * scale
        got = topk.accumulate(q, lists, 400)
        assert (got == q @ x.T).all() and got.dtype == kind
    assert [topk.weights(np.array([v])).dtype for v in (0.5, 200.0, 1e8)] == [np.int16, np.int32, np.int64]


def test_one_reader_deals_its_blocks_over_all_places(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 16)
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(160)], "id long, x array<double>").coalesce(1)
    packed = tiles.pack(rows, 10, 16, True, topk.weights).collect()
    assert sorted(r["place"] for r in packed) == list(range(10)) and {len(r["vectors"]) for r in packed} == {16 * 2 * 2}


def test_nearest_recall_ties_and_odd_rows(spark):
    df, x = vectors(spark, 600)
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    found = []
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        rows = got[q]
        assert len(rows) == 20 and q not in [v for v, _ in rows] and all(v < 600 for v, _ in rows)
        assert np.allclose([v for _, v in rows], s[[v for v, _ in rows]], rtol=1e-12)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        found.append(len({v for v, _ in rows} & set(best.tolist())) / 20)
    assert np.mean(found) >= 0.9 and [v for v, _ in got[20] if 21 <= v <= 25] == [21, 22, 23, 24, 25]
    assert ann.nearest(df.limit(0)).collect() == []
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted((r["query_id"], r["vec_id"]) for r in ann.nearest(few).collect()) == [(0, 1), (0, 2)]


def test_probe_sequence_is_in_order_of_expected_distance():
    sets = ann.sequence(4, 30)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == len(sets) == 30
    assert all(not (7 - i in s) for s in sets for i in s)


def test_sets_of_equal_names_are_told_apart(spark, monkeypatch):
    names = ngram_join.names_of
    monkeypatch.setattr(ngram_join, "names_of", lambda x, offs, salt=0x1234567F: names(x, offs, salt) if salt == ngram_join.SECOND else names(x, offs, salt) % 7)
    texts = near_copies()[:60]
    got = ngram_join.join(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_join(texts, 3, 90, 100)


def test_forest_spans_and_is_small():
    rng = np.random.default_rng(6)
    for _ in range(30):
        near = rng.random((12, 12)) < 0.15
        near |= near.T
        np.fill_diagonal(near, False)
        pairs = ngram_join.forest(near)
        reach = np.linalg.matrix_power(np.eye(12, dtype=int) + near, 12) > 0
        of = np.arange(12)
        for x, y in pairs:
            assert near[x, y] and of[x] != of[y]
            of[of == of[y]] = of[x]
        assert ((of[:, None] == of[None]) == reach).all()


def as_table(spark, x, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "vectors.parquet")
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))}), path)
    return spark.read.parquet(path)


def recall(rows, x, every):
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    parts = []
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -np.inf
        parts.append(len(got[q] & set(np.argpartition(-s, 20)[:20].tolist())) / 20)
    return np.mean(parts)


@pytest.mark.parametrize("shape", ["isotropic", "clusters", "one long vector", "256 components"])
def test_recall_at_size(spark, tmp_path, shape):
    rng = np.random.default_rng(3)
    n = 10_000 if shape.startswith("256") else 50_000
    x = rng.normal(size=(n, 256 if shape.startswith("256") else 64))
    if shape == "clusters":
        x = rng.normal(size=(400, 64))[rng.integers(0, 400, n)] * 2 + x * 0.7
    if shape == "one long vector":
        x[7] *= 10
    assert recall(ann.nearest(as_table(spark, x, tmp_path), every=1000).collect(), x, 1000) >= 0.9


def test_recall_of_small_groups_with_short_vectors(spark, tmp_path):
    """Four groups of 100 that are nearest to each other only, with norms from 1 down to 0.03 of a component: recall group by group."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 40)) * np.r_[np.ones(32), np.zeros(8)]
    for g, scale in enumerate((1.0, 0.3, 0.1, 0.03)):
        rows = np.arange(100) * 200 + 10 * g  # 0, 200, ... are queries of the first group, and so on
        x[rows] = scale * (np.eye(40)[32 + 2 * g] * 3 + rng.normal(size=(100, 40)) * np.r_[np.zeros(32 + 2 * g), 0.5, 0.5, np.zeros(6 - 2 * g)])
    got = ann.nearest(as_table(spark, x, tmp_path), every=10).where("query_id % 200 in (0, 10, 20, 30, 100)").collect()
    x = x.astype(np.float32).astype(float)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for g in (0, 10, 20, 30, 100):
        parts = []
        for q in range(g, 20_000, 200):
            s = x @ x[q]
            s[q] = -np.inf
            best = np.argpartition(-s, 20)[:20]
            parts.append(len(found[q] & set(best.tolist())) / 20)
        assert np.mean(parts) >= 0.9, (g, np.mean(parts))


def test_norms_without_squares(spark):
    """Vectors whose squares are lost or overflow take part as any others; only the direction tells their neighbours apart."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[1::2] *= 1e-200
    x[0::30] *= 1e150
    assert ann.bands(np.array([[1e-200, 0.0], [3e-320, 0.0], [1e150, 1e150], [1.0, 0.0], [1.5, 0.0]])).tolist() == [math.ceil(2 * math.log2(v)) for v in (1e-200, 3e-320, math.sqrt(2) * 1e150, 1.0, 1.5)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(rows, every=15).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    parts = []
    for q in range(0, 300, 15):
        s = (x * x[q]).sum(1)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        parts.append(len(set(found[q]) & set(best)) / 20)
    assert min(parts[1::2]) >= 0.7 and np.mean(parts) >= 0.9


def test_candidates_come_from_probed_buckets_only(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(5).normal(size=(4000, 32))
    table = as_table(spark, x, tmp_path)
    full = recall(ann.nearest(table, every=100).collect(), x, 100)
    monkeypatch.setattr(ann, "MOST_PROBES", 25)
    assert full >= 0.9 > 0.6 > recall(ann.nearest(table, every=100, tables=2).collect(), x, 100)


def test_farness_is_where_a_probe_reaches():
    rng = np.random.default_rng(1)
    family = ann.Family(8, 6, 3, 2.5, 4)
    q, x = rng.normal(size=(40, 8)), rng.normal(size=(40, 8))
    far = ann.farness(family, q, x)
    own, borders = family.asked(q)
    sets = ann.as_matrix(ann.sequence(6, 10**6), 6)
    costs = sets @ np.array(ann.expected(6))
    keys = family.cells(x) @ family.mark
    for i in range(40):
        hit = [costs[j] for t in range(3) for j in np.flatnonzero(own[i, t] @ family.mark + sets @ family.steps(borders)[i, t] == keys[i, t])]
        assert far[i] == pytest.approx(min(hit, default=np.inf))


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_BYTES", 64 * 8 * 4)
    x = np.random.default_rng(9).normal(size=(1500, 4))
    x[500:1200] = x[500]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(rows).where("query_id = 500").orderBy("rank").collect()]
    s = (x * x[500]).sum(1)
    best = sorted((i for i in range(1500) if i != 500), key=lambda i: (-s[i], i))[:20]
    assert len(set(got)) == 20 and len({v for v, _ in got} & set(best)) >= 18


def test_repeated_ids_do_not_depend_on_partitions(spark):
    rows = [(i % 40, [float((7 * i * j) % 11) - 5 for j in range(1, 5)]) for i in range(160)] + [(3, [0.0] * 4), (5, None), (5, [float("nan")] * 4)]
    frames = [spark.createDataFrame(r, "vec_id long, embedding array<double>").repartition(p) for r, p in ((rows, 1), (rows[::-1], 1), (rows, 8))]
    for operator in (lambda f: ann.nearest(f, every=10), lambda f: topk.top_k(f, every=10)):
        results = [sorted(map(tuple, operator(f).collect())) for f in frames]
        assert results[0] == results[1] == results[2] and results[0]
