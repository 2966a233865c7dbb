import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfeed.llm.ann import search, walk
from loomfeed.llm.embedding_dedup import hadamard, near_duplicates

KIND = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    out, i = [], 0
    for b in base:
        for _ in range(rng.integers(1, 8)):
            out.append((i, (b + 0.12 * rng.standard_normal(16)).tolist(), int(rng.integers(0, 2))))
            i += 1
    out += [(i + k, out[0][1], out[0][2]) for k in range(6)]
    i += 6
    out += [(i, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [1.0] * 15 + [None], 0), (i + 3, [float("nan")] * 16, 0), (i + 4, [float("inf")] * 16, 0), (i + 5, out[0][1], None), (i + 6, [], 0), (i + 7, [1.0, 2.0], 0), (i + 8, [1.0, 2.0], 0), (None, out[0][1], 0)]
    return out


def usable(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)


@pytest.mark.parametrize("block", [2000, 3])
def test_near_duplicates_equal_brute_force(spark, rows, block):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, KIND).withColumn("rep", F.lit(0)), tables=10, probes=6, block=block).collect()}
    ok = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and usable(v) and lab is not None]
    links = {i: set() for i, *_ in rows}
    for i, v, a in ok:
        for j, u, b in ok:
            if i != j and a == b and len(u) == len(v) and v @ u / np.linalg.norm(v) / np.linalg.norm(u) >= 0.93:
                links[i].add(j)
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        want = (len(links[i]), i if i is None else min(seen), i is not None and min(seen) == i)
        assert got[i] == want, i


def test_production_parameters_on_the_embeddings_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in t.collect() if usable(r.embedding) and r.label is not None]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in rows])
    label = np.array([lab for *_, lab in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r.n_links for r in near_duplicates(t).collect()}
    have = np.array([got[i] for i, *_ in rows])
    assert (have <= near.sum(1)).all() and have.sum() >= 0.99 * near.sum()
    ids, v = np.array([i for i, *_ in rows]), np.stack([v for _, v, _ in rows])
    found = {}
    for r in search(t, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    best = {q: [i for i in ids[np.argsort(-(v @ v[ids == q][0]), kind="stable")].tolist() if i != q][:20] for q in found}
    assert len(found) == (ids % 20 == 0).sum() and np.mean([len(found[q] & set(best[q])) / 20 for q in found]) >= 0.9


def test_empty_and_repeated_vectors(spark):
    df = spark.createDataFrame([], KIND)
    assert near_duplicates(df).count() == 0 and search(df, F.col("vec_id") % 2 == 0).count() == 0
    two = near_duplicates(spark.createDataFrame([(1, [1.0, 0.5], 3), (1, [1.0, 0.5], 3)], KIND)).collect()
    assert [(r.n_links, r.component_id) for r in two] == [(1, 1), (1, 1)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 32))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_walk_is_in_order():
    rng = np.random.default_rng(2)
    books = (rng.standard_normal((7, 4)), rng.standard_normal((5, 4)))
    q = rng.standard_normal(8)
    cells = walk(q, books, np.ones(35, int), 35)
    cost = [-(books[0][c // 5] @ q[:4]) - (books[1][c % 5] @ q[4:]) for c in cells]
    assert sorted(cells) == list(range(35)) and cost == sorted(cost)


def test_search_recall_and_order(spark, rows):
    df = spark.createDataFrame(rows, KIND).withColumn("cell", F.lit(1))
    got = {}
    for r in search(df, F.col("vec_id") % 5 == 0, k=10, centroids=8, block=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = {i: np.array(v) for i, v, _ in rows if i is not None and usable(v) and len(v) == 16}
    hit = n = 0
    assert set(got) == {i for i in ok if i % 5 == 0}
    for q, found in got.items():
        found.sort()
        scores = sorted(((-(ok[q] * v).sum(), i) for i, v in ok.items() if i != q))[:10]
        assert [r for r, *_ in found] == list(range(1, 11))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - ok[q] @ ok[i]) < 1e-12 for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in scores})
        n += 10
    assert hit / n >= 0.9


def test_search_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (20, [0.5, 1.0], 0)], KIND)
    got = sorted(tuple(r) for r in search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
