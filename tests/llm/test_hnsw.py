import math

import numpy as np
import pytest

from stromlage.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, k=5):
    """query id -> [(id, score)] by comparing with every row."""
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            seen = {
                (i, tuple(b)): float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) for i, b in ok if i != q and len(a) == len(b)
            }
            out[q] = sorted(((i, s) for (i, _), s in seen.items()), key=lambda x: (-x[1], x[0]))[:k]
    return out


def search(df, **options):
    got = {}
    for r in hnsw.nearest_neighbours(df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_recall_against_brute_force(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in df.collect()]), search(df)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found / (5 * len(want)) >= 0.95
    score = {q: dict(x) for q, x in want.items()}
    assert all(s == pytest.approx(score[q][i], abs=1e-12) for q in got for i, s in got[q] if i in score[q])


def test_many_shards_and_query_groups(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 64 * 8 * 300)
    monkeypatch.setattr(hnsw, "QUERY_BYTES", 64 * 8 * 10)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in df.collect()]), search(df)
    assert hnsw.build_index(df).count() > 3
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found / (5 * len(want)) >= 0.98


def test_close_groups_stay_reachable():
    """A third of the vectors in one close group, many pairs, and single ones."""
    random = np.random.default_rng(3)
    group = random.normal(size=16) + 0.01 * random.normal(size=(1000, 16))
    single = random.normal(size=(1000, 16))
    vectors = np.vstack([group, single, single + 0.001 * random.normal(size=(1000, 16))])
    graph, order = hnsw.build(vectors, np.arange(3000))
    asked = hnsw.unit(vectors[::7])
    found = order[hnsw.search(graph, asked.astype("f4"))[:, :5]]
    best = np.argsort(-(asked @ hnsw.unit(vectors).T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.tolist(), best.tolist())]) > 0.97


def test_odd_rows_ties_and_copies(spark):
    e = [1.0, 0.0, 2.0]
    rows = [
        (0, e), (50, e), (51, e), (52, e), (53, e), (54, e), (55, e), (56, e), (100, [2.0, 0.0, 4.0]), (57, [-1.0, 0.0, 0.5]),
        (150, None), (200, []), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 1.0]), (350, [math.nan, 1.0, 1.0]),
        (400, [math.inf, 1.0, 1.0]), (None, e), (450, [1.0, 1.0]), (1, [3.0, -1.0]), (500, [1e-38, 0.0, 0.0]), (51, e),
        (550, [7.0]), (-50, [0.5, 3.0, 0.1]),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, vector int")
    got, want = search(df), brute([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert got.keys() == {q for q, x in want.items() if x} == {0, 50, 100, 450, 500, -50}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert [i for i, _ in got[0]] == [50, 51, 52, 53, 54]


def test_empty_table_and_no_queries(spark):
    assert hnsw.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hnsw.nearest_neighbours(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0
    assert hnsw.nearest_neighbours(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)).count() == 0
