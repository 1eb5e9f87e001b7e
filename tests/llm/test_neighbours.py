import numpy as np
import pytest

from tessella.llm import neighbours
from tessella.llm.common import table


def exact(rows, every=20, nearest=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in zip(ids, x, strict=True):
        if q % every == 0:
            s = x @ v
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:nearest]
            out[q] = [int(ids[k]) for k in order]
    return out


def test_recall_against_brute_force(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = {}
    for r in neighbours.nearest_neighbours(vectors, shard=700).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = exact(rows)
    x = {i: np.array(v, float) for i, v in rows}
    assert got.keys() == want.keys()
    assert np.mean([len({r.vec_id for r in got[q]} & set(want[q])) / 20 for q in want]) >= 0.95
    for q, rs in got.items():
        assert [r.rank for r in rs] == list(range(1, 21)) and [r.score for r in rs] == sorted((r.score for r in rs), reverse=True)
        assert all(r.score == pytest.approx(float(x[q] @ x[r.vec_id]), abs=1e-12) for r in rs)


def test_pruning_keeps_no_neighbour_behind_another():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(80, 5))
    own = np.arange(6)
    kept = neighbours.prune(points, own, np.tile(np.arange(80), (6, 1)), degree=79, relax=1.2)
    for i, row in zip(own, kept, strict=True):
        d = lambda a, b: np.linalg.norm(points[a] - points[b])
        slow, left = [], sorted(set(range(80)) - {i}, key=lambda j: d(i, j))
        while left:
            slow.append(left.pop(0))
            left = [j for j in left if 1.2 * d(slow[-1], j) > d(i, j)]
        assert [j for j in row if j >= 0] == slow


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (20, [0.5, 0.5], "a"), (1, [2.0, 2.0], "a"), (2, [2.0, 2.0], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (40, [float("nan"), 1.0], "a"), (5, [None, 1.0], "a"), (None, [1.0, 1.0], "a"), (6, [float("inf"), 1.0], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest_neighbours(frame).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.5), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 0.5)]
    assert neighbours.nearest_neighbours(frame.limit(0)).count() == 0
    twice = frame.filter("vec_id in (0, 1)").unionByName(frame.filter("vec_id = 0"))
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest_neighbours(twice).collect()] == [(0, 1)]


def test_copies_stay_in_the_index(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-8, 9, (1000, 16)).astype(float)
    copies = np.concatenate([np.repeat(x[:1], 440, axis=0), np.repeat(x[1:4], 20, axis=0)])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(1500), np.concatenate([x, copies]), strict=True)]
    # queries beside a group of copies, whose answers are the least ids of it
    rows += [(2000 + 20 * k, (3 * x[k] + rng.integers(0, 2, 16)).tolist()) for k in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact(rows)
    for shard in (2000, 700):
        got = {}
        for r in neighbours.nearest_neighbours(frame, shard=shard).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got.keys() == want.keys()
        assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95
        assert all(got[q] == want[q] for q in range(2000, 2080, 20))


def test_vectors_of_different_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(90)] + [(200, [1.0] * 9)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, nearest=4).collect()
    by_id = dict(rows)
    for q in range(0, 90, 10):
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        others = [i for i in by_id if i != q and len(by_id[i]) == len(by_id[q])]
        assert own == sorted(others, key=lambda i: (-np.dot(by_id[i], by_id[q]), i))[:4]
    assert not [r for r in got if r.query_id == 200]
