import math

import numpy as np

from pathloom.llm import topk


def brute(rows, k=5, every=50):
    v = {}
    fine = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in fine:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in fine if j != i and len(w) == len(q))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out), v


def test_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    r = np.random.default_rng(0)
    data = [(i, r.normal(size=40).astype(np.float32).tolist()) for i in range(400)]
    data += [(i, data[7][1]) for i in range(400, 460)]  # one common vector: ties
    data += [(None, data[0][1]), (500, None), (501, [None] * 40), (502, [math.nan] * 40), (503, [math.inf] * 40), (504, [0.0] * 40), (550, [1.0, 2.0]), (551, [3.0, -1.0]), (600, [])]
    df = spark.createDataFrame([(*x, 1) for x in data], "vec_id long, embedding array<float>, rank int").repartition(3)
    assert rows(topk.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(brute(data)[0], key=repr)
    assert topk.top_k(df.limit(0)).count() == 0


def test_blocks_with_pruning():
    r = np.random.default_rng(1)
    base = r.normal(size=(64, 3000)) * np.exp(-np.arange(64) / 8)[:, None]
    v = np.floor(256 * base).astype(np.int64)
    q, ids = v[:, ::100], np.arange(3000)
    rows, found, score = topk.search_block(ids[::100], q, ids, v, 5)
    full = q.T @ v
    for j in range(30):
        s = full[j].copy()
        s[j * 100] = -(10**12)
        best = sorted(zip((-s).tolist(), ids.tolist(), strict=True))[:5]
        assert [(x, y) for x, y in zip(score[rows == j].tolist(), found[rows == j].tolist(), strict=True)] == [(-a, b) for a, b in best]


def test_large_components():
    v = np.array([[2**30, -(2**30), 5]], np.int64)
    _, ids, score = topk.search_block(np.array([0]), v[:, :1], np.arange(3), v, 2)
    assert list(zip(ids.tolist(), score.tolist(), strict=True)) == [(2, 5 * 2**30), (1, -(2**60))]


def test_pairs_are_dropped_early():
    r = np.random.default_rng(2)
    ids = np.arange(4000)
    falling = np.floor(256 * r.normal(size=(64, 4000)) * np.exp(-np.arange(64) / 8)[:, None]).astype(np.int64)
    alive: list[float] = []
    topk.search_block(ids[::50], falling[:, ::50], ids, falling, 5, alive=alive)
    assert alive[32 // topk.STEP - 1] < 0.05
    # random directions: nothing goes early, but with a floor most goes before the end
    even = r.normal(size=(64, 4000))
    even = np.floor(256 * even / np.linalg.norm(even, axis=0)).astype(np.int64)
    score = (even.T @ even)[::50]
    floors = np.sort(score, axis=1)[:, -6].astype(float)
    alive = []
    topk.search_block(ids[::50], even[:, ::50], ids, even, 5, floors, alive)
    assert alive[48 // topk.STEP - 1] < 0.3 and alive[-1] < 0.05
    for f in (None, floors):
        rows, found, best = topk.search_block(ids[::50], even[:, ::50], ids, even, 5, f)
        for j in range(80):
            s = score[j].copy()
            s[j * 50] = -(10**9)
            want = sorted(zip((-s).tolist(), ids.tolist(), strict=True))[:5]
            assert [(-x, y) for x, y in zip(best[rows == j].tolist(), found[rows == j].tolist(), strict=True)] == want
