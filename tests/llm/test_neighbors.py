import numpy as np

from cohort.llm import neighbors


def brute(rows, asked, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.all(np.isfinite(v)) and np.any(v)]
    out = {}
    for i, q in good:
        if i in asked:
            scored = sorted((-float(q @ v / np.sqrt((q @ q) * (v @ v))), j) for j, v in good if j != i)
            out[i] = [j for _, j in scored[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=24).astype(np.float32).tolist()) for k in range(3000)]
    frame = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    out = neighbors.nearest(frame, frame.filter("vec_id % 50 = 0")).toPandas()
    want = brute(rows, set(range(0, 3000, 50)))
    assert (out.groupby("query_id").size() == 5).all() and set(out.query_id) == set(want)
    recall = np.mean([len(set(g.vec_id) & set(want[q])) / 5 for q, g in out.groupby("query_id")])
    assert recall >= 0.9
    vec = dict(rows)
    for r in out.itertuples():
        a, b = np.array(vec[r.query_id], np.float64), np.array(vec[r.vec_id], np.float64)
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert out.sort_values(["query_id", "rank"]).groupby("query_id").score.apply(lambda s: s.is_monotonic_decreasing).all()


def test_small_tables_are_searched_whole_with_ties_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (9, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbors.nearest(frame, frame.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 2), (0, 2, 3), (0, 3, 50), (50, 1, 0), (50, 2, 2), (50, 3, 3)]
    assert neighbors.nearest(frame.limit(0)).count() == 0
    assert neighbors.nearest(frame.filter("vec_id = 0")).count() == 0


def test_many_copies_and_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else rng.normal(size=3).tolist()) for k in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbors.nearest(frame, frame.filter("vec_id % 50 = 0")).toPandas()
    want = brute(rows, set(range(0, 400, 50)))
    for q, g in out.sort_values("rank").groupby("query_id"):
        if q % 3 == 0:
            assert g.vec_id.tolist() == want[q]
    valid = neighbors.usable(frame, "vec_id", "embedding")
    pivots = neighbors.choose_pivots(valid)
    assert len(np.unique(pivots.round(9), axis=0)) == len(pivots)
    index = neighbors.build_index(valid, pivots, 20)
    parts = [sorted(map(tuple, neighbors.search(index, valid.filter("key % 50 = 0"), pivots, prefix=20, block=b).collect())) for b in (2, 100)]
    assert parts[0] == parts[1]
