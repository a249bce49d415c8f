import numpy as np

from loanweave.llm import hilbert_search as hs
from loanweave.llm.hilbert import positions

DDL = "vec_id long, embedding array<float>, label int"


def brute(ids, v, query, k):
    at = ids.index(query)
    scores = (v * v[at]).sum(1)
    return sorted((-s, i) for s, i in zip(scores, ids) if i != query)[:k]


def run(spark, rows, k=20, **options):
    vectors = hs.usable(spark.createDataFrame(rows, DDL))
    found = hs.nearest(vectors, vectors.where("id % 20 = 0"), k=k, **options).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_curve_visits_every_cell_by_single_steps():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        place = positions(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_recall_and_exact_scores(spark):
    draw = np.random.default_rng(3)
    v = draw.normal(size=(3000, 24)).astype(np.float32)
    found = run(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)], largest_block=100)
    hit = 0
    for query, answers in found.items():
        truth = brute(list(range(3000)), v.astype(float), query, 20)
        hit += len({i for _, i in truth} & {i for _, i, _ in answers})
        assert [r for r, _, _ in answers] == list(range(1, 21))
        for _, i, score in answers:
            assert score == (v[i].astype(float) * v[query].astype(float)).sum()
        assert [(-s, i) for _, i, s in answers] == sorted((-s, i) for _, i, s in answers)
    assert len(found) == 150 and hit / (150 * 20) >= 0.9


def test_clustered_vectors_have_narrow_windows(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 16)) * 4
    v = [(i, (centres[i % 60] + draw.normal(size=16) * 0.05).tolist(), 0) for i in range(3000)]
    found = run(spark, v, k=5)
    ids, m = list(range(3000)), np.array([x[1] for x in v], np.float32).astype(float)
    hit = sum(len({i for _, i in brute(ids, m, q, 5)} & {i for _, i, _ in a}) for q, a in found.items())
    assert hit / (5 * len(found)) >= 0.9


def test_few_odd_and_equal_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0], 1), (3, [0.5, 0.5], 1), (40, None, 1), (60, [0.0, 0.0], 1), (80, [nan, 1.0], 1),
            (100, [inf, 1.0], 1), (120, [None, 1.0], 1), (None, [1.0, 1.0], 1), (140, [1.0], 1), (160, [], 1),
            (3, [0.5, 0.5], None)]
    rows += [(200 + i, [2.0, 1.0], 1) for i in range(60)]
    found = run(spark, rows)
    assert set(found) == {20, 200, 220, 240}
    assert [i for _, i, _ in found[20]] == list(range(200, 220))
    assert [i for _, i, _ in found[220]] == [i for i in range(200, 221) if i != 220]
    three = run(spark, [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [-1.0, -1.0], 1)])
    assert three == {0: [(1, 1, 4.0), (2, 2, -3.0)]}
    assert run(spark, []) == {}
