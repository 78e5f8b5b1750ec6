"""Nearest neighbours against brute force."""
import numpy as np
from pyspark.sql import functions as F

from frostline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, node long, query string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, wanted, top=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    dim = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, dim - len(v)))) for i, v in good]
    out = {}
    for at, (i, v) in enumerate(good):
        if wanted(i):
            out[i] = sorted(((-float(v @ w), j) for k, (j, w) in enumerate(good) if k != at))[:top]
    return out


def check(got, want, exact=True):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        scores = {j: -s for s, j in want[q]}
        for r in rows:
            if r.vec_id in scores:
                assert abs(scores[r.vec_id] - r.score) < 1e-12
        hits += len({r.vec_id for r in rows} & set(scores))
        total += len(want[q])
        if exact:
            assert [r.vec_id for r in rows] == [j for _, j in want[q]]
    return hits / max(1, total)


def test_recall_on_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()], lambda i: i % 20 == 0)
    assert check(ann.nearest(rows, F.col("vec_id") % 20 == 0).collect(), want, exact=False) >= 0.95


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(45)]              # a hot vector
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5),
             (None, [1.0] * 6), (205, []), (206, [0.5, 0.5]), (220, [-0.0, 0.0, 3.0, 0.0, 0.0, 0.0])]
    want = brute(rows, lambda i: i % 20 == 0)
    check(ann.nearest(make(spark, rows), F.col("vec_id") % 20 == 0).collect(), want)


def test_few_and_none(spark):
    assert ann.nearest(make(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(make(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).count() == 0
    two = [(0, [1.0, 2.0]), (1, [2.0, 1.0])]
    check(ann.nearest(make(spark, two), F.col("vec_id") % 20 == 0).collect(), brute(two, lambda i: i % 20 == 0))
    same = [(i, [1.0, 2.0]) for i in range(30)]
    check(ann.nearest(make(spark, same), F.col("vec_id") % 20 == 0).collect(), brute(same, lambda i: i % 20 == 0))


def test_different_norms(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.1, 5)).tolist()) for i in range(400)]
    want = brute(rows, lambda i: i % 20 == 0)
    assert check(ann.nearest(make(spark, rows), F.col("vec_id") % 20 == 0).collect(), want, exact=False) >= 0.9


def test_hub_keeps_its_own_neighbours(spark):
    """A node that 2,000 list: its own neighbours, which nobody else lists, are found, and the closest of the 2,000."""
    rng = np.random.default_rng(5)
    n, own, listing = 2033, list(range(1, 33)), list(range(33, 2033))
    vec = np.concatenate([np.ones((33, 8)) + rng.uniform(-0.01, 0.01, (33, 8)), rng.uniform(-0.5, 0.5, (2000, 8))])
    vec[33:38] = 0.9
    unit = np.concatenate([vec, np.zeros((n, 1))], axis=1).astype(np.float16)
    nodes = spark.createDataFrame([(i, v.tobytes(), u.tobytes()) for i, (v, u) in enumerate(zip(vec, unit, strict=True))], "node long, vec binary, unit binary")
    score = (vec @ vec[0]).tolist()
    graph = spark.createDataFrame([(0, own, [score[i] for i in own], [False] * 32)] + [(i, [0], [score[i]], [False]) for i in listing], ann._GRAPH)
    beam = {r.peer for r in ann.search(spark.createDataFrame([(0,)], "node long"), nodes, graph).collect()}
    assert {*own, *range(33, 38)} <= beam


def test_large_group_of_close_vectors(spark):
    """A thousand vectors that differ by less than 16-bit floats can tell."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((1500, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[1:1000] = v[0] + 2e-5 * rng.standard_normal((999, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    wanted = lambda i: i % 20 == 0 and i < 1000
    got = ann.nearest(make(spark, rows), (F.col("vec_id") % 20 == 0) & (F.col("vec_id") < 1000)).collect()
    assert check(got, brute(rows, wanted), exact=False) >= 0.9
