"""Whitening and code compression against plain versions; edge cases."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from helpers import SF001, SF01, assert_equals_sql, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frostline.llm import codes, vectors, whitening
from frostline.llm.oracle import ORACLE
from frostline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, x string, members long, z int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "a", 5, 1) for i, v, lab in rows], SCHEMA)


def _whole(v, scale, size=0):
    x = [math.floor(Fraction(c) * scale) for c in v]
    return x + [0] * (size - len(x))


def _good(rows):
    return [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def _plain_whitening(rows, scale=256, components=4, counts=False):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by plain numpy."""
    rows = _good(rows)
    size = max(len(v) for _, v, _ in rows)
    xs = [tuple(_whole(v, scale, size)) for _, v, _ in rows]
    fit = xs if counts else sorted(set(xs))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array(fit, float) - np.array(s, float) / n
    e, vec = np.linalg.eigh(m.T @ m / n)
    out = []
    for (i, _, _), x in zip(rows, xs):
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for c in range(min(components, size)):
            if e[-1 - c] > 1e-10 * e.sum():
                z = (np.array(x, float) - np.array(s, float) / n) @ vec[:, -1 - c] / math.sqrt(e[-1 - c])
                out.append((i, c + 1, n, dev, abs(z), e[-1 - c] / e.sum()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


def _check_whitening(got, want):
    got = sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got),
                 key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-7, atol=1e-7)


ODD = [(1, None, 1), (2, [0.5, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1)]


def _rows(n=120, size=6, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(0, [9, 5, 3, 2, 1, 1][:size]).tolist(), int(i) % 3 or None) for i in range(10, 10 + n)]
    hot = [0.25, -0.0, 1.5, -2.0, 0.125, 3.0][:size]
    return rows + [(1000 + i, hot, 7) for i in range(n // 2)] + [(None, hot, None), (10, hot, 1)] + ODD


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_equals_plain(spark, weights):
    rows = _rows()
    got = whitening.whiten(_table(spark, rows).repartition(5), weights=weights).collect()
    _check_whitening(got, _plain_whitening(rows, counts=weights == "counts"))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_whitening_pads_short_vectors_and_leaves_flat_components_out(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [2.0], 1), (3, [], 1), (4, [1.0, 2.0], 1)]
    got = whitening.whiten(_table(spark, rows)).collect()
    _check_whitening(got, _plain_whitening(rows))
    line = [(i, [float(i), 2.0 * i], 1) for i in range(5)]
    assert {r.component for r in whitening.whiten(_table(spark, line)).collect()} == {1}
    for flat in ([], [(1, [1.0, 2.0], 1)], [(1, [], 1)], ODD):
        out = whitening.whiten(_table(spark, flat))
        assert out.collect() == [] and out.columns[:2] == ["vec_id", "component"]


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(i, [1e6 * i, -3e6 + i * i, float(7 * i % 5)], 1) for i in range(9)] + [(99, [1e300, 0.0, 0.0], 1)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(_table(spark, rows)).collect()}
    xs = {i: [max(-vectors.LARGEST, min(vectors.LARGEST, c)) for c in _whole(v, 256)] for i, v, _ in rows}
    s = [sum(c) for c in zip(*xs.values())]
    assert got == {i: sum((len(xs) * a - b) ** 2 for a, b in zip(x, s)) for i, x in xs.items()}


def test_whitening_query_on_whole_table(spark):
    got = QUERIES["op11_embedding_whitening"](spark, SF01).collect()
    rows = [(r.vec_id, [float(c) for c in r.embedding], r.label) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    _check_whitening(got, _plain_whitening(rows))
    assert got[0].identity_error < 1e-8


def _plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    rows = _good(rows)
    size = max(len(v) for _, v, _ in rows)
    size = -(-size // parts) * parts
    width = size // parts
    xs = [_whole(v, scale, size) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, xs[j]))[:entries]
    cut = [[tuple(x[p * width:(p + 1) * width]) for p in range(parts)] for x in xs]
    books = [[cut[j][p] for j in order] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = [near(c[p], books[p])[1] for c in cut]
            books[p] = [tuple(sum(col) // len(own) for col in zip(*own)) if (own := [c[p] for c, g in zip(cut, got) if g == k]) else e
                        for k, e in enumerate(books[p])]
    final = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    out = [(rows[j][0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), rows[j][2]) for j, f in enumerate(final)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    by = {}
    for _, _, e, lab in out:
        by[lab] = by.get(lab, 0) + e
    return sorted((str(i), c, e, by[lab]) for i, c, e, lab in out), digest


@pytest.mark.parametrize("rows,entries", [(_rows(60), 16), (_rows(20, 3), 256), ([(1, [1.0], None), (1, [1.0], None), (2, [-2.5, 7.0, 1.0, 0.0, 9.0], 3)], 2),
                                          ([(i, [1e300 * (-1) ** i, i * 1e5, 3.0, 4.0], 1) for i in range(1, 8)][1:] + [(50, [3.5, 1.0], 1)], 3)])
def test_codes_equal_plain(spark, rows, entries):
    coded, books = codes.compress(_table(spark, rows).repartition(4), entries=entries)
    got = codes.with_label_errors(coded).collect()
    if any(abs(c) > 1e7 for _, v, _ in _good(rows) for c in v):     # entries beyond the limit stay at it
        rows = [(i, [max(-vectors.LARGEST / 1024, min(vectors.LARGEST / 1024, c)) for c in v], lab) for i, v, lab in rows]
    want, digest = _plain_codes(rows, entries=entries)
    assert sorted((str(r.vec_id), r.code, int(r.error), int(r.label_error)) for r in got) == want
    assert codes.books_digest(books) == digest


def test_codes_of_nothing(spark):
    for rows in ([], ODD, [(1, [], 1)]):
        coded, books = codes.compress(_table(spark, rows))
        assert codes.with_label_errors(coded).collect() == [] and books == []


def test_codes_query_equals_sql(spark):
    assert_equals_sql(QUERIES["op12_vector_codes"](spark, SF01), duck(SF01, "embeddings"), ORACLE["op12_vector_codes"])


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_search_is_exact(data):
    size = data.draw(st.integers(1, 9))
    reach = data.draw(st.sampled_from([2, 50, 2**20, 2**31 - 1]))
    vec = st.lists(st.integers(-reach, reach), min_size=size, max_size=size)
    p = np.array(data.draw(st.lists(vec, min_size=1, max_size=12)), np.int64)
    c = np.array(data.draw(st.lists(vec, min_size=1, max_size=12)), np.int64)
    entry, dist = codes.nearest_entries(p, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)), k) for k, v in enumerate(c)) for u in p]
    assert [(int(d), int(e)) for d, e in zip(dist, entry)] == want


def test_coefficients_come_by_sign_changes():
    for size in (1, 2, 8, 32):
        h = codes.transform(np.eye(size, dtype=np.int64))
        assert (np.diff(h, axis=0) != 0).sum(0).tolist() == list(range(size))
        assert (h @ h.T == size * np.eye(size)).all()


def test_hot_groups_are_broadcast_and_the_rest_joined(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(None)).otherwise(F.col("id") % 1200).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("members"), F.sum("id").alias("total"))
    got = vectors.join_groups(rows, groups, "k", "members")
    assert got.columns == ["k", "id", "total"] and got.count() == 3000
    want = {r.k: r.total for r in groups.collect()}
    assert all(r.total == want[r.k] for r in got.collect())
