import math
from fractions import Fraction

import numpy as np
import pytest

from casegrid.llm.queries import QUERIES
from casegrid.llm.whitening import pair_squares, whiten

SCHEMA = "vec_id long, embedding array<double>, component int, n string, x string"


def made(spark, rows):
    return spark.createDataFrame([(i, v, 7, "n", "x") for i, v in rows], SCHEMA)


def brute(vectors):
    """Exact covariances of the distinct grid vectors by plain centred products, and exact deviations."""
    grid = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    fit = sorted(set(grid))
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centred = [[n * x - s for x, s in zip(v, sums, strict=True)] for v in fit]
    dims = len(sums)
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in centred), n**3)) for b in range(dims)] for a in range(dims)])
    values, vectors_ = np.linalg.eigh(v)
    white = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(g, sums, strict=True)] for g in grid])
    white = white @ vectors_[:, ::-1][:, :4] / np.sqrt(np.maximum(values[::-1][:4], 1e-300))
    deviation = [sum((n * x - s) ** 2 for x, s in zip(g, sums, strict=True)) for g in grid]
    return n, deviation, white, values[::-1] / np.trace(v)


def agree(rows, ids, vectors, width=4):
    n, deviation, white, share = brute(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * width
    for c in range(1, width + 1):
        own = np.array([got[i, c].whitened for i in ids])
        sign = np.sign(own @ white[:, c - 1])
        assert np.allclose(own * sign, white[:, c - 1], rtol=1e-7, atol=1e-9)
    for i, d in zip(ids, deviation, strict=True):
        r = got[i, 1]
        assert r.n == n and r.deviation == d and abs(r.explained / share[0] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whole_table_equals_brute_force(spark):
    rows = QUERIES["op13_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    agree(rows, [r.vec_id for r in table], [r.embedding for r in table])


def test_rows_that_are_no_vectors_give_nothing_and_repeats_count_once(spark):
    rng = np.random.default_rng(5)
    good = [[float(c) for c in rng.normal(size=5)] for _ in range(40)]
    good += [good[3], [c + 1e-9 for c in good[4]]]  # the same vector, and one on the same point of the grid
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = whiten(made(spark, [*enumerate(good), *((100 + i, v) for i, v in enumerate(bad))]).repartition(3)).collect()
    agree(rows, list(range(len(good))), good)
    twice = whiten(made(spark, [(None, good[0]), (None, good[0]), *enumerate(good[1:])])).collect()
    assert sum(r.vec_id is None for r in twice) == 8


def test_numbers_beyond_64_bits_stay_exact(spark):
    rng = np.random.default_rng(6)
    vectors = [[float(c) * 2.0**40 for c in rng.normal(size=3)] + [float(rng.normal())] for _ in range(30)]
    rows = whiten(made(spark, list(enumerate(vectors)))).collect()
    _, deviation, white, _ = brute(vectors)
    for r in rows:
        assert r.deviation is None and int(r.deviation_digits) == deviation[r.vec_id]
    for c in range(1, 4):
        own = np.array([r.whitened for r in sorted(rows, key=lambda r: r.vec_id) if r.component == c])
        assert np.allclose(np.abs(own), np.abs(white[:, c - 1]), rtol=1e-6, atol=1e-8)
    ends = whiten(made(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [5.0, 3.0])])).collect()
    assert len(ends) == 6 and all(r.n == 3 for r in ends)


@pytest.mark.parametrize("dtype", [np.int64, object])
def test_pair_squares(dtype):
    d = np.array([[1, -2, 3], [4, 0, -7]], dtype=dtype)
    assert [[int(x) for x in row] for row in pair_squares(d)] == [[17, 17, 25], [4, 50], [58]]


def test_degenerate_tables(spark):
    assert whiten(made(spark, [])).count() == 0
    assert whiten(made(spark, [(1, None), (2, [])])).count() == 0
    one = whiten(made(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in one)
    line = whiten(made(spark, [(i, [float(i), float(2 * i)]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and len(line) == 18
