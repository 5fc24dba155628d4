"""Every operation against NumPy on the same values."""

import numpy as np
import pytest
from numpy.testing import assert_allclose, assert_array_equal

from rowforge.functions import api as rf

X = np.array([[1.5, -2.0, 0.0, 7.0], [3.0, 3.0, -0.25, 0.0], [9.0, 0.5, 4.0, -6.0], [0.0, 0.0, 8.0, 2.5], [-1.0, 5.0, 6.0, 3.0]])
N, M = X.shape


@pytest.fixture(scope="module", params=["ndarray", "zarr"])
def made(request, spark, tmp_path_factory):
    array = rf.from_ndarray(spark, X, (2, M))
    if request.param == "zarr":
        path = str(tmp_path_factory.mktemp("z") / "x.zarr")
        array.to_zarr(path, (2, M))
        return lambda: rf.from_zarr(spark, path)
    return lambda: rf.from_ndarray(spark, X, (2, M))


def same(got, want, exact_dtype=True):
    if isinstance(got, rf.Array):
        assert got.shape == want.shape
        if exact_dtype:
            assert got.dtype == want.dtype
    assert_allclose(np.asarray(got), want, equal_nan=True)


def test_identity_shape_copy(made):
    x = made()
    same(x, X)
    assert (x.ndim, x.size, len(x), x.chunks) == (2, N * M, N, (2, M))
    same(x.copy(), X)
    with pytest.raises(TypeError):
        iter(x)


def test_astype(made):
    x = made()
    y = x.astype(int)
    same(y, X.astype(int))
    before = id(x)
    x = x.astype(int, copy=False)
    assert id(x) == before and x.dtype == np.int64
    same((made() - 2.7).astype(np.int8), (X - 2.7).astype(np.int8))
    same(made().astype(bool), X.astype(bool))


def test_arithmetic(made):
    x = made()
    same(7 - (x * 0.5 + 3) / (x * x + 1), 7 - (X * 0.5 + 3) / (X * X + 1))
    same(x * x - 3 * x, X * X - 3 * X)
    same(0.25 + x, 0.25 + X)
    same(9 / (np.float32(3) + abs(x)), 9 / (np.float32(3) + abs(X)))
    same(x**3, X**3)
    same(x // 1.7, X // 1.7)
    same(x % -2.5, X % -2.5)
    same(-x, -X)
    same(np.arange(M) - x, np.arange(M) - X)
    same(np.multiply(x, x), X * X)
    same(np.add(x, 1, dtype=np.float32), np.add(X, 1).astype(np.float32))


def test_broadcasting(made):
    x, row, column = made(), np.linspace(-1, 2, M), np.linspace(3, 7, N)[:, None]
    same(x + row, X + row)
    same(row * x, row * X)
    same(x + row[None], X + row[None])
    same(x - column, X - column)
    same(column / (x + 11), column / (X + 11))
    same(x / np.sum(abs(x), axis=1)[:, np.newaxis], X / abs(X).sum(1)[:, None])
    same(x - x.mean(axis=0), X - X.mean(0))
    same((x - x.mean(axis=0)) / x.std(axis=0), (X - X.mean(0)) / X.std(0))
    same(x * x.sum(axis=0, keepdims=True), X * X.sum(0, keepdims=True))
    same(x + rf.from_ndarray(x.rows.sparkSession, np.array([2.5])), X + 2.5)
    same(x + X, X + X)
    with pytest.raises(ValueError):
        x + np.ones(M + 1)
    with pytest.raises(ValueError):
        x + rf.from_ndarray(x.rows.sparkSession, np.ones(M + 1))


def test_comparisons_and_masks(made):
    x = made()
    for f in (np.equal, np.not_equal, np.greater, np.less, np.greater_equal, np.less_equal):
        same(f(x, 3), f(X, 3))
    same(~(x == 0.0), ~(X == 0.0))
    same((x > 1) & (x < 5) | (x == 0), (X > 1) & (X < 5) | (X == 0))
    same((x > 1) ^ (x > 3), (X > 1) ^ (X > 3))


def test_in_place(made):
    x = made()
    before = id(x)
    x += 1
    assert id(x) == before
    same(x, X + 1)
    y = made()
    np.multiply(x, 2, out=y)
    same(y, (X + 1) * 2)
    with pytest.raises(ValueError):
        np.add(x, 1, out=x.sum(axis=1))


def test_rows(made):
    x = made()
    assert_allclose(x[0], X[0])
    assert_allclose(x[-1], X[-1])
    for s in (slice(1, 3), slice(0, 2), slice(None, None, 2), slice(-2, None), slice(None, None, -1), slice(4, 0, -2), slice(1, 99), slice(7, 9)):
        same(x[s], X[s])
        same(x[s, :], X[s, :])
    same(x[np.array([True, False, True, False, True]), :], X[[0, 2, 4]])
    same(x[np.array([2, 0, 0, -1])], X[[2, 0, 0, -1]])
    with pytest.raises(IndexError):
        x[N]
    s, t = np.sum(x, axis=1), X.sum(1)
    same(s[s > 7], t[t > 7])
    assert 0 < (t > 7).sum() < N
    same(x[s > 7], X[t > 7])
    same(x[s > 7][0:1] * 2, X[t > 7][0:1] * 2)
    same(x[s > 7] + x[s > 7], X[t > 7] * 2)
    assert x[np.array([1])][0][2] == -0.25


def test_columns(made):
    x = made()
    for c in (slice(1, 3), slice(None, None, 2), slice(None, None, -1), np.array([True, False, False, True]), np.array([1, 3]), [3, -4, 3], slice(3, 2)):
        same((x + 1)[:, c], (X + 1)[:, c])
    same(x[:, 2], X[:, 2])
    same((x + np.arange(M))[:, 1:3], (X + np.arange(M))[:, 1:3])
    same(x[1:3, 1:3], X[1:3, 1:3])
    same(x[..., 1:2], X[..., 1:2])
    same(np.sum(x, axis=1)[:, np.newaxis], X.sum(1)[:, None])


@pytest.mark.parametrize("name", ["sum", "prod", "min", "max", "mean", "all", "any", "argmin", "argmax", "var", "std"])
@pytest.mark.parametrize("axis", [None, 0, 1])
def test_reductions(made, name, axis):
    x = made() - 2
    same(getattr(np, name)(x, axis=axis), getattr(np, name)(X - 2, axis=axis))
    if axis is not None:
        same(getattr(x, name)(axis, keepdims=True), getattr(X - 2, name)(axis, keepdims=True))


def test_integer_and_nan_reductions(spark):
    v = np.array([[3, -1, 2**40], [7, 7, 2**41], [-3, 0, 2**42]])
    a = rf.from_ndarray(spark, v, (2, 3))
    n = np.array([[1.0, np.nan, 3.0], [np.nan, 2.0, 3.0], [0.0, 2.0, -np.inf]])
    b = rf.from_ndarray(spark, n)
    for axis in (None, 0, 1):
        for name in ("sum", "prod", "min", "max", "mean", "argmin", "argmax", "all", "any"):
            same(getattr(a, name)(axis), getattr(v, name)(axis))
            same(getattr(b, name)(axis), getattr(n, name)(axis))
    same(a.sum(0)[1:], v.sum(0)[1:])
    same(a[:, 0].argmax(), v[:, 0].argmax())
    same(np.nansum(b, axis=0), np.nansum(n, axis=0))
    assert np.ptp(a) == np.ptp(v) and np.count_nonzero(a) == 8
    same(np.median(b[:, 2]), np.median(n[:, 2]))
    same(np.median(b, axis=0), np.median(n, axis=0))
    with pytest.raises(TypeError):
        a.sum(0, where=True)


FLOATS = np.array([np.inf, -np.inf, -3, -1, -0.5, -0.0, 0.0, 0.5, 1, 3, 7.25, np.nan])
INTS = np.array([-7, -3, -1, 1, 2, 3, 7, 2**62, -(2**63)])


@pytest.fixture(scope="module")
def grid(spark):
    a, b = (g.ravel()[:, None] for g in np.meshgrid(FLOATS, FLOATS))
    both = rf.from_ndarray(spark, np.hstack([a, b]))
    return both[:, 0:1], both[:, 1:2], a, b


@pytest.mark.parametrize("name", sorted(rf.ufuncs.FLOAT))
def test_float_ufuncs(grid, name):
    f = getattr(np, name)
    x, y, a, b = grid
    with np.errstate(all="ignore"):
        want = f(a, b) if f.nin == 2 else f(a)
    got = f(x, y) if f.nin == 2 else f(x)
    assert got.dtype == want.dtype
    got = np.asarray(got)
    assert_allclose(got, want, rtol=1e-12, atol=1e-300)
    if name in ("arctan2", "copysign", "negative", "absolute", "floor", "ceil", "trunc", "reciprocal"):
        assert_array_equal(np.signbit(got[~np.isnan(want)]), np.signbit(want[~np.isnan(want)]))


@pytest.mark.parametrize("dtype", ["i8", "i4", "u1"])
@pytest.mark.parametrize("name", sorted(set(rf.ufuncs.INTEGER)))
def test_integer_ufuncs(spark, name, dtype):
    f = getattr(np, name)
    values = INTS.astype(dtype)
    a, b = (g.ravel()[:, None] for g in np.meshgrid(values, values))
    if "shift" in name:
        b = np.abs(b.astype(int) % 8).astype(dtype)
    x = rf.from_ndarray(spark, np.hstack([a, b]))
    with np.errstate(all="ignore"):
        want = f(a, b) if f.nin == 2 else f(a)
    got = f(x[:, 0:1], x[:, 1:2]) if f.nin == 2 else f(x[:, 0:1])
    assert got.dtype == want.dtype
    assert_array_equal(np.asarray(got), want)


def test_boolean_ufuncs(spark):
    a, b = np.array([[True, True, False, False]] * 2), np.array([[True, False, True, False]] * 2)
    x = rf.from_ndarray(spark, np.hstack([a, b]))
    for name in rf.ufuncs.BOOLEAN:
        f = getattr(np, name)
        same(f(x[:, 0:4], x[:, 4:8]) if f.nin == 2 else f(x[:, 0:4]), f(a, b) if f.nin == 2 else f(a))
    same(x.sum(1), np.hstack([a, b]).sum(1))
    same(np.mean(x, axis=0), np.hstack([a, b]).mean(0))


def test_ufuncs_without_expression(made, spark):
    x = made()
    same(np.nextafter(x, 9.0), np.nextafter(X, 9.0))
    same(np.spacing(x + 1), np.spacing(X + 1))
    v = np.array([[12, 18], [7, 21]])
    same(np.gcd(rf.from_ndarray(spark, v), np.array([6, 14])), np.gcd(v, [6, 14]))
    same(np.power(rf.from_ndarray(spark, v), 3), v**3)
    whole, part = np.divmod(x, 2)
    same(whole, X // 2)
    same(part, X % 2)
    for got, want in zip(np.modf(x - 0.5), np.modf(X - 0.5), strict=True):
        same(got, want)
    with pytest.raises(TypeError):
        np.add(x, 1, where=np.ones(M, bool))


def test_vectors_and_different_rows(spark, made):
    v, w = np.arange(3.0), np.array([5.0, -1.0, 2.0])
    a, b = rf.from_ndarray(spark, v), rf.from_ndarray(spark, w)
    same(a + b, v + w)
    same(a * w, v * w)
    same(made() + rf.from_ndarray(spark, X * 2), X * 3)
    same(a[::-1] - b, v[::-1] - w)
    same(made() + rf.from_ndarray(spark, np.arange(float(M))), X + np.arange(float(M)))
    with pytest.raises(ValueError):
        np.asarray(a + rf.from_ndarray(spark, np.arange(4.0)))


def test_constants_and_evaluate(spark, made):
    assert_allclose(np.asarray(np.sum(rf.zeros(spark, (N, M), (2, M), int), axis=0)), np.zeros(M))
    o = rf.ones(spark, (N, M), (2, M), dtype=int)
    same(np.sum(o, axis=0), np.full(M, N))
    assert o.dtype == np.int64
    same(rf.full(spark, 4, 2.5), np.full(4, 2.5))
    empty = rf.from_ndarray(spark, np.zeros((0, 3)))
    assert np.asarray(empty + 1).shape == (0, 3) and empty.sum() == 0 and np.isnan(empty.mean())
    with pytest.raises(TypeError):
        rf.from_ndarray(spark, np.array([1j]))
    x = made()
    for got, want in zip(rf.evaluate(x + 1, x + 2, x.sum(1)), (X + 1, X + 2, X.sum(1)), strict=True):
        assert_allclose(got, want)
    for got, want in zip(rf.asndarrays(x + 1, o), (X + 1, np.ones((N, M))), strict=True):
        assert_allclose(got, want)


def test_local_fallback(made):
    x = made()
    assert_allclose(np.diff(x, axis=0), np.diff(X, axis=0))
    with pytest.warns(UserWarning, match="driver"):
        assert_allclose(np.sort(x, axis=0), np.sort(X, axis=0))
    assert_allclose(np.concatenate([x, x]), np.concatenate([X, X]))
    same(x.clip(1, 4), X.clip(1, 4))
    same((x / 3).round(2), (X / 3).round(2))
    assert_allclose(np.asarray(x, dtype=np.float32), X.astype(np.float32))


def test_products_and_reduce(made):
    x, m = made(), np.arange(2.0 * M).reshape(M, 2)
    same(x @ m, X @ m)
    same(x @ m[:, 0], X @ m[:, 0])
    same(np.add.reduce(x), np.add.reduce(X))
    same(np.maximum.reduce(x, axis=1), np.maximum.reduce(X, axis=1))
    for bad in (lambda: m.T @ x, lambda: np.add.accumulate(x)):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        x @ np.ones((M + 1, 2))


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_products_of_arrays(spark, made, monkeypatch, most):
    """A right factor that goes whole to the executors, and one that is joined."""
    from rowforge.operators import array

    monkeypatch.setattr(array, "PRODUCT_SIZE", most)
    m = np.arange(3.0 * M).reshape(M, 3) - 4
    x, b = made(), rf.from_ndarray(spark, m)
    same(x @ b, X @ m)
    same(x @ b[:, 1], X @ m[:, 1])
    with pytest.raises(ValueError):
        b @ b


@pytest.mark.parametrize("axis", [None, 0, 1])
def test_percentiles(spark, made, axis):
    x = made()
    same(np.median(x, axis=axis), np.median(X, axis=axis))
    for q in (0, 12.5, 50, 71, 100):
        same(np.percentile(x, q, axis=axis), np.percentile(X, q, axis=axis))
    same(np.quantile(x, 0.3, axis=axis), np.quantile(X, 0.3, axis=axis))
    if axis != 1:
        same(np.percentile(x, [10, 90, 50], axis=axis), np.percentile(X, [10, 90, 50], axis=axis))
    wild = np.array([[1e300, -1e300, 5e-324, 1.0], [np.inf, 0.0, -0.0, 1.0], [-np.inf, 3.0, 1e-300, 1.0], [2.0, 4.0, 1e-310, 1.0]])
    with np.errstate(all="ignore"):
        for q in (30, 50, 60):
            same(np.percentile(rf.from_ndarray(spark, wild), q, axis=axis), np.percentile(wild, q, axis=axis))
    holes = np.where(X == 3.0, np.nan, X)
    same(np.median(rf.from_ndarray(spark, holes), axis=axis), np.median(holes, axis=axis))
    assert np.isnan(np.median(rf.from_ndarray(spark, np.zeros((0, 2)))))
    with pytest.raises(ValueError):
        np.percentile(x, 101)


def test_percentiles_of_many_close_values(spark):
    """Values that differ in their last bits and far outliers: rounds close in until ends are equal."""
    rng = np.random.default_rng(8)
    v = np.concatenate([1 + rng.integers(0, 4000, 5000) * 2.0**-52, [1e200, -1e200], rng.normal(size=500)])
    a = rf.from_ndarray(spark, v)
    for q in (0.02, 5, 50, 77.7, 99.99):
        assert np.percentile(a, q) == np.percentile(v, q)


@pytest.mark.parametrize("rows", [1_000_000, 2])
def test_running_results_and_order(spark, made, monkeypatch, rows):
    """With one range, and with two rows a range."""
    from rowforge.operators import dense

    monkeypatch.setattr(dense, "ROWS_A_RANGE", rows)
    x, v = made(), np.array([5, 3, -7, 3, 2**40, 0, 5, 5], np.int64)
    for axis in (0, 1):
        same(np.cumsum(x, axis=axis), np.cumsum(X, axis=axis))
        same(np.cumprod(x + 0.5, axis=axis), np.cumprod(X + 0.5, axis=axis))
    a, f = rf.from_ndarray(spark, v), rf.from_ndarray(spark, np.where(v == 3, np.nan, v / 2))
    same(np.cumsum(a), np.cumsum(v))
    same(np.cumprod(a * a), np.cumprod(v * v))  # wraps
    same(np.cumsum(x[x[:, 1] >= 0.5][:, 0]), np.cumsum(X[X[:, 1] >= 0.5][:, 0]))
    same(np.sort(a), np.sort(v))
    same(np.argsort(a), np.argsort(v, kind="stable"))
    same(np.sort(f), np.sort(np.where(v == 3, np.nan, v / 2)))
    same(np.sort(x, axis=1), np.sort(X, axis=1))
    same(np.argsort(x, axis=1), np.argsort(X, axis=1, kind="stable"))
    same(np.unique(a), np.unique(v))
    same(np.unique(x), np.unique(X))
    same(np.unique(f), np.unique(np.where(v == 3, np.nan, v / 2)))


def test_running_results_of_ranges_in_several_files(spark, monkeypatch):
    """Each range stays in one task, as it does not where Spark turns a join into a broadcast as it runs."""
    from rowforge.operators import dense

    monkeypatch.setattr(dense, "ROWS_A_RANGE", 500)
    rng, small = np.random.default_rng(4), "spark.sql.adaptive.coalescePartitions.enabled"
    v, w, was = rng.integers(1, 50, 2000).astype(np.int32), rng.integers(1, 50, (2000, 3)) / 4, spark.conf.get(small)
    try:
        spark.conf.set(small, "false")  # or tables as small as these go to one task
        same(np.cumsum(rf.from_ndarray(spark, v, (70,))), np.cumsum(v))
        same(np.cumsum(rf.from_ndarray(spark, w, (70, 3)), axis=0), np.cumsum(w, axis=0))
        same(np.cumprod(rf.from_ndarray(spark, v, (70,))), np.cumprod(v, dtype=np.int64))  # wraps
    finally:
        spark.conf.set(small, was)


def test_frexp(spark):
    v = np.array([0.0, -0.0, 1.0, -1.0, 0.5, 0.75, -3.7, 2.0**60, 2.0**-60, 1 - 2.0**-53, 1 + 2.0**-52, 1.7e308, 5e-324, -2.2e-310, np.inf, -np.inf, np.nan])
    for got, want in zip(np.frexp(rf.from_ndarray(spark, v)), np.frexp(v), strict=True):
        finite = np.isfinite(v) if want.dtype == np.int32 else slice(None)  # the exponent of an infinity is left open
        assert got.dtype == want.dtype and np.array_equal(np.asarray(got)[finite], want[finite], equal_nan=want.dtype != np.int32)


@pytest.mark.parametrize("rows,item", [([0, 3], slice(0, 3)), ([1], slice(1, 2)), ([0, 2, 4], slice(0, 9)), ([], slice(0, 0)), ([4], slice(3, None))])
def test_rows_across_chunks(made, rows, item):
    x = made()
    same(x[np.array(rows, int)], X[np.array(rows, int)])
    same(x[item, :], X[item, :])


def test_second_moments(made):
    def spread(x):
        return (x * x).mean(axis=0) - np.square(x.mean(axis=0))

    same(spread(made()), spread(X))
