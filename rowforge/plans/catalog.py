"""Named queries over the driver's tables, each with its SQL twin where SQL can say it.

Arrays come out flat: (i, j, x) for two dimensions, (i, x) for one, (x) for a scalar; doubles are rounded to six
places on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.functions import api as rf
from rowforge.operators import array as arrays
from rowforge.sources import zarr
from rowforge.sources.staging import shared_dir

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

E_SQL = "E AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(j AS INTEGER) AS j, x FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings))"
C_SQL = "C AS (SELECT CAST(c_custkey AS BIGINT) AS i, CAST(0 AS INTEGER) AS j, CAST(c_nationkey AS DOUBLE) AS x FROM customer UNION ALL SELECT c_custkey, 1, c_acctbal FROM customer)"
P_SQL = "P AS (SELECT CAST(p_partkey AS BIGINT) AS i, p_size AS x FROM part)"
V_SQL = "V AS (SELECT CAST(event_id AS BIGINT) AS i, value AS x FROM events)"
O_SQL = "O AS (SELECT CAST(o_orderkey AS BIGINT) AS i, o_totalprice AS x FROM orders)"


def embeddings(spark, sf_dir):
    """(n, 64) doubles."""
    return rf.from_parquet(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", width=64).astype(float)


def customers(spark, sf_dir):
    """(n, 2): nation and balance."""
    return rf.from_parquet(spark, f"{sf_dir}/customer.parquet", "c_custkey", ["c_nationkey", "c_acctbal"])


def sizes(spark, sf_dir):
    """(n,) int32: parts' sizes."""
    return rf.from_parquet(spark, f"{sf_dir}/part.parquet", "p_partkey", "p_size")


def event_values(spark, sf_dir):
    return rf.from_parquet(spark, f"{sf_dir}/events.parquet", "event_id", "value")


def order_prices(spark, sf_dir):
    return rf.from_parquet(spark, f"{sf_dir}/orders.parquet", "o_orderkey", "o_totalprice")


def flat(got, spark) -> DataFrame:
    """An array, scalar or DataFrame as the flat form that is compared."""
    if isinstance(got, DataFrame):
        return got
    if not isinstance(got, rf.Array):
        value = got.item() if isinstance(got, np.generic) else got
        return spark.range(1).select(F.round(F.lit(value), 6).alias("x") if isinstance(value, float) else F.lit(value).cast("boolean" if isinstance(value, bool) else "bigint").alias("x"))
    df = got.to_long()
    return df.withColumn("x", F.round("x", 6) + F.lit(0.0)) if dict(df.dtypes)["x"] in ("double", "float") else df


def register(name: str, make: Callable, sql: str, source: Callable) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(make(source(spark, sf_dir)), spark)
    ORACLE[name] = sql


def element(name: str, make: Callable, x: str, source: Callable = embeddings, table: str = "E", head: str = E_SQL, floating: bool = True, where: str = "") -> None:
    """A query whose elements are one SQL expression of x."""
    two = table in ("E", "C")
    value = f"round(CAST({x} AS DOUBLE), 6) + 0.0" if floating else x
    register(name, make, f"WITH {head} SELECT i, {'j, ' if two else ''}{value} AS x FROM {table} {where}", source)


# --- elementwise ------------------------------------------------------------------------------------------

for _name, _make, _x in (
    ("identity", lambda e: e, "x"),
    ("copy", lambda e: e.copy(), "x"),
    ("scalar_add", lambda e: e + 1.5, "x + 1.5"),
    ("scalar_sub", lambda e: 2 - e, "2 - x"),
    ("scalar_mul", lambda e: e * 3, "x * 3"),
    ("scalar_div", lambda e: e / 0.25, "x / 0.25"),
    ("scalar_chained", lambda e: 5 - (e * 0.5 - 3) / (e + 8) * 7, "5 - (x * 0.5 - 3) / (x + 8) * 7"),
    ("floor_div", lambda e: e // 0.1, "floor(x / 0.1)"),
    ("mod", lambda e: (e * 1000).round() % 7, "((round_even(x * 1000, 0) % 7) + 7) % 7"),
    ("power", lambda e: e**2, "pow(x, 2)"),
    ("self_mul", lambda e: e * e, "x * x"),
    ("arithmetic_mix", lambda e: e * 2 + e, "x * 2 + x"),
    ("in_place", lambda e: e.__iadd__(1), "x + 1"),
    ("out_argument", lambda e: np.multiply(e, 2, out=e), "x * 2"),
    ("maximum", lambda e: np.maximum(e, 0.1), "greatest(x, 0.1)"),
    ("minimum", lambda e: np.minimum(e, e * 2), "least(x, x * 2)"),
    ("arctan2", lambda e: np.arctan2(e, e + 1), "atan2(x, x + 1)"),
    ("hypot", lambda e: np.hypot(e, 1.0), "sqrt(x * x + 1)"),
    ("copysign", lambda e: np.copysign(0.5, e), "CASE WHEN x < 0 THEN -0.5 ELSE 0.5 END"),
    ("clip", lambda e: e.clip(-0.1, 0.1), "least(greatest(x, -0.1), 0.1)"),
    ("logaddexp", lambda e: np.logaddexp(e, 0.2), "ln(exp(x) + exp(0.2))"),
    ("fmod", lambda e: np.fmod(e * 10, 0.75), "x * 10 - trunc(x * 10 / 0.75) * 0.75"),
    ("heaviside", lambda e: np.heaviside(e, 0.5), "CASE WHEN x < 0 THEN 0 WHEN x = 0 THEN 0.5 ELSE 1 END"),
    ("same_shape_add", lambda e: e + (e - 1), "x + (x - 1)"),
    ("fmax", lambda e: np.fmax(e, np.log(e)), "CASE WHEN x > 0 THEN greatest(x, ln(x)) ELSE x END"),
    ("fmin", lambda e: np.fmin(np.sqrt(e), 0.2), "CASE WHEN x >= 0 THEN least(sqrt(x), 0.2) ELSE 0.2 END"),
    ("modf_fraction", lambda e: np.modf(e * 10)[0], "x * 10 - trunc(x * 10)"),
    ("modf_whole", lambda e: np.modf(e * 10)[1], "trunc(x * 10)"),
    ("frexp_mantissa", lambda e: np.frexp(e)[0], "CASE WHEN x = 0 THEN 0 ELSE x / pow(2, floor(log2(abs(x))) + 1) END"),
    ("arrow_nextafter", lambda e: np.nextafter(e, 9.0), "x"),
):
    element(_name, _make, _x)

for _name, _x in (
    ("log1p", "ln(1 + x)"), ("exp", "exp(x)"), ("exp2", "pow(2, x)"), ("expm1", "exp(x) - 1"), ("square", "x * x"), ("cbrt", "cbrt(x)"), ("absolute", "abs(x)"), ("negative", "-x"), ("sign", "sign(x)"),
    ("sin", "sin(x)"), ("cos", "cos(x)"), ("tan", "tan(x)"), ("sinh", "sinh(x)"), ("cosh", "cosh(x)"), ("tanh", "tanh(x)"), ("arcsin", "asin(x)"), ("arccos", "acos(x)"), ("arctan", "atan(x)"),
    ("arcsinh", "asinh(x)"), ("arctanh", "atanh(x)"), ("degrees", "degrees(x)"), ("radians", "radians(x)"), ("reciprocal", "1 / x"),
):
    element(f"unary_{_name}", lambda e, f=getattr(np, _name): f(e), _x)
for _name, _x in (("sqrt", "sqrt(abs(x))"), ("log", "ln(abs(x))"), ("log2", "log2(abs(x))"), ("log10", "log10(abs(x))")):
    element(f"unary_{_name}", lambda e, f=getattr(np, _name): f(np.abs(e)), _x)
for _name, _x in (("floor", "floor(x * 10)"), ("ceil", "ceil(x * 10)"), ("trunc", "trunc(x * 10)"), ("rint", "round_even(x * 10, 0)")):
    element(f"unary_{_name}", lambda e, f=getattr(np, _name): f(e * 10), _x)
for _name, _x in (("isnan", "isnan(x)"), ("isfinite", "isfinite(x)"), ("isinf", "isinf(x)"), ("signbit", "x < 0")):
    element(f"unary_{_name}", lambda e, f=getattr(np, _name): f(e), _x, floating=False)
element("log_of_negative_is_nan", lambda e: np.isnan(np.log(e)), "x < 0", floating=False)
element("divide_by_zero_is_infinite", lambda e: np.isinf(e / 0.0), "x <> 0", floating=False)
element("astype_int", lambda c: c.astype(int), "CAST(trunc(x) AS BIGINT)", customers, "C", C_SQL, floating=False)
element("astype_float32", lambda c: c.astype(np.float32).astype(float), "CAST(CAST(x AS FLOAT) AS DOUBLE)", customers, "C", C_SQL)
element("astype_bool", lambda c: c.astype(bool), "x <> 0", customers, "C", C_SQL, floating=False)

for _name, _make, _x in (
    ("cmp_eq", lambda v: v == 24, "x = 24"), ("cmp_ne", lambda v: v != 24, "x <> 24"), ("cmp_lt", lambda v: v < 24, "x < 24"), ("cmp_le", lambda v: v <= 24, "x <= 24"), ("cmp_gt", lambda v: v > 24, "x > 24"), ("cmp_ge", lambda v: v >= 24, "x >= 24"),
    ("invert_mask", lambda v: ~(v > 24), "NOT x > 24"), ("mask_and", lambda v: (v > 10) & (v < 30), "x > 10 AND x < 30"), ("mask_or", lambda v: (v < 10) | (v > 30), "x < 10 OR x > 30"), ("mask_xor", lambda v: (v > 10) ^ (v > 30), "(x > 10) <> (x > 30)"),
    ("logical_not", lambda v: np.logical_not(v - 24), "x = 24"), ("logical_xor", lambda v: np.logical_xor(v - 24, v > 30), "(x <> 24) <> (x > 30)"),
    ("bitwise_and", lambda v: v & 12, "x & 12"), ("bitwise_or", lambda v: v | 65, "x | 65"), ("bitwise_xor", lambda v: v ^ 21, "xor(x, 21)"), ("bitwise_not", lambda v: ~v, "-x - 1"), ("left_shift", lambda v: v << 3, "x << 3"), ("right_shift", lambda v: v >> 2, "x >> 2"),
    ("int_floor_div", lambda v: (v - 30) // 7, "CAST(floor((x - 30) / 7.0) AS INTEGER)"), ("int_mod", lambda v: (v - 30) % 7, "CAST((((x - 30) % 7) + 7) % 7 AS INTEGER)"), ("int_negative_mod", lambda v: v % -7, "CAST(-((7 - x % 7) % 7) AS INTEGER)"),
    ("divmod_whole", lambda v: np.divmod(v, 7)[0], "CAST(x // 7 AS INTEGER)"), ("divmod_rest", lambda v: np.divmod(v, 7)[1], "CAST(x % 7 AS INTEGER)"), ("frexp_exponent", lambda v: np.frexp(v)[1], "CAST(floor(log2(x)) + 1 AS INTEGER)"),
    ("int_wraps", lambda v: v.astype(np.int8) * np.int8(5), "CAST(((x * 5 + 128) % 256) - 128 AS TINYINT)"), ("arrow_gcd", lambda v: np.gcd(v, 36), "CAST(gcd(x, 36) AS INTEGER)"),
):
    element(_name, _make, _x, sizes, "P", P_SQL, floating=False)

# --- broadcasting -----------------------------------------------------------------------------------------

ROW = np.arange(64) / 10.0
element("row_broadcast_add", lambda e: e + ROW, "x + j / 10.0")
element("row_broadcast_mul", lambda e: ROW * e, "x * (j / 10.0)")
register("center_columns", lambda e: e - e.mean(axis=0), f"WITH {E_SQL} SELECT i, j, round(x - avg(x) OVER (PARTITION BY j), 6) + 0.0 AS x FROM E", embeddings)
register("scale_columns", lambda e: e / e.std(axis=0), f"WITH {E_SQL} SELECT i, j, round(x / stddev_pop(x) OVER (PARTITION BY j), 6) + 0.0 AS x FROM E", embeddings)
register("normalize_rows", lambda e: np.exp(e) / np.sum(np.exp(e), axis=1)[:, np.newaxis], f"WITH {E_SQL} SELECT i, j, round(exp(x) / sum(exp(x)) OVER (PARTITION BY i), 6) + 0.0 AS x FROM E", embeddings)
register("col_broadcast_add", lambda e: e + np.sum(e, axis=1)[:, np.newaxis], f"WITH {E_SQL} SELECT i, j, round(x + sum(x) OVER (PARTITION BY i), 6) + 0.0 AS x FROM E", embeddings)
register("row_operand_array", lambda e: e * e.max(axis=0) + e[7:8].sum(axis=0), f"WITH {E_SQL} SELECT i, j, round(x * max(x) OVER (PARTITION BY j) + max(x) FILTER (i = 7) OVER (PARTITION BY j), 6) + 0.0 AS x FROM E", embeddings)
QUERIES["cross_source_add"] = lambda spark, sf_dir: flat(_first(order_prices(spark, sf_dir), event_values(spark, sf_dir)), spark)
ORACLE["cross_source_add"] = f"WITH {O_SQL}, {V_SQL} SELECT O.i, round(O.x + V.x, 6) + 0.0 AS x FROM O JOIN V ON O.i = V.i"


def _first(a, b):
    """Two tables of different sources, by position, over all rows that both have."""
    n = min(len(a), len(b))
    return a[:n] + b[:n]


# --- selection --------------------------------------------------------------------------------------------

for _name, _make, _sql in (
    ("row_slice", lambda e: e[100:200, :], "SELECT i - 100 AS i, j, round(x, 6) + 0.0 AS x FROM E WHERE i >= 100 AND i < 200"),
    ("row_slice_step", lambda e: e[10:400:3], "SELECT CAST((i - 10) / 3 AS BIGINT) AS i, j, round(x, 6) + 0.0 AS x FROM E WHERE i >= 10 AND i < 400 AND (i - 10) % 3 = 0"),
    ("row_slice_negative", lambda e: e[-20:], "SELECT i - (SELECT max(i) - 19 FROM E) AS i, j, round(x, 6) + 0.0 AS x FROM E WHERE i > (SELECT max(i) - 20 FROM E)"),
    ("row_reverse", lambda e: e[::-1], "SELECT (SELECT max(i) FROM E) - i AS i, j, round(x, 6) + 0.0 AS x FROM E"),
    ("row_mask", lambda e: e[e[:, 0] > 0].densified(), "SELECT CAST(dense_rank() OVER (ORDER BY i) - 1 AS BIGINT) AS i, j, round(x, 6) + 0.0 AS x FROM E WHERE i IN (SELECT i FROM E WHERE j = 0 AND x > 0)"),
    ("row_take_ints", lambda e: e[np.array([7, 3, 3, 250])], "SELECT k AS i, j, round(x, 6) + 0.0 AS x FROM E JOIN (VALUES (0::BIGINT, 7), (1, 3), (2, 3), (3, 250)) t(k, place) ON i = place"),
    ("bool_index_rowsum", lambda e: np.sum(e, axis=1)[np.sum(e, axis=1) > 0], "SELECT i, round(x, 6) + 0.0 AS x FROM (SELECT i, sum(x) AS x FROM E GROUP BY i) WHERE x > 0"),
    ("col_slice", lambda e: e[:, 10:20], "SELECT i, CAST(j - 10 AS INTEGER) AS j, round(x, 6) + 0.0 AS x FROM E WHERE j >= 10 AND j < 20"),
    ("col_slice_step", lambda e: e[:, ::-2], "SELECT i, CAST((63 - j) / 2 AS INTEGER) AS j, round(x, 6) + 0.0 AS x FROM E WHERE j % 2 = 1"),
    ("col_mask", lambda e: e[:, np.arange(64) % 5 == 0], "SELECT i, CAST(j / 5 AS INTEGER) AS j, round(x, 6) + 0.0 AS x FROM E WHERE j % 5 = 0"),
    ("col_take", lambda e: e[:, [5, 1, 5]], "SELECT i, CAST(k AS INTEGER) AS j, round(x, 6) + 0.0 AS x FROM E JOIN (VALUES (0, 5), (1, 1), (2, 5)) t(k, place) ON j = place"),
    ("col_one", lambda e: e[:, -1], "SELECT i, round(x, 6) + 0.0 AS x FROM E WHERE j = 63"),
    ("newaxis", lambda e: np.sum(e, axis=1)[:, np.newaxis], "SELECT i, CAST(0 AS INTEGER) AS j, round(sum(x), 6) + 0.0 AS x FROM E GROUP BY i"),
):
    register(_name, _make, f"WITH {E_SQL} {_sql.replace('(i - 10) / 3', '(i - 10) // 3').replace('(63 - j) / 2', '(63 - j) // 2').replace('j / 5 AS', 'j // 5 AS')}", embeddings)
QUERIES["int_index"] = lambda spark, sf_dir: spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(embeddings(spark, sf_dir)[3])], "j int, x double")
ORACLE["int_index"] = f"WITH {E_SQL} SELECT j, round(x, 6) AS x FROM E WHERE i = 3"

# --- reductions -------------------------------------------------------------------------------------------

for _name, _agg, _floating in (
    ("sum", "sum(x)", True), ("prod", "product(x)", True), ("min", "min(x)", True), ("max", "max(x)", True), ("mean", "avg(x)", True), ("var", "var_pop(x)", True), ("std", "stddev_pop(x)", True),
    ("all", "bool_and(x > -0.5)", False), ("any", "bool_or(x > 0.4)", False),
):
    _source = {"all": lambda e: e > -0.5, "any": lambda e: e > 0.4, "prod": lambda e: e * 8}.get(_name, lambda e: e)
    _agg = "product(x * 8)" if _name == "prod" else _agg
    _places = 2 if _name == "prod" else 6
    _value = f"round({_agg}, {_places}) + 0.0" if _floating else _agg
    if _name != "prod":
        register(f"{_name}_axis0", lambda e, n=_name, s=_source: getattr(np, n)(s(e), axis=0), f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, {_value} AS x FROM E GROUP BY j", embeddings)
        register(f"{_name}_axis1", lambda e, n=_name, s=_source: getattr(np, n)(s(e), axis=1), f"WITH {E_SQL} SELECT i, {_value} AS x FROM E GROUP BY i", embeddings)
        register(f"{_name}_all", lambda e, n=_name, s=_source: getattr(np, n)(s(e)), f"WITH {E_SQL} SELECT {_value} AS x FROM E", embeddings)
    else:  # of factors near one, whose product stays in reach
        _near = "round(product(1 + x / 100), 6) + 0.0"
        register("prod_axis0", lambda e: np.prod(e / 100 + 1, axis=0), f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, {_near} AS x FROM E GROUP BY j", embeddings)
        register("prod_axis1", lambda e: np.prod(e / 100 + 1, axis=1), f"WITH {E_SQL} SELECT i, {_near} AS x FROM E GROUP BY i", embeddings)
        register("prod_all", lambda e: np.prod(e / 100000 + 1), f"WITH {E_SQL} SELECT round(product(1 + x / 100000), 6) + 0.0 AS x FROM E", embeddings)
for _name, _order in (("argmin", "ASC"), ("argmax", "DESC")):
    register(f"{_name}_axis0", lambda e, n=_name: getattr(np, n)(e, axis=0), f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, first(i ORDER BY x {_order}, i) AS x FROM E GROUP BY j", embeddings)
    register(f"{_name}_axis1", lambda e, n=_name: getattr(np, n)(e, axis=1), f"WITH {E_SQL} SELECT i, CAST(first(j ORDER BY x {_order}, j) AS BIGINT) AS x FROM E GROUP BY i", embeddings)
    register(f"{_name}_all", lambda e, n=_name: getattr(np, n)(e), f"WITH {E_SQL} SELECT first(i * 64 + j ORDER BY x {_order}, i, j) AS x FROM E", embeddings)
register("variance_recipe", lambda e: np.multiply(e, e).mean(axis=0) - e.mean(axis=0) ** 2, f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, round(avg(x * x) - pow(avg(x), 2), 6) + 0.0 AS x FROM E GROUP BY j", embeddings)
register("log1p_colsum", lambda e: np.log1p(e).sum(axis=0), f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, round(sum(ln(1 + x)), 6) + 0.0 AS x FROM E GROUP BY j", embeddings)
register("ptp_axis0", lambda e: np.ptp(e, axis=0), f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, round(max(x) - min(x), 6) + 0.0 AS x FROM E GROUP BY j", embeddings)
register("nansum_axis0", lambda e: np.nansum(np.sqrt(e), axis=0), f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, round(sum(sqrt(x)) FILTER (x >= 0), 6) + 0.0 AS x FROM E GROUP BY j", embeddings)
register("keepdims_axis1", lambda e: e - e.mean(axis=1, keepdims=True), f"WITH {E_SQL} SELECT i, j, round(x - avg(x) OVER (PARTITION BY i), 6) + 0.0 AS x FROM E", embeddings)

# --- order ------------------------------------------------------------------------------------------------

register("median_all", lambda e: float(np.median(e)), f"WITH {E_SQL} SELECT round(median(x), 6) AS x FROM E", embeddings)
register("median_axis0", lambda e: np.median(e, axis=0), f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, round(median(x), 6) + 0.0 AS x FROM E GROUP BY j", embeddings)
register("median_axis1", lambda e: np.median(e, axis=1), f"WITH {E_SQL} SELECT i, round(median(x), 6) + 0.0 AS x FROM E GROUP BY i", embeddings)
register("percentile_axis0", lambda e: np.percentile(e, 37.5, axis=0), f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, round(quantile_cont(x, 0.375), 6) + 0.0 AS x FROM E GROUP BY j", embeddings)
register("percentile_axis1", lambda e: np.percentile(e, 90, axis=1), f"WITH {E_SQL} SELECT i, round(quantile_cont(x, 0.9), 6) + 0.0 AS x FROM E GROUP BY i", embeddings)
register("quantile_vector", lambda v: float(np.quantile(v, 0.99)), f"WITH {V_SQL} SELECT round(quantile_cont(x, 0.99), 6) AS x FROM V", event_values)
register("cumsum_axis0", lambda e: np.cumsum(e, axis=0), f"WITH {E_SQL} SELECT i, j, round(sum(x) OVER (PARTITION BY j ORDER BY i), 6) + 0.0 AS x FROM E", embeddings)
register("cumsum_axis1", lambda e: np.cumsum(e, axis=1), f"WITH {E_SQL} SELECT i, j, round(sum(x) OVER (PARTITION BY i ORDER BY j), 6) + 0.0 AS x FROM E", embeddings)
register("cumsum_vector", lambda v: np.cumsum(v), f"WITH {P_SQL} SELECT i, CAST(sum(x) OVER (ORDER BY i) AS BIGINT) AS x FROM P", sizes)
register("cumprod_axis0", lambda e: np.cumprod(e / 1000 + 1, axis=0), f"WITH {E_SQL} SELECT i, j, round(product(x / 1000 + 1) OVER (PARTITION BY j ORDER BY i), 6) + 0.0 AS x FROM E", embeddings)
register("sort_axis1", lambda e: np.sort(e, axis=1), f"WITH {E_SQL} SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY x, j) - 1 AS INTEGER) AS j, round(x, 6) + 0.0 AS x FROM E", embeddings)
register("argsort_axis1", lambda e: np.argsort(e, axis=1), f"WITH {E_SQL} SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY x, j) - 1 AS INTEGER) AS j, CAST(j AS BIGINT) AS x FROM E", embeddings)
register("sort_vector", lambda v: np.sort(v), f"WITH {V_SQL} SELECT CAST(row_number() OVER (ORDER BY x, i) - 1 AS BIGINT) AS i, round(x, 6) + 0.0 AS x FROM V", event_values)
register("argsort_vector", lambda v: np.argsort(v), f"WITH {P_SQL} SELECT CAST(row_number() OVER (ORDER BY x, i) - 1 AS BIGINT) AS i, CAST(i AS BIGINT) AS x FROM P", sizes)
register("unique_values", lambda v: np.unique(v), f"WITH {P_SQL} SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS BIGINT) AS i, x FROM (SELECT DISTINCT x FROM P)", sizes)

# --- products ---------------------------------------------------------------------------------------------

FACTOR = (np.arange(64 * 3).reshape(64, 3) % 7 - 3) / 4.0
register("matmul_driver_matrix", lambda e: e @ FACTOR, f"WITH {E_SQL} SELECT i, CAST(k AS INTEGER) AS j, round(sum(x * ((j * 3 + k) % 7 - 3) / 4.0), 6) + 0.0 AS x FROM E CROSS JOIN range(3) r(k) GROUP BY i, k", embeddings)
_PRODUCT = f"WITH {E_SQL} SELECT a.i, b.j, round(sum(a.x * b.x), 6) + 0.0 AS x FROM E a JOIN E b ON a.j = b.i WHERE b.i < 64 GROUP BY a.i, b.j"
register("matmul_arrays", lambda e: e @ e[:64], _PRODUCT, embeddings)
register("matmul_joined", lambda e: arrays._joined_product(e, e[:64]), _PRODUCT, embeddings)
register("int_sum", lambda v: v.sum(), f"WITH {P_SQL} SELECT CAST(sum(x) AS BIGINT) AS x FROM P", sizes)
register("int_max", lambda v: v.max().astype(int), f"WITH {P_SQL} SELECT CAST(max(x) AS BIGINT) AS x FROM P", sizes)
register("count_nonzero_axis0", lambda c: np.count_nonzero(c > 10, axis=0), f"WITH {C_SQL} SELECT CAST(j AS BIGINT) AS i, count(*) FILTER (x > 10) AS x FROM C GROUP BY j", customers)

# --- constructors, partitions, storage --------------------------------------------------------------------

QUERIES["zeros_colsum"] = lambda spark, sf_dir: flat(np.sum(rf.zeros(spark, (1000, 5), (100, 5), int), axis=0), spark)
ORACLE["zeros_colsum"] = "SELECT CAST(range AS BIGINT) AS i, CAST(0 AS BIGINT) AS x FROM range(5)"
QUERIES["ones_colsum"] = lambda spark, sf_dir: flat(np.sum(rf.ones(spark, (1000, 5), (100, 5), int), axis=0), spark)
ORACLE["ones_colsum"] = "SELECT CAST(range AS BIGINT) AS i, CAST(1000 AS BIGINT) AS x FROM range(5)"
register("repartition_sizes", lambda v: v.repartition(700).chunk_sizes(700), f"WITH {P_SQL} SELECT CAST(i // 700 AS BIGINT) AS chunk, count(*) AS n FROM P GROUP BY 1", sizes)
register("repartition_after_mask", lambda v: v[v > 10].chunk_sizes(500), f"WITH {P_SQL} SELECT CAST(k // 500 AS BIGINT) AS chunk, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY i) - 1 AS k FROM P WHERE x > 10) GROUP BY 1", sizes)


def _stored(array, spark, chunk: int, ncopies: int = 1, mapping: bool = False):
    """The array written and read back, in the folder that driver and executors share and nowhere else."""
    path = f"{zarr.local_path(shared_dir(spark))}/zarr/{uuid.uuid4().hex}"
    store = zarr.Folder(path) if mapping else path
    array.to_zarr(store, (chunk, array.width), ncopies)
    return rf.from_zarr(spark, store)


QUERIES["zarr_roundtrip"] = lambda spark, sf_dir: flat(_stored(embeddings(spark, sf_dir) * 2, spark, 128), spark)
ORACLE["zarr_roundtrip"] = f"WITH {E_SQL} SELECT i, j, round(x * 2, 6) + 0.0 AS x FROM E"
QUERIES["zarr_mapping"] = lambda spark, sf_dir: flat(_stored(embeddings(spark, sf_dir) - 1, spark, 100, mapping=True), spark)
ORACLE["zarr_mapping"] = f"WITH {E_SQL} SELECT i, j, round(x - 1, 6) + 0.0 AS x FROM E"
QUERIES["zarr_ncopies"] = lambda spark, sf_dir: flat(_stored(customers(spark, sf_dir), spark, 100, 3), spark)
ORACLE["zarr_ncopies"] = f"WITH {C_SQL} SELECT CAST(i + k * (SELECT max(i) + 1 FROM C) AS BIGINT) AS i, j, round(x, 6) + 0.0 AS x FROM C CROSS JOIN range(3) r(k)"


def _both(spark, sf_dir):
    c = customers(spark, sf_dir)
    sums, means = rf.evaluate(c.sum(axis=1), c.mean(axis=1))
    return spark.createDataFrame([(k, round(float(a), 6), round(float(b), 6)) for k, (a, b) in enumerate(zip(sums, means, strict=True))], "i bigint, total double, mean double")


QUERIES["evaluate_many"] = _both
ORACLE["evaluate_many"] = f"WITH {C_SQL} SELECT i, round(sum(x), 6) AS total, round(avg(x), 6) AS mean FROM C GROUP BY i"
