"""Reductions along rows (an expression of the row), along columns (partial and final aggregates by column) and of all.

NaN wins in min, max and their positions, as in NumPy.  Integer sums are 64-bit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rowforge.functions import dtypes as dt
from rowforge.functions.ufuncs import INTEGER


def result_dtype(name: str, dtype: np.dtype) -> np.dtype:
    """NumPy's dtype of a reduction."""
    if name in ("all", "any"):
        return np.dtype(bool)
    if name in ("argmin", "argmax"):
        return np.dtype(np.int64)
    if name in ("mean", "var", "std"):
        return dtype if dtype.kind == "f" else np.dtype(float)
    if name in ("sum", "prod"):
        return dtype if dtype.kind == "f" else np.dtype(np.int64)
    return dtype


def _number(x: Column, dtype: np.dtype) -> Column:
    return dt.working(x, dtype, np.float64 if dtype.kind == "f" else np.int64)


def row_value(name: str, values: Column, width: int, dtype: np.dtype) -> Column:
    """A reduction of one row's array."""
    floating = dtype.kind == "f"
    kind = "double" if floating else "bigint"

    def folded(start, step) -> Column:
        return F.aggregate(values, F.lit(start).cast(kind), lambda a, x: step(a, _number(x, dtype)))

    if name == "sum":
        return folded(0, lambda a, x: a + x)
    if name == "prod":
        return folded(1, (lambda a, x: a * x) if floating else INTEGER["multiply"])
    if name == "all":
        return F.forall(values, lambda x: dt.working(x, dtype, bool))
    if name == "any":
        return F.exists(values, lambda x: dt.working(x, dtype, bool))
    if name in ("mean", "var", "std"):
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + dt.working(x, dtype, np.float64)) / F.lit(float(width))
        if name == "mean":
            return mean
        off = F.element_at(F.transform(F.array(mean), lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(dt.working(x, dtype, np.float64) - m, F.lit(2.0)))), 1) / F.lit(float(width))
        return F.sqrt(off) if name == "std" else off
    best = F.array_min(values) if name.endswith("min") else F.array_max(values)
    if floating and name.endswith("min"):
        best = F.when(F.exists(values, F.isnan), F.lit(float("nan")).cast(dt.spark_type(dtype))).otherwise(best)
    if name in ("min", "max"):
        return best
    return F.element_at(F.transform(F.array(values), lambda v: F.array_position(v, F.element_at(F.transform(F.array(best), lambda b: b), 1)) - 1), 1)


def group_value(name: str, x: Column, at: Column, dtype: np.dtype) -> Column:
    """A reduction as an aggregate over elements x, at positions `at`."""
    floating = dtype.kind == "f"
    if name == "sum":
        return F.sum(_number(x, dtype))
    if name == "prod":
        return F.product(_number(x, dtype))
    if name == "mean":
        return F.avg(dt.working(x, dtype, np.float64))
    if name == "var":
        return F.var_pop(dt.working(x, dtype, np.float64))
    if name == "std":
        return F.stddev_pop(dt.working(x, dtype, np.float64))
    if name == "all":
        return F.bool_and(dt.working(x, dtype, bool))
    if name == "any":
        return F.bool_or(dt.working(x, dtype, bool))
    if name == "max":
        return F.max(x)
    if name == "min":
        return F.when(F.bool_or(F.isnan(x)), F.lit(float("nan")).cast(dt.spark_type(dtype))).otherwise(F.min(x)) if floating else F.min(x)
    if name == "argmin":
        number = F.isnan(x) if floating else F.lit(False)
        return F.min(F.struct((~number).alias("a"), x.alias("b"), at.alias("c")))["c"]
    return -F.max(F.struct(x.alias("a"), (-at).alias("b")))["b"]


def reduce(name: str, array, axis: int | None):
    """axis 1: a vector by rows; axis 0: a vector by columns (of a 1-D array: a scalar); None: a scalar."""
    from rowforge.operators.array import from_rows

    dtype, out = array.dtype, result_dtype(name, array.dtype)
    cast = lambda c: c.cast(dt.spark_type(out))
    if array.ndim == 2 and axis == 1:
        if not array.width and name in ("min", "max", "argmin", "argmax"):
            raise ValueError(f"{name} of no values")
        column = cast(row_value(name, array.value(), array.width, dtype))
        return array._like(leaves=[], scalars=[column], build=lambda e, s: s[0], dtype=out, width=None)
    if array.ndim == 2 and axis == 0:
        if name == "prod" and out.kind != "f":
            return _integer_products(array)
        rows = array.to_long().groupBy("j").agg(cast(group_value(name, F.col("x"), F.col("i"), dtype)).alias("x"))
        return from_rows(rows.select(F.col("j").cast("bigint").alias("i"), "x"), out, None, array.width)
    return _scalar(name, array, out)


def _scalar(name: str, array, out: np.dtype):
    dtype = array.dtype
    if name == "prod" and out.kind != "f":
        vector = array if array.ndim == 1 else reduce("prod", array, 1)
        return out.type(_integer_products(vector.astype(out)[:, None]).asndarray()[0])
    if array.ndim == 1:
        rows = array.to_df().agg(group_value(name, F.col("x"), F.col("i"), dtype).alias("x"), F.count("*").alias("n"))
    elif name in ("sum", "prod", "min", "max", "all", "any"):  # of the rows' own reductions
        part = reduce(name, array, 1)
        rows = part.to_df().agg(group_value(name, F.col("x"), F.col("i"), part.dtype).alias("x"), F.count("*").alias("n"))
    else:
        flat = F.col("i") * F.lit(array.width) + F.col("j")
        rows = array.to_long().agg(group_value(name, F.col("x"), flat, dtype).alias("x"), F.count("*").alias("n"))
    got = rows.first()
    if got.x is None:
        if name in ("sum", "prod"):
            return out.type(0 if name == "sum" else 1)
        if name in ("all", "any"):
            return np.bool_(name == "all")
        if name in ("mean", "var", "std"):
            return out.type(np.nan)
        raise ValueError(f"{name} of no values")
    return out.type(got.x)


def _integer_products(array):
    """Wrapping products down the columns: each partition's, then the partitions' in one short fold a column."""
    from rowforge.operators.array import from_rows

    width = array.width

    def run(batches):
        total = np.ones(width, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                values = np.asarray(batch.column(0).flatten()).reshape(-1, width).astype(np.int64)
                total = total * np.prod(values, axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int64()), pa.array(total)], names=["i", "x"])

    parts = array.astype(np.int64).to_df().select("v").mapInArrow(run, "i bigint, x bigint")
    fold = F.aggregate(F.collect_list("x"), F.lit(1).cast("bigint"), INTEGER["multiply"])
    return from_rows(parts.groupBy("i").agg(fold.alias("x")), np.int64, None, width)
