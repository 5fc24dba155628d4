"""NumPy dtypes and the Spark types that hold them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPARK = {"b1": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "f2": "float", "f4": "float", "f8": "double"}


def spark_type(dtype) -> str:
    """The Spark type for a dtype; unsigned ones are held in the next wider signed one."""
    code = np.dtype(dtype).str[1:]
    if code not in _SPARK:
        raise TypeError(f"dtype {np.dtype(dtype)} is not supported")
    return _SPARK[code]


def numpy_dtype(spark_name: str) -> np.dtype:
    """The dtype of a Spark numeric type."""
    for code, name in _SPARK.items():
        if name == spark_name and code[0] != "u" and code != "f2":
            return np.dtype(code)
    raise TypeError(f"Spark type {spark_name} has no dtype")


def wrapped(x: Column, dtype) -> Column:
    """A bigint in the range of an integer dtype, as NumPy wraps it."""
    dtype = np.dtype(dtype)
    bits = 8 * dtype.itemsize
    if dtype.kind == "u":
        x = x.bitwiseAND(F.lit((1 << bits) - 1))
    elif bits < 64:
        x = (x + F.lit(1 << (bits - 1))).bitwiseAND(F.lit((1 << bits) - 1)) - F.lit(1 << (bits - 1))
    return x.cast(spark_type(dtype))


def working(x: Column, dtype, loop) -> Column:
    """x, held for dtype, as the type that a loop over dtype `loop` works in: double, bigint or boolean."""
    kind, own = np.dtype(loop).kind, np.dtype(dtype).kind
    if kind == "f":
        return x.cast("int").cast("double") if own == "b" else x.cast("double")
    if kind in "iu":
        return x.cast("int").cast("bigint") if own == "b" else x.cast("bigint")
    return x if own == "b" else x != F.lit(0).cast(spark_type(dtype))


def converted(x: Column, dtype, to) -> Column:
    """x cast as `astype` does: towards zero, wrapping, and NaN or infinity to the least integer."""
    dtype, to = np.dtype(dtype), np.dtype(to)
    if to.kind == "b":
        return working(x, dtype, to)
    if to.kind == "f":
        return working(x, dtype, to).cast(spark_type(to))
    if dtype.kind == "f":
        x = x.cast("double")
        x = F.when(F.isnan(x) | (F.abs(x) >= F.lit(2.0**63)), F.lit(-(1 << 63))).otherwise(x.cast("bigint"))
    return wrapped(working(x, np.int64 if dtype.kind == "f" else dtype, np.int64), to)
