"""NumPy-style functions over arrays: constructors, sources, and every ufunc that has an expression."""

from __future__ import annotations

import numpy as np

from rowforge.functions import ufuncs
from rowforge.operators.array import Array, evaluate, from_ndarray, from_table, full, ones, zeros
from rowforge.sources.zarr import from_zarr

asndarrays = evaluate


def from_parquet(spark, path: str, key: str, values, width: int | None = None, n: int | None = None, dtype=None) -> Array:
    """An array of a Parquet table; see from_table."""
    return from_table(spark.read.parquet(path), key, values, width, n, dtype)


def _reduction(name: str):
    def reduce(array: Array, axis=None, **kwargs):
        return getattr(array, name)(axis, **kwargs)

    reduce.__name__ = name
    return reduce


_SAME = {name: getattr(np, name) for table in (ufuncs.FLOAT, ufuncs.INTEGER, ufuncs.BOOLEAN) for name in table}
_REDUCTIONS = {name: _reduction(name) for name in ("sum", "prod", "mean", "min", "max", "argmin", "argmax", "all", "any", "var", "std", "ptp", "count_nonzero", "nansum", "median", "cumsum", "cumprod")}


def percentile(array: Array, q, axis=None, **kwargs):
    return array.percentile(q, axis, **kwargs)


def quantile(array: Array, q, axis=None, **kwargs):
    return array.quantile(q, axis, **kwargs)


def sort(array: Array, axis: int = -1) -> Array:
    return array.sorted(axis)


def argsort(array: Array, axis: int = -1) -> Array:
    return array.argsort(axis)


def unique(array: Array) -> Array:
    return array.unique()


globals().update(_SAME | _REDUCTIONS)
__all__ = ["Array", "asndarrays", "evaluate", "from_ndarray", "from_parquet", "from_table", "from_zarr", "full", "ones", "percentile", "quantile", "sort", "argsort", "unique", "zeros", *_SAME, *_REDUCTIONS]  # noqa: PLE0604
