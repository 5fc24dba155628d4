"""Selection of rows and columns: slices, integer lists, masks, and a new axis.

Rows: a slice is a predicate on `i`; positions and ndarray masks are joined by position; a mask over the same rows is a
filter, which leaves gaps in `i` that are closed only when positions are needed again.  Columns are selected from the
columns that the elementwise expression reads, so unused elements are not computed."""

from __future__ import annotations

import numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rowforge.operators.array import Array, joined


def take(array: Array, item):
    """array[item]."""
    if not isinstance(item, tuple):
        item = (item,)
    if Ellipsis in [x for x in item if x is Ellipsis]:
        k = next(k for k, x in enumerate(item) if x is Ellipsis)
        given = len([x for x in item if x is not None]) - 1
        item = (*item[:k], *[slice(None)] * (array.ndim - given), *item[k + 1 :])
    if len(item) == 2 and array.ndim == 1 and item[1] is None:
        rows = take(array, item[0]) if not _whole(item[0]) else array
        return rows._like(leaves=[F.array(rows.value())], scalars=[], build=lambda e, s: e[0], width=1)
    if None in [x for x in item if x is None]:
        raise IndexError("a new axis is supported after a vector's rows: x[:, np.newaxis]")
    if len(item) > array.ndim:
        raise IndexError("too many indices")
    rows, columns = item[0], item[1] if len(item) > 1 else slice(None)
    if isinstance(rows, Array) and rows.ndim == 2:
        raise IndexError("a mask of two dimensions would flatten the array; use asndarray()")
    if not _whole(columns):
        array = _columns(array, columns)
        if isinstance(columns, numbers.Integral):
            return array if _whole(rows) else take(array, rows)
    return array if _whole(rows) else _rows(array, rows)


def _whole(x) -> bool:
    return isinstance(x, slice) and x == slice(None)


def _columns(array: Array, item):
    width = array.width
    if isinstance(item, numbers.Integral):
        k = range(width)[int(item)]
        picked = _columns(array, [k])
        return picked._like(leaves=[], scalars=[F.element_at(picked.value(), 1)], build=lambda e, s: s[0], width=None)
    if isinstance(item, slice):
        start, stop, step = item.indices(width)
        places = list(range(start, stop, step))
        if step == 1:
            return array._like(leaves=[F.slice(c, start + 1, max(0, stop - start)) for c in array.leaves], width=len(places))
    else:
        values = item.asndarray() if isinstance(item, Array) else np.asarray(item)
        if values.dtype == bool:
            if values.shape != (width,):
                raise IndexError(f"a mask of {values.shape} for {width} columns")
            places = np.flatnonzero(values).tolist()
        else:
            places = [range(width)[int(k)] for k in values]
    chosen = F.lit(places).cast("array<int>") if places else F.array().cast("array<int>")
    return array._like(leaves=[_gathered(c, chosen) for c in array.leaves], width=len(places))


def _gathered(column, chosen):
    return F.element_at(F.transform(F.array(column), lambda held: F.transform(chosen, lambda j: F.get(held, j))), 1)


def _moved(array: Array, rows, n, dense=True) -> Array:
    return array._like(rows=rows, n=n, dense=dense)


def _carried(array: Array) -> Array:
    """The array over a plain column, if its expression is more than that: rows are about to be re-numbered."""
    return array._settled()


def _rows(array: Array, item):
    if isinstance(item, numbers.Integral):
        n, k = len(array), int(item)
        if not -n <= k < n:
            raise IndexError(f"row {k} of {n}")
        found = array.densified().to_df().where(F.col("i") == k % n).first()
        return array.dtype.type(found[1]) if array.ndim == 1 else np.array(found[1], array.dtype)
    if isinstance(item, slice):
        return _sliced(array.densified(), item)
    if isinstance(item, Array):
        if item.dtype == bool:
            array, item = joined(array, item)
            return _moved(array, item.held().where(item.value()), None, False)
        item = item.asndarray()
    values = np.asarray(item)
    if values.dtype == bool:
        if array._n is not None and values.shape != (array._n,):
            raise IndexError(f"a mask of {values.shape} for {array._n} rows")
        return _picked(array.densified(), np.flatnonzero(values))
    if (values < 0).any() or array._n is not None:
        n = len(array)
        if ((values < -n) | (values >= n)).any():
            raise IndexError(f"rows outside 0..{n - 1}")
        values = np.where(values < 0, values + n, values)
    return _picked(array.densified(), values.astype(np.int64))


def _sliced(array: Array, item: slice) -> Array:
    step = 1 if item.step is None else int(item.step)
    bounded = step > 0 and all(x is None or x >= 0 for x in (item.start, item.stop))
    if bounded and array._n is None:  # no need to count
        start, stop, n = item.start or 0, item.stop, None
    else:
        start, stop, step = item.indices(len(array))
        n = len(range(start, stop, step))
    i, settled = F.col("i"), _carried(array)
    if step > 0:
        inside = (i >= start) if stop is None else (i >= start) & (i < stop)
        place = i - F.lit(start)
    else:
        inside, place = (i <= start) & (i > stop), F.lit(start) - i
    rows = settled.rows.where(inside)
    if abs(step) != 1:
        rows = rows.where(place % abs(step) == 0)
        place = F.floor(place / abs(step))
    return _moved(settled, rows.withColumn("i", place.cast("bigint")), n)


def _picked(array: Array, places: np.ndarray) -> Array:
    settled = _carried(array)
    wanted = settled.rows.sparkSession.createDataFrame(pa.table({"i": pa.array(places, pa.int64()), "_to": pa.array(np.arange(len(places)), pa.int64())}), "i bigint, _to bigint")
    rows = settled.rows.join(wanted, "i").drop("i").withColumnRenamed("_to", "i")
    return _moved(settled, rows, len(places))
