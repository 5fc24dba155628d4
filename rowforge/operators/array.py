"""Arrays whose rows are DataFrame rows, behind NumPy's interface.

A two-dimensional array is a DataFrame with a bigint `i` (row position) and array columns; a one-dimensional one has
`i` and scalar columns.  Elementwise work is kept as one function of elements and put into a single `transform` (or,
for column reductions, into a projection over exploded elements) only when the array is used.  Arrays made from the
same rows combine as expressions; others are joined on `i`.
"""

from __future__ import annotations

import builtins
import itertools
import numbers
import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.functions import dtypes as dt
from rowforge.functions import ufuncs
from rowforge.operators import reductions
from rowforge.operators.dense import dense_index

LITERAL_WIDTH = 100_000  # a row operand is at most a row: longer ones are refused as literals
PRODUCT_SIZE = 1 << 24  # elements of a right factor that is sent whole to every executor
HELD = {"u1": "i2", "u2": "i4", "u4": "i8", "f2": "f4"}  # dtypes in the wider ones that hold them


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Array(np.lib.mixins.NDArrayOperatorsMixin):
    """rows: DataFrame with `i`; leaves: array-valued columns of it (2-D), all of `width`; scalars: row-valued columns;
    build: elements of the leaves and the scalars -> an element.  A 1-D array has scalars only.  operands: row operands by
    the names of the columns that hold them once the rows are used."""

    def __init__(self, rows: DataFrame, leaves: list[Column], scalars: list[Column], build: Callable, dtype, width: int | None, n: int | None = None, dense: bool = True, chunk_rows: int | None = None, operands: dict | None = None):
        self.rows, self.leaves, self.scalars, self.build = rows, leaves, scalars, build
        self.dtype, self.width, self._n, self.dense, self.chunk_rows = np.dtype(dtype), width, n, dense, chunk_rows
        self.operands = operands or {}

    # --- shape -------------------------------------------------------------------------------------------

    @property
    def ndim(self) -> int:
        return 1 if self.width is None else 2

    @property
    def shape(self) -> tuple:
        return (len(self),) if self.ndim == 1 else (len(self), self.width)

    @property
    def size(self) -> int:
        return len(self) * (1 if self.width is None else self.width)

    @property
    def chunks(self) -> tuple:
        rows = self.chunk_rows or builtins.max(1, len(self))
        return (rows,) if self.ndim == 1 else (rows, self.width)

    def __len__(self) -> int:
        if self._n is None:
            self._n = self.rows.count()
        return self._n

    def __iter__(self):
        raise TypeError("rows are not iterated on the driver; use asndarray() or a row slice")

    def __repr__(self) -> str:
        return f"Array(ndim={self.ndim}, width={self.width}, dtype={self.dtype})"

    def _like(self, **changes) -> Array:
        now = {"rows": self.rows, "leaves": self.leaves, "scalars": self.scalars, "build": self.build, "dtype": self.dtype, "width": self.width, "n": self._n, "dense": self.dense, "chunk_rows": self.chunk_rows, "operands": self.operands}
        return Array(**(now | changes))

    def copy(self) -> Array:
        return self._like()

    def _become(self, other: Array) -> Array:
        self.__dict__.update(other.__dict__)
        return self

    # --- expressions -------------------------------------------------------------------------------------

    def _bound(self, values: list[Column], body: Callable[[list[Column]], Column]) -> Column:
        """body over values, each bound once; plain columns need no binding."""
        if not values:
            return body([])
        return let(values[0], lambda v: self._bound(values[1:], lambda rest: body([v, *rest])))

    def held(self, *others: Array) -> DataFrame:
        """The rows with the columns of all row operands, its own and those of others over the same rows."""
        columns = {name: row.column() for a in (self, *others) for name, row in a.operands.items()}
        return self.rows.withColumns(columns) if columns else self.rows

    def value(self) -> Column:
        """The value of a row of `held`: an array (2-D) or a scalar."""
        if self.ndim == 1:
            return self.build([], self.scalars)
        first, *rest = self.leaves
        if rest or self.scalars:
            return self._bound([*rest, *self.scalars], lambda got: F.transform(first, lambda x, j: self.build([x, *[F.get(o, j) for o in got[: len(rest)]]], got[len(rest) :])))
        return F.transform(first, lambda x: self.build([x], []))

    def to_df(self) -> DataFrame:
        """(i, v) of a 2-D array, (i, x) of a 1-D one."""
        return self.held().select("i", self.value().alias("v" if self.ndim == 2 else "x"))

    def to_long(self) -> DataFrame:
        """(i, j, x): elements of a 2-D array; the expression is applied to exploded elements, not before."""
        if self.ndim == 1:
            return self.to_df()
        held = self.held().select("i", *[c.alias(f"_l{k}") for k, c in enumerate(self.leaves)], *[c.alias(f"_s{k}") for k, c in enumerate(self.scalars)])
        rest = [f"_l{k}" for k in range(1, len(self.leaves))]
        flat = held.select("i", *rest, *[f"_s{k}" for k in range(len(self.scalars))], F.posexplode("_l0").alias("j", "_x"))
        elements = [F.col("_x"), *[F.get(F.col(c), F.col("j")) for c in rest]]
        return flat.select("i", "j", self.build(elements, [F.col(f"_s{k}") for k in range(len(self.scalars))]).alias("x"))

    def _settled(self) -> Array:
        """The same array over a plain column."""
        return from_rows(self.to_df(), self.dtype, self.width, self._n, self.dense, self.chunk_rows)

    def densified(self) -> Array:
        """The same array with positions 0, 1, ...; only a mask leaves gaps."""
        if self.dense:
            return self
        return from_rows(dense_index(self.to_df()), self.dtype, self.width, self._n, True, self.chunk_rows)

    # --- to the driver -----------------------------------------------------------------------------------

    def asndarray(self) -> np.ndarray:
        """The whole array on the driver, in row order."""
        table = self.to_df().orderBy("i").toArrow().combine_chunks()
        column = table.column(1).combine_chunks()
        if self.ndim == 1:
            return np.asarray(column.to_numpy(zero_copy_only=False)).astype(self.dtype)
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).astype(self.dtype).reshape(len(column), self.width)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        if copy is False:
            raise ValueError("an array on a cluster cannot be had without a copy")
        return self.asndarray().astype(dtype or self.dtype, copy=False)

    # --- elementwise -------------------------------------------------------------------------------------

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, dtype=None, **kwargs):
        if method == "reduce":
            name = {"add": "sum", "multiply": "prod", "minimum": "min", "maximum": "max", "logical_and": "all", "logical_or": "any"}.get(ufunc.__name__)
            return getattr(inputs[0], name)(kwargs.pop("axis", 0), out, dtype, **kwargs) if name else NotImplemented
        if kwargs:
            raise TypeError(f"{ufunc.__name__}: {', '.join(kwargs)} is not supported")
        if ufunc is np.matmul and method == "__call__" and out is None:
            return matmul(*inputs)
        if ufunc.signature is not None:
            raise TypeError(f"{ufunc.__name__} is not supported")
        if method != "__call__":
            return NotImplemented
        if len(inputs) > 2:
            raise TypeError("ufuncs of more than two inputs are not supported")
        if ufunc.nout == 2:
            return _two_outputs(ufunc, inputs)
        result = apply_ufunc(ufunc, *inputs)
        if dtype is not None:
            result = result.astype(dtype)
        if out is not None:
            target = out[0] if isinstance(out, tuple) else out
            if not isinstance(target, Array) or target.ndim != result.ndim or target.width != result.width:
                raise ValueError("out must be an array of the result's shape")
            return target._become(result)
        return result

    def __array_function__(self, func, types, args, kwargs):
        own = {np.sum: "sum", np.prod: "prod", np.min: "min", np.amin: "min", np.max: "max", np.amax: "max", np.mean: "mean", np.var: "var", np.std: "std", np.argmin: "argmin", np.argmax: "argmax", np.all: "all", np.any: "any", np.ptp: "ptp", np.count_nonzero: "count_nonzero", np.nansum: "nansum", np.median: "median", np.percentile: "percentile", np.quantile: "quantile", np.cumsum: "cumsum", np.cumprod: "cumprod", np.sort: "sorted", np.argsort: "argsort", np.unique: "unique"}.get(func)
        if own and isinstance(args[0], Array):
            try:
                return getattr(args[0], own)(*args[1:], **kwargs)
            except TypeError as unsupported:
                if own not in ("percentile", "quantile", "cumsum", "cumprod", "sorted", "argsort", "unique"):
                    raise
                warnings.warn(f"{func.__name__} is computed on the driver: {unsupported}", stacklevel=2)
        plain = [np.asarray(a) if isinstance(a, Array) else [np.asarray(x) if isinstance(x, Array) else x for x in a] if isinstance(a, (list, tuple)) else a for a in args]
        return func(*plain, **{k: np.asarray(v) if isinstance(v, Array) else v for k, v in kwargs.items()})  # on the driver

    def astype(self, dtype, copy: bool = True) -> Array:
        build, was = self.build, self.dtype
        out = self._like(build=lambda e, s: dt.converted(build(e, s), was, dtype), dtype=np.dtype(dtype))
        return out if copy else self._become(out)

    def clip(self, low, high) -> Array:
        return np.minimum(np.maximum(self, low), high)

    def round(self, decimals: int = 0) -> Array:
        return np.rint(self) if not decimals else np.rint(self * 10.0**decimals) / 10.0**decimals

    # --- reductions --------------------------------------------------------------------------------------

    def _reduced(self, name: str, axis=None, out=None, dtype=None, keepdims: bool = False, **kwargs):
        if kwargs or out is not None:
            raise TypeError(f"{name}: only axis, dtype and keepdims are supported")
        axis = axis if axis is None else int(axis) % self.ndim
        source = self if dtype is None else self.astype(dtype)
        got = reductions.reduce(name, source.densified() if name in ("argmin", "argmax") else source, axis)
        if keepdims:
            if not isinstance(got, Array):
                return np.full((1,) * self.ndim, got)
            return got[:, np.newaxis] if axis == 1 else np.asarray(got)[np.newaxis]
        return got

    def sum(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("sum", axis, out, dtype, keepdims, **kw)

    def prod(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("prod", axis, out, dtype, keepdims, **kw)

    def mean(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("mean", axis, out, dtype, keepdims, **kw)

    def min(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("min", axis, out, dtype, keepdims, **kw)

    def max(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("max", axis, out, dtype, keepdims, **kw)

    def argmin(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("argmin", axis, out, dtype, keepdims, **kw)

    def argmax(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("argmax", axis, out, dtype, keepdims, **kw)

    def all(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("all", axis, out, dtype, keepdims, **kw)

    def any(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("any", axis, out, dtype, keepdims, **kw)

    def var(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("var", axis, out, dtype, keepdims, **kw)

    def std(self, axis=None, out=None, dtype=None, keepdims=False, **kw):
        return self._reduced("std", axis, out, dtype, keepdims, **kw)

    def count_nonzero(self, axis=None, **kw):
        return (self != 0).astype(np.int64).sum(axis, **kw)

    def nansum(self, axis=None, **kw):
        build = self.build
        clean = self._like(build=lambda e, s: F.nanvl(build(e, s).cast("double"), F.lit(0.0))) if self.dtype.kind == "f" else self
        return clean.sum(axis, **kw)

    def ptp(self, axis=None, **kw):
        return self.max(axis, **kw) - self.min(axis, **kw)

    # --- order: see operators/order.py -------------------------------------------------------------------

    def percentile(self, q, axis=None, keepdims: bool = False):
        from rowforge.operators import order

        return order.percentile(self, q, axis, keepdims)

    def quantile(self, q, axis=None, keepdims: bool = False):
        return self.percentile(np.asarray(q) * 100, axis, keepdims)

    def median(self, axis=None, keepdims: bool = False):
        return self.percentile(50, axis, keepdims)

    def cumsum(self, axis=None):
        from rowforge.operators import order

        return order.running(self, False, axis)

    def cumprod(self, axis=None):
        from rowforge.operators import order

        return order.running(self, True, axis)

    def sorted(self, axis: int = -1):
        from rowforge.operators import order

        return order.sort(self, axis)

    def argsort(self, axis: int = -1):
        from rowforge.operators import order

        return order.argsort(self, axis)

    def unique(self):
        from rowforge.operators import order

        return order.unique(self)

    # --- indexing ----------------------------------------------------------------------------------------

    def __getitem__(self, item):
        from rowforge.operators import indexing

        return indexing.take(self, item)

    # --- partitions and storage --------------------------------------------------------------------------

    def repartition(self, chunk_rows: int) -> Array:
        """The same array in partitions of near `chunk_rows` rows in row order (exact cuts are made when it is stored)."""
        settled = self.densified()
        parts = builtins.max(1, -(-len(settled) // chunk_rows))
        return from_rows(settled.to_df().repartitionByRange(parts, "i"), self.dtype, self.width, self._n, True, chunk_rows)

    def chunk_sizes(self, chunk_rows: int) -> DataFrame:
        """(chunk, n): how many rows each chunk of `chunk_rows` holds."""
        return self.densified().rows.groupBy(F.floor(F.col("i") / chunk_rows).cast("bigint").alias("chunk")).agg(F.count("*").alias("n"))

    def to_zarr(self, store, chunks=None, ncopies: int = 1, compressor: str | None = None) -> None:
        from rowforge.sources import zarr

        zarr.write(self, store, (chunks or self.chunks)[0], ncopies, compressor)

    def to_zarr_gcs(self, gcs_path: str, chunks, gcs_project: str, gcs_token: str = "cloud", ncopies: int = 1) -> None:
        from rowforge.sources import zarr

        self.to_zarr(zarr.gcs_store(gcs_path, gcs_project, gcs_token), chunks, ncopies)

    def explain(self, mode: str = "formatted") -> None:
        """Print the plan that makes the array."""
        self.to_df().explain(mode)

    def to_parquet(self, path: str) -> None:
        """(i, v) or (i, x) as Parquet, sorted by i in each file."""
        self.densified().to_df().sortWithinPartitions("i").write.mode("overwrite").parquet(path)


def from_rows(df: DataFrame, dtype, width: int | None, n: int | None = None, dense: bool = True, chunk_rows: int | None = None) -> Array:
    """An array over a DataFrame of `i` and `v` (arrays of `width`), or `i` and `x` (width None)."""
    if width is None:
        return Array(df, [], [F.col("x")], lambda e, s: s[0], dtype, None, n, dense, chunk_rows)
    return Array(df, [F.col("v")], [], lambda e, s: e[0], dtype, width, n, dense, chunk_rows)


def from_ndarray(spark: SparkSession, values, chunks: tuple | None = None) -> Array:
    """An array of an ndarray's rows (1-D or 2-D)."""
    values = np.asarray(values)
    if values.ndim not in (1, 2):
        raise ValueError("arrays have one or two dimensions")
    dt.spark_type(values.dtype)  # raises for dtypes without a Spark type
    held = values.astype(HELD.get(values.dtype.str[1:], values.dtype))
    at = pa.array(np.arange(len(values), dtype=np.int64))
    if values.ndim == 1:
        table = pa.table({"i": at, "x": pa.array(held)})
        schema = f"i bigint, x {dt.spark_type(values.dtype)}"
    else:
        n, width = values.shape
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width) if width else np.zeros(n + 1), pa.int32()), pa.array(held.ravel()))
        table, schema = pa.table({"i": at, "v": lists}), f"i bigint, v array<{dt.spark_type(values.dtype)}>"
    rows = chunks[0] if chunks else None
    df = spark.createDataFrame(table, schema)
    if rows:
        df = df.repartitionByRange(builtins.max(1, -(-len(values) // rows)), "i")
    return from_rows(df, values.dtype, None if values.ndim == 1 else values.shape[1], len(values), True, rows)


def full(spark: SparkSession, shape, value, dtype=float, chunks: tuple | None = None) -> Array:
    """A constant array, made on the executors."""
    shape = (shape,) if isinstance(shape, numbers.Integral) else tuple(shape)
    n, parts = int(shape[0]), builtins.max(1, -(-int(shape[0]) // chunks[0])) if chunks else None
    ids = spark.range(0, n, 1, parts).select(F.col("id").alias("i")) if parts else spark.range(n).select(F.col("id").alias("i"))
    x = F.lit(np.dtype(dtype).type(value).item()).cast(dt.spark_type(dtype))
    if len(shape) == 1:
        return from_rows(ids.withColumn("x", x), dtype, None, n, True, chunks and chunks[0])
    return from_rows(ids.withColumn("v", F.array_repeat(x, int(shape[1]))), dtype, int(shape[1]), n, True, chunks and chunks[0])


def zeros(spark: SparkSession, shape, chunks: tuple | None = None, dtype=float) -> Array:
    return full(spark, shape, 0, dtype, chunks)


def ones(spark: SparkSession, shape, chunks: tuple | None = None, dtype=float) -> Array:
    return full(spark, shape, 1, dtype, chunks)


def from_table(df: DataFrame, key: str, values: str | list[str], width: int | None = None, n: int | None = None, dtype=None) -> Array:
    """An array of a table: `key` (unique) orders the rows; values: an array column of `width`, a scalar column, or
    scalar columns side by side.  The key is taken as positions 0, 1, ...; use densified() if it has gaps."""
    kinds = dict(df.dtypes)
    if isinstance(values, str) and kinds[values].startswith("array"):
        inner = kinds[values][6:-1]
        if width is None:
            width = df.select(F.size(values)).first()[0]
        return from_rows(df.select(F.col(key).cast("bigint").alias("i"), F.col(values).alias("v")), dtype or dt.numpy_dtype(inner), width, n)
    if isinstance(values, str):
        return from_rows(df.select(F.col(key).cast("bigint").alias("i"), F.col(values).alias("x")), dtype or dt.numpy_dtype(kinds[values]), None, n)
    common = np.result_type(*[dt.numpy_dtype(kinds[c]) for c in values])
    parts = [dt.converted(F.col(c), dt.numpy_dtype(kinds[c]), common) for c in values]
    return from_rows(df.select(F.col(key).cast("bigint").alias("i"), F.array(*parts).alias("v")), common, len(values), n)


def evaluate(*arrays: Array) -> list[np.ndarray]:
    """All arrays on the driver; those over the same rows in one pass."""
    if len({id(a.rows) for a in arrays}) != 1:
        return [a.asndarray() for a in arrays]
    table = arrays[0].held(*arrays[1:]).select("i", *[a.value().alias(f"a{k}") for k, a in enumerate(arrays)]).orderBy("i").toArrow().combine_chunks()
    out = []
    for k, a in enumerate(arrays):
        column = table.column(k + 1).combine_chunks()
        flat = column if a.ndim == 1 else column.flatten()
        values = np.asarray(flat.to_numpy(zero_copy_only=False)).astype(a.dtype)
        out.append(values if a.ndim == 1 else values.reshape(len(column), a.width))
    return out


# --- combining two operands -------------------------------------------------------------------------------


def joined(a: Array, b: Array) -> tuple[Array, Array]:
    """The two arrays over common rows, matched by position."""
    if a.rows is b.rows:
        return a, b
    a, b = a.densified(), b.densified()
    if a._n is not None and b._n is not None and a._n != b._n:
        raise ValueError(f"operands have {a._n} and {b._n} rows")
    names = ["v" if x.ndim == 2 else "x" for x in (a, b)]
    rows = a.to_df().withColumnRenamed(names[0], "a").join(b.to_df().withColumnRenamed(names[1], "b"), "i")

    def over(x: Array, name: str) -> Array:
        own = from_rows(rows, x.dtype, x.width, x._n, True, x.chunk_rows)
        return own._like(leaves=[F.col(name)]) if x.ndim == 2 else own._like(scalars=[F.col(name)])

    return over(a, "a"), over(b, "b")


_row_numbers = itertools.count()


class Row:
    """A vector as a row operand of a matrix: a scalar subquery puts its values into one array when the plan runs, so
    nothing runs before.  It is as long as a row, or one long."""

    def __init__(self, vector: Array, width: int):
        n = len(vector)
        if n not in (1, width):
            raise ValueError(f"operands could not be broadcast together: widths {n} and {width}")
        self.vector, self.width, self.wide, self.dtype = vector.densified(), width, n == width, vector.dtype
        self.name = f"_row{next(_row_numbers)}"

    def column(self) -> Column:
        gathered = self.vector.to_df().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
        if not self.wide:
            gathered = gathered.select(F.array_repeat(F.get("v", F.lit(0)), self.width).alias("v"))
        return gathered.scalar()


def _row_literal(values: np.ndarray) -> Column:
    if len(values) > LITERAL_WIDTH:
        raise ValueError(f"a row operand has at most {LITERAL_WIDTH} values")
    kind = dt.spark_type(values.dtype)
    return F.lit([x.item() for x in values]).cast(f"array<{kind}>") if len(values) else F.array().cast(f"array<{kind}>")


def _operand(x, like: Array):
    """A Python scalar, an Array, or an ndarray made one of: a scalar, a row (1-D ndarray) or an Array."""
    if isinstance(x, Array) or isinstance(x, (bool, int, float)):
        return x
    if isinstance(x, numbers.Number) and not isinstance(x, np.generic):
        return x
    values = np.asarray(x)
    if values.ndim == 0:
        return values[()]
    if values.ndim == 2 and values.shape[0] == 1 and like.ndim == 2:
        values = values[0]
    if values.ndim == 1 and like.ndim == 2:
        return values
    return from_ndarray(like.rows.sparkSession, values)


def apply_ufunc(ufunc: np.ufunc, *inputs) -> Array:
    """A ufunc of one or two operands, one of them an Array at least, with NumPy's broadcasting."""
    arrays = [x for x in inputs if isinstance(x, Array)]
    like = builtins.max(arrays, key=lambda a: a.ndim)
    parts = [_operand(x, like) for x in inputs]
    if len(parts) == 2 and all(isinstance(p, Array) for p in parts):
        a, b = parts
        if a.ndim != b.ndim:  # a 1-D operand is a row of the other
            one = 0 if a.ndim == 1 else 1
            parts[one] = Row(parts[one], parts[1 - one].width)
        else:
            parts = list(joined(a, b))
    made = [p for p in parts if isinstance(p, Array)]
    base = builtins.max(made, key=lambda a: (a.ndim, a.width or 0))
    width = base.width
    leaves, scalars, readers, kinds, operands = [], [], [], [], {}
    for p in parts:
        if isinstance(p, Array):
            operands |= p.operands
            start, wide = len(scalars), p.width
            if p.ndim == 2 and wide != width and wide != 1:
                raise ValueError(f"operands could not be broadcast together: widths {wide} and {width}")
            if p.ndim == 2 and wide == 1 and width != 1:  # (n, 1) against (n, m): one value a row
                scalars.append(F.element_at(p.value(), 1))
                readers.append(lambda e, s, k=start: s[k])
            else:
                places = []
                for leaf in p.leaves:  # a column read by both operands is read once
                    k = next((k for k, known in enumerate(leaves) if known is leaf), len(leaves))
                    places.append(k)
                    leaves += [leaf] if k == len(leaves) else []
                scalars += p.scalars
                readers.append(lambda e, s, build=p.build, places=places, m=start, z=len(scalars): build([e[k] for k in places], s[m:z]))
            kinds.append(p.dtype)
        elif isinstance(p, Row):
            leaves.append(F.col(p.name))
            operands[p.name] = p
            readers.append(lambda e, s, k=len(leaves) - 1: e[k])
            kinds.append(p.dtype)
        elif isinstance(p, np.ndarray):
            if len(p) not in (1, width):
                raise ValueError(f"operands could not be broadcast together: widths {len(p)} and {width}")
            if len(p) == 1:
                readers.append(lambda e, s, c=F.lit(p[0].item()).cast(dt.spark_type(p.dtype)): c)
            else:
                leaves.append(_row_literal(p))
                readers.append(lambda e, s, k=len(leaves) - 1: e[k])
            kinds.append(p.dtype)
        else:
            kind = p.dtype if isinstance(p, np.generic) else type(p)
            weak = kind in (int, float)
            value = p.item() if isinstance(p, np.generic) else p
            held = ("double" if kind is float else "bigint") if weak else dt.spark_type(kind)
            readers.append(lambda e, s, c=F.lit(value).cast(held): c)
            kinds.append(kind)
    loop_kinds = [k if k in (int, float) else np.dtype(k) for k in kinds]
    held = [np.dtype(np.int64) if k is int else np.dtype(np.float64) if k is float else k for k in loop_kinds]
    if not leaves and base.ndim == 2:
        raise ValueError("no operand has columns")
    if not ufuncs.has_expression(ufunc, loop_kinds):
        return _by_arrow(ufunc, base._like(operands=operands), leaves, scalars, readers, held, loop_kinds)
    lead = next((k for k, c in enumerate(leaves) if c is base.leaves[0]), 0) if leaves else 0  # a real column leads

    def build(e: list[Column], s: list[Column]) -> Column:
        e = e if lead == 0 else [*e[1 : lead + 1], e[0], *e[lead + 1 :]]
        loop = ufuncs.loop_dtypes(ufunc, loop_kinds)
        args = [r(e, s) for r in readers]
        given = [loop[k] if loop_kinds[k] in (int, float) and loop[k].kind == held[k].kind else held[k] for k in range(len(args))]
        return ufuncs.expression(ufunc, args, given)

    ordered = [leaves[lead], *leaves[:lead], *leaves[lead + 1 :]] if leaves else []
    return base._like(leaves=ordered, scalars=scalars, build=build, dtype=ufuncs.loop_dtypes(ufunc, loop_kinds)[-1], operands=operands)


def _by_arrow(ufunc: np.ufunc, base: Array, leaves, scalars, readers, held, loop_kinds) -> Array:
    """A ufunc without an expression: its operands are laid out as columns and it is applied to Arrow batches."""
    out = ufuncs.loop_dtypes(ufunc, loop_kinds)[-1]
    parts = []
    for k, read in enumerate(readers):
        one = base._like(leaves=leaves or base.leaves, scalars=scalars, build=read, dtype=held[k])
        parts.append(one.value().alias(f"p{k}"))
    wide, kind, width = base.ndim == 2, dt.spark_type(out), base.width or 1
    scalar = [isinstance(d, type) for d in loop_kinds]

    def run(batches):
        for batch in batches:
            columns = []
            for k in range(len(held)):
                c = batch.column(k + 1)
                values = np.asarray((c.flatten() if wide else c).to_numpy(zero_copy_only=False)).astype(held[k])
                columns.append(loop_kinds[k](values[0]) if scalar[k] and len(values) else values)
            with np.errstate(all="ignore"):
                got = np.asarray(ufunc(*columns)) if batch.num_rows else np.zeros(0, out)
            got = pa.array(got.astype(HELD.get(out.str[1:], out)))
            result = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), got) if wide else got
            yield pa.RecordBatch.from_arrays([batch.column(0), result], names=["i", "v" if wide else "x"])

    rows = base.held().select("i", *parts).mapInArrow(run, f"i bigint, v array<{kind}>" if wide else f"i bigint, x {kind}")
    return from_rows(rows, out, base.width, base._n, base.dense, base.chunk_rows)


def matmul(a: Array, b) -> Array:
    """a @ b.  b on the driver, or an array of at most PRODUCT_SIZE elements, goes whole to the executors, with one product
    an Arrow batch; a larger array is joined on the inner position, and products are summed by place."""
    if not isinstance(a, Array) or a.ndim != 2:
        raise TypeError("the left operand must be a two-dimensional array of rows")
    if isinstance(b, Array):
        if len(b) != a.width:
            raise ValueError(f"operands could not be multiplied: widths {a.width} and {b.shape}")
        if b.size > PRODUCT_SIZE:
            return _joined_product(a, b)
    b = np.asarray(b)
    if b.ndim not in (1, 2) or b.shape[0] != a.width:
        raise ValueError(f"operands could not be multiplied: widths {a.width} and {b.shape}")
    width, wide, out = a.width, b.ndim == 2, np.result_type(a.dtype, b.dtype)
    kind, dtype = dt.spark_type(out), a.dtype

    def run(batches):
        for batch in batches:
            values = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).astype(dtype).reshape(-1, width)
            got = (values @ b).astype(out)
            flat = pa.array(got.ravel().astype(HELD.get(out.str[1:], out)))
            result = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * b.shape[1], pa.int32()), flat) if wide else flat
            yield pa.RecordBatch.from_arrays([batch.column(0), result], names=["i", "v" if wide else "x"])

    rows = a.to_df().mapInArrow(run, f"i bigint, v array<{kind}>" if wide else f"i bigint, x {kind}")
    return from_rows(rows, out, b.shape[1] if wide else None, a._n, a.dense, a.chunk_rows)


def _joined_product(a: Array, b: Array) -> Array:
    """Rows i of a meet rows k of b where a's element k is; the products of (i, j) are added, before the shuffle as far as they meet."""
    out = np.result_type(a.dtype, b.dtype)
    kind = dt.spark_type(out)
    left = a.to_long().select("i", F.col("j").cast("bigint").alias("k"), F.col("x").cast(kind).alias("x"))
    right = b.densified().to_long()
    right = right.select(F.col("i").alias("k"), *(["j"] if b.ndim == 2 else [F.lit(0).alias("j")]), F.col("x").cast(kind).alias("y"))
    places = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).cast(kind).alias("x"))
    if b.ndim == 1:
        return from_rows(places.select("i", "x"), out, None, a._n, a.dense, a.chunk_rows)
    rows = places.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("v"))
    return from_rows(rows, out, b.width, a._n, a.dense, a.chunk_rows)


def _frexp(x: Array) -> tuple:
    """Mantissas in [0.5, 1) with the sign, and exponents; zero, NaN and infinity are their own mantissas, with exponent 0."""
    x = x if x.dtype.kind == "f" else x.astype(float)
    build, kind = x.build, dt.spark_type(x.dtype)

    def parts(v: Column, body: Callable[[Column, Column], Column]) -> Column:
        """body(mantissa, exponent) of v: an estimate by the logarithm, set right by one step either way."""
        small = F.abs(v) < F.lit(2.0**-1000)  # subnormals are scaled up first
        scaled, off = F.when(small, v * F.lit(2.0**100)).otherwise(v), F.when(small, F.lit(-100)).otherwise(F.lit(0))

        def found(s: Column) -> Column:
            def settled(e: Column) -> Column:
                half = F.pow(F.lit(2.0), F.floor(e / 2).cast("double"))  # two factors: neither leaves the range of doubles
                m = s / half / F.pow(F.lit(2.0), (e - F.floor(e / 2)).cast("double"))
                return let(m, lambda m: F.when(F.abs(m) >= 1, body(m / 2, e + 1 + off)).when(F.abs(m) < 0.5, body(m * 2, e - 1 + off)).otherwise(body(m, e + off)))

            return let((F.floor(F.log2(F.abs(s))) + 1).cast("bigint"), settled)

        plain = (v == 0) | F.isnan(v) | (F.abs(v) == float("inf"))
        return F.when(plain, body(v, F.lit(0).cast("bigint"))).otherwise(let(scaled, found))

    mantissa = x._like(build=lambda e, s: let(build(e, s).cast("double"), lambda v: parts(v, lambda m, k: m)).cast(kind))
    exponent = x._like(build=lambda e, s: let(build(e, s).cast("double"), lambda v: parts(v, lambda m, k: k)).cast("int"), dtype=np.int32)
    return mantissa, exponent


def _two_outputs(ufunc: np.ufunc, inputs) -> tuple:
    """divmod, modf and frexp by their parts."""
    if ufunc is np.frexp:
        return _frexp(inputs[0])
    if ufunc is np.divmod:
        return np.floor_divide(*inputs), np.remainder(*inputs)
    if ufunc is np.modf:
        x = inputs[0] if inputs[0].dtype.kind == "f" else inputs[0].astype(float)
        whole, build = np.trunc(x), x.build
        sign = ufuncs.FLOAT["copysign"]

        def fraction(e: list[Column], s: list[Column]) -> Column:
            v = build(e, s).cast("double")
            rest = F.when(F.abs(v) == float("inf"), F.lit(0.0)).otherwise(v - ufuncs.FLOAT["trunc"](v))
            return sign(rest, v).cast(dt.spark_type(x.dtype))

        return x._like(build=fraction), whole
    raise TypeError(f"{ufunc.__name__} has two outputs and is not supported")
