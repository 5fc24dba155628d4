"""Operations that need an order: percentiles, running sums and products, sorting and distinct values.

None brings the array to the driver or into one task.  Percentiles come from histograms that close in on the values
wanted; running results and positions come from ranges, each worked on its own from where those before it end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions import dtypes as dt
from rowforge.operators import dense
from rowforge.operators.array import HELD, Array, from_ndarray, from_rows
from rowforge.sources.staging import stage

BINS, MOST_ROUNDS = 1024, 400


# --- percentiles ------------------------------------------------------------------------------------------


def percentile(array: Array, q, axis: int | None = None, keepdims: bool = False):
    """np.percentile by linear interpolation.  q: a number, or (axis None or 0) a list; NaN where there is a NaN."""
    one, q = np.ndim(q) == 0, np.atleast_1d(np.asarray(q, float))
    if ((q < 0) | (q > 100)).any():
        raise ValueError("percentiles must be from 0 to 100")
    if axis is not None:
        axis = int(axis) % array.ndim
    if array.ndim == 2 and axis == 1:
        if not one:
            raise TypeError("along rows one percentile at a time is taken")
        got = _of_rows(array, float(q[0]))
        return got[:, np.newaxis] if keepdims else got
    columns = array.ndim == 2 and axis == 0
    if columns:
        long, groups = array.to_long().select("j", F.col("x").cast("double").alias("x")), range(array.width)
    else:
        long, groups = array.to_long().select(F.lit(0).alias("j"), F.col("x").cast("double").alias("x")), range(1)
    found = np.array(_quantiles(long, len(groups), q / 100))
    out = found.astype(array.dtype if array.dtype.kind == "f" else float)
    if columns:
        got = from_ndarray(array.rows.sparkSession, out[:, 0]) if one else out.T
        return np.asarray(got)[np.newaxis] if keepdims and one else got
    got = out[0, 0] if one else out[0]
    return np.full((1,) * array.ndim, got) if keepdims and one else got


def _of_rows(array: Array, q: float) -> Array:
    place = q / 100 * (array.width - 1)
    low, part = int(np.floor(place)), place - np.floor(place)

    def pick(values: Column) -> Column:
        a, b = F.get(values, F.lit(low)), F.get(values, F.lit(min(low + 1, array.width - 1)))
        return F.when(F.isnan(F.get(values, F.lit(array.width - 1))), F.lit(float("nan"))).otherwise(_between(a, b, part))

    ordered = F.array_sort(F.transform(array.value(), lambda x: x.cast("double")))
    value = F.element_at(F.transform(F.array(ordered), pick), 1)
    out = array.dtype if array.dtype.kind == "f" else np.dtype(float)
    return array._like(leaves=[], scalars=[value.cast(dt.spark_type(out))], build=lambda e, s: s[0], dtype=out, width=None)


def _between(a: Column, b: Column, part: float) -> Column:
    """From a to b by a part of the way, reckoned from the nearer end, as NumPy does."""
    return a if not part else F.when(a == b, a).otherwise(a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part))


def _quantiles(long: DataFrame, groups: int, q: np.ndarray) -> list[list[float]]:
    """For each group j of (j, x) the interpolated quantiles q.

    A round counts the values of every interval sought in BINS bins, and goes into the bin that holds the rank: the
    interval's ends are values that occur, so it is done when they are equal.  The driver sees a few numbers a bin."""
    real = F.when(~F.isnan("x"), F.col("x"))
    first = {r.j: r for r in long.groupBy("j").agg(F.count("*").alias("n"), F.count(real).alias("m"), F.min(real).alias("a"), F.max(real).alias("z")).collect()}
    if not first:
        return [[float("nan")] * len(q)] * groups
    state, known = {}, {}
    for j, r in first.items():
        if r.m == r.n:
            for rank in {int(k) for x in q for k in (np.floor(x * (r.n - 1)), np.ceil(x * (r.n - 1)))}:
                state[j, rank] = (r.a, r.z, 0)
    for _ in range(MOST_ROUNDS):
        for at, (a, z, _before) in list(state.items()):
            if a == z:
                known[at] = a
                del state[at]
        if not state:
            break
        wanted = sorted({(j, float(a), float(z), before) for (j, _), (a, z, before) in state.items()})
        spans = long.sparkSession.createDataFrame([(int(j), a, z) for j, a, z, _ in wanted], "j int, a double, z double")
        most = F.lit(np.finfo(float).max)
        held = lambda c: F.greatest(F.least(F.col(c), most), -most) / 2  # noqa: E731  (no difference overflows)
        cell = F.least(F.floor(F.try_divide(held("x") - held("a"), (held("z") - held("a")) / BINS)), F.lit(BINS - 1))
        inside = long.join(F.broadcast(spans), "j").where("x >= a and x <= z").withColumn("cell", F.coalesce(F.when(F.col("x") == F.col("a"), F.lit(0)).otherwise(cell), F.lit(0)))
        counts: dict[tuple, list] = {}
        for r in inside.groupBy("j", "a", "z", "cell").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
            counts.setdefault((r.j, r.a, r.z), []).append((r.cell, r.n, r.low, r.high))
        for (j, rank), (a, z, before) in list(state.items()):
            own = sorted(counts[j, a, z])
            if len(own) == 1:  # too near for bins: the ends part on their own
                before, own = _ends(long, j, a, z, before, rank)
            for _cell, n, low, high in own:
                if rank < before + n:
                    state[j, rank] = (low, high, before)
                    break
                before += n
    else:
        raise RuntimeError("the percentiles have not settled")
    out = []
    for j in range(groups):
        r, row = first.get(j), []
        for x in q:
            if r is None or r.m < r.n:
                row.append(float("nan"))
                continue
            place = x * (r.n - 1)
            a, b = known[j, int(np.floor(place))], known[j, int(np.ceil(place))]
            part = place - np.floor(place)
            row.append(a if a == b else a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part))
        out.append(row)
    return out


def _ends(long: DataFrame, j: int, a: float, z: float, before: int, rank: int) -> tuple[int, list]:
    """An interval whose values all fall into one bin, as its least value, its greatest, and what is between."""
    kind = F.when(F.col("x") == a, 0).when(F.col("x") == z, 2).otherwise(1)
    rows = long.where((F.col("j") == j) & (F.col("x") >= a) & (F.col("x") <= z)).groupBy(kind.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    return before, sorted((r.cell, r.n, r.low, r.high) for r in rows)


# --- running sums and products ----------------------------------------------------------------------------


def running(array: Array, product: bool, axis: int | None = None) -> Array:
    """np.cumsum or np.cumprod.  Along the first axis, ranges of rows run on their own from what those before them come to."""
    if array.ndim == 2 and axis is None:
        raise TypeError("a running result over a flattened array is not supported; name an axis")
    out = array.dtype if array.dtype.kind == "f" else np.dtype(np.int64)
    step = np.multiply if product else np.add
    array = array.densified().astype(out)
    if array.ndim == 2 and int(axis) % 2 == 1:
        return _along_rows(array, step)
    wide = array.ndim == 2
    column = "v" if wide else "x"
    width = array.width if wide else 1
    rows = dense.placed_by(stage(array.to_df()))
    neutral = np.ones if product else np.zeros
    kind = dt.spark_type(out)

    def values_of(column) -> np.ndarray:
        return np.asarray((column.flatten() if wide else column).to_numpy(zero_copy_only=False)).astype(out).reshape(-1, width)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, values = np.asarray(batch.column(0)), values_of(batch.column(1))
            with np.errstate(all="ignore"):
                for r in np.unique(at).tolist():
                    held[r] = step(held.get(r, neutral(width, out)), step.reduce(values[at == r], axis=0))
        flat = np.concatenate([np.zeros(0, out), *held.values()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(held))), pa.array(flat.astype(HELD.get(out.str[1:], out)))], names=["_range", "j", "t"])

    parts = rows.select("_range", column).mapInArrow(totals, f"_range int, j int, t {kind}")

    def began(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last, held = None, None, neutral(1, out)  # column, range, and what all before comes to
        for batch in batches:
            if not batch.num_rows:
                continue
            j, at = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            t, kept, cut = np.asarray(batch.column(2)).astype(out), [], [0, *(np.flatnonzero(np.diff(j)) + 1).tolist(), len(j)]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if j[a] != place:
                    place, last, held = j[a], None, neutral(1, out)
                with np.errstate(all="ignore"):
                    total = step.accumulate(np.concatenate((held, t[a:z])))
                first = np.flatnonzero(np.diff(at[a:z], prepend=at[a] - 1 if last is None else last))
                kept.append((at[a:z][first], np.full(len(first), place), total[first]))
                last, held = at[z - 1], total[-1:]
            ranges, columns, before = (np.concatenate(k) for k in zip(*kept, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(columns, pa.int32()), pa.array(before.astype(HELD.get(out.str[1:], out)))], names=["_range", "j", "t"])

    ordered = parts.select("j", "_range", "t").repartition("j").sortWithinPartitions("j", "_range")  # of each column a row a range and task
    whole = ordered.mapInArrow(began, f"_range int, j int, t {kind}").groupBy("_range").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "t"))), lambda s: s["t"]).alias("_start"))
    # a range's start is a row before its rows: after a join Spark may leave the deal out and read ranges in pieces
    starts = whole.select("_range", F.lit(None).cast("bigint").alias("i"), (F.col("_start") if wide else F.get("_start", F.lit(0))).alias(column), F.lit(False).alias("_own"))
    dealt = rows.select("_range", "i", column, F.lit(True).alias("_own")).unionByName(starts).repartition("_range").sortWithinPartitions("_range", "_own", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, neutral(width, out)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, values = np.asarray(batch.column(0)), values_of(batch.column(2))
            got = np.empty_like(values)
            cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if at[a] != now:
                    now, held = at[a], neutral(width, out)
                with np.errstate(all="ignore"):
                    got[a:z] = step.accumulate(np.concatenate((held[None], values[a:z])), axis=0)[1:]
                held = got[z - 1].copy()
            own = np.asarray(batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(batch.column(3)), _packed(got[own], wide, out)], names=["i", column])

    return from_rows(dealt.mapInArrow(run, f"i bigint, v array<{kind}>" if wide else f"i bigint, x {kind}"), out, array.width, array._n, True, array.chunk_rows)


def _packed(values: np.ndarray, wide: bool, dtype: np.dtype):
    flat = pa.array(values.ravel().astype(HELD.get(dtype.str[1:], dtype)))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat) if wide else flat


def _along_rows(array: Array, step: np.ufunc) -> Array:
    out, width, kind = array.dtype, array.width, dt.spark_type(array.dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).astype(out).reshape(-1, width)
            with np.errstate(all="ignore"):
                got = step.accumulate(values, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(got, True, out)], names=["i", "v"])

    return from_rows(array.to_df().mapInArrow(run, f"i bigint, v array<{kind}>"), out, width, array._n, array.dense, array.chunk_rows)


# --- sorting and distinct values --------------------------------------------------------------------------


def sort(array: Array, axis: int = -1) -> Array:
    """np.sort of a vector, or of each row of a matrix; NaN comes last."""
    if array.ndim == 1:
        return from_rows(_ranked(array).select("i", "x"), array.dtype, None, array._n, True, array.chunk_rows)
    _rows_only(axis)
    return array._like(leaves=[F.array_sort(array.value())], scalars=[], build=lambda e, s: e[0])


def argsort(array: Array, axis: int = -1) -> Array:
    """Where each value of the sorted vector or row stands; of equal ones the first comes first."""
    if array.ndim == 1:
        return from_rows(_ranked(array.densified()).select("i", F.col("was").alias("x")), np.int64, None, array._n, True, array.chunk_rows)
    _rows_only(axis)
    pairs = F.transform(array.value(), lambda x, j: F.struct(x.alias("x"), j.cast("bigint").alias("j")))
    return array._like(leaves=[F.transform(F.array_sort(pairs), lambda s: s["j"])], scalars=[], build=lambda e, s: e[0], dtype=np.int64)


def _rows_only(axis: int) -> None:
    if int(axis) % 2 != 1:
        raise TypeError("a matrix is sorted along its rows (axis 1) only")


def _ranked(array: Array) -> DataFrame:
    """i (the rank), x and was (the position) of a vector's values."""
    df = array.to_df()
    parts = max(1, -(-len(array) // dense.ROWS_A_RANGE))
    dealt = df.select("x", F.col("i").alias("was")).repartitionByRange(parts, "x", "was").withColumn("_range", F.spark_partition_id())
    rows = stage(dealt)  # so that the ranges stay what they are
    starts = dense.range_starts(rows.groupBy("_range").agg(F.count("*").alias("_n")), "_n")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("x", "was")) - 1
    return rows.withColumn("_rank", rank).join(starts, "_range").select((F.col("_rank") + F.col("_start")).cast("bigint").alias("i"), "x", "was")


def unique(array: Array) -> Array:
    """The distinct values, ascending, as a vector."""
    values = array.to_long().select("x").distinct().select(F.monotonically_increasing_id().alias("i"), "x")
    return sort(from_rows(stage(values), array.dtype, None, None, False))
