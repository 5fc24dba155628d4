"""Arrow batches: their size, and runs of equal keys in a sorted stream of them, without a pandas group for each."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at most, cut without a copy: what is made from a batch stays small whatever the
    session's setting; an empty one is passed over."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> Iterator[None]:
    """What runs inside gets Arrow batches of at most `rows` rows and some `size` bytes; the session's settings are its own
    again when it ends, and lower ones hold inside as well.

    The JVM builds a batch outside its heap in buffers that double, and holds it beside Python: with the default of 10,000
    rows of whole texts or sets that is a task's whole partition, and what it frees stays with the process in pieces."""
    conf, given = spark.conf, spark.conf.getAll
    to_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {}
    for name, most, read in (("maxRecordsPerBatch", rows, int), ("maxBytesPerBatch", size, to_bytes)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < read(conf.get(key)) <= most:
            before[key] = given.get(key)
            conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, giving freed memory back to the system after each partition: a worker lives on, idle, beside others."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return kept


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shielded(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its other columns under names that clash with nothing, and what gives them their own names back."""
    names = docs.columns
    return docs.toDF(*[c if c in needed else f"_extra{k}" for k, c in enumerate(names)]), lambda out: out.toDF(*names)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of equal integer keys; a run may span batches."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cut = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            own = tuple(int(c[a]) for c in columns)
            if own != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = own, []
            held.append(batch.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)
