"""Zarr v2 directory stores of row chunks: a Spark data source that reads them, and a writer.

A chunk holds `chunks[0]` rows of all columns; it is one partition when read and one file when written.  Chunks are
raw or under zlib or gzip; other compressors raise.  A store is a local or mounted path, or any mapping of names to
bytes that can be pickled and reaches one place from everywhere, as object-store mappings do."""

from __future__ import annotations

import gzip
import json
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowforge.functions.dtypes import spark_type

_HELD = {"u1": "i2", "u2": "i4", "u4": "i8", "f2": "f4"}


def local_path(path: str) -> str:
    """A path without its file: scheme; other schemes are not mounted here."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: only local and mounted paths can hold a Zarr store here")
    return path


class Folder:
    """A store in a folder: names to bytes.  Files appear whole, by a rename."""

    def __init__(self, path: str):
        self.root = local_path(path)

    def get(self, name: str) -> bytes | None:
        try:
            with open(os.path.join(self.root, name), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def __setitem__(self, name: str, data: bytes) -> None:
        target = os.path.join(self.root, name)
        part = f"{target}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, target)

    def clear(self) -> None:
        if os.path.exists(self.root):
            if os.listdir(self.root) and not os.path.exists(os.path.join(self.root, ".zarray")):
                raise ValueError(f"{self.root} holds something else than a Zarr array")
            shutil.rmtree(self.root)
        os.makedirs(self.root)


def opened(store):
    """A path's folder, or the mapping itself."""
    return Folder(store) if isinstance(store, str) else store


def gcs_store(path: str, project: str, token: str = "cloud"):
    """A mapping of a Google Cloud Storage prefix; needs gcsfs."""
    import gcsfs

    return gcsfs.mapping.GCSMap(path, gcs=gcsfs.GCSFileSystem(project, token=token))


def metadata(store) -> dict:
    """The store's .zarray: shape, chunks, dtype, compressor, fill_value, order."""
    data = opened(store).get(".zarray")
    if data is None:
        raise FileNotFoundError(f"{store}: no .zarray")
    found = json.loads(data)
    if found["zarr_format"] != 2 or found.get("filters"):
        raise ValueError("only Zarr format 2 without filters is supported")
    if (found["compressor"] or {"id": "zlib"})["id"] not in ("zlib", "gzip"):
        raise ValueError(f"compressor {found['compressor']['id']} is not available here")
    return found


def _fill(meta: dict) -> float:
    value = meta["fill_value"]
    return {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf, None: 0}.get(value, value) if not isinstance(value, (int, float)) else value


def read_chunk(store, meta: dict, *index: int) -> np.ndarray:
    """One chunk, cut at the array's edges; a missing one is the fill value."""
    shape, chunks = meta["shape"], meta["chunks"]
    inside = tuple(slice(0, max(0, min(c, n - c * k))) for k, c, n in zip(index, chunks, shape, strict=True))
    data = opened(store).get(meta.get("dimension_separator", ".").join(map(str, index)))
    if data is None:
        return np.full(chunks, _fill(meta), meta["dtype"])[inside]
    if meta["compressor"]:
        data = zlib.decompress(data) if meta["compressor"]["id"] == "zlib" else gzip.decompress(data)
    return np.frombuffer(data, meta["dtype"]).reshape(chunks, order=meta["order"])[inside]


class ZarrPartition(InputPartition):
    def __init__(self, chunk: int):
        self.chunk = chunk


class ZarrReader(DataSourceReader):
    """Options: path; columns (comma-joined positions: only those are sent on); row_start, row_stop (other chunks are not opened)."""

    def __init__(self, options: dict, store=None):
        self.path = options["path"] if store is None else store
        self.meta = metadata(self.path)
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None
        n = self.meta["shape"][0]
        self.start, self.stop = int(options.get("row_start", 0)), min(n, int(options.get("row_stop", n)))

    def partitions(self) -> list[ZarrPartition]:
        rows = self.meta["chunks"][0]
        return [ZarrPartition(k) for k in range(self.start // rows, -(-self.stop // rows))] or [ZarrPartition(-1)]

    def read(self, partition: ZarrPartition) -> Iterator[pa.RecordBatch]:
        if partition.chunk < 0:
            return
        meta, rows, k = self.meta, self.meta["chunks"][0], partition.chunk
        if len(meta["shape"]) == 1:
            values = read_chunk(self.path, meta, k)
        else:
            across = -(-meta["shape"][1] // meta["chunks"][1])
            values = np.concatenate([read_chunk(self.path, meta, k, c) for c in range(across)], 1)
        first = max(self.start, k * rows)
        values = values[first - k * rows : self.stop - k * rows]
        if values.ndim == 2 and self.columns is not None:
            values = values[:, self.columns]
        values = values.astype(_HELD.get(values.dtype.str[1:], values.dtype.newbyteorder("=")))
        at = pa.array(np.arange(first, first + len(values), dtype=np.int64))
        if values.ndim == 1:
            yield pa.RecordBatch.from_arrays([at, pa.array(values)], names=["i", "x"])
            return
        step = max(1, (1 << 20) // max(1, values.shape[1]))
        for a in range(0, len(values), step):
            some = np.ascontiguousarray(values[a : a + step])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * some.shape[1], pa.int32()), pa.array(some.ravel()))
            yield pa.RecordBatch.from_arrays([at[a : a + step], lists], names=["i", "v"])


class ZarrSource(DataSource):
    """format("zarr"): i, and v (array) of a 2-D store or x of a 1-D one."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> str:
        meta = metadata(self.options["path"])
        kind = spark_type(meta["dtype"])
        return f"i bigint, v array<{kind}>" if len(meta["shape"]) == 2 else f"i bigint, x {kind}"

    def reader(self, schema) -> ZarrReader:
        return ZarrReader(self.options)


def from_zarr(spark: SparkSession, store, columns: list[int] | None = None, row_start: int = 0, row_stop: int | None = None):
    """An array of a store, or of some of its columns and rows."""
    from rowforge.operators.array import from_rows

    meta = metadata(store)
    n = meta["shape"][0]
    stop = n if row_stop is None else min(n, row_stop)
    options = {"row_start": row_start, "row_stop": stop} | ({} if columns is None else {"columns": ",".join(map(str, columns))})
    if isinstance(store, str):
        spark.dataSource.register(ZarrSource)
        df = spark.read.format("zarr").options(**options).load(store)
    else:
        reader, kind = ZarrReader(options, store), spark_type(meta["dtype"])
        chunks = [p.chunk for p in reader.partitions()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from reader.read(ZarrPartition(k))

        df = spark.range(chunks[0], chunks[-1] + 1, 1, len(chunks)).mapInArrow(run, f"i bigint, v array<{kind}>" if len(meta["shape"]) == 2 else f"i bigint, x {kind}")
    if row_start:
        df = df.withColumn("i", F.col("i") - F.lit(row_start))
    width = None if len(meta["shape"]) == 1 else (meta["shape"][1] if columns is None else len(columns))
    return from_rows(df, np.dtype(meta["dtype"]), width, max(0, stop - row_start), True, meta["chunks"][0])


def _file(values: np.ndarray, chunk: tuple, dtype: np.dtype, compressor: str | None) -> bytes:
    if values.shape != chunk:  # an edge chunk is stored whole
        whole = np.zeros(chunk, dtype)
        whole[: len(values)] = values
        values = whole
    data = np.ascontiguousarray(values, dtype).tobytes()
    return data if compressor is None else zlib.compress(data, 1) if compressor == "zlib" else gzip.compress(data, 1)


def write(array, store, chunk_rows: int, ncopies: int = 1, compressor: str | None = None) -> None:
    """Store an array, tiled `ncopies` times downwards, in chunks of chunk_rows rows.

    Each task writes whole chunks, so a task that runs twice does no harm."""
    if compressor not in (None, "zlib", "gzip"):
        raise ValueError(f"compressor {compressor} is not available here")
    array, store = array.densified(), opened(store)
    n, dtype = len(array), array.dtype.newbyteorder("<") if array.dtype.itemsize > 1 else array.dtype
    shape = (n * ncopies,) if array.ndim == 1 else (n * ncopies, array.width)
    chunk = (chunk_rows, *shape[1:])
    store.clear()
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunk), "dtype": dtype.str, "compressor": compressor and {"id": compressor, "level": 1}, "fill_value": None if dtype.kind == "b" else 0, "order": "C", "filters": None}
    store[".zarray"] = json.dumps(meta).encode()
    df, value = array.to_df(), "v" if array.ndim == 2 else "x"
    if ncopies > 1:
        df = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(ncopies - 1)))).select((F.col("i") + F.col("_copy") * F.lit(n)).alias("i"), value)
    _write_chunks(df, store, chunk, dtype, compressor, max(1, -(-shape[0] // chunk_rows)))


def _write_chunks(df: DataFrame, store, chunk: tuple, dtype: np.dtype, compressor: str | None, chunks: int) -> None:
    wide = len(chunk) == 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, written = None, [], 0

        def flush() -> None:
            values = np.concatenate(held) if len(held) > 1 else held[0]
            store[f"{key}.0" if wide else str(key)] = _file(values.astype(dtype), chunk, dtype, compressor)

        for batch in batches:
            keys = np.asarray(batch.column(0))
            column = batch.column(1)
            flat = np.asarray((column.flatten() if wide else column).to_numpy(zero_copy_only=False))
            values = flat.reshape(-1, chunk[1]) if wide else flat
            cut = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if a == z:
                    continue
                if held and keys[a] != key:
                    flush()
                    held, written = [], written + 1
                key = int(keys[a])
                held.append(values[a:z])
        if held:
            flush()
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])

    value = "v" if wide else "x"
    keyed = df.select(F.floor(F.col("i") / chunk[0]).cast("bigint").alias("chunk"), value, "i")
    dealt = keyed.repartition(min(chunks, 100_000), "chunk").sortWithinPartitions("chunk", "i").select("chunk", value)
    dealt.mapInArrow(run, "files bigint").agg(F.sum("files")).first()
