import json
import os
import sys
import types
from collections import Counter

import numpy as np
import pytest
from numpy.testing import assert_array_equal

from pyspark.sql import functions as F

from rowforge.functions import api as rf
from rowforge.operators.dense import dense_index
from rowforge.sources import zarr
from rowforge.sources.ranges import key_ranges


@pytest.mark.parametrize("compressor", [None, "zlib", "gzip"])
@pytest.mark.parametrize("dtype", ["f8", "f4", "i4", "u1", "b1", "i8"])
def test_zarr_round_trip(spark, tmp_path, compressor, dtype):
    values = (np.arange(35).reshape(7, 5) % 3).astype(dtype)
    path = str(tmp_path / "a.zarr")
    rf.from_ndarray(spark, values).to_zarr(path, (3, 5), compressor=compressor)
    meta = json.load(open(os.path.join(path, ".zarray")))
    assert meta["shape"] == [7, 5] and meta["chunks"] == [3, 5] and sorted(f for f in os.listdir(path) if f[0] != ".") == ["0.0", "1.0", "2.0"]
    back = rf.from_zarr(spark, path)
    assert back.dtype == values.dtype and back.chunks == (3, 5) and back.rows.rdd.getNumPartitions() == 3
    assert_array_equal(back.asndarray(), values)
    assert_array_equal(rf.from_zarr(spark, path, columns=[4, 1], row_start=2, row_stop=5).asndarray(), values[2:5, [4, 1]])
    back[1:6].to_zarr(path + "2", (2, 5))
    assert_array_equal(rf.from_zarr(spark, path + "2").asndarray(), values[1:6])


def test_copies_vectors_and_errors(spark, tmp_path):
    values, path = np.arange(6.0).reshape(3, 2), str(tmp_path / "b.zarr")
    rf.from_ndarray(spark, values).to_zarr(path, (2, 2), ncopies=3)
    assert_array_equal(rf.from_zarr(spark, path).asndarray(), np.vstack([values] * 3))
    rf.from_ndarray(spark, np.arange(5)).to_zarr(path, (2,))
    assert_array_equal(rf.from_zarr(spark, path).asndarray(), np.arange(5))
    meta = json.load(open(os.path.join(path, ".zarray")))
    os.remove(os.path.join(path, "1"))
    assert_array_equal(rf.from_zarr(spark, path).asndarray(), [0, 1, 0, 0, 4])
    json.dump(meta | {"compressor": {"id": "blosc"}}, open(os.path.join(path, ".zarray"), "w"))
    with pytest.raises(ValueError):
        rf.from_zarr(spark, path)
    with pytest.raises(ValueError):
        zarr.local_path("s3://x/y")
    os.makedirs(str(tmp_path / "other"))
    open(str(tmp_path / "other" / "f"), "w").close()
    with pytest.raises(ValueError):
        rf.from_ndarray(spark, values).to_zarr(str(tmp_path / "other"), (2, 2))


class Shared(dict):
    """A mapping over a folder, as object stores give."""

    def __init__(self, root):
        super().__init__()
        self.root = root

    def __reduce__(self):
        return Shared, (self.root,)

    def get(self, name, default=None):
        path = os.path.join(self.root, name)
        return open(path, "rb").read() if os.path.exists(path) else default

    def __setitem__(self, name, data):
        with open(os.path.join(self.root, name), "wb") as f:
            f.write(data)

    def clear(self):
        for name in os.listdir(self.root):
            os.remove(os.path.join(self.root, name))


def test_mapping_store(spark, tmp_path):
    store, values = Shared(str(tmp_path)), np.arange(14.0).reshape(7, 2)
    rf.from_ndarray(spark, values).to_zarr(store, (3, 2), ncopies=2)
    back = rf.from_zarr(spark, store)
    assert_array_equal(back.asndarray(), np.vstack([values] * 2))
    assert_array_equal(rf.from_zarr(spark, store, columns=[1], row_start=4, row_stop=9).asndarray(), np.vstack([values] * 2)[4:9, 1:])
    with pytest.raises(ImportError):
        back.to_zarr_gcs("bucket/a", (3, 2), "project")
    back.explain()


def test_gcs_writer_against_a_fake(spark, tmp_path, monkeypatch):
    """The writer gives the library path, project and token, and what it writes is read back through the same mapping."""
    seen = {}

    def system(project, token):
        seen.update(project=project, token=token)
        return "gcs"

    def mapping(path, gcs):
        assert gcs == "gcs"
        root = str(tmp_path / path.replace("/", "_"))
        os.makedirs(root, exist_ok=True)
        return Shared(root)

    monkeypatch.setitem(sys.modules, "gcsfs", types.SimpleNamespace(GCSFileSystem=system, mapping=types.SimpleNamespace(GCSMap=mapping)))
    values = np.arange(22.0).reshape(11, 2)
    rf.from_ndarray(spark, values).to_zarr_gcs("bucket/a.zarr", (4, 2), "some-project", "anon", ncopies=2)
    assert seen == {"project": "some-project", "token": "anon"}
    assert_array_equal(rf.from_zarr(spark, zarr.gcs_store("bucket/a.zarr", "some-project", "anon")).asndarray(), np.vstack([values] * 2))


@pytest.mark.parametrize("n,chunk,want", [(12, 5, [5, 5, 2]), (12, 2, [2] * 6), (12, 6, [6, 6])])
def test_chunk_sizes(spark, n, chunk, want):
    x = rf.from_ndarray(spark, np.arange(n)[:, None], (5, 1))
    assert [r.n for r in x.chunk_sizes(chunk).orderBy("chunk").collect()] == want
    assert_array_equal(x.repartition(chunk).asndarray(), np.arange(n)[:, None])
    less = x[np.arange(n) != 7]
    assert sum(r.n for r in less.chunk_sizes(chunk).collect()) == n - 1
    masked = x[x[:, 0] != 7]
    assert_array_equal(masked.repartition(4).asndarray()[:, 0], [k for k in range(n) if k != 7])
    assert masked[7][0] == 8


def test_dense_index_over_ranges(spark):
    from rowforge.operators import dense

    rows, dense.ROWS_A_RANGE = dense.ROWS_A_RANGE, 7
    try:
        df = spark.createDataFrame([(k * k, k) for k in range(50)], "i bigint, k int").repartition(6)
        assert all(r.i == r.k for r in dense_index(df).collect())
    finally:
        dense.ROWS_A_RANGE = rows


def test_ranges_of_a_sample(spark, monkeypatch):
    """Beyond SAMPLE_ROWS quantiles are those of a sample: ranges stay near equal, and a hot key is still cut."""
    monkeypatch.setattr("rowforge.sources.ranges.SAMPLE_ROWS", 2000)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id")).alias("k"), "id")
    cut = key_ranges(df, "k", 20)
    sizes = Counter(r.r for r in cut.place(df, "k", "r", F.xxhash64("id")).collect())
    assert sum(sizes.values()) == 20_000 and len(sizes) > 15 and max(sizes.values()) < 2500


@pytest.mark.parametrize("kind", ["even", "skewed", "hot", "wide"])
@pytest.mark.parametrize("ranges", [1, 2, 40, 400])
def test_ranges_keep_order(spark, kind, ranges):
    """Ranges ascend with the key, cover nulls, lie within their count, and a hot key's rows part by their hash."""
    rng = np.random.default_rng(5)
    keys = {"even": rng.permutation(4000), "skewed": (rng.pareto(0.3, 4000) * 10).clip(0, 2.0**62).astype(np.int64), "hot": np.where(rng.random(4000) < 0.6, 77, rng.integers(0, 500, 4000)), "wide": rng.choice([-(1 << 63), (1 << 63) - 1, 0, -5, 9], 4000)}[kind].tolist()
    df = spark.createDataFrame([(None if k == 500 else int(k), n) for n, k in enumerate(keys)], "k long, n long")
    cut = key_ranges(df, "k", ranges, hot_rows=200)
    got = cut.place(df, "k", "r", F.xxhash64("n")).collect()
    assert len(got) == 4000 and all(0 <= g.r < cut.count for g in got)
    least = -(1 << 63)
    order = sorted((least if g.k is None else g.k, g.r) for g in got)
    assert [r for _, r in order] == sorted(r for _, r in order)
    if kind in ("even", "hot") and ranges >= 40:
        assert max(Counter(g.r for g in got).values()) < 4000 / ranges * 4 + 20


def test_parquet_and_pushdown(spark, tmp_path):
    values, path = np.arange(20.0).reshape(10, 2), str(tmp_path / "p")
    rf.from_ndarray(spark, values).to_parquet(path)
    x = rf.from_parquet(spark, path, "i", "v")
    assert_array_equal(x[3:6].asndarray(), values[3:6])
    plan = x[3:6].to_df()._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(i), GreaterThanOrEqual(i,3), LessThan(i,6)]" in plan
    same = (x * 2 + x).to_df()._jdf.queryExecution().toString()
    assert "Join" not in same.split("== Physical Plan ==")[1] and same.split("== Physical Plan ==")[1].count("transform(") == 1
    two = rf.from_table(spark.createDataFrame([(0, 1, 2.5), (1, 3, 4.5)], "k long, a int, b double"), "k", ["a", "b"])
    assert_array_equal(two.asndarray(), [[1, 2.5], [3, 4.5]])
    one = rf.from_table(spark.createDataFrame([(0, 1, 2.5), (1, 3, 4.5)], "k long, a int, b double"), "k", "a")
    assert one.dtype == np.int32 and one.sum() == 4
