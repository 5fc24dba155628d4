import numpy as np

from rowforge.streaming.elementwise import apply


def test_same_values_as_numpy_on_a_stream(spark, tmp_path):
    values = [0.5, -2.0, 0.0, float("inf")]
    spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v double").parquet(str(tmp_path / "in"))
    out = apply(apply(stream, np.log1p, "v", name="a"), np.floor_divide, "k", 2, name="b")
    query = out.writeStream.format("memory").queryName("elementwise").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("elementwise").orderBy("k").collect()
    with np.errstate(all="ignore"):
        np.testing.assert_allclose([r.a for r in rows], np.log1p(values))
    assert [r.b for r in rows] == [0, 0, 1, 1]
