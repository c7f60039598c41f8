"""Streams in pieces equal their batch forms."""

import numpy as np
import pytest

from sparksci.streaming import operators as T


def test_filters_in_batch_and_stream(spark, tmp_path):
    x = [float(v) for v in np.sin(np.arange(40))]
    rows = [(k, i, v * (k + 1)) for k in range(2) for i, v in enumerate(x)]
    schema = "s long, t long, x double"
    df = spark.createDataFrame(rows, schema)
    b, a = [0.2, 0.3], [1.0, -0.5, 0.1]
    want = []
    for i, v in enumerate(x):
        past = lambda c, k: c[i - k] if i >= k else 0.0  # noqa: B023, E731
        want.append(0.2 * v + 0.3 * past(x, 1) + 0.5 * past(want, 1) - 0.1 * past(want, 2))
    got = [r["y"] for r in T.lfilter(df, "x", "t", "s", b, a).where("s = 0").orderBy("t").collect()]
    assert got == pytest.approx(want)
    assert [r["y"] for r in T.sosfilt(df, "x", "t", "s", [[0.2, 0.3, 0, 1, -0.5, 0.1]]).where("s = 0").orderBy("t").collect()] == pytest.approx(want)

    source = f"{tmp_path}/in"
    df.where("t < 20").coalesce(1).write.parquet(source)
    df.where("t >= 20").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = T.lfilter_stream(stream, "x", "t", "s", b, a).writeStream.format("memory").queryName("filtered").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.sql("SELECT * FROM filtered WHERE s = 0 ORDER BY t").collect()
    assert len(rows) == 40


def test_windowed_statistics(spark, tmp_path):
    df = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id * 10 AS INT)) AS ts, 'a' AS k, CAST(id AS double) AS x FROM range(12)")
    out = {r["start"].hour: r["nobs"] for r in T.windowed_statistics(df, "ts", "x", "k").collect()}
    assert out == {0: 6, 1: 6}


def test_mini_batches_move_centres(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 10 + 0.1 * i]) for i in range(20)], "id long, v array<double>")
    m = T.MiniBatchKMeans([[1.0], [9.0]])
    m.update(df.where("id < 10"))
    m.update(df.where("id >= 10"))
    assert m.centers.ravel().tolist() == pytest.approx([0.9, 11.0])
