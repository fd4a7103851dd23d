import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwell.operators.knn import knn_join
from nearwell.sources import records
from nearwell.streaming.search import answer, knn_stream

from .test_search import table


def test_texmex(spark, tmp_path):
    x = np.random.default_rng(0).random((50, 6)).astype(np.float32)
    path = str(tmp_path / "a.fvecs")
    records.write_texmex(table(spark, x), path)
    rows = records.read_texmex(spark, path).orderBy("id").collect()
    assert np.array_equal(np.array([r["v"] for r in rows], np.float32), x)
    assert records.read_texmex(spark, path, limit=1).count() == 1
    assert len(records.read_texmex(spark, path, keep=2).first()["v"]) == 2
    assert records.read_texmex(spark, path, with_dimension=True).first()["v"][0] == 6
    parts = records.write_texmex_parts(table(spark, x).repartition(3), str(tmp_path), "ivecs").collect()
    assert sum(r["n"] for r in parts) == 50
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        records.read_texmex(spark, path)


def test_raw_numbers(spark, tmp_path):
    x = np.random.default_rng(1).random(1000)
    path = str(tmp_path / "a.bin")
    records.write_raw(spark.createDataFrame(list(enumerate(x.tolist())), "pos long, value double"), path)
    assert [r["value"] for r in records.read_raw(spark, path).orderBy("pos").collect()] == x.tolist()
    assert records.read_raw_vectors(spark, path, 10).count() == 100


def test_images_and_text(spark, tmp_path):
    rows = np.random.default_rng(2).integers(0, 256, (4, 13), dtype=np.uint8)
    (tmp_path / "c.bin").write_bytes(rows.tobytes())
    got = records.read_cifar(spark, str(tmp_path / "c.bin"), pixels=12).orderBy("id").collect()
    assert [r["label"] for r in got] == rows[:, 0].tolist() and got[1]["v"] == rows[1, 1:].tolist()
    inter = records.read_cifar(spark, str(tmp_path / "c.bin"), pixels=12).select(records.interleave_planes(F.col("v"), 2).alias("v")).first()["v"]
    assert sorted(inter) == sorted(rows[0, 1:].tolist()) and inter[:3] == [rows[0, 1], rows[0, 5], rows[0, 9]]
    (tmp_path / "n.txt").write_text("cat dog\nbird\n")
    assert [r["name"] for r in records.read_categories(spark, str(tmp_path / "n.txt")).orderBy("pos").collect()] == ["cat", "dog", "bird"]
    (tmp_path / "iris").write_text("5.1 3.5 1.4 0.2 setosa\n4.9 3.0 1.4 0.2 other\n\n")
    assert [r["label"] for r in records.read_iris(spark, str(tmp_path / "iris")).collect()] == ["setosa", "other"]
    k, points, query = records.parse_points(spark, "2 3 0 0 1 1 1 2 5 5 3 0.1 0 0")
    assert k == 2 and points.count() == 3 and [r["id"] for r in knn_join(query.withColumn("id", F.lit(9).cast("long")), points, k).orderBy("rank").collect()] == [0, 1]
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    assert [r["v"] for r in records.read_npy(spark, str(tmp_path / "a.npy")).orderBy("id").collect()] == [[0, 1], [2, 3], [4, 5]]
    records.append_benchmark(str(tmp_path / "b.csv"), 4, "linear", 1.5)
    assert records.read_benchmark(spark, str(tmp_path / "b.csv")).first()["elapsed"] == 1.5


def test_stream(spark, tmp_path):
    x = np.random.default_rng(3).random((40, 3))
    base = table(spark, x)
    table(spark, x[:7]).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("id long, v array<double>").parquet(str(tmp_path / "q"))
    run = knn_stream(stream, base, 3).writeStream.format("memory").queryName("near").start()
    run.processAllAvailable()
    run.stop()
    want = sorted(map(tuple, knn_join(table(spark, x[:7]), base, 3).collect()))
    assert sorted(map(tuple, spark.table("near").collect())) == want
    seen = []
    run = stream.writeStream.foreachBatch(answer(base, 3, lambda df, n: seen.extend(map(tuple, df.collect())))).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(seen) == want
