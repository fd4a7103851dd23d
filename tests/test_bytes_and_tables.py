"""Byte vectors, the TEXMEX data source and the table function."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwell.functions import distances, table_functions
from nearwell.functions.packed import pack_bytes, packed, unpack_bytes
from nearwell.functions.vectors import VectorError
from nearwell.operators import knn
from nearwell.sources import records, texmex

from .test_search import brute, found, table


def byte_table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), bytearray(r.tobytes())) for i, r in zip(ids if ids is not None else range(len(x)), x)], "id long, v binary")


@pytest.mark.parametrize("width", [3, 8, 29])
def test_byte_kernels_equal_those_over_numbers(width):
    rng = np.random.default_rng(width)
    q, b = rng.integers(0, 256, (7, width), dtype=np.uint8), rng.integers(0, 256, (600, width), dtype=np.uint8)
    for name in ("l2", "l1", "max", "minkowski3", "chi_square", "hellinger", "hamming", "hist_intersect"):
        want = distances.get(name).matrix(q.astype(float), b.astype(float))
        got = packed(name)
        assert np.array_equal(got.matrix(q, b), want), name
        assert np.array_equal(got.pairs(q, b[:7]), np.diag(want[:, :7])), name


@pytest.mark.parametrize("few", [20, 60])
def test_byte_vectors_are_searched(spark, monkeypatch, few):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (300, 48), dtype=np.uint8)
    b, q = byte_table(spark, x).repartition(5), byte_table(spark, x[:few])
    for name in ("l2", "hamming", "l1"):
        assert found(knn.knn_join(q, b, 4, name)) == brute(x[:few], x, 4, name)
    assert {r["qid"] == r["id"] for r in knn.knn_join(q, b, 4, itself=False).collect()} == {False}
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 4096)
    assert found(knn.knn_join(q, b, 4)) == brute(x[:few], x, 4)


def test_byte_vectors_that_are_refused(spark):
    b = byte_table(spark, np.ones((4, 3), np.uint8))
    ragged = spark.createDataFrame([(0, bytearray(b"ab")), (1, bytearray(b"abc"))], "id long, v binary")
    null = spark.createDataFrame([(0, None)], "id long, v binary")
    for bad in (ragged, null):
        with pytest.raises(VectorError):
            knn.knn_join(bad, b, 1)
    with pytest.raises(VectorError):
        knn.knn_join(b, table(spark, [[1.0, 2.0, 3.0]]), 1)
    with pytest.raises(Exception, match="0 to 255"):
        table(spark, [[256.0]]).select(pack_bytes(F.col("v"))).collect()


def test_packing_is_reversible(spark):
    x = np.arange(256).reshape(4, 64)
    rows = table(spark, x).select("id", unpack_bytes(pack_bytes(F.col("v"))).alias("v")).orderBy("id").collect()
    assert [r["v"] for r in rows] == x.tolist()


def test_cifar_images_stay_bytes(spark, tmp_path):
    rows = np.random.default_rng(2).integers(0, 256, (60, 1 + 3072), dtype=np.uint8)
    (tmp_path / "c.bin").write_bytes(rows.tobytes())
    images = records.read_cifar(spark, str(tmp_path / "c.bin"), packed=True)
    assert dict(images.dtypes)["v"] == "binary" and [r["label"] for r in images.orderBy("id").collect()] == rows[:, 0].tolist()
    q = images.where("id < 40")
    assert found(knn.knn_join(q, images, 3)) == brute(rows[:40, 1:], rows[:, 1:], 3)


def test_texmex_source(spark, tmp_path):
    texmex.register(spark)
    x = np.random.default_rng(0).random((50, 6)).astype(np.float32)
    path = str(tmp_path / "set")
    df = table(spark, x).select("id", F.col("v").cast("array<float>").alias("v"))
    df.repartitionByRange(3, "id").sortWithinPartitions("id").write.format("texmex").option("kind", "fvecs").mode("append").save(path)
    files = sorted(os.listdir(path))
    assert "_SUCCESS" in files and len([f for f in files if f.endswith(".fvecs")]) == 3 and not [f for f in files if f.startswith("_") and f != "_SUCCESS"]
    back = spark.read.format("texmex").load(path).orderBy("id").collect()
    assert np.array_equal(np.array([r["v"] for r in back], np.float32), x) and [r["id"] for r in back] == list(range(50))
    assert spark.read.format("texmex").option("limit", 1).load(path).count() == 1
    assert len(spark.read.format("texmex").option("keep", 2).load(path).first()["v"]) == 2
    df.limit(5).write.format("texmex").option("kind", "fvecs").mode("overwrite").save(path)
    assert spark.read.format("texmex").load(path).count() == 5
    one = str(tmp_path / "one.ivecs")
    records.write_texmex(table(spark, [[1, 2], [3, 4]]), one)
    assert [r["v"] for r in spark.read.format("texmex").load(one).orderBy("id").collect()] == [[1, 2], [3, 4]]
    with open(one, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="records of"):
        spark.read.format("texmex").load(one).collect()
    table(spark, x).where("id < 0").select("id", "v").write.format("texmex").option("kind", "fvecs").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("texmex").option("kind", "fvecs").load(str(tmp_path / "none")).count() == 0


def test_texmex_ranges_are_read_apart(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(1).integers(0, 100, (100, 4))
    path = str(tmp_path / "a.bvecs")
    records.write_texmex(table(spark, x), path)
    monkeypatch.setattr(texmex, "RANGE_BYTES", 80)
    reader = texmex.TexmexReader(path, "bvecs", None, 95)
    parts = reader.partitions()
    assert len(parts) == 10 and sum(p.many for p in parts) == 95
    rows = [v for p in reversed(parts) for b in reader.read(p) for v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert [v for _, v in sorted(rows)] == x[:95].tolist()


def test_table_function(spark, monkeypatch):
    x = np.random.default_rng(5).random((200, 4))
    b = table(spark, x)
    table_functions.register_knn(spark, "near_test", b, 3, "l1")
    q = table(spark, x[:30] + 0.01).unionByName(spark.createDataFrame([(99, None)], "id long, v array<double>"))
    q.createOrReplaceTempView("queries_test")
    out = spark.sql("SELECT q.id AS qid, n.rank, n.id, n.dist FROM queries_test q, LATERAL near_test(q.v) n")
    assert found(out) == brute(x[:30] + 0.01, x, 3, "l1")
    with pytest.raises(Exception, match="VectorError"):
        spark.sql("SELECT * FROM near_test(array(1.0D, 2.0D))").collect()
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 100)
    with pytest.raises(ValueError, match="knn_join"):
        table_functions.register_knn(spark, "near_test", b, 3)


def test_near_values_hold_every_distance_within_their_error():
    from nearwell.functions import distances

    rng = np.random.default_rng(8)
    q, b = rng.normal(size=(30, 9)) * 3, rng.normal(size=(70, 9)) * 3
    q[:4, :5], b[:9, 3:] = 0, 0
    b[20:30] = q[:10]
    for name in ("l1", "max", "minkowski3", "minkowski2", "hist_intersect", "hellinger", "chi_square", "kullback_leibler", "kullback_leibler_query", "l2"):
        for scale in (1.0, 1e-5, 1e4):
            d = distances.get(name)
            x, y = (np.abs(v) * scale for v in (q, b))
            near, error = d.bounds(x, y)
            assert (np.abs(near - d.matrix(x, y)) <= error).all() and error.shape == (1, len(b)), name
    assert distances.get("kullback_leibler").bounds(q, b) is None and distances.get("chi_square").bounds(q, b) is None and distances.get("l1").bounds(q * 1e9, b) is None
    with pytest.raises(ValueError):
        distances.get("hellinger").bounds(q, b)


def test_rough_near_values_are_within_their_error():
    rng = np.random.default_rng(6)
    for scale, shift in ((1.0, 0.0), (1e-12, 0.0), (1e6, 0.0), (1.0, 50.0)):
        q, b = rng.random((40, 24)) * scale + shift, rng.random((300, 24)) * scale + shift
        b[:5] = q[:5]
        q[7, :9] = 0
        for name in ("l2", "l1", "hellinger", "kullback_leibler", "kullback_leibler_query"):
            d = distances.get(name)
            near, error = d.bounds(q, b, True)
            assert near.dtype == np.float32 and (np.abs(near - d.matrix(q, b)) <= error).all(), (name, scale, shift)
            best = knn._Best(40, 6)
            for _ in knn.meet(d, best, np.arange(40), np.arange(40), q, np.arange(300), b, None, True):
                pass
            want = np.sort(d.matrix(q, b), axis=1)[:, :6]
            assert (best.dist == want).all(), (name, scale, shift)
    assert distances.get("l1").bounds(q * 0, b * 0, True) is None and distances.get("l2").bounds(q * 1e200, b, True) is None


def test_points_in_several_trees_count_once_when_merged():
    best = knn._Best(3, 3, unique=True)
    best._merge(np.array([0, 0, 0, 2, 2]), np.array([2.0, 1.0, 1.0, np.nan, 5.0]), np.array([8, 9, 4, 1, 2]))
    best._merge(np.array([0, 0, 2]), np.array([1.0, 1.5, 5.0]), np.array([9, 7, 2]))
    assert best.id[0].tolist() == [4, 9, 7] and best.dist[2].tolist() == [5.0, np.inf, np.inf] and best.dist[1].tolist() == [np.inf] * 3


@pytest.mark.parametrize("fits", [1 << 20, 9000, 8000])
def test_many_queries_are_not_one_task(spark, monkeypatch, fits):
    """Over a base of one partition; with points sent, queries sent, and neither."""
    monkeypatch.setattr(knn, "DEALT", 50)
    monkeypatch.setattr(knn, "BROADCAST_BYTES", fits)
    x = np.random.default_rng(2).random((900 if fits != 1 << 20 else 1200, 6)).round(1)
    b, q = table(spark, x).coalesce(1), table(spark, x[:150] if fits != 1 << 20 else x).coalesce(1)
    for name in ("l2", "l1"):
        pairs = knn._candidates(q, b, name, 4, None, False, "auto")
        assert pairs.select(F.spark_partition_id()).distinct().count() > 1
        d = distances.get(name).matrix(x[: q.count()], x)
        np.fill_diagonal(d, np.inf)
        got = found(knn.knn_join(q, b, 4, name, itself=False))
        assert got == {(i, r + 1): (int(j), float(d[i, j])) for i in range(len(d)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4])}
    assert knn.radius_count(q, b, 0.05).agg(F.sum("n")).first()[0] == (distances.get("l2").matrix(x[: q.count()], x) < 0.05).sum()


def test_bits_of_longs_are_counted_by_word():
    from nearwell.functions import distances

    rng = np.random.default_rng(8)
    q, b = rng.integers(0, 1 << 20, (7, 13)), rng.integers(0, 1 << 20, (11, 13))
    want = [[sum((int(x) ^ int(y)).bit_count() for x, y in zip(r, s, strict=True)) for s in b] for r in q]
    assert distances.get("hamming").matrix(q.astype(float), b.astype(float)).tolist() == want
    assert not distances.get("hamming").matrix(np.zeros((2, 3)), np.zeros((4, 3))).any()


def test_few_components_meet_near_tiles_only(monkeypatch):
    rng = np.random.default_rng(4)
    x, q = np.column_stack((rng.integers(0, 9, 6000), rng.normal(size=6000).round(2))), np.column_stack((rng.integers(0, 9, 700), rng.normal(size=700).round(2)))
    met, meet = [], knn.meet
    monkeypatch.setattr(knn, "TILE", 32)
    monkeypatch.setattr(knn, "meet", lambda d, best, part, *a: met.append(len(part) * len(a[2])) or meet(d, best, part, *a))
    for name in ("l2", "l1", "max", "minkowski3"):
        want = [sorted(zip(r.tolist(), range(6000), strict=True))[:4] for r in distances.get(name).matrix(q, x)]
        met.clear()
        got = knn.best_of(np.arange(700), q, np.arange(6000), x, name, 4).to_pandas().sort_values(["qid", "dist", "id"])
        assert [list(zip(g["dist"], g["id"], strict=True)) for _, g in got.groupby("qid")] == want
        assert sum(met) < 700 * 6000 // 4, (name, sum(met))
        near = knn.best_of(np.arange(700), q, np.arange(6000), x, name, None, 0.04)
        assert near.num_rows == (distances.get(name).matrix(q, x) < 0.04).sum()


def test_table_function_looks_about_the_place_of_a_query(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.column_stack((rng.integers(0, 3, 3000), rng.random(3000).round(3) * 100))
    b, q = table(spark, x), table(spark, np.vstack((x[:20] + 0.01, [[1, -50.0], [1, 500.0]])))
    q.createOrReplaceTempView("some_queries")
    for name in ("l2", "chi_square", "kullback_leibler"):
        y = np.abs(x) if name != "l2" else x
        table_functions.register_knn(spark, f"near_{name}", table(spark, y), 4, name)
        view = q.where("v[1] > 0") if name != "l2" else q
        view.createOrReplaceTempView("some_queries")
        got = spark.sql(f"SELECT q.id AS qid, n.rank, n.id, n.dist FROM some_queries q, LATERAL near_{name}(q.v) n")
        assert found(got) == found(knn.knn_join(view, table(spark, y), 4, name, method="blocks"))
    seen, best_of = [], knn.best_of
    monkeypatch.setattr(knn, "best_of", lambda *a: seen.append(len(a[2])) or best_of(*a))
    kept = {}
    monkeypatch.setattr(type(spark.udtf), "register", lambda self, n, f: kept.update({n: f.func}))
    table_functions.register_knn(spark, "counted", b, 4)
    assert len(list(kept["counted"]().eval([1.0, 50.0]))) == 4 and max(seen) < 3000
