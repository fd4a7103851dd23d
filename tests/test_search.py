import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwell.functions import distances
from nearwell.functions.vectors import VectorError
from nearwell.operators import classify, cluster, evaluate, knn, sampling, stats
from nearwell.operators.index import SearchParams, create, load
from nearwell.operators.index.lsh import xor_masks
from nearwell.operators.index.trees import KdTree


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "id long, v array<double>")


def brute(q, b, k, name="l2"):
    d = distances.get(name).matrix(np.asarray(q, float), np.asarray(b, float))
    return {(i, r + 1): (int(j), float(d[i, j])) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(b)), d[i]))[:k])}


def found(df):
    return {(r["qid"], r["rank"]): (r["id"], r["dist"]) for r in df.collect()}


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(3).random((300, 3))


@pytest.mark.parametrize("name", [n for n in distances.DISTANCES if not n.startswith("hamming")])
def test_forms_of_a_distance_agree(spark, name):
    rng = np.random.default_rng(1)
    a, b = rng.random((6, 5)) * (rng.random((6, 5)) > 0.2), rng.random((6, 5)) * (rng.random((6, 5)) > 0.2)
    want = np.diag(distances.get(name).matrix(a, b))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>")
    d = distances.get(name)
    rows = df.select(d.expression(F.col("a"), F.col("b")).alias("x"), d.expression(F.col("a"), F.col("b"), 5).alias("y")).collect()
    assert np.allclose([r["x"] for r in rows], want, atol=1e-12) and np.allclose([r["y"] for r in rows], want, atol=1e-12)


def test_names_numbers_and_combinations():
    assert distances.get(1).name == "l2" and distances.get("Manhattan").name == "l1" and distances.get("minkowski4").name == "minkowski4"
    with pytest.raises(ValueError):
        distances.get("nonsense")
    with pytest.raises(ValueError):
        distances.check_combination("kdtree", "max")
    distances.check_combination("kmeans", "max")


@pytest.mark.parametrize("method", ["blocks", "expression"])
def test_exact_join(spark, cloud, method):
    b = table(spark, cloud)
    q = table(spark, cloud[:40])
    assert found(knn.knn_join(q, b, 10, method=method)) == brute(cloud[:40], cloud, 10)


def test_dealt_blocks_agree(spark, cloud, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 2048)
    b = table(spark, cloud)
    assert found(knn.knn_join(b, b, 4, method="blocks")) == brute(cloud, cloud, 4)


@pytest.mark.parametrize("parts", [1, 60, 300])
def test_no_query_finds_itself_at_any_partitioning(spark, cloud, parts):
    """A task that sees fewer rows than k must not fill up with pairs that are left out: the query itself, or what lies beyond the radius."""
    b = table(spark, cloud).repartition(parts)
    q = table(spark, cloud[:50])
    d = distances.get("l2").matrix(cloud[:50], cloud)
    d[np.arange(50), np.arange(50)] = np.inf
    k = 6
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    assert found(knn.knn_join(q, b, k, itself=False)) == {(i, r + 1): (int(j), float(d[i, j])) for i in range(50) for r, j in enumerate(order[i])}
    radius = 0.004  # fewer hits than k for most
    within = {(i, r + 1): (int(j), float(d[i, j])) for i in range(50) for r, j in enumerate(order[i]) if d[i, j] < radius}
    assert found(knn.radius_join(q, b, radius, max_neighbours=k, itself=False)) == within
    shards = [b.where(F.pmod("id", F.lit(3)) == i) for i in range(3)]
    assert found(knn.sharded_radius(q, shards, radius, max_neighbours=k, itself=False)) == within
    assert knn.knn_join(q, b, 1000, itself=False).count() == 50 * 299


@pytest.mark.parametrize("n", [32, 33])
def test_infinite_distances_are_kept_and_non_finite_vectors_refused(spark, n):
    """The forms behave alike on both sides of FEW_QUERIES."""
    q = table(spark, [[float(i)] for i in range(n)])
    for parts in (1, 2):
        b = table(spark, [[0.0], [1e200], [2e200]]).repartition(parts)
        got = found(knn.knn_join(q, b, 5))
        assert got == {(i, r): (r - 1, float(i * i) if r == 1 else float("inf")) for i in range(n) for r in (1, 2, 3)}
        assert got == found(knn.knn_join(q, b, 5, method="blocks"))
    for value in (float("nan"), float("inf")):
        odd = table(spark, [[0.0], [value]])
        with pytest.raises(VectorError):
            knn.knn_join(odd, q, 2)
        with pytest.raises(Exception, match="VectorError"):
            knn.knn_join(q, odd, 2).collect()


def test_ties_large_k_and_duplicates(spark):
    x = [[0.0], [1.0], [1.0], [-1.0]]
    b = table(spark, x, [4, 3, 2, 1])
    q = table(spark, [[0.0]])
    assert [r["id"] for r in knn.knn_join(q, b, 9).orderBy("rank").collect()] == [4, 1, 2, 3]
    assert [r["id"] for r in knn.knn_join(q, b, 2, method="blocks").orderBy("rank").collect()] == [4, 1]


def test_bad_vectors_are_refused(spark):
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, v array<double>")
    null = spark.createDataFrame([(0, [1.0, None])], "id long, v array<double>")
    for bad in (ragged, null):
        with pytest.raises(VectorError):
            knn.knn_join(bad, bad, 1).collect()
    with pytest.raises(ValueError):
        create(spark.createDataFrame([], "id long, v array<double>"), "kdtree").build()


def test_radius(spark, cloud):
    b = table(spark, cloud)
    d = distances.get("l2").matrix(cloud, cloud)
    n = {r["qid"]: r["n"] for r in knn.radius_count(b, b, 0.01).collect()}
    assert n == {i: int((d[i] < 0.01).sum()) for i in range(len(cloud))}
    assert knn.radius_join(b, b, 0.01).count() == sum(n.values())
    assert knn.radius_join(b, b, 0.01, max_neighbours=2).count() == sum(min(v, 2) for v in n.values())
    assert knn.radius_join(b, b, 0.01, max_neighbours=0).count() == 0
    assert knn.radius_count(b, b, 0.0, itself=False).agg(F.sum("n")).first()[0] == 0


@pytest.mark.parametrize("method,params", [("kdtree_single", {"leaf_size": 8}), ("kdtree", {"trees": 2, "leaf_size": 16}), ("kmeans", {"branching": 4, "leaf_size": 20}), ("hierarchical", {"branching": 4, "trees": 2, "leaf_size": 20}), ("composite", {"trees": 2, "branching": 4, "leaf_size": 20})])
def test_indexes_are_exact_at_full_budget(spark, cloud, method, params):
    # 300 points of small scale: pruning by unsquared gaps would lose neighbours here
    b = table(spark, cloud)
    index = create(b, method, **params).build()
    assert found(index.knn(table(spark, cloud[:30]), 10, SearchParams(checks=-1))) == brute(cloud[:30], cloud, 10)


def test_budget_raises_recall(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, (60, 8)) for c in rng.random((8, 8))])
    b = table(spark, x)
    truth = knn.knn_join(b, b, 5).cache()
    index = create(b, "kdtree", trees=2, leaf_size=10).build()
    r = [evaluate.recall(index.knn(b, 5, SearchParams(checks=c)), truth).first()["recall"] for c in (5, 40, -1)]
    assert r[0] <= r[1] + 0.02 and r[1] > 0.6 and r[2] == 1.0
    assert index.knn(b, 5, SearchParams(checks=1)).count() == 5 * len(x)
    target = evaluate.checks_for_precision(lambda c: index.knn(b, 5, SearchParams(checks=c)), truth, [0.5], first=5)
    assert target[0][2] >= 0.5


METHODS = [("kdtree", {"trees": 2, "leaf_size": 16}), ("kdtree_single", {"leaf_size": 8}), ("kdtree_cyclic", {"leaf_size": 8}), ("kmeans", {"branching": 4, "leaf_size": 20}), ("hierarchical", {"branching": 4, "trees": 2, "leaf_size": 20}), ("composite", {"trees": 2, "branching": 4, "leaf_size": 20}), ("linear", {})]


@pytest.mark.parametrize("method,params", METHODS)
def test_points_added_without_rebuild_are_found(spark, cloud, method, params, tmp_path):
    b, q = table(spark, cloud), table(spark, cloud[250:280])
    index = create(b.where("id < 160"), method, rebuild_threshold=0, **params).build()
    index.add(b.where("id >= 160"))
    want = brute(cloud[250:280], cloud, 6)
    for checks in (-1, 1 << 30):
        assert found(index.knn(q, 6, SearchParams(checks=checks))) == want
    index.remove([0, 5])
    index.save(str(tmp_path / "index"))
    again = load(spark, str(tmp_path / "index"))
    assert type(again) is type(index) and again.size() == 298
    assert found(again.knn(q, 6, SearchParams(checks=1 << 30))) == found(index.knn(q, 6, SearchParams(checks=-1)))


def test_autotuned(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, (60, 8)) for c in rng.random((8, 8))])
    b = table(spark, x)
    index = create(b, "autotuned", sample_fraction=0.5, extra={"trials": [("kmeans", {"branching": 8, "iterations": 2}), ("kdtree", {"trees": 2})]}).build()
    assert [r[0] for r in index.report] == ["linear", "kmeans", "kdtree"] and len(index.TRIALS) == 25
    truth = knn.knn_join(b, b, 1)
    assert evaluate.recall(index.knn(b, 1), truth).first()["recall"] > 0.7
    index.save(str(tmp_path / "tuned"))
    again = load(spark, str(tmp_path / "tuned"))
    assert found(again.knn(b, 1)) == found(index.knn(b, 1)) and again.checks == index.checks
    assert found(again.knn(b, 3, SearchParams(checks=-1))) == brute(x, x, 3)


def test_crowded_cells_are_dealt(spark, cloud, monkeypatch):
    from nearwell.operators.index import cells

    monkeypatch.setattr(cells, "CELL_BYTES", 7 * 8 * 3)
    monkeypatch.setattr(cells, "PROBES", 0)  # queries and points are brought together by a shuffle
    b = table(spark, np.concatenate((cloud, np.tile(cloud[:1], (40, 1)))))
    index = create(b, "kmeans", branching=4, leaf_size=60).build()
    assert found(index.knn(b, 50, SearchParams(checks=1 << 30))) == found(knn.knn_join(b, b, 50))


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e12, 1e200])
def test_bounded_products_keep_the_last_bit(scale):
    rng = np.random.default_rng(3)
    x = (rng.random((500, 40)) - 0.5) * scale
    x[100:200] = x[:100]  # ties
    x[200:300] = x[:100] * (1 + 1e-15)
    for itself in (True, False):
        got = knn.best_of(np.arange(500), x, np.arange(500), x, "l2", 7, None, itself).to_pylist()
        d = distances.get("l2").matrix(x, x)
        if not itself:
            d[np.arange(500), np.arange(500)] = np.nan  # sorts last
        order = np.argsort(d, axis=1, kind="stable")[:, :7]
        assert [(r["qid"], r["id"], r["dist"]) for r in got] == [(i, int(j), float(d[i, j])) for i in range(500) for j in order[i]]  # infinite ones too


def test_hellinger_refuses_negative_components(spark):
    b = table(spark, [[0.5, 0.5], [-0.1, 1.1]])
    for method in ("expression", "blocks"):
        with pytest.raises(Exception, match="hellinger is defined"):
            knn.knn_join(b, b, 1, "hellinger", method=method).collect()


def test_traversal(spark):
    x = np.random.default_rng(2).random((1 << 9, 4))
    index = create(table(spark, x), "kdtree_cyclic", leaf_size=1).build()
    nodes = {n["node"]: n for n in index.traverse()}
    leaves = [n for n in nodes.values() if n["left"] is None]
    assert sorted(r["id"] for n in leaves[:20] for r in index.leaf(n["cell"]).collect()) and len(leaves) == 1 << 9
    for n in nodes.values():
        if n["left"] is not None:
            assert n["split_dim"] == n["depth"] % 4 and n["left"] in nodes and n["right"] in nodes


def test_clone_and_swap(spark, cloud):
    a, b = (create(table(spark, cloud[k : k + 100], range(k, k + 100)), "kdtree", trees=1, leaf_size=20).build() for k in (0, 100))
    copy = a.clone()
    copy.remove([0])
    copy.add(table(spark, [[9.0, 9.0, 9.0]], [777]))
    assert a.size() == 100 and copy.size() == 100 and a.get_point(777).count() == 0
    a.swap(b)
    assert a.get_point(150).count() == 1 and b.get_point(50).count() == 1


def test_user_distance(spark, cloud):
    weighted = distances.Distance("weighted", lambda x, y: F.abs(x - y) * 2, lambda x, y: np.abs(x - y) * 2, "abs({x}-{y})*2", metric_space=False)
    b = table(spark, cloud)
    want = {k: (i, 2 * d) for k, (i, d) in brute(cloud[:40], cloud, 3, "l1").items()}
    got = found(knn.knn_join(table(spark, cloud[:40]), b, 3, weighted))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert found(create(b, "kdtree", weighted, trees=1).build().knn(table(spark, cloud[:40]), 3, SearchParams(checks=1 << 30))) == got


def test_sharded_radius(spark, cloud):
    b, q = table(spark, cloud), table(spark, cloud[:20])
    shards = [b.where("id < 90"), b.where("id >= 90")]
    assert found(knn.sharded_radius(q, shards, 0.02)) == found(knn.radius_join(q, b, 0.02))
    assert found(knn.sharded_radius(q, shards, 0.02, max_neighbours=2)) == found(knn.radius_join(q, b, 0.02, max_neighbours=2))


def test_maintenance_and_storage(spark, cloud, tmp_path):
    b = table(spark, cloud)
    index = create(b.where("id < 200"), "kdtree", trees=1, leaf_size=16, rebuild_threshold=1.2).build()
    index.add(b.where("id >= 200"))
    assert index.built_size == 300  # grew beyond the threshold and was built again
    index.remove([0, 1, 2])
    q = table(spark, cloud[:3])
    kept = cloud[3:]
    want = {k: (i + 3, d) for k, (i, d) in brute(cloud[:3], kept, 4).items()}
    assert found(index.knn(q, 4, SearchParams(checks=-1))) == want
    assert index.size() == 297 and index.get_point(1).count() == 0 and index.get_point(5).count() == 1
    index.save(str(tmp_path / "index"))
    again = load(spark, str(tmp_path / "index"))
    assert found(again.knn(q, 4, SearchParams(checks=-1))) == want and again.parameters()["algorithm"] == "kdtree"
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "index"), "l1")


def test_tree_partition():
    x = np.random.default_rng(2).random((1 << 12, 16))
    tree = KdTree(x, 1, np.random.default_rng(0))
    assert sorted(np.bincount(tree.descend(x)).tolist()) == [1] * (1 << 12)
    inner = tree.dim >= 0
    assert ((tree.left >= 0) == inner).all() and ((tree.right >= 0) == inner).all() and len(tree.dim) == 2 * (1 << 12) - 1
    same = KdTree(np.zeros((50, 4)), 1)
    assert same.cells == 1


def test_forest_api(spark, cloud):
    index = create(table(spark, cloud), "kdtree", trees=2, leaf_size=50).build()
    assert index.cells.groupBy("table_no").count().where("count <> 300").count() == 0
    assert "cell" in index.outline() and index.nodes().where("split_dim < 0").count() == len(index.forest.leaves())
    assert index.veclen() == 3 and index.used_memory() > 0 and index.clone().size() == 300


def test_lsh_with_all_masks_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (60, 2)).astype(float)
    b = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "id long, v array<bigint>")
    index = create(b, "lsh", "hamming", table_number=1, key_size=4, multi_probe_level=4).build()
    assert found(index.knn(b, 3)) == brute(x, x, 3, "hamming")
    assert len(xor_masks(20, 2)) == 211
    exact = found(knn.knn_join(b, b, 3, "hamming"))
    few = create(b, "lsh", "hamming", table_number=2, key_size=8, multi_probe_level=0).build()
    assert found(few.knn(b, 3, SearchParams(checks=-1))) == exact != found(few.knn(b, 3))


def test_crowded_buckets_are_dealt(spark, monkeypatch):
    from nearwell.operators.index import cells

    rng = np.random.default_rng(6)
    x = np.concatenate((np.full((80, 2), 7), rng.integers(0, 256, (60, 2))))
    b = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "id long, v array<bigint>")
    index = create(b, "lsh", "hamming", table_number=3, key_size=4, multi_probe_level=1).build()
    want = found(index.knn(b, 5))
    assert {k: v for k, v in want.items() if k[0] < 80} == {k: v for k, v in brute(x, x, 5, "hamming").items() if k[0] < 80}
    monkeypatch.setattr(cells, "CELL_BYTES", 7 * 8 * 2)
    assert found(index.knn(b, 5)) == want
    index.remove([0])
    index.add(spark.createDataFrame([(500, [7, 7])], "id long, v array<bigint>"))
    got = found(index.knn(b.where("id = 1"), 90))
    assert (500, 0.0) in got.values() and 0 not in {i for i, _ in got.values()}


def test_numbers_name_methods_and_searches_agree(spark, cloud):
    from nearwell.operators.index.base import NUMBERS

    b = table(spark, cloud[:60])
    for number in (0, 1, 2, 4, 5):
        index = create(b, number, leaf_size=20, branching=4, trees=2).build()
        assert index.method == NUMBERS[number] and found(index.knn(b, 2, SearchParams(checks=-1))) == brute(cloud[:60], cloud[:60], 2)
    with pytest.raises(ValueError):
        create(b, 17)


def test_squares_and_ratios(spark):
    rows = spark.createDataFrame([(4.0, 2.0), (0.0, 0.0)], "a double, b double")
    got = rows.select(distances.squared("l1", F.col("a")).alias("x"), distances.squared("l2", F.col("a")).alias("y"), distances.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(16.0, 4.0, 2.0), (0.0, 0.0, 1.0)]

def test_votes(spark):
    points = [(x, y) for x, y in itertools.product((-2, -1, 1, 2), repeat=2)]
    name = {(False, False): "lower left", (False, True): "upper left", (True, False): "lower right", (True, True): "upper right"}
    b = table(spark, points)
    labels = spark.createDataFrame([(i, name[p[0] > 0, p[1] > 0]) for i, p in enumerate(points)], "id long, label string")
    q = table(spark, [(-0.4, -1.3), (-3, 2.4), (1.2, -0.1), (4.5, 1.6)])
    want = {0: "lower left", 1: "upper left", 2: "lower right", 3: "upper right"}
    near = knn.knn_join(q, b, 3)
    for vote in (classify.majority, classify.majority_first_seen, classify.inverse_distance):
        assert {r["qid"]: r["label"] for r in vote(near, labels).collect()} == want
    truth = spark.createDataFrame(list(want.items()), "id long, label string")
    assert evaluate.accuracy(classify.majority(near, labels), truth).first()["accuracy"] == 100.0
    hit = knn.knn_join(table(spark, [points[0]]), b, 3)
    assert classify.inverse_distance(hit, labels).first()["weight"] == 1.0
    three = classify.three_classes(near, labels.withColumn("label", F.col("id") % 4)).orderBy("qid").first()
    assert three["c1"] + three["c2"] + three["c3"] == 3


def test_statistics(spark):
    b = table(spark, [(0.5, 5, 50), (1, 10, 100), (1, 10, 100), (1.5, 15, 150)])
    rows = stats.mean_variance(b).orderBy("dim").collect()
    assert np.allclose([(r["mean"], r["variance"]) for r in rows], [(1, 0.5), (10, 50), (100, 5000)], rtol=1e-12)
    assert [r["dim"] for r in stats.widest(b, 2).collect()] == [2, 1]
    assert stats.median(b, 0).first()["median"] == 1.0
    assert tuple(stats.plane_split(b, 0, 1.0).first()) == (1, 2, 1)
    assert stats.bounding_box(b).orderBy("dim").first()["high"] == 1.5


def test_clustering(spark):
    x = np.concatenate([np.random.default_rng(i).normal(10 * i, 0.1, (30, 2)) for i in range(3)])
    b = table(spark, x)
    for chooser in ("random", "gonzales", "kmeanspp", "groupwise"):
        start = cluster.CHOOSERS[chooser](b, 3)
        assert len(start) == 3
    centres = cluster.lloyd(b, [list(v) for _, v in cluster.gonzales(b, 3)], -1)
    assert np.allclose(sorted(c[0] for c in centres), [0, 10, 20], atol=0.2)
    assert cluster.cost(cluster.assign(b, cluster.centre_table(spark, centres))).first()["cost"] < 10
    assert len(cluster.cluster_centres(b, 3)) == 3


def test_sampling(spark):
    b = table(spark, np.zeros((100, 1)))
    a, rest = sampling.split(b, 30, seed=2)
    assert a.count() == 30 and rest.count() == 70 and a.join(rest, "id").count() == 0
    assert [r["id"] for r in sampling.random_sample(b, 5, 1).collect()] == [r["id"] for r in sampling.random_sample(b, 5, 1).collect()]
    u = sampling.uniform(spark, 50, 4, seed=1, low=-1)
    assert u.count() == 50 and all(-1 <= c < 1 for r in u.collect() for c in r["v"])


def test_shards_and_nested(spark, cloud):
    b = table(spark, cloud)
    q = table(spark, cloud[:5])
    assert found(knn.sharded_knn(q, [b.where("id < 100"), b.where("id >= 100")], 6)) == brute(cloud[:5], cloud, 6)
    assert all(len(r["neighbours"]) == 6 for r in knn.nested(knn.knn_join(q, b, 6)).collect())


def test_running_distances_equal_those_to_all_centres(spark, monkeypatch):
    monkeypatch.setattr(cluster, "ROUNDS", 3)
    x = np.random.default_rng(4).random((120, 3))
    b = table(spark, x)
    chosen = [i for i, _ in cluster.gonzales(b, 9)]
    want, d = [0], distances.get("l2").matrix(x, x)
    while len(want) < 9:
        want.append(int(np.argmax(d[want].min(axis=0))))
    assert chosen == want
    for chooser in ("kmeanspp", "groupwise"):
        assert len({tuple(c) for c in cluster.CHOOSERS[chooser](b, 8)}) == 8


def test_best_cut(spark):
    rows = [(0, None, 100, 10.0), (1, 0, 60, 8.0), (2, 0, 40, 1.0), (3, 1, 30, 1.0), (4, 1, 30, 1.0), (5, 2, 20, 0.5), (6, 2, 20, 0.5), (7, 3, 10, 0.9), (8, 3, 20, 0.9)]
    nodes = spark.createDataFrame(rows, "node long, parent long, size long, variance double")
    cuts = {m: sorted(r["node"] for r in cluster.best_cut(nodes, m).collect()) for m in (1, 2, 3, 4, 5, 9)}
    assert cuts == {1: [0], 2: [1, 2], 3: [2, 3, 4], 4: [3, 4, 5, 6], 5: [4, 5, 6, 7, 8], 9: [4, 5, 6, 7, 8]}
    with pytest.raises(ValueError):
        cluster.best_cut(nodes.where("node > 0"), 3)
    x = np.concatenate([np.random.default_rng(i).normal(10 * i, 0.1, (40, 2)) for i in range(4)])
    index = create(table(spark, x), "kmeans", branching=2, leaf_size=10, centers_init="gonzales").build()
    centres = sorted(r["centre"][0] for r in index.cluster_centres(4).collect())
    assert np.allclose(centres, [0, 10, 20, 30], atol=0.2) and index.cluster_centres(4).agg(F.sum("size")).first()[0] == 160


def test_samples_depend_on_ids_and_seed_only(spark):
    b = table(spark, np.arange(300)[:, None])
    few, rest = sampling.share(b, 20, seed=3)
    again, _ = sampling.share(b.repartition(7), 20, seed=3)
    ids = sorted(r["id"] for r in few.collect())
    assert ids == sorted(r["id"] for r in again.collect()) and 30 < len(ids) < 90 and rest.count() == 300 - len(ids)
    assert [r["id"] for r in sampling.first_rows(b, 4).collect()] == [0, 1, 2, 3]
    order = [r["id"] for r in sampling.permutation(b, 1).orderBy("order", "id").collect()]
    assert sorted(order) == list(range(300)) != order and order != [r["id"] for r in sampling.permutation(b, 2).orderBy("order", "id").collect()]


def test_median_ranks_only_what_lies_about_it(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=5001), rng.integers(0, 3, 4000).astype(float), np.array([4.0, 1.0]), np.zeros(7)):
        b = spark.createDataFrame([([float(v)],) for v in x] + [([None],)], "v array<double>")
        got = stats.median(b, 0)
        assert got.first()["median"] == np.sort(x)[(len(x) - 1) // 2]
        assert "percentile_disc" not in got._jdf.queryExecution().toString().lower()
    assert stats.median(spark.createDataFrame([], "v array<double>"), 0).first()["median"] is None


@pytest.mark.parametrize("name", ["l2", "l1", "hellinger", "kullback_leibler", "kullback_leibler_query"])
@pytest.mark.parametrize("kind", ["even", "copies", "far", "zeros"])
def test_screens_leave_out_no_neighbour(name, kind):
    """Sides prepared once for products in single precision: the k best equal those of the distances themselves."""
    r = np.random.default_rng(3)
    x = r.standard_normal((5000, 24)) / 5
    if kind == "copies":
        x = x[r.integers(0, 400, len(x))]
    elif kind == "far":
        x = x + 1000
    elif kind == "zeros":
        x[r.random(x.shape) < 0.5] = 0
    x = x if name in ("l2", "l1") else np.abs(x)
    q, d, ids, qids = x[:300], distances.get(name), r.permutation(len(x)), np.arange(300)
    assert d.screen(q, x) is not None
    dist = d.matrix(q, x)
    dist[qids[:, None] == ids[None, :]] = np.nan
    near = d.screen(q, x)
    held = np.empty(300 * len(x), np.float32)
    values, error = near.near(slice(0, 300), slice(0, len(x)), held)
    assert np.nanmax(values - dist) <= error.max()
    assert near.floor or np.nanmax(dist - values) <= error.max()
    got = knn.best_of(qids, q, ids, x, name, 4, itself=False).sort_by([("qid", "ascending"), ("dist", "ascending"), ("id", "ascending")])
    order = np.lexsort((np.broadcast_to(ids, dist.shape), dist), axis=1)[:, :4]
    assert got["qid"].to_pylist() == np.repeat(qids, 4).tolist()
    assert got["id"].to_pylist() == ids[order].ravel().tolist()
    assert got["dist"].to_pylist() == np.take_along_axis(dist, order, axis=1).ravel().tolist()


def test_lower_bounds_of_l1_leave_few_pairs():
    """Over vectors without structure a product of matrices tells nearly all pairs of l1 apart."""
    r = np.random.default_rng(5)
    x = r.standard_normal((20_000, 64))
    d = distances.get("l1")
    screen = d.screen(x[:256], x)
    dist = d.matrix(x[:256], x)
    near, error = screen.near(slice(0, 256), slice(0, len(x)), np.empty(256 * len(x), np.float32))
    kth = np.partition(dist, 10, axis=1)[:, 10]
    assert (near <= (kth + error.max())[:, None]).mean() < 0.05


@pytest.mark.parametrize("sent", [True, False])
def test_all_within_a_radius_is_ranked_where_it_is_found(spark, monkeypatch, sent):
    """No found pair is shuffled: the plan has no window, and ranks are those of a sort by (dist, id), also where queries share an id."""
    monkeypatch.setattr(knn, "DEALT", 64)
    if not sent:
        monkeypatch.setattr(knn, "BROADCAST_BYTES", 4096)
    r = np.random.default_rng(8)
    x = r.standard_normal((700, 6))
    x[300:400] = x[100:200]
    ids = [5, 5, *range(10, 708)]
    t = table(spark, x, ids)
    for itself in (True, False):
        out = knn.radius_join(t, t, 2.0, itself=itself)
        assert "Window" not in out._jdf.queryExecution().toString()
        want, dist = {}, distances.get("l2").matrix(x, x)
        for i, j in zip(*np.nonzero(dist < 2.0), strict=True):
            if itself or ids[i] != ids[j]:
                want.setdefault(ids[i], []).append((dist[i, j], ids[j]))
        want = sorted((q, n + 1, p, d) for q, v in want.items() for n, (d, p) in enumerate(sorted(v)))
        assert sorted(map(tuple, out.collect())) == want


@pytest.mark.parametrize("sent", [True, False])
def test_radius_of_cells_is_ranked_where_it_is_found(spark, monkeypatch, sent):
    from nearwell.operators.index import cells

    monkeypatch.setattr(cells, "PROBES", 100)
    r = np.random.default_rng(9)
    b, q = r.random((2000, 2)) * [20, 1000], r.random((300, 2)) * [20, 1000]
    index = create(table(spark, b), "kdtree_single", leaf_size=20).build()
    index.remove([3, 4, 5])
    if not sent:
        monkeypatch.setattr(knn, "BROADCAST_BYTES", 1024)
    out = index.radius(table(spark, q), 900.0)
    assert "Window" not in out._jdf.queryExecution().toString()
    dist = distances.get("l2").matrix(q, b)
    dist[:, [3, 4, 5]] = np.inf
    want = sorted((i, n + 1, int(p), dist[i, p]) for i in range(len(q)) for n, p in enumerate(np.lexsort((np.arange(len(b)), dist[i]))) if dist[i, p] < 900)
    assert sorted(map(tuple, out.collect())) == want


@pytest.mark.parametrize("name", [n for n in distances.DISTANCES if not n.startswith("hamming")])
@pytest.mark.parametrize("n", [1, 7, 8, 513, 1031])
def test_pairs_add_in_order_of_components(name, n):
    """A pair's distance has the same bits as in a matrix, whatever the number of pairs."""
    r = np.random.default_rng(n)
    q, b, d = r.random((n, 37)), r.random((n, 37)), distances.get(name)
    assert d.pairs(q, b).tolist() == [float(d.matrix(q[i : i + 1], b[i : i + 1])[0, 0]) for i in range(n)]


@pytest.mark.parametrize("fits", [1 << 20, 4096, 512])
def test_vectors_of_floats_are_dealt_as_floats(spark, monkeypatch, fits):
    """Points sent, queries sent, and neither; l2 and l1."""
    monkeypatch.setattr(knn, "DEALT", 10)
    x = np.random.default_rng(8).normal(size=(90, 6)).astype(np.float32).astype(float)
    b, few = table(spark, x), table(spark, x[:50 if fits == 4096 else 90])
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 50 * 32 if fits == 4096 else fits)
    for name in ("l2", "l1"):
        out = knn.knn_join(few, b, 4, name)
        assert "array<float>" in out._jdf.queryExecution().analyzed().toString()
        assert found(out) == brute(x[: few.count()], x, 4, name)
    other = table(spark, x + 1e-12)
    out = knn.knn_join(few, other, 4)
    assert "array<float>" not in out._jdf.queryExecution().analyzed().toString() and found(out) == brute(x[: few.count()], x + 1e-12, 4)


def test_blocks_are_shuffled_once(spark, monkeypatch):
    """However many blocks either side has, none is copied by the shuffle."""
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 512)
    x = np.random.default_rng(9).normal(size=(120, 6))
    b = table(spark, x)
    out = knn.knn_join(b, b, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert found(out) == brute(x, x, 4)


@pytest.mark.parametrize("name", ["l2", "l1", "minkowski3", "l2_3d", "hellinger", "chi_square"])
def test_nearest_centres_are_those_of_the_matrix(name):
    d, x = distances.get(name), np.random.default_rng(2).random((300, 7))
    centres = np.vstack((x[:5], x[:5]))  # ties
    assert (d.nearest(x, centres) == d.matrix(x, centres).argmin(axis=1)).all() and d.nearest(x[:5], centres).max() < 5


def _all_within(x, ids, name, radius, itself):
    dist = distances.get(name).matrix(x, x)
    want = {}
    for i, j in zip(*np.nonzero(dist < radius), strict=True):
        if itself or ids[i] != ids[j]:
            want[ids[i]] = want.get(ids[i], 0) + 1
    return want


@pytest.mark.parametrize("fits", [1 << 20, 8192])
@pytest.mark.parametrize("name, dim", [("l2", 6), ("l1", 6), ("l2", 2), ("l2_3d", 6)])
def test_pairs_within_a_radius_are_counted_where_they_are_found(spark, monkeypatch, name, dim, fits):
    """No pair leaves a task: counts do, also of queries that share an id, of copies and of distances equal to the radius."""
    monkeypatch.setattr(knn, "DEALT", 64)
    monkeypatch.setattr(knn, "BROADCAST_BYTES", fits)
    x = np.random.default_rng(3).random((600, dim)).astype(np.float32).astype(float)
    x[300:400] = x[100:200]
    ids = [5, 5, *range(10, 608)]
    t, radius = table(spark, x, ids), float(distances.get(name).matrix(x[:1], x[9:10])[0, 0])
    for itself in (True, False):
        out = knn.within(t, t, radius, name, itself)
        assert "dist" not in out._jdf.queryExecution().executedPlan().toString()
        want = _all_within(x, ids, name, radius, itself)
        assert {r["qid"]: r["n"] for r in out.collect()} == want
        assert evaluate.found_total(out).first()[0] == sum(want.values())


@pytest.mark.parametrize("kind", ["even", "copies", "far", "zeros", "wide"])
def test_lower_bounds_of_chi_square_leave_out_no_neighbour(kind):
    r = np.random.default_rng(6)
    x = np.abs(r.standard_normal((5000, 24)))
    if kind == "copies":
        x = x[r.integers(0, 400, len(x))]
    elif kind == "far":
        x = x + 1000
    elif kind == "zeros":
        x[r.random(x.shape) < 0.5] = 0
    elif kind == "wide":
        x = 10 ** (20 * r.standard_normal(x.shape)).clip(-300, 25)
    q, d, ids, qids = x[:300], distances.get("chi_square"), r.permutation(len(x)), np.arange(300)
    near, error = d.screen(q, x).near(slice(0, 300), slice(0, len(x)), np.empty(300 * len(x), np.float32))
    dist = d.matrix(q, x)
    assert (near - dist).max() <= error.max()
    order = np.lexsort((np.broadcast_to(ids, dist.shape), dist), axis=1)[:, :4]
    got = knn.best_of(qids, q, ids, x, "chi_square", 4).sort_by([("qid", "ascending"), ("dist", "ascending"), ("id", "ascending")])
    assert got["id"].to_pylist() == ids[order].ravel().tolist()
    assert got["dist"].to_pylist() == np.take_along_axis(dist, order, axis=1).ravel().tolist()


def test_lower_bounds_of_chi_square_leave_few_pairs():
    r = np.random.default_rng(5)
    x = np.abs(r.standard_normal((20_000, 64)))
    d = distances.get("chi_square")
    near, error = d.screen(x[:256], x).near(slice(0, 256), slice(0, len(x)), np.empty(256 * len(x), np.float32))
    kth = np.partition(d.matrix(x[:256], x), 10, axis=1)[:, 10]
    assert (near <= (kth + error.max())[:, None]).mean() < 0.05


def test_all_points_are_shuffled_once_for_a_radius(spark, monkeypatch):
    """However many tasks hold all points, the shuffle makes no copy for each; several tiles, and queries that share an id."""
    from nearwell.operators.index import cells

    monkeypatch.setattr(knn, "DEALT", 64)
    monkeypatch.setattr(cells, "PROBES", 100)
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 1024)
    monkeypatch.setattr(knn, "TILE_BYTES", 16 << 10)
    r = np.random.default_rng(10)
    for dim, scale, radius in ((6, 1, 0.5), (2, [20, 1000], 900.0)):
        x = r.random((900, dim)) * scale
        ids = [5, 5, *range(10, 908)]
        q, b = table(spark, x, ids), table(spark, x)
        index = create(b, "kdtree_single", leaf_size=20).build()
        out = index.radius(q, radius) if dim == 2 else knn.radius_join(q, b, radius)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan
        want, dist = {}, distances.get("l2").matrix(x, x)
        for i, j in zip(*np.nonzero(dist < radius), strict=True):
            want.setdefault(ids[i], []).append((dist[i, j], int(j)))
        assert sorted(map(tuple, out.collect())) == sorted((i, n + 1, p, d) for i, v in want.items() for n, (d, p) in enumerate(sorted(v)))
