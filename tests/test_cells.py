"""Points stored by cell: what a search reads, how exact it is, and how cells grow."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwell.functions import distances
from nearwell.operators import evaluate, knn
from nearwell.operators.index import SearchParams, cells, create, load
from nearwell.operators.index.nodes import Boxes, box_bound, root
from nearwell.operators.index.trees import KdTree

from .test_search import brute, found, table


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(11)
    return np.concatenate([rng.normal(c, 0.03, (150, 6)) for c in rng.random((20, 6))])


def test_box_bounds_are_below_every_distance():
    rng = np.random.default_rng(5)
    for name in ("l2", "l2_3d", "l1", "max", "minkowski3", "hellinger", "chi_square", "hist_intersect", "kullback_leibler"):
        d = distances.get(name)
        for low_most in (0.0, -1.0) if not d.positive else (0.0,):
            x = rng.random((60, 5)) * (1 - low_most) + low_most
            q = rng.random((40, 5)) * (1 - low_most) + low_most
            low, high = np.tile(x.min(axis=0), (40, 1)), np.tile(x.max(axis=0), (40, 1))
            bound = box_bound(d, q, low, high)
            assert (bound <= d.matrix(q, x).min(axis=1)).all()
            if name not in ("kullback_leibler", "hist_intersect"):
                far = box_bound(d, q, low + 3, high + 3)
                assert (low_most < 0 or (far > 0).all()) and (far <= d.matrix(q, x + 3).min(axis=1)).all()


@pytest.mark.parametrize("name", ["l2", "l1", "hellinger", "chi_square", "hist_intersect", "minkowski3", "kullback_leibler"])
def test_single_tree_is_exact_under_every_distance(spark, clusters, name):
    x = np.abs(clusters[::6])
    b, q = table(spark, x), table(spark, x[:40] + 0.01)
    index = create(b, "kdtree_single", name, leaf_size=12).build()
    want = brute(x[:40] + 0.01, x, 4, name)
    assert found(index.knn(q, 4)) == want
    if name not in ("kullback_leibler", "hist_intersect"):  # a similarity and a divergence prune little or nothing
        assert index.visited(q, 4).agg(F.avg("share")).first()[0] < 0.7


def test_tight_boxes_visit_fewer_cells_than_split_planes(spark, clusters):
    tight = create(table(spark, clusters), "kdtree_single", leaf_size=20).build().forest
    planes = Boxes.load(tight.dump())
    planes.low[:], planes.high[:] = -np.inf, np.inf
    for node in range(len(planes)):  # parents come first
        for side in range(planes.count[node]):
            kid, at = planes.first[node] + side, planes.split[node]
            planes.low[kid], planes.high[kid] = planes.low[node], planes.high[node]
            (planes.low if side else planes.high)[kid, at] = planes.value[node]
    d = distances.get("l2")
    worst = np.sort(d.matrix(clusters[:200], clusters), axis=1)[:, 4]
    few, many = len(tight.within(d, clusters[:200], worst)[0]), len(planes.within(d, clusters[:200], worst)[0])
    assert few < 0.9 * many


@pytest.mark.parametrize("name", ["l2", "l1", "max", "hellinger", "minkowski3"])
def test_kmeans_tree_is_exact_by_pruning(spark, clusters, name):
    x = np.abs(clusters)
    index = create(table(spark, x), "kmeans", name, branching=8, leaf_size=25, iterations=5).build()
    q = table(spark, x[::50] + 0.005)
    assert found(index.knn(q, 5, SearchParams(checks=-1))) == brute(x[::50] + 0.005, x, 5, name)
    share = index.visited(q, 5, SearchParams(checks=-1)).agg(F.avg("share")).first()[0]
    assert share < 0.3


def test_budgets_bound_the_work_and_recall_is_high_on_clusters(spark, clusters):
    b, q = table(spark, clusters), table(spark, clusters[::15])
    truth = knn.knn_join(q, b, 5)
    for method, params in (("kdtree", {"trees": 4}), ("kmeans", {"branching": 8}), ("hierarchical", {"trees": 3, "branching": 8})):
        index = create(b, method, leaf_size=20, **params).build()
        trees = len(index.forest.roots)
        seen = []
        for checks in (1, 60, 300):
            v = index.visited(q, 5, SearchParams(checks=checks)).agg(F.max("points"), F.max("cells")).first()
            largest = int(index.forest.held[index.forest.leaves()].max())
            assert v[0] < max(checks, 5) * trees + largest
            seen.append(evaluate.recall(index.knn(q, 5, SearchParams(checks=checks)), truth).first()["recall"])
        assert seen[0] <= seen[1] + 0.02 and seen[2] >= 0.95, (method, seen)  # a tenth of the table


def test_best_first_finds_leaves_in_order_of_their_bounds(clusters):
    f = Boxes(6)
    f.plant(KdTree(clusters, 10).shape())
    d = distances.get("l2")
    leaf = f.descend(d, clusters, 0)
    for x, at in zip(clusters, leaf):
        f.widen(np.array([at]), np.array([1]), x[None], x[None], None)
    f.settle(d)
    q = clusters[:9] + 0.02
    bound = np.stack([box_bound(d, q, np.tile(f.low[i], (9, 1)), np.tile(f.high[i], (9, 1))) for i in f.leaves()], axis=1)
    row, node = f.best_first(d, q, 1e9)
    for i in range(9):
        order = np.searchsorted(f.leaves(), node[row == i])
        assert sorted(order) == list(range(len(f.leaves()))) and (np.diff(bound[i][order]) >= 0).all()
    few, _ = f.best_first(d, q, 30)
    assert np.bincount(few).max() <= 30 and len(few) < len(row)


def test_eps_prunes_more_and_stays_within_its_promise(spark, clusters):
    b, q = table(spark, clusters), table(spark, clusters[::40] + 0.02)
    index = create(b, "kdtree_single", leaf_size=10).build()
    exact, loose = (index.visited(q, 5, SearchParams(eps=e)).agg(F.sum("points")).first()[0] for e in (0.0, 3.0))
    assert loose < exact
    true, got = found(index.knn(q, 5)), found(index.knn(q, 5, SearchParams(eps=3.0)))
    assert len(got) == len(true) and all(true[k][1] <= d <= true[k][1] * 4 + 1e-12 for k, (_, d) in got.items())


def test_radius_by_cells(spark, clusters):
    b, q = table(spark, clusters), table(spark, clusters[::60])
    for method, params in (("kdtree_single", {}), ("kmeans", {"branching": 8}), ("kdtree", {"trees": 2})):
        index = create(b, method, leaf_size=20, **params).build()
        for most in (-1, 3, 0):
            assert found(index.radius(q, 0.01, SearchParams(max_neighbours=most))) == found(knn.radius_join(q, b, 0.01, max_neighbours=most))


def _folders(df):
    """(shelves that the plan's scans read, all input files)"""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan), len(df.inputFiles())


def test_a_search_reads_the_shelves_it_asks_for(spark, clusters, tmp_path):
    index = create(table(spark, clusters), "kdtree_single", leaf_size=20, shelf_points=100).build()
    everything = len(index.shelves_read().inputFiles())
    assert everything > 15
    near = table(spark, clusters[:3])
    asked, _ = index._asked(near, None, 3, 5, SearchParams())
    of = np.array([r["cell"] for r in asked.collect()])
    read = index.shelves_read({0: of})
    filters, _ = _folders(read)
    assert "shelf" in filters[0]
    shelves = {int(re.search(r"shelf=(\d+)", f)[1]) for f in (r[0] for r in read.select(F.input_file_name()).distinct().collect())}
    assert shelves == {int(c) // index.widths[0] for c in of} and len(shelves) < everything / 3
    index.save(str(tmp_path / "index"))
    again = load(spark, str(tmp_path / "index"))
    assert found(again.knn(near, 5)) == found(index.knn(near, 5)) == brute(clusters[:3], clusters, 5)
    assert len(again.shelves_read({0: of}).select(F.input_file_name()).distinct().collect()) == len(shelves)


def test_cells_are_placed_once(spark, clusters, monkeypatch):
    index = create(table(spark, clusters), "kdtree", trees=2, leaf_size=20).build()
    monkeypatch.setattr(type(index), "place", lambda *a: (_ for _ in ()).throw(AssertionError("placed again")))
    assert index.knn(table(spark, clusters[:5]), 3, SearchParams(checks=50)).count() == 15


@pytest.mark.parametrize("method,params", [("kdtree", {"trees": 2}), ("kdtree_single", {}), ("kmeans", {"branching": 6}), ("hierarchical", {"trees": 2, "branching": 6})])
def test_leaves_split_when_they_outgrow(spark, clusters, method, params):
    first, rest = clusters[:300], clusters[300:]  # two of the twenty clusters: the others fall into few leaves
    index = create(table(spark, first), method, leaf_size=20, rebuild_threshold=0, **params).build()
    before = {r[:2]: r[2] for r in index.cells.groupBy("table_no", "cell").agg(F.sort_array(F.collect_list("id"))).collect()}
    copy = index.clone()
    index.add(table(spark, rest, range(300, len(clusters))))
    after = {r[:2]: r[2] for r in index.cells.groupBy("table_no", "cell").agg(F.sort_array(F.collect_list("id"))).collect()}
    assert max(map(len, after.values())) <= 2 * index.limit
    kept = [c for c in before if c in after]
    assert kept and all(set(before[c]) <= set(after[c]) for c in kept)  # numbers aren't used again
    assert index.entries() == len(clusters) * len(index.forest.roots) and copy.entries() == 300 * len(index.forest.roots)
    q = table(spark, clusters[::90])
    want = brute(clusters[::90], clusters, 4)
    assert found(index.knn(q, 4, SearchParams(checks=-1))) == want == found(index.knn(q, 4, SearchParams(checks=1 << 30)))
    assert found(copy.knn(q, 4, SearchParams(checks=-1))) == brute(clusters[::90], first, 4)
    index.remove(list(range(0, 200)))
    left = {k: (i + 200, v) for k, (i, v) in brute(clusters[::90], clusters[200:], 4).items()}
    assert found(index.knn(q, 4, SearchParams(checks=-1))) == left
    assert index.knn(q, 4, SearchParams(checks=4)).count() == 4 * len(clusters[::90])


def test_equal_points_stay_in_one_leaf(spark):
    x = np.zeros((300, 3))
    index = create(table(spark, x[:100]), "kdtree", trees=1, leaf_size=5, rebuild_threshold=0).build()
    index.add(table(spark, x[100:], range(100, 300)))
    assert len(index.forest.leaves()) == 1 and [r["id"] for r in index.knn(table(spark, x[:1]), 3, SearchParams(checks=-1)).orderBy("rank").collect()] == [0, 1, 2]


def test_many_pairs_of_query_and_cell_are_lists_of_numbers(spark, clusters, monkeypatch):
    """No vector of a query is a row: the pairs meet the points as lists, also in crowded cells, and each point counts once."""
    monkeypatch.setattr(cells.CellIndex, "_joined", lambda *a: (_ for _ in ()).throw(AssertionError("vectors are shuffled")))
    monkeypatch.setattr(cells, "SCAN", 9.0)
    x = np.vstack((clusters, np.tile(clusters[:1], (300, 1))))
    b, q = table(spark, x), table(spark, clusters[::40] + 0.01)
    for method, params in (("kdtree", {"trees": 3}), ("kmeans", {"branching": 4})):
        index = create(b, method, leaf_size=20, **params).build()
        index.remove([3, 40])
        want = [found(index.knn(q, 5, SearchParams(checks=c))) for c in (60, -1)]
        near = found(index.radius(q, 0.02))
        with monkeypatch.context() as m:
            m.setattr(cells, "PROBES", 0)
            m.setattr(cells, "PACKED", 50)
            m.setattr(cells, "CELL_BYTES", 48 * 100)
            assert [found(index.knn(q, 5, SearchParams(checks=c))) for c in (60, -1)] == want
            assert found(index.radius(q, 0.02)) == near and len(near)


def test_queries_beyond_a_broadcast_meet_cells_by_a_shuffle(spark, clusters, monkeypatch):
    b, q = table(spark, clusters), table(spark, clusters[::10])
    index = create(b, "kdtree", trees=2, leaf_size=20).build()
    single = create(b, "kdtree_single", leaf_size=20).build()
    want = found(index.knn(q, 4, SearchParams(checks=100))), found(single.knn(q, 4)), found(single.radius(q, 0.01))
    monkeypatch.setattr(cells.exact, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(cells, "CELL_BYTES", 64)
    assert (found(index.knn(q, 4, SearchParams(checks=100))), found(single.knn(q, 4)), found(single.radius(q, 0.01))) == want


def test_medoid_trees_on_packed_bits(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, (12, 8))
    x = np.concatenate([base[i] ^ (rng.integers(0, 256, (60, 8)) & rng.integers(0, 256, (60, 8)) & rng.integers(0, 256, (60, 8)) & rng.integers(0, 256, (60, 8))) for i in range(12)])
    b = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "id long, v array<bigint>")
    index = create(b, "hierarchical", "hamming", trees=4, branching=8, leaf_size=20).build()
    q = b.where("id % 9 = 0")
    truth = knn.knn_join(q, b, 5, "hamming")
    assert evaluate.recall(index.knn(q, 5, SearchParams(checks=120)), truth).first()["recall"] >= 0.9
    assert found(index.knn(q, 5, SearchParams(checks=-1))) == found(truth)


def test_infinite_distances_are_found_by_indexes(spark):
    x = np.array([[0.0, 0], [1e200, 1], [2e200, 2], [1, 1], [2e200, 3]])
    for method in ("kdtree_single", "kmeans", "kdtree"):
        index = create(table(spark, x), method, leaf_size=1, **({"branching": 2} if method == "kmeans" else {})).build()
        assert found(index.knn(table(spark, x[:1]), 4, SearchParams(checks=-1))) == found(knn.knn_join(table(spark, x[:1]), table(spark, x), 4))


def test_root_undoes_powers():
    assert root(distances.get("l2"), np.array([9.0]))[0] == 3.0 and root(distances.get("kullback_leibler"), np.array([1.0])) is None


def test_searches_that_would_look_at_half_of_all_points_scan_stored_cells(spark, clusters, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 32))  # isotropic: no cell can be left out
    b, q = table(spark, x), table(spark, x[::2] + 0.01)
    want = brute(x[::2] + 0.01, x, 4)
    pairs, scored = [], cells.CellIndex._scored
    monkeypatch.setattr(cells.CellIndex, "_scored", lambda self, queries, held, *a, **kw: pairs.append(len(held.ids)) or scored(self, queries, held, *a, **kw))
    monkeypatch.setattr(cells, "FEW_PROBES", 0)
    for method, params in (("kdtree", {"trees": 2}), ("kmeans", {"branching": 4}), ("hierarchical", {"trees": 2, "branching": 4})):
        index = create(b.where("id < 150"), method, leaf_size=10, rebuild_threshold=0, **params).build()
        index.add(b.where("id >= 150"))
        for checks in (-1, 200, 1 << 30):
            assert found(index.knn(q, 4, SearchParams(checks=checks))) == want
        index.remove([0, 1, 2, 3])
        assert found(index.knn(q, 4, SearchParams(checks=-1))) == found(knn.knn_join(q, b.where("id > 3"), 4))
    assert max(pairs) <= cells.WEIGHED  # only the queries that a search is weighed by
    monkeypatch.setattr(cells, "knn_join", lambda *a: (_ for _ in ()).throw(AssertionError("scanned")))
    index = create(table(spark, clusters), "kmeans", branching=8, leaf_size=20).build()
    near = table(spark, clusters[::15])
    assert found(index.knn(near, 4, SearchParams(checks=-1))) == brute(clusters[::15], clusters, 4)


def _written(path):
    """(type of a stored vector's components, all files below path)"""
    import pyarrow.parquet as pq

    files = list(Path(path).rglob("*.parquet"))
    schema = pq.ParquetFile(files[0]).schema_arrow
    return str(schema.field("v").type.value_type), files


@pytest.mark.parametrize("single", [True, False])
def test_points_are_stored_once_and_in_single_precision_where_nothing_is_lost(spark, clusters, tmp_path, single):
    x = clusters[:600].astype(np.float32).astype(float) if single else clusters[:600]
    index = create(table(spark, x[:400]), "kdtree", trees=2, leaf_size=20, rebuild_threshold=0).build()
    index.add(table(spark, clusters[400:600], range(400, 600)))  # doubles, whatever the others are
    assert [_written(path)[0] for path, _ in index.tables][:1] == ["float" if single else "double"]
    assert _written(index.tables[1][0])[0] == "double"
    x = np.concatenate((x[:400], clusters[400:600]))
    q = table(spark, x[::30])
    want = brute(x[::30], x, 4)
    assert found(index.knn(q, 4, SearchParams(checks=-1))) == want == found(index.knn(q, 4, SearchParams(checks=1 << 30)))
    index.save(str(tmp_path / "index"))
    assert not (tmp_path / "index" / "points").exists()
    again = load(spark, str(tmp_path / "index"))
    assert found(again.knn(q, 4, SearchParams(checks=-1))) == want and again.size() == 600 == again.points.count()
    assert again.get_point(7).first()["v"] == x[7].tolist()


def test_building_shuffles_no_points_unless_they_are_many(spark, clusters, monkeypatch):
    b = table(spark, clusters)
    dealt = []
    plain = type(b).repartition
    monkeypatch.setattr(type(b), "repartition", lambda self, *a: dealt.append(a) or plain(self, *a))
    few = create(b, "kdtree", trees=2, leaf_size=20).build()
    assert not dealt
    monkeypatch.setattr(cells, "DIRECT_BYTES", 0)
    many = create(b, "kdtree", trees=2, leaf_size=20).build()
    assert dealt
    read = lambda i: {r[:3]: r[3] for r in i.cells.collect()}
    assert read(few) == read(many)


def test_removed_ids_are_sent_to_the_points(spark, clusters):
    b = table(spark, clusters)
    index = create(b, "kdtree", trees=2, leaf_size=20).build()
    index.remove(b.where("id % 3 = 0").select("id"))
    index.remove([1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # by size alone nothing is sent
    try:
        plan = index.alive_cells()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    left = np.array([i for i in range(len(clusters)) if i % 3 and i != 1])
    want = {k: (int(left[i]), d) for k, (i, d) in brute(clusters[:9], clusters[left], 3).items()}
    assert found(index.knn(table(spark, clusters[:9]), 3, SearchParams(checks=-1))) == want


def test_a_composite_scans_once(spark, clusters, monkeypatch):
    b, q = table(spark, clusters[:500]), table(spark, clusters[:500:25])
    index = create(b, "composite", trees=2, branching=4, leaf_size=20).build()
    calls = []
    monkeypatch.setattr(cells, "knn_join", lambda *a, **kw: calls.append(a) or knn.knn_join(*a, **kw))
    assert found(index.knn(q, 4, SearchParams(checks=1 << 30))) == brute(clusters[:500:25], clusters[:500], 4)
    assert len(calls) == 1
    assert index.knn(q, 4, SearchParams(checks=40)).count() == 80 and len(calls) == 1


def test_the_training_sample_is_cut_before_it_is_sorted(spark, clusters):
    b = table(spark, clusters)
    index = create(b, "kdtree", leaf_size=20).build()
    want = [r["id"] for r in b.orderBy(F.xxhash64("id", F.lit(0)), "id").limit(60).collect()]
    ids, x = index.sample(60)
    assert ids.tolist() == want and (x == clusters[ids]).all()
    same = create(table(spark, clusters[:400], [5] * 400), "kdtree", leaf_size=20).build()
    assert len(same.sample(60)[0]) == 60  # one hash: the cut leaves none or all
