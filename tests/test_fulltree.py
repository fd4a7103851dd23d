"""Trees over all points, grown by jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwell.operators.index import fulltree

from .test_search import table


def check(tree, x, ids=None):
    """The points that lie below every node are on the right side of all planes above; returns the nodes."""
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    leaves = {r["id"]: r["leaf"] for r in tree.leaves.collect()}
    ids = range(len(x)) if ids is None else ids
    assert sorted(leaves) == sorted(ids)
    size = dict.fromkeys(nodes, 0)
    for i, v in zip(ids, x):
        node, path = 1, [1]
        while nodes[node]["left"] is not None:
            r = nodes[node]
            node = r["right"] if v[r["split_dim"]] >= r["split_value"] else r["left"]
            assert nodes[node]["parent"] == path[-1] and nodes[node]["depth"] == len(path)
            path.append(node)
        assert leaves[i] == node
        for p in path:
            size[p] += 1
    assert all(nodes[p]["size"] == n > 0 for p, n in size.items())
    return nodes


@pytest.mark.parametrize("pivot,choose,block", [("median", "span", 64), ("mean", "cyclic", 64), ("middle", "span", 30), ("median", "cyclic", 10_000)])
def test_every_point_has_a_leaf(spark, pivot, choose, block):
    x = np.random.default_rng(3).random((1 << 10, 5))
    nodes = check(fulltree.build(table(spark, x), pivot=pivot, choose=choose, block=block), x)
    assert len(nodes) == 2 * len(x) - 1 and sum(r["left"] is None for r in nodes.values()) == len(x)
    assert pivot != "median" or max(r["depth"] for r in nodes.values()) <= 13


def test_equal_points_and_larger_leaves(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((np.ones((300, 2)), rng.integers(0, 6, (200, 2)).astype(float)))
    for block in (40, 1000):
        nodes = check(fulltree.build(table(spark, x), block=block), x)
        assert sum(r["left"] is None for r in nodes.values()) == len(np.unique(x, axis=0))
    nodes = check(fulltree.build(table(spark, x), leaf_size=50, block=20), x)
    assert max(r["size"] for r in nodes.values() if r["left"] is None) >= 300
    one = check(fulltree.build(table(spark, [[1.0, 2.0]])), [[1.0, 2.0]])
    assert len(one) == 1
    with pytest.raises(ValueError):
        fulltree.build(table(spark, x).where(F.lit(False)))
