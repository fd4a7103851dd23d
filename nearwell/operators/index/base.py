"""The index facade: build, search, add, remove, look up, save and load.

Methods with cells (`cells.py`) store their points by cell and read only what a search asks for; the linear method scans. A full budget
(checks=-1) is exact for every method. Searches never return fewer than min(k, n) rows (LSH within its probes aside).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import distances
from ...functions.vectors import slim, survey
from ..knn import knn_join, matrix, radius_count, radius_join

MAX_CELLS = 65_536  # of all trees of an index, about
SENT_IDS = 1 << 20  # removed ids that are sent to the tasks that read points
TRAIN = 50_000  # vectors that trees and centres are trained on
#: The public numbers of the methods.
NUMBERS = {0: "linear", 1: "kdtree", 2: "kmeans", 3: "composite", 4: "kdtree_single", 5: "hierarchical", 6: "lsh", 254: "saved", 255: "autotuned"}


@dataclass
class SearchParams:
    """checks: candidates scored per query, -1 for all that are needed to be exact, -2 for what autotuning found; eps widens exact pruning."""

    checks: int = 32
    eps: float = 0.0
    sorted: bool = True
    max_neighbours: int = -1


@dataclass
class IndexParams:
    """Of all methods; each reads its own. Unknown names raise TypeError."""

    trees: int = 4
    branching: int = 32
    iterations: int = 11
    centers_init: str = "random"
    cb_index: float = 0.2
    leaf_size: int = 100
    shelf_points: int = 0  # points that are stored side by side and read together; 0: as many as make SHELF_BYTES
    reorder: bool = True
    table_number: int = 12
    key_size: int = 20
    multi_probe_level: int = 2
    pivot: str = "median"
    target_precision: float = 0.8
    build_weight: float = 0.01
    memory_weight: float = 0.0
    sample_fraction: float = 0.1
    rebuild_threshold: float = 2.0
    seed: int = 0
    extra: dict = field(default_factory=dict)


METHODS: dict[str, type[VectorIndex]] = {}


def register(name: str):
    def put(cls):
        cls.method = name
        METHODS[name] = cls
        return cls

    return put


def create(points: DataFrame, method: str | int = "kdtree", distance="l2", **params) -> VectorIndex:
    """An index that isn't built yet over points (id, v)."""
    from . import centroid, composite, lsh, trees  # noqa: F401  they register themselves

    name = NUMBERS.get(method, "") if isinstance(method, int) else method
    if name not in METHODS:
        raise ValueError(f"no index method {method!r}")
    distances.check_combination(name, distance)
    return METHODS[name](points, distance, IndexParams(**params))


class VectorIndex:
    """Points (id, v) under a method. Changes return nothing and take effect in the next search."""

    method = "linear"
    exact = True  # every search is exact whatever the budget

    def __init__(self, points: DataFrame, distance="l2", params: IndexParams | None = None):
        self.spark: SparkSession = points.sparkSession
        self.points, self.distance, self.params = points.select("id", "v"), distances.get(distance), params or IndexParams()
        self.removed: DataFrame | None = None
        self.built_size = 0

    # construction

    def build(self) -> VectorIndex:
        """Compact removed points, check vectors, train the method and place every point."""
        if self.removed is not None:
            self.points, self.removed = self.alive(), None
        self.built_size, self.dim, self.single = survey(self.points, single=True)
        if not self.dim:
            raise ValueError("an index needs points")
        self.train()
        self.store()
        return self

    def train(self) -> None:
        """Learn cells from a bounded sample; the linear method has none."""

    def store(self) -> None:
        """Place every point and write the cells; the linear method has none."""

    def placed(self, points: DataFrame) -> None:
        """Further points, which are in self.points already, get their places."""

    @property
    def cells(self) -> DataFrame | None:
        """(table_no, cell, id, v) of all points, removed ones included; None where there are no cells."""
        return None

    def sample(self, n: int = TRAIN):
        """Ids and vectors of at most n points, as arrays: the training set."""
        key = F.xxhash64("id", F.lit(self.params.seed))
        points = self.points.select("id", slim(F.col("v"), self.single).alias("v"))
        lowest = lambda df: df.orderBy(key, "id").limit(n).toArrow()
        share = (n + 10 * n**0.5) / max(self.built_size, 1)
        t = lowest(points.where(key < int(share * 2**64) - 2**63) if share < 1 else points)  # every task sends what may be among the lowest
        if share < 1 and t.num_rows < n:  # ids that repeat a lot
            t = lowest(points)
        return t["id"].to_numpy(), matrix(t["v"].combine_chunks())

    # search

    def alive(self) -> DataFrame:
        return self.points if self.removed is None else self.points.join(self.removed, "id", "left_anti")

    def knn(self, queries: DataFrame, k: int, params: SearchParams | None = None) -> DataFrame:
        """(qid, rank, id, dist) for queries (id, v)."""
        return knn_join(queries, self.alive(), k, self.distance)

    def alive_cells(self) -> DataFrame:
        return self.cells if self.removed is None else self.cells.join(self.removed, "id", "left_anti")

    def radius(self, queries: DataFrame, radius: float, params: SearchParams | None = None) -> DataFrame:
        """(qid, rank, id, dist) of all points nearer than radius; by scan, as is every exact search of this kind."""
        return radius_join(queries, self.alive(), radius, self.distance, (params or SearchParams()).max_neighbours)

    def radius_count(self, queries: DataFrame, radius: float) -> DataFrame:
        return radius_count(queries, self.alive(), radius, self.distance)

    # maintenance

    def add(self, points: DataFrame) -> None:
        """Append points: they are placed in the cells there are, and the index is rebuilt when it has grown by the factor rebuild_threshold
        (never at 0 or below)."""
        points = points.select("id", "v")
        self.points = self.points.unionByName(points)
        if not self.built_size:
            return
        threshold = self.params.rebuild_threshold
        if threshold > 0 and self.points.count() > self.built_size * threshold:
            self.build()
        else:
            self.placed(points)

    def remove(self, ids: DataFrame | list[int]) -> None:
        """Remove points by id: they are left out of every search and go for good when the index is built again."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        gone = ids.select("id").distinct()
        gone = gone if self.removed is None else self.removed.unionByName(gone).distinct()
        self.removed = F.broadcast(gone) if gone.limit(SENT_IDS + 1).count() <= SENT_IDS else gone  # so points needn't be shuffled to leave them out

    def get_point(self, key: int) -> DataFrame:
        return self.alive().where(F.col("id") == key)

    def size(self) -> int:
        return self.alive().count()

    def veclen(self) -> int:
        return self.dim

    def used_memory(self) -> int:
        """Bytes of vectors and of cell entries."""
        return self.size() * self.dim * 8 + self.entries() * 20

    def entries(self) -> int:
        """Places of points in cells."""
        return 0

    def parameters(self) -> dict:
        return {"algorithm": self.method, "distance": self.distance.name} | asdict(self.params)

    def clone(self) -> VectorIndex:
        """An index of its own over the same tables: adding to one or removing from it leaves the other alone."""
        import copy

        out = copy.copy(self)
        out.params = copy.deepcopy(self.params)
        out.adopt({name: part.clone() for name, part in self.children().items()})
        return out

    def swap(self, other: VectorIndex) -> None:
        """Exchange everything with another index of the same method."""
        if type(self) is not type(other):
            raise ValueError("indexes of two methods can't be swapped")
        self.__dict__, other.__dict__ = other.__dict__, self.__dict__

    # storage

    def state(self) -> dict:
        """What train() learnt and is small, as JSON values."""
        return {}

    def restore(self, state: dict) -> None: ...

    def save_points(self, folder: str) -> None:
        """points, where cells don't hold them."""
        self.alive().write.mode("overwrite").option("compression", "lz4").parquet(f"{folder}/points")

    @classmethod
    def saved_points(cls, spark: SparkSession, folder: str, meta: dict, children: dict[str, VectorIndex]) -> DataFrame:
        """The (id, v) of an index saved in folder."""
        return spark.read.parquet(f"{folder}/points")

    def save_cells(self, folder: str) -> None:
        """Whatever else a search reads, as tables below folder."""

    def load_cells(self, folder: str) -> None: ...

    def children(self) -> dict[str, VectorIndex]:
        """Indexes that this one is made of, by a name for their folder."""
        return {}

    def adopt(self, children: dict[str, VectorIndex]) -> None: ...

    def save(self, folder: str) -> None:
        """points (or cells that hold them) and meta below folder, compressed with lz4."""
        write = lambda df, name: df.write.mode("overwrite").option("compression", "lz4").parquet(f"{folder}/{name}")
        self.save_points(folder)
        self.save_cells(folder)
        for name, part in self.children().items():
            part.removed = self.removed
            part.save(f"{folder}/{name}")
        meta = {"children": list(self.children()), "signature": "nearwell-index-2", "method": self.method, "distance": self.distance.name, "dim": self.dim, "size": self.size(), "params": asdict(self.params), "state": self.state()}
        write(self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1), "meta")


def load(spark: SparkSession, folder: str, distance=None) -> VectorIndex:
    """A saved index; a distance that isn't the saved one raises ValueError."""
    meta = json.loads(spark.read.parquet(f"{folder}/meta").first()["meta"])
    if meta.get("signature") != "nearwell-index-2":
        raise ValueError(f"{folder} holds no index")
    if distance is not None and distances.get(distance).name != meta["distance"]:
        raise ValueError(f"the index was built for {meta['distance']}")
    from . import centroid, composite, lsh, trees  # noqa: F401  they register themselves

    children = {name: load(spark, f"{folder}/{name}") for name in meta.get("children", [])}
    points = METHODS[meta["method"]].saved_points(spark, folder, meta, children)
    index = create(points, meta["method"], meta["distance"], **meta["params"])
    index.dim, index.built_size = meta["dim"], meta["size"]
    index.restore(meta["state"])
    index.adopt(children)
    index.load_cells(folder)
    return index


register("linear")(VectorIndex)
