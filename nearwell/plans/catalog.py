"""Registered queries of the vector operators and their DuckDB twins.

Every query runs over its whole table: the embeddings search themselves, suppliers search customers. SQL is written from the same distance
definitions, so both sides add their terms in one order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distances, table_functions
from ..functions import vectors as fv
from ..functions.distances import get
from ..functions.packed import pack_bytes
from ..operators import classify, cluster, evaluate, knn, sampling, stats
from ..operators.index import SearchParams, create, load
from ..operators.index import fulltree
from ..operators.index import lsh as lsh_ops
from ..sources import texmex
from ..sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K = 5
RADIUS = 1.5
BITS_SQL = "list_transform(range(0, 8), lambda g: list_sum(list_transform(range(0, 8), lambda i: CASE WHEN v[(g*8+i+1)::INT] >= 0 THEN 1::BIGINT << i::INT ELSE 0::BIGINT END))::BIGINT)"
E_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
ABS_SQL = "e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS v, label FROM embeddings)"
PACKED_SQL = f"r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT id, {BITS_SQL} AS v FROM r)"
S_SQL = "q AS (SELECT s_suppkey AS id, [s_nationkey::DOUBLE, s_acctbal] AS v FROM supplier), b AS (SELECT c_custkey AS id, [c_nationkey::DOUBLE, c_acctbal] AS v FROM customer)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fv.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def absolute(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.transform("v", lambda x: F.abs(x)))


def packed(df: DataFrame) -> DataFrame:
    return df.withColumn("v", fv.pack_signs(F.col("v"), 8))


def accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(suppliers, customers) as points of nation and balance."""
    point = lambda t, k, n, a: table(spark, sf_dir, t).select(F.col(k).alias("id"), F.array(F.col(n).cast("double"), F.col(a)).alias("v"))
    return point("supplier", "s_suppkey", "s_nationkey", "s_acctbal"), point("customer", "c_custkey", "c_nationkey", "c_acctbal")


def knn_sql(ctes: str, distance="l2", k: int = K, skip: int = 0, itself: bool = True, q: str = "e", b: str = "e", out: str = "qid, rank, id, dist", tail: str = "") -> str:
    other = "" if itself else " AND q.id <> b.id"
    return f"""WITH {ctes},
p AS (SELECT q.id AS qid, b.id AS id, {get(distance).duckdb("q.v", "b.v")} AS dist FROM {q} q JOIN {b} b ON true{other}),
n AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - {skip} AS r, id, dist FROM p),
t AS (SELECT qid, r::INTEGER AS rank, id, dist FROM n WHERE r BETWEEN 1 AND {k})
{tail or f"SELECT {out} FROM t"}"""


def near(spark: SparkSession, sf_dir: str, k: int = K, itself: bool = False) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return knn.knn_join(e, e, k, itself=itself)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("id", "label")


# nearest neighbours under every distance


def _distance_query(name: str, distance: str, prepare=None, ctes: str = E_SQL, rounded: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = embeddings(spark, sf_dir).select("id", "v")
        e = prepare(e) if prepare else e
        out = knn.knn_join(e, e, K, distance)
        return out.withColumn("dist", F.round("dist", 6)) if rounded else out

    query(name, knn_sql(ctes, distance, out="qid, rank, id, round(dist, 6) AS dist" if rounded else "qid, rank, id, dist"))(run)


for _name, _distance, _prepare, _ctes, _rounded in (
    ("knn_linear_l2", "l2", None, E_SQL, False),
    ("knn_l2_simple", "l2_simple", None, E_SQL, False),
    ("knn_l2_3d", "l2_3d", None, E_SQL, False),
    ("knn_l1", "l1", None, E_SQL, False),
    ("knn_minkowski3", "minkowski3", None, E_SQL, False),
    ("knn_chebyshev", "max", None, E_SQL, False),
    ("knn_hist_intersection", "hist_intersect", absolute, ABS_SQL, False),
    ("knn_hellinger", "hellinger", absolute, ABS_SQL, False),
    ("knn_chisq", "chi_square", absolute, ABS_SQL, False),
    ("knn_kl", "kullback_leibler", absolute, ABS_SQL, True),
    ("knn_kl_of_query", "kullback_leibler_query", absolute, ABS_SQL, True),
    ("knn_hamming", "hamming", packed, PACKED_SQL, False),
    ("knn_hamming_popcnt", "hamming_popcnt", packed, PACKED_SQL, False),
    ("knn_hamming_lut", "hamming_lut", packed, PACKED_SQL, False),
):
    _distance_query(_name, _distance, _prepare, _ctes, _rounded)


@query("knn_single_query", f"WITH {E_SQL}, c AS (SELECT list_transform(range(0, 64), lambda i: 0.0::DOUBLE) AS v) SELECT row_number() OVER (ORDER BY dist, id)::INTEGER AS rank, id, dist FROM (SELECT e.id, {get('l2').duckdb('c.v', 'e.v')} AS dist FROM e, c ORDER BY dist, id LIMIT {K})")
def knn_single_query(spark, sf_dir):
    return knn.knn_single(embeddings(spark, sf_dir), [0.0] * 64, K)


@query("knn_expression_form", knn_sql(E_SQL + ", q AS (SELECT * FROM e WHERE id < 32)", q="q"))
def knn_expression_form(spark, sf_dir):
    """A handful of queries, the only ones that plain expressions are for."""
    e = embeddings(spark, sf_dir).select("id", "v")
    return knn.knn_join(e.where("id < 32"), e, K, method="expression")


@query("knn_nested", knn_sql(E_SQL, tail="SELECT qid, list(id ORDER BY dist, id) AS ids FROM t GROUP BY qid"))
def knn_nested(spark, sf_dir):
    return knn.nested(near(spark, sf_dir, itself=True)).select("qid", F.transform("neighbours", lambda n: n["id"]).alias("ids"))


@query("ground_truth_skip_self", knn_sql(E_SQL, k=10, skip=1))
def ground_truth_skip_self(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    return knn.knn_join(e, e, 10, skip=1)


@query("knn_accounts", knn_sql(S_SQL, k=3, q="q", b="b"))
def knn_accounts(spark, sf_dir):
    return knn.knn_join(*accounts(spark, sf_dir), 3)


@query("knn_payload", knn_sql(E_SQL, itself=False, tail="SELECT qid, rank, t.id, dist, label FROM t JOIN e ON e.id = t.id"))
def knn_payload(spark, sf_dir):
    return classify.with_payload(near(spark, sf_dir), embeddings(spark, sf_dir), "label")


@query("sharded_topk_merge", knn_sql(E_SQL))
def sharded_topk_merge(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    return knn.sharded_knn(e, [e.where(F.pmod("id", F.lit(3)) == i) for i in range(3)], K)


# radius

_RADIUS_SQL = f"WITH {E_SQL}, p AS (SELECT q.id AS qid, b.id AS id, {get('l2').duckdb('q.v', 'b.v')} AS dist FROM e q JOIN e b ON q.id <> b.id), w AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rank, id, dist FROM p WHERE dist < {RADIUS}) "


@query("radius_all", _RADIUS_SQL + "SELECT * FROM w")
def radius_all(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    return knn.radius_join(e, e, RADIUS, itself=False)


@query("sharded_radius", _RADIUS_SQL + "SELECT * FROM w WHERE rank <= 4")
def sharded_radius(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    return knn.sharded_radius(e, [e.where("id % 3 = 0"), e.where("id % 3 = 1"), e.where("id % 3 = 2")], RADIUS, max_neighbours=4, itself=False)


@query("radius_capped", _RADIUS_SQL + "SELECT * FROM w WHERE rank <= 3")
def radius_capped(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    return knn.radius_join(e, e, RADIUS, max_neighbours=3, itself=False)


@query("radius_count", _RADIUS_SQL + "SELECT e.id AS qid, count(w.id)::BIGINT AS n FROM e LEFT JOIN w ON w.qid = e.id GROUP BY e.id")
def radius_count(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    return knn.radius_count(e, e, RADIUS, itself=False)


# votes and evaluation

_LOO = E_SQL
_VOTES = "v AS (SELECT qid, label, count(*) AS votes FROM t JOIN e ON e.id = t.id GROUP BY qid, label)"


def _vote_sql(order: str, extra: str = "") -> str:
    return knn_sql(_LOO, itself=False, tail=f", {_VOTES}{extra} SELECT qid, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS o FROM v{' JOIN s USING (label)' if extra else ''}) WHERE o = 1").replace("\n, v AS", ",\nv AS")


@query("vote_majority", _vote_sql("votes DESC, label"))
def vote_majority(spark, sf_dir):
    return classify.majority(near(spark, sf_dir), labels(spark, sf_dir))


@query("vote_first_seen_tie", _vote_sql("votes DESC, seen", ", s AS (SELECT label, min(id) AS seen FROM e GROUP BY label)"))
def vote_first_seen_tie(spark, sf_dir):
    return classify.majority_first_seen(near(spark, sf_dir), labels(spark, sf_dir))


@query(
    "vote_three_class",
    knn_sql(_LOO, itself=False, tail=", c AS (SELECT qid, count_if(label = 1)::BIGINT AS c1, count_if(label = 2)::BIGINT AS c2, count_if(label NOT IN (1, 2))::BIGINT AS c3 FROM t JOIN e ON e.id = t.id GROUP BY qid) SELECT qid, c1, c2, c3, CASE WHEN c1 = greatest(c1, c2, c3) THEN 1 WHEN c2 = greatest(c1, c2, c3) THEN 2 ELSE 3 END::INTEGER AS label, greatest(c1, c2, c3) AS votes FROM c").replace("\n, c AS", ",\nc AS"),
)
def vote_three_class(spark, sf_dir):
    return classify.three_classes(near(spark, sf_dir), labels(spark, sf_dir))


@query(
    "vote_inverse_distance",
    knn_sql(_LOO, itself=False, tail=", w AS (SELECT qid, label, sum(1 / sqrt(dist)) AS weight FROM t JOIN e ON e.id = t.id GROUP BY qid, label) SELECT qid, label, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(weight, 12) DESC, label) AS o FROM w) WHERE o = 1").replace("\n, w AS", ",\nw AS"),
)
def vote_inverse_distance(spark, sf_dir):
    return classify.inverse_distance(near(spark, sf_dir), labels(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("classify_accuracy", f"SELECT round(avg((v.label = m.label)::INT::DOUBLE) * 100, 6) AS accuracy FROM ({_vote_sql('votes DESC, label')}) v JOIN embeddings m ON m.vec_id = v.qid")
def classify_accuracy(spark, sf_dir):
    p = classify.majority(near(spark, sf_dir), labels(spark, sf_dir))
    return evaluate.accuracy(p, labels(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


def _two_sql(tail: str) -> str:
    """Found neighbours under l1 (f) against true ones under l2 (t)."""
    f = knn_sql(E_SQL, "l1", k=10, itself=False)
    t = knn_sql(E_SQL, "l2", k=10, itself=False)
    return f"WITH f AS ({f}), t AS ({t}) {tail}"


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = embeddings(spark, sf_dir).select("id", "v")
    return knn.knn_join(e, e, 10, "l1", itself=False), knn.knn_join(e, e, 10, itself=False)


@query("recall_at_k", _two_sql("SELECT count(f.id)::BIGINT AS hits, count(*)::BIGINT AS total, count(f.id) / count(*) AS recall FROM t LEFT JOIN f ON f.qid = t.qid AND f.id = t.id"))
def recall_at_k(spark, sf_dir):
    return evaluate.recall(*_two(spark, sf_dir))


@query("positional_accuracy", _two_sql("SELECT count_if(f.id = t.id)::BIGINT AS same, count(*)::BIGINT AS total, count_if(f.id = t.id) / count(*) AS accuracy FROM t LEFT JOIN f ON f.qid = t.qid AND f.rank = t.rank"))
def positional_accuracy(spark, sf_dir):
    return evaluate.positional_accuracy(*_two(spark, sf_dir))


@query("precision_overlap", _two_sql("SELECT t.qid, count(f.id) / count(*) AS precision FROM t LEFT JOIN f ON f.qid = t.qid AND f.id = t.id GROUP BY t.qid"))
def precision_overlap(spark, sf_dir):
    return evaluate.precision(*_two(spark, sf_dir))


@query("distance_ratio", _two_sql("SELECT round(avg(CASE WHEN f.dist = 0 AND t.dist = 0 THEN 1 ELSE f.dist / t.dist END), 6) AS ratio FROM t JOIN f ON f.qid = t.qid AND f.rank = t.rank"))
def distance_ratio(spark, sf_dir):
    return evaluate.distance_ratio(*_two(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query("found_total", _RADIUS_SQL + "SELECT count(*)::BIGINT AS n FROM w")
def found_total(spark, sf_dir):
    """The pairs of radius_all, which are as many as grow with the square of the table: they are counted where they are found."""
    e = embeddings(spark, sf_dir).select("id", "v")
    return evaluate.found_total(knn.within(e, e, RADIUS, itself=False))


@query("label_mismatch", f"SELECT count_if(v.label <> m.label)::BIGINT AS mismatches, count(*)::BIGINT AS total FROM ({_vote_sql('votes DESC, label')}) v JOIN embeddings m ON m.vec_id = v.qid")
def label_mismatch(spark, sf_dir):
    p = classify.majority(near(spark, sf_dir), labels(spark, sf_dir))
    return evaluate.label_mismatches(p.select(F.col("qid").alias("id"), "label"), labels(spark, sf_dir))


# statistics

_DIMS = f"WITH {E_SQL}, c AS (SELECT id, (unnest(range(1, len(v) + 1)) - 1)::INTEGER AS dim, unnest(v) AS x FROM e) "


@query("dim_mean_variance", _DIMS + "SELECT dim, round(avg(x), 9) AS mean, round(var_pop(x) * count(x), 6) AS variance FROM c GROUP BY dim")
def dim_mean_variance(spark, sf_dir):
    return stats.mean_variance(embeddings(spark, sf_dir)).select("dim", F.round("mean", 9).alias("mean"), F.round("variance", 6).alias("variance"))


@query("bounding_box", _DIMS + "SELECT dim, min(x) AS low, max(x) AS high FROM c GROUP BY dim")
def bounding_box(spark, sf_dir):
    return stats.bounding_box(embeddings(spark, sf_dir))


@query("dim_extent", "SELECT min(embedding[1])::DOUBLE AS low, max(embedding[1])::DOUBLE AS high FROM embeddings")
def dim_extent(spark, sf_dir):
    return stats.extent(embeddings(spark, sf_dir), 0)


@query("max_variance_dim", _DIMS + "SELECT dim, round(variance, 6) AS variance FROM (SELECT dim, var_pop(x) * count(x) AS variance FROM c GROUP BY dim) ORDER BY round(variance, 9) DESC, dim LIMIT 1")
def max_variance_dim(spark, sf_dir):
    return stats.widest(embeddings(spark, sf_dir)).withColumn("variance", F.round("variance", 6))


@query("top5_variance_dims", _DIMS + "SELECT dim, round(variance, 6) AS variance FROM (SELECT dim, var_pop(x) * count(x) AS variance FROM c GROUP BY dim) ORDER BY round(variance, 9) DESC, dim LIMIT 5")
def top5_variance_dims(spark, sf_dir):
    return stats.widest(embeddings(spark, sf_dir), 5).withColumn("variance", F.round("variance", 6))


@query("median_split", "WITH m AS (SELECT quantile_disc(l_extendedprice, 0.5) AS v FROM lineitem) SELECT count_if(l_extendedprice < v)::BIGINT AS below, count_if(l_extendedprice = v)::BIGINT AS at, count_if(l_extendedprice > v)::BIGINT AS above FROM lineitem, m".replace(" AS at,", ' AS "at",'))
def median_split(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_extendedprice").alias("v"))
    return stats.plane_split(rows, 0, stats.median(rows, 0).first()["median"])


@query("lineitem_statistics", "WITH c AS (SELECT unnest([0, 1, 2, 3])::INTEGER AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem) SELECT dim, round(avg(x), 6) AS mean, min(x) AS low, max(x) AS high FROM c GROUP BY dim")
def lineitem_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("v"))
    return stats.components(rows).groupBy("dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))


for _how, _sql in (("max", "max(x)"), ("min", "min(x)"), ("sum", "round(sum(x), 6)"), ("prod", "round(product(x), 6)")):

    def _reduce(spark, sf_dir, how=_how):
        return stats.reduce_elements(embeddings(spark, sf_dir), how).withColumn("x", F.round("x", 6) if how in ("sum", "prod") else F.col("x"))

    query(f"reduce_{_how}", _DIMS + f"SELECT dim, {_sql} AS x FROM c GROUP BY dim")(_reduce)


@query("benchmark_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_pop(value) / sqrt(count(value)), 6) AS error FROM events GROUP BY event_type")
def benchmark_summary(spark, sf_dir):
    out = stats.benchmark_summary(table(spark, sf_dir, "events"), "event_type", value="value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "error")])


@query("benchmark_speedup", "WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) / sqrt(count(value)) AS e FROM events GROUP BY event_type), b AS (SELECT * FROM s ORDER BY event_type LIMIT 1) SELECT s.event_type, round(b.m / s.m, 6) AS speedup, round(b.m / s.m * sqrt(pow(s.e / s.m, 2) + pow(b.e / b.m, 2)), 6) AS error FROM s, b")
def benchmark_speedup(spark, sf_dir):
    s = stats.benchmark_summary(table(spark, sf_dir, "events"), "event_type", value="value")
    b = s.orderBy("event_type").limit(1).first()
    up, error = stats.speedup(F.col("mean"), F.col("error"), F.lit(b["mean"]), F.lit(b["error"]))
    return s.select("event_type", F.round(up, 6).alias("speedup"), F.round(error, 6).alias("error"))


# clustering: the first eight vectors are the centres

_CENTRES = f"{E_SQL}, c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS cluster, v FROM e ORDER BY id LIMIT 8)"
_ASSIGN = f"WITH {_CENTRES}, d AS (SELECT e.id, e.v, c.cluster, {get('l2').duckdb('c.v', 'e.v')} AS dist FROM e, c), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS o FROM d) WHERE o = 1) "


def assigned(spark, sf_dir) -> DataFrame:
    e = embeddings(spark, sf_dir).select("id", "v")
    start = [list(r["v"]) for r in e.orderBy("id").limit(8).select("v").collect()]
    return cluster.assign(e, cluster.centre_table(spark, start))


@query("kmeans_assign_step", _ASSIGN + "SELECT id, cluster, dist FROM a")
def kmeans_assign_step(spark, sf_dir):
    return assigned(spark, sf_dir).select("id", "cluster", "dist")


@query("kmeans_update_step", _ASSIGN + ", u AS (SELECT cluster, (unnest(range(1, len(v) + 1)) - 1)::INTEGER AS dim, unnest(v) AS x FROM a) SELECT cluster, dim, round(avg(x), 6) AS x FROM u GROUP BY cluster, dim".replace(") , u", "), u"))
def kmeans_update_step(spark, sf_dir):
    return cluster.update(assigned(spark, sf_dir)).withColumn("x", F.round("x", 6))


@query("clustering_cost", _ASSIGN + "SELECT round(sum(dist), 6) AS cost FROM a")
def clustering_cost(spark, sf_dir):
    return cluster.cost(assigned(spark, sf_dir)).select(F.round("cost", 6).alias("cost"))


@query(
    "node_statistics",
    _ASSIGN + f", u AS (SELECT cluster, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM a), m AS (SELECT cluster, list(x ORDER BY dim) AS mean FROM (SELECT cluster, dim, avg(x) AS x FROM u GROUP BY cluster, dim) GROUP BY cluster), s AS (SELECT a.cluster, {get('l2').duckdb('m.mean', 'a.v')} AS d FROM a JOIN m USING (cluster)) SELECT cluster, count(*)::BIGINT AS size, round(max(d), 6) AS radius, round(avg(d), 6) AS variance FROM s GROUP BY cluster",
)
def node_statistics(spark, sf_dir):
    s = cluster.node_statistics(assigned(spark, sf_dir))
    return s.select("cluster", "size", F.round("radius", 6).alias("radius"), F.round("variance", 6).alias("variance"))


@query("medoid_assign", _ASSIGN.replace(get("l2").duckdb("c.v", "e.v"), get("l1").duckdb("c.v", "e.v")) + "SELECT id, cluster, dist FROM a")
def medoid_assign(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    start = [list(r["v"]) for r in e.orderBy("id").limit(8).select("v").collect()]
    return cluster.assign(e, cluster.centre_table(spark, start), "l1").select("id", "cluster", "dist")


def _gonzales_sql(k: int) -> str:
    """Farthest-first, a step per centre."""
    d = lambda c: get("l2").duckdb(f"{c}.v", "e.v")
    out = f"WITH {E_SQL}, c0 AS (SELECT id, v FROM e ORDER BY id LIMIT 1), n0 AS (SELECT e.id, e.v, {d('c0')} AS dist FROM e, c0)"
    for i in range(1, k):
        out += f", c{i} AS (SELECT id, v FROM n{i - 1} ORDER BY dist DESC, id LIMIT 1), n{i} AS (SELECT e.id, e.v, least(e.dist, {d(f'c{i}')}) AS dist FROM n{i - 1} e, c{i})"
    return out + " " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS step, id FROM c{i}" for i in range(k))


@query("gonzales_centers", _gonzales_sql(6))
def gonzales_centers(spark, sf_dir):
    chosen = cluster.gonzales(embeddings(spark, sf_dir).select("id", "v"), 6)
    return spark.createDataFrame([(i, c) for i, (c, _) in enumerate(chosen)], "step int, id long")


# LSH over sign bits

_POSITIONS = lsh_ops.tables(64, 4, 10, seed=1)
_KEYS_SQL = "[" + ", ".join("{'table_no': %d, 'key': (%s)::BIGINT}" % (t, " + ".join(f"((v[{p // 8 + 1}] >> {p % 8}) & 1) * {1 << j}" for j, p in enumerate(ps))) for t, ps in enumerate(_POSITIONS)) + "]"
_BUCKETS = f"WITH {PACKED_SQL}, k AS (SELECT id, unnest({_KEYS_SQL}) AS b FROM e), b AS (SELECT b.table_no::INTEGER AS table_no, b.key AS key, id FROM k) "


def _buckets(spark, sf_dir) -> DataFrame:
    return lsh_ops.buckets(packed(embeddings(spark, sf_dir)).select("id", "v"), _POSITIONS)


@query("lsh_buckets", _BUCKETS + "SELECT table_no, key, id FROM b")
def lsh_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir)


@query("lsh_bucket_stats", _BUCKETS + "SELECT table_no, count(*)::BIGINT AS n_buckets, floor(avg(s))::BIGINT AS mean, quantile_disc(s, 0.5)::BIGINT AS median, min(s)::BIGINT AS smallest, max(s)::BIGINT AS largest FROM (SELECT table_no, key, count(*) AS s FROM b GROUP BY table_no, key) GROUP BY table_no")
def lsh_bucket_stats(spark, sf_dir):
    return stats.bucket_stats(_buckets(spark, sf_dir))


@query("lsh_bucket_histogram", _BUCKETS + "SELECT table_no, floor(s / 20)::BIGINT AS bin, count(*)::BIGINT AS n FROM (SELECT table_no, key, count(*) AS s FROM b GROUP BY table_no, key) GROUP BY 1, 2")
def lsh_bucket_histogram(spark, sf_dir):
    return stats.bucket_histogram(_buckets(spark, sf_dir))


@query("lsh_multiprobe_masks", _BUCKETS + ", m AS (SELECT unnest(range(0, 1024)) AS mask) SELECT id, mask::BIGINT AS mask, bit_count(mask::BIGINT)::INTEGER AS bits, xor(key, mask::BIGINT) AS key FROM b, m WHERE table_no = 0 AND bit_count(mask::BIGINT) <= 2")
def lsh_multiprobe_masks(spark, sf_dir):
    """The buckets that every vector probes in the first table: keys that differ by two bits at most."""
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("bits")) for m in lsh_ops.xor_masks(10, 2)])
    own = _buckets(spark, sf_dir).where("table_no = 0").select("id", "key", F.explode(masks).alias("m"))
    return own.select("id", "m.mask", "m.bits", F.col("key").bitwiseXOR(F.col("m.mask")).alias("key"))


_MASKS = "[" + ", ".join(map(str, lsh_ops.xor_masks(10, 1))) + "]"


@query("lsh_knn", _BUCKETS + f", p AS (SELECT id AS qid, table_no, unnest({_MASKS})::BIGINT AS m, key FROM b), h AS (SELECT DISTINCT p.qid, b.id FROM p JOIN b ON b.table_no = p.table_no AND b.key = xor(p.key, p.m)), s AS (SELECT h.qid, h.id, {get('hamming').duckdb('q.v', 'c.v')} AS dist FROM h JOIN e q ON q.id = h.qid JOIN e c ON c.id = h.id) SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rank, id, dist FROM s) WHERE rank <= {K}")
def lsh_knn(spark, sf_dir):
    e = packed(embeddings(spark, sf_dir)).select("id", "v")
    index = create(e, "lsh", "hamming", table_number=4, key_size=10, multi_probe_level=1, seed=1).build()
    return index.knn(e, K)


# indexes: exact at full budget

_FULL = SearchParams(checks=-1)
FLOOR, SHARE = 0.9, 0.5  # recall of the budgeted searches, and the share of the table that it takes: the vectors are nearly isotropic


def _index_query(name: str, method: str, **params) -> None:
    def run(spark, sf_dir):
        e = embeddings(spark, sf_dir).select("id", "v")
        return create(e, method, **params).build().knn(e, K, _FULL)

    query(name, knn_sql(E_SQL))(run)


for _name, _method, _params in (
    ("index_linear", "linear", {}),
    ("ivf_knn_full_probe", "kmeans", {"branching": 8, "leaf_size": 40}),
    ("hierarchical_full_budget", "hierarchical", {"branching": 8, "trees": 2}),
    ("kd_forest_full_budget", "kdtree", {"trees": 2}),
    ("composite_full_budget", "composite", {"trees": 2, "branching": 8}),
):
    _index_query(_name, _method, **_params)


@query("kd_single_exact", knn_sql(S_SQL, k=3, q="q", b="b"))
def kd_single_exact(spark, sf_dir):
    q, b = accounts(spark, sf_dir)
    return create(b, "kdtree_single", leaf_size=10).build().knn(q, 3)


@query("kd_cyclic_exact", knn_sql(S_SQL, k=3, q="q", b="b"))
def kd_cyclic_exact(spark, sf_dir):
    q, b = accounts(spark, sf_dir)
    return create(b, "kdtree_cyclic", leaf_size=20).build().knn(q, 3)


_ABS_S_SQL = "q AS (SELECT s_suppkey AS id, [s_nationkey::DOUBLE, abs(s_acctbal)] AS v FROM supplier), b AS (SELECT c_custkey AS id, [c_nationkey::DOUBLE, abs(c_acctbal)] AS v FROM customer)"

for _name, _method, _distance, _params in (
    ("kd_single_hellinger", "kdtree_single", "hellinger", {"leaf_size": 20}),
    ("kd_single_chi_square", "kdtree_single", "chi_square", {"leaf_size": 20}),
    ("kd_single_l1", "kdtree_single", "l1", {"leaf_size": 20}),
    ("kmeans_tree_exact", "kmeans", "l2", {"branching": 16, "leaf_size": 20, "iterations": 5}),
    ("medoid_trees_exact", "hierarchical", "l1", {"branching": 16, "leaf_size": 20, "trees": 2}),
):

    def _pruned(spark, sf_dir, method=_method, distance=_distance, params=_params):
        """Exact by leaving out cells whose boxes or balls lie too far, not by a scan."""
        q, b = (absolute(t) for t in accounts(spark, sf_dir))
        return create(b, method, distance, **params).build().knn(q, 3, _FULL)

    query(_name, knn_sql(_ABS_S_SQL, _distance, k=3, q="q", b="b"))(_pruned)


@query("kd_single_radius", f"WITH {_ABS_S_SQL}, p AS (SELECT q.id AS qid, b.id AS id, {get('l2').duckdb('q.v', 'b.v')} AS dist FROM q, b) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rank, id, dist FROM p WHERE dist < 900")
def kd_single_radius(spark, sf_dir):
    q, b = (absolute(t) for t in accounts(spark, sf_dir))
    return create(b, "kdtree_single", leaf_size=20).build().radius(q, 900.0)


@query("kmeans_tree_visits", "SELECT true AS prunes, count(*) AS queries FROM supplier")
def kmeans_tree_visits(spark, sf_dir):
    """One row: do exact searches of a k-means tree look at less than a fifth of the points?"""
    q, b = accounts(spark, sf_dir)
    index = create(b, "kmeans", branching=16, leaf_size=20, iterations=5).build()
    return index.visited(q, 3, _FULL).agg((F.avg("share") < 0.2).alias("prunes"), F.count("*").alias("queries"))


ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v): the share of each letter in a document, a vector that clusters by language; documents without text have none.

    Written once: a search reads it several times, and texts are long.
    """
    text = F.lower("text")
    share = F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / F.length(text) for c in ALPHABET])
    path = scratch(spark, "letters")
    table(spark, sf_dir, "documents").where("length(text) > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), share.alias("v")).dropDuplicates(["id"]).write.parquet(path)
    return spark.read.parquet(path)


LITTLE = 0.1  # share of a clustered table that a budgeted search takes


def _little(spark, sf_dir, method: str, points: DataFrame, distance="l2", queries: DataFrame | None = None, **params) -> DataFrame:
    """One row: does a tenth of the table suffice for FLOOR of the true neighbours of every 50th row, or of queries (id, v, n: rows that ask so)?"""
    q = points.where("id % 50 = 0").withColumn("n", F.lit(1)) if queries is None else queries
    index = create(points, method, distance, leaf_size=20, **params).build()
    got = index.knn(q.select("id", "v"), K, SearchParams(checks=max(4 * K, int(LITTLE * index.built_size))))
    # of equal distances any will do
    true = knn.knn_join(q.select("id", "v"), points, K, distance).groupBy("qid").agg(F.max("dist").alias("worst"))
    both = got.join(true, "qid").join(q.select(F.col("id").alias("qid"), "n"), "qid")
    return both.agg((F.sum(F.when(F.col("dist") <= F.col("worst"), F.col("n")).otherwise(0)) >= FLOOR * F.sum("n")).alias("reaches"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


_LITTLE_SQL = f"SELECT true AS reaches, count(DISTINCT doc_id) * {K} AS total FROM documents WHERE doc_id % 50 = 0 AND length(text) > 0"


@query("kd_forest_clustered_recall", _LITTLE_SQL)
def kd_forest_clustered_recall(spark, sf_dir):
    return _little(spark, sf_dir, "kdtree", letters(spark, sf_dir), trees=4)


@query("kmeans_clustered_recall", _LITTLE_SQL)
def kmeans_clustered_recall(spark, sf_dir):
    return _little(spark, sf_dir, "kmeans", letters(spark, sf_dir), branching=16)


@query("medoid_hamming_recall", _LITTLE_SQL.replace("doc_id % 50 = 0 AND ", ""))
def medoid_hamming_recall(spark, sf_dir):
    """Medoid trees over bits: whether a letter is more frequent in a document than in the first language's texts.

    Every document asks. Those of equal bits have the same answer, so they ask once and count for as many as they are.
    """
    rows = letters(spark, sf_dir)
    bits = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.get("v", g * 8 + i) > 0.03, F.pow(F.lit(2.0), i).cast("long")).otherwise(0)))
    points = rows.select("id", bits.alias("v"))
    path = scratch(spark, "codes")
    points.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).write.parquet(path)
    return _little(spark, sf_dir, "hierarchical", points, "hamming", spark.read.parquet(path), trees=4, branching=16)


def _full_tree_sql(table_sql: str) -> str:
    return f"SELECT (2 * count(DISTINCT v) - 1)::BIGINT AS nodes, count(DISTINCT v)::BIGINT AS leaves, count(*)::BIGINT AS points, true AS one_root FROM ({table_sql})"


def _tree_counts(tree) -> DataFrame:
    """One row: nodes, leaves, points in leaves, and whether all nodes but one are children of others."""
    points = tree.leaves.select(F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("parent"), F.col("id").alias("point"))
    rows = tree.nodes.select("node", "left", "parent", F.lit(None).cast("long").alias("point")).unionByName(points)
    is_node = F.col("node").isNotNull()
    return rows.agg(F.count("node").alias("nodes"), F.count_if(is_node & F.col("left").isNull()).alias("leaves"), F.count("point").alias("points"), (F.count_if(is_node & F.col("parent").isNull()) == 1).alias("one_root"))


@query("full_tree", _full_tree_sql("SELECT embedding AS v FROM embeddings"))
def full_tree(spark, sf_dir):
    """A tree over all vectors, a point a leaf; blocks of 100 so that levels are grown by jobs."""
    return _tree_counts(fulltree.build(embeddings(spark, sf_dir).select("id", "v"), block=100))


@query("full_tree_mean_cyclic", _full_tree_sql("SELECT [c_nationkey::DOUBLE, c_acctbal] AS v FROM customer"))
def full_tree_mean_cyclic(spark, sf_dir):
    return _tree_counts(fulltree.build(accounts(spark, sf_dir)[1], pivot="mean", choose="cyclic", block=300))


@query("full_tree_leaves", "SELECT c_custkey AS id, count(*) OVER (PARTITION BY c_nationkey, c_acctbal)::BIGINT AS size FROM customer")
def full_tree_leaves(spark, sf_dir):
    """(id, size): every point once, in a leaf of its own; equal ones share theirs."""
    tree = fulltree.build(accounts(spark, sf_dir)[1], block=500)
    return tree.leaves.join(tree.nodes.select(F.col("node").alias("leaf"), "size"), "leaf").select("id", "size")


@query("index_add_splits", knn_sql(E_SQL))
def index_add_splits(spark, sf_dir):
    """Leaves that outgrow their size are split where they lie; every point is found in them."""
    e = embeddings(spark, sf_dir)
    index = create(e.where("label < 2"), "kdtree", trees=2, leaf_size=10, rebuild_threshold=0).build()
    index.add(e.where("label >= 2 or label is null"))
    return index.knn(e.select("id", "v"), K, SearchParams(checks=1 << 30))


@query("index_load_pruned", knn_sql(_ABS_S_SQL, k=3, q="q", b="b"))
def index_load_pruned(spark, sf_dir):
    """A saved index is searched from its stored cells."""
    folder = scratch(spark, "pruned")
    q, b = (absolute(t) for t in accounts(spark, sf_dir))
    create(b, "kdtree_single", leaf_size=20, shelf_points=200).build().save(folder)
    return load(spark, folder, "l2").knn(q, 3)


@query("kd_forest_budgeted")
def kd_forest_budgeted(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    index = create(e, "kdtree", trees=4, leaf_size=20).build()
    return index.knn(e, K, SearchParams(checks=int(SHARE * index.built_size)))


@query("ivf_nprobe")
def ivf_nprobe(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    index = create(e, "kmeans", branching=16, leaf_size=20).build()
    return index.knn(e, K, SearchParams(checks=int(SHARE * index.built_size)))


def _reaches(spark, sf_dir, search) -> DataFrame:
    """One row: does a budgeted search find FLOOR of the true neighbours?"""
    e = embeddings(spark, sf_dir).select("id", "v")
    return evaluate.recall(search(spark, sf_dir), knn.knn_join(e, e, K)).select((F.col("recall") >= FLOOR).alias("reaches"), "total")


_FLOOR_SQL = f"SELECT true AS reaches, count(*) * {K} AS total FROM embeddings"


@query("kd_forest_recall", _FLOOR_SQL)
def kd_forest_recall(spark, sf_dir):
    return _reaches(spark, sf_dir, kd_forest_budgeted)


@query("ivf_recall", _FLOOR_SQL)
def ivf_recall(spark, sf_dir):
    return _reaches(spark, sf_dir, ivf_nprobe)


_TRIALS = {"trials": [("kmeans", {"branching": b, "iterations": i}) for i in (1, 5) for b in (16, 32)] + [("kdtree", {"trees": t}) for t in (1, 4)]}


@query("autotune_report")
def autotune_report(spark, sf_dir):
    """What the trials need: the columns of the report that don't hang on the clock. The whole grid is the operator's default."""
    index = create(embeddings(spark, sf_dir).select("id", "v"), "autotuned", sample_fraction=0.3, extra=_TRIALS).build()
    rows = [(m, str(x), int(c), float(mem)) for m, x, _, _, c, mem, _ in index.report] or [("linear", "{}", -1, 1.0)]
    return spark.createDataFrame(rows, "method string, params string, checks int, memory double")


@query("autotuned_full_budget", knn_sql(E_SQL))
def autotuned_full_budget(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "v")
    extra = {"trials": [("kmeans", {"branching": 16, "iterations": 1}), ("kdtree", {"trees": 2})]}
    return create(e, "autotuned", sample_fraction=0.3, extra=extra).build().knn(e, K, _FULL)


CUT = 60
#: Customers by nation, then by market segment and by the sign of the balance: a tree of groups with their balances' variances.
_CUT_NODES = """
c AS (SELECT c_nationkey AS n, (ascii(substr(c_mktsegment, 1, 1)) * 2 + (c_acctbal < 0)::INT)::BIGINT AS s, c_acctbal AS x FROM customer),
t AS (
  SELECT 0::BIGINT AS node, NULL::BIGINT AS parent, count(*)::BIGINT AS size, round(var_pop(x), 4) AS variance FROM c
  UNION ALL SELECT 1 + n, 0, count(*), round(var_pop(x), 4) FROM c GROUP BY n
  UNION ALL SELECT 1000 * (1 + n) + s, 1 + n, count(*), round(var_pop(x), 4) FROM c GROUP BY n, s)"""


@query(
    "tree_cut",
    f"""WITH RECURSIVE {_CUT_NODES},
g AS (SELECT p.node, list(k.node) AS kids, count(*) AS many, sum(k.variance * k.size) - any_value(p.variance * p.size) AS gain FROM t p JOIN t k ON k.parent = p.node GROUP BY p.node),
o AS (SELECT row_number() OVER (ORDER BY gain, node) AS place, * FROM g),
cut AS (
  SELECT [0::BIGINT] AS members
  UNION ALL
  SELECT list_concat(list_filter(members, lambda m: m <> node), kids) FROM (
    SELECT cut.members, o.*, row_number() OVER (ORDER BY o.place) AS first FROM cut JOIN o ON list_contains(cut.members, o.node)
  ) WHERE first = 1 AND len(members) + many - 1 <= {CUT})
SELECT node, size, variance FROM t WHERE node IN (SELECT unnest(members) FROM (SELECT members FROM cut ORDER BY len(members) DESC LIMIT 1))""",
)
def tree_cut(spark, sf_dir):
    """The best cut of a fixed tree over the customers."""
    s = (F.ascii(F.substring("c_mktsegment", 1, 1)) * 2 + (F.col("c_acctbal") < 0).cast("int")).cast("long")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("n"), s.alias("s"), F.col("c_acctbal").alias("x"))
    numbers = [F.count("*").alias("size"), F.round(F.var_pop("x"), 4).alias("variance")]
    root = c.agg(*numbers).select(F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), "size", "variance")
    nations = c.groupBy("n").agg(*numbers).select((F.col("n") + 1).alias("node"), F.lit(0).cast("long").alias("parent"), "size", "variance")
    parts = c.groupBy("n", "s").agg(*numbers).select((1000 * (F.col("n") + 1) + F.col("s")).alias("node"), (F.col("n") + 1).alias("parent"), "size", "variance")
    return cluster.best_cut(root.unionByName(nations).unionByName(parts), CUT).select("node", "size", "variance")


@query("kmeans_tree_cut", "SELECT 9::BIGINT AS clusters, count(*)::BIGINT AS points FROM embeddings")
def kmeans_tree_cut(spark, sf_dir):
    """One row: the best cut of a k-means tree of branching 5 with at most 12 clusters has (5 - 1) m + 1 of them, and they hold all points."""
    index = create(embeddings(spark, sf_dir), "kmeans", branching=5, leaf_size=20, iterations=3).build()
    return index.cluster_centres(12).agg(F.count("*").alias("clusters"), F.sum("size").alias("points"))


@query("cluster_centres")
def cluster_centres(spark, sf_dir):
    found = cluster.cluster_centres(embeddings(spark, sf_dir).select("id", "v"), 4, iterations=3)
    return cluster.centre_table(spark, found)


# maintenance


@query("index_add_then_knn", knn_sql(E_SQL))
def index_add_then_knn(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    index = create(e.where("label < 5"), "kdtree", trees=2).build()
    index.add(e.where("label >= 5 or label is null"))
    return index.knn(e.select("id", "v"), K, _FULL)


@query("index_add_to_kmeans", knn_sql(E_SQL))
def index_add_to_kmeans(spark, sf_dir):
    """Points added below the rebuild threshold lie in the cells there are, and every search sees them."""
    e = embeddings(spark, sf_dir)
    index = create(e.where("label < 5"), "kmeans", branching=8, rebuild_threshold=0).build()
    index.add(e.where("label >= 5 or label is null"))
    return index.knn(e.select("id", "v"), K, SearchParams(checks=1 << 30))


@query("index_remove_then_knn", knn_sql(E_SQL + ", b AS (SELECT * FROM e WHERE label <> 3)", b="b"))
def index_remove_then_knn(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    index = create(e, "kdtree", trees=2).build()
    index.remove(e.where("label = 3").select("id"))
    return index.knn(e.select("id", "v"), K, _FULL)


@query("get_point", "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7")
def get_point(spark, sf_dir):
    return create(embeddings(spark, sf_dir), "linear").build().get_point(7)


@query("index_save_load", knn_sql(E_SQL))
def index_save_load(spark, sf_dir):
    folder = scratch(spark, "index")
    e = embeddings(spark, sf_dir).select("id", "v")
    create(e, "kdtree", trees=2).build().save(folder)
    return load(spark, folder, "l2").knn(e, K, _FULL)


@query("composite_save_load", knn_sql(E_SQL))
def composite_save_load(spark, sf_dir):
    folder = scratch(spark, "composite")
    e = embeddings(spark, sf_dir).select("id", "v")
    create(e, "composite", trees=2, branching=8).build().save(folder)
    return load(spark, folder, "l2").knn(e, K, SearchParams(checks=1 << 30))


# sampling and vector functions


@query("train_test_split", "SELECT id, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5(id || ':1'), 1, 15))::BIGINT, id) <= 100 THEN 'test' ELSE 'train' END AS part FROM (SELECT vec_id AS id FROM embeddings)")
def train_test_split(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id")
    test, train = sampling.split(e, 100, seed=1)
    return test.withColumn("part", F.lit("test")).unionByName(train.withColumn("part", F.lit("train")))


@query("vector_slice", f"WITH {E_SQL} SELECT id, v[1:8] AS v FROM e")
def vector_slice(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", fv.head(F.col("v"), 8).alias("v"))


@query("vector_with_dimension", f"WITH {E_SQL} SELECT id, [len(v)::DOUBLE] || v AS v FROM e")
def vector_with_dimension(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", fv.with_dimension(F.col("v")).alias("v"))


@query("highest_bit", "SELECT l_orderkey, l_linenumber, (length(bin(l_orderkey)) - 1)::INTEGER AS bit FROM lineitem WHERE l_orderkey > 0")
def highest_bit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_orderkey > 0").select("l_orderkey", "l_linenumber", fv.highest_bit(F.col("l_orderkey")).alias("bit"))


@query("texmex_roundtrip", f"WITH {E_SQL} SELECT id - (SELECT min(id) FROM e) AS id, v::FLOAT[] AS v FROM e")
def texmex_roundtrip(spark, sf_dir):
    """Written and read again by the data source, sorted over its files; ids count the records."""
    texmex.register(spark)
    path = scratch(spark, "vectors.fvecs")
    rows = embeddings(spark, sf_dir).select("id", F.col("v").cast("array<float>").alias("v"))
    rows.repartitionByRange(4, "id").sortWithinPartitions("id").write.format("texmex").option("kind", "fvecs").mode("append").save(path)
    return spark.read.format("texmex").load(path)


#: Components as bytes: 128 and 64 a unit, cut at 0 and 255.
_BYTES_SQL = "r AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: least(255, greatest(0, floor(128 + 64 * x)))) AS v FROM embeddings)"


def byte_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v): embeddings as BINARY, a byte a component."""
    level = F.transform("v", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 64 * x).cast("double"))))
    return embeddings(spark, sf_dir).select("id", pack_bytes(level).alias("v"))


@query("knn_bytes_l2", knn_sql(_BYTES_SQL.replace("r AS", "e AS")))
def knn_bytes_l2(spark, sf_dir):
    e = byte_vectors(spark, sf_dir)
    return knn.knn_join(e, e, K)


@query("knn_bytes_hamming", knn_sql(_BYTES_SQL + ", e AS (SELECT id, list_transform(v, lambda x: x::BIGINT) AS v FROM r)", "hamming"))
def knn_bytes_hamming(spark, sf_dir):
    e = byte_vectors(spark, sf_dir)
    return knn.knn_join(e, e, K, "hamming")


@query("radius_bytes", f"WITH {_BYTES_SQL.replace('r AS', 'e AS')}, p AS (SELECT q.id AS qid, b.id AS id, {get('l2').duckdb('q.v', 'b.v')} AS dist FROM e q JOIN e b ON q.id <> b.id) SELECT e.id AS qid, count(p.id)::BIGINT AS n FROM e LEFT JOIN p ON p.qid = e.id AND p.dist < {int(RADIUS * 4096)} GROUP BY e.id")
def radius_bytes(spark, sf_dir):
    e = byte_vectors(spark, sf_dir)
    return knn.radius_count(e, e, float(int(RADIUS * 4096)), itself=False)


@query("knn_lateral", knn_sql(S_SQL, k=3, q="q", b="b"))
def knn_lateral(spark, sf_dir):
    """Nearest neighbours by a table function in SQL text."""
    q, b = accounts(spark, sf_dir)
    table_functions.register_knn(spark, "three_nearest", b, 3)
    q = q.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # one small file, and much work a row
    q.createOrReplaceTempView("nearwell_suppliers")
    return spark.sql("SELECT q.id AS qid, n.rank, n.id, n.dist FROM nearwell_suppliers q, LATERAL three_nearest(q.v) n")


__all__ = ["ORACLES", "QUERIES", "distances"]
