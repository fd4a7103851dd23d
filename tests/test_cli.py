import numpy as np

from nearwell.__main__ import main
from nearwell.operators.knn import knn_join
from nearwell.sources import records

from .test_search import table


def test_methods_against_truth(spark, tmp_path):
    x = np.random.default_rng(0).random((120, 4)).astype(np.float32)
    base, queries, truth, out = (str(tmp_path / n) for n in ("b.fvecs", "q.fvecs", "t.ivecs", "o.csv"))
    b = table(spark, x)
    records.write_texmex(b, base)
    records.write_texmex(b.where("id < 10"), queries)
    near = knn_join(b.where("id < 10"), b, 5).orderBy("qid", "rank").collect()
    records.write_texmex(spark.createDataFrame([(q, [r["id"] for r in near if r["qid"] == q]) for q in range(10)], "id long, v array<int>"), truth)
    got = main([base, queries, truth, "-k", "5", "--methods", "linear,kdtree", "--trees", "1", "--checks", "-1", "--output", out])
    assert [(m, r) for m, r, _ in got] == [("linear", 1.0), ("kdtree", 1.0)]
    assert records.read_benchmark(spark, out).count() == 2
