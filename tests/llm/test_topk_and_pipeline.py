import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearwell.llm import bpe, exact_topk, langid, pii, queries

from ..conftest import SF
from . import fixtures
from .test_documents import jaccard_components


def brute(rows, k, every):
    use = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {i: v for i, v in use if i % every == 0}.items():
        scores = sorted((-int(q @ v), j) for j, v in use if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [False, True])
def test_top_k(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(exact_topk, "DATA_BLOCK", 100)
        monkeypatch.setattr(exact_topk, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(exact_topk, "CELL_ROWS", 60)
        monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + rng.normal(size=8) * 0.05).tolist()) for i in range(500)]
    rows += [(600 + i, [0.25] * 8) for i in range(30)] + [(700, None), (701, []), (702, [1.0] * 7 + [None]), (703, [float("nan")] * 8), (704, [float("inf")] * 8), (None, [9.0] * 8), (750, [1.0] * 3), (800, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS side")
    assert sorted(map(tuple, exact_topk.top_k(df).collect())) == brute(rows, 5, 50)
    assert exact_topk.top_k(df.limit(0)).count() == 0


def test_dual_trees_prune_and_agree():
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.02, (200, 16)) for c in rng.normal(size=(10, 16))]))
    score, ids = exact_topk.dual_search(x[::40], np.arange(0, len(x), 40), x, np.arange(len(x)), 5)
    for i, s, who in zip(range(0, len(x), 40), score, ids, strict=True):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(len(x)) if j != i)[:5]
        assert [(-int(a), int(b)) for a, b in zip(s, who, strict=True)] == want
    tree = exact_topk.CoverTree(x)
    work = [tree.root]
    while work:
        node = work.pop()
        assert np.sqrt(((x[node.members] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children]).tolist()) == sorted(node.members.tolist())
        work += node.children


def test_large_components(spark):
    rows = [(0, [1e9, -1e9]), (1, [1e9, 1e9]), (2, [-1e9, 0.5])]
    got = {r["vec_id"]: r["score"] for r in exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 0, 2: max(-(2**63), -(256 * 10**9) ** 2 - 128 * 256 * 10**9)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:  # profiles learnt from the rows outside the fold, and the distance, are tested by themselves
            found = langid.identify(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= corpus_pipeline.MIN_SCORE))
            assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(r[0] for r in found.select("doc_id").collect())
        if k == 1:
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            least = jaccard_components(rows)
            assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(i for i, _ in rows if least[i] == i)
        if k == 2:
            want = {r["doc_id"]: pii.pseudonymise(r["text"])[0] for r in before.collect()}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in after.collect())
        if k == 4:
            import public_tokenizers
            import tiktoken

            with open(queries.ranks_file(), "rb") as f:
                enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
            want = collections.Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"]))) for r in before.collect())
            assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in after.collect()) == want
        if k == 1:
            assert 0 < after.count() < before.count() and after.select("text").distinct().count() == after.count()
        if k == 3:
            assert after.select("doc_id").distinct().count() == before.count() and after.count() > before.count()
        last, before = before, after
    rows = before.collect()
    assert all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in rows) and len(rows) == last.count()
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r["doc_id"], hashlib.md5(str(r["ids"]).encode()).hexdigest())
    assert collections.Counter(map(key, whole.collect())) == collections.Counter(map(key, rows))


def test_pipeline_of_odd_rows(spark):
    docs = fixtures.docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        docs.count()
    empty = fixtures.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
