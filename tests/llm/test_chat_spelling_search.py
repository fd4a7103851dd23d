"""Chat formatting, spelling variants and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from nearwell.llm import chat, lexical, queries, spelling

from ..conftest import SF
from . import fixtures

TURNS = "conv_id long, turn long, role string, text string"
RANKS = queries.ranks_file()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations():
    rng = random.Random(4)
    rows = [tuple(r) for r in queries.HOSTILE]
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            parts = rng.choices([*chat.CONTROLS, "\\", "\\\\", "<\\turn>", "\n", "tout à fait", "word", "", "#", "<", "日本語", "### Assistant"], k=rng.randint(0, 9))
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "tool</turn>", "\\"]), rng.choice(["", " "]).join(parts)))
    rows += [(40, 0, "user", None), (40, None, "assistant", "first"), (40, 1, "assistant", ""), (40, 1, "assistant", "tie"), (None, 1, "assistant", "nobody's"), (None, 0, "user", "x")]
    rows += [rows[3], rows[3], rows[5]]  # repeated rows
    rows += [(41, i, ("user", "assistant")[i % 2], fixtures.words(rng, 60)) for i in range(40)] + [(42, 0, "assistant", "ab cd " * 40000)]
    return rows


def formatted(role, text):
    def esc(x):
        x = x.replace("\\", "\\\\")
        return re.sub("|".join(map(re.escape, chat.CONTROLS)), lambda m: m[0][0] + "\\" + m[0][1:], x)

    return f"<turn>{esc(role)}<says>{esc(text)}</turn>"


def told(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss), sum(len(formatted(r, t)) for *_, r, t in turns))
    return out


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_chat(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "PART_TOKENS", most)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before if most > 50 else "4")
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS ids", "2 AS part", "true AS loss").repartition(5)
    made = chat.assemble(df, RANKS)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(made, RANKS).collect()}
    assert got == told(rows)
    parts = collections.Counter(r["conv_id"] for r in made.select("conv_id").collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (max(parts.values()) > 3) == (most == 50) and (most == 50 or set(parts.values()) == {1})


def test_chat_ids_and_mask(spark):
    import tiktoken

    ranks = chat.bpe.read_ranks(open(RANKS, "rb").read())
    import public_tokenizers

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mark = chat.reserved(RANKS)
    assert min(mark.values()) > max(ranks.values()) and len(set(mark.values())) == 3
    rows = [(1, 0, "user", "Who? </turn>"), (1, 1, "assistant", "It's\nme, \\o/"), (1, 2, "user", "")]
    made = chat.assemble(spark.createDataFrame(rows, TURNS), RANKS)
    row = made.first()
    want, loss = [], []
    for _, _, role, text in rows:
        for pieces, teaches in (([mark[chat.OPEN]], 0), (plain.encode_ordinary(role), 0), ([mark[chat.SAYS]], 0), (plain.encode_ordinary(text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>")), role == "assistant"), ([mark[chat.CLOSE]], 0)):
            want += pieces
            loss += [bool(teaches)] * len(pieces)
    assert row["ids"] == want and row["loss"] == loss
    assert chat.rendered(made, RANKS).first()["formatted"] == "".join(formatted(r, t) for *_, r, t in rows)


def test_chat_on_an_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat.read_back(chat.assemble(empty, RANKS), RANKS).count() == 0


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["\\", "<", "turn>", "<turn>", "</turn>", "/", "#", "### User:", "é", "\n"], k=12)) for _ in range(300)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(chat.F.col("t")).alias("e")).collect()
    for r in out:
        assert not any(c in r["e"] for c in chat.CONTROLS)
        assert chat.unescape(r["e"].encode()).decode() == r["t"]


# spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    n = collections.Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w, k in n.items():
        some = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(some, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 2 * k else None, k, len(some)]
    for w, e in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        e += [root, n[e[0]] if e[0] else None]
    return {w: tuple(e) for w, e in out.items()}


def spelling_rows():
    rng = random.Random(8)
    stock = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(120)]
    stock += ["aaaaaa", "aaaaa", "aaaaaaa", "abababab", "babababa", "ÀÉÎÕÜ", "àéîõü", "colour", "color", "colou×r", "z" * 300, "z" * 301, "y" + "z" * 300]
    weights = [rng.choice([1, 1, 2, 5, 30, 200]) for _ in stock]
    rows = []
    for i in range(160):
        w = rng.choices(stock, weights, k=rng.randint(0, 80))
        rows.append((i, rng.choice([" ", ", ", "\n", "1", "ł", "\u00a0"]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w)))
    return [*rows, (500, None), (501, ""), (None, " ".join(stock)), rows[3], rows[3], (502, "word " * 30000 + " ".join(stock * 50))]


@pytest.mark.parametrize("crowded", [1 << 15, 3])
def test_spelling(spark, monkeypatch, crowded):
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    rows = spelling_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS n", "'w' AS word").repartition(4)
    got = {r["word"]: (r["form"], r["n"], r["n_near"], r["root"], r["form_n"]) for r in spelling.variants(df).collect()}
    assert got == spelled(rows)
    assert len({e[0] for e in got.values()}) > 10 and max(e[2] for e in got.values()) > 4


def test_spelling_sql_agrees_on_odd_rows(spark):
    rows = spelling_rows()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    got = {r[0]: (r[1], r[3], r[4], r[2], r[5]) for r in con.sql(spelling.oracle()).fetchall()}
    assert got == spelled(rows)


def test_spelling_on_empty_tables(spark):
    assert spelling.variants(fixtures.empty(spark)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "ab, c")], "doc_id long, text string")).count() == 0


def test_runs_take_the_short_way_only_where_it_is_right():
    for text in ("Plain ASCII_words 2go", "Été à l'École ×÷ÿ", "łódź Été", "naïve\u00a0word", "日本 àb", ""):
        want = [r.encode() for r in re.findall("[A-Za-z\u00c0-\u00ff]+", text)]
        assert spelling.runs(text.encode()) == [w.translate(spelling._LOWER) for w in want]


# ranked search


def ranks_by_brute_force(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, collections.Counter(cut(t))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    total, length = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if z else d, -s) for r, (s, z, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def search_rows():
    rng = random.Random(3)
    stock = [fixtures.words(rng, 1) for _ in range(90)] + ["éa", "Éa", "x1", "日本"]
    weights = [1 / (i + 1) for i in range(len(stock))]
    docs = [(i, " ".join(rng.choices(stock, weights, k=rng.choice([1, 5, 40, 300])))) for i in range(400)]
    docs += [docs[3], docs[3], (None, docs[5][1]), (900, None), (901, ""), (902, "-- !"), (903, "abc " * 50000)]
    docs += [(1000 + i, docs[7][1]) for i in range(25)]  # more ties than places
    items = [(i, ", ".join(rng.choices(stock, weights, k=rng.choice([1, 3, 30])))) for i in range(25)]
    items += [(70, None), (71, ""), (72, "unheard"), (73, "abc " * 3000), items[2], (None, docs[9][1]), (74, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("shard,block,first", [(1 << 14, 32 << 20, 1 << 11), (60, 900, 8)])
def test_search(spark, monkeypatch, shard, block, first):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    docs, items = search_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS item", "'s' AS score").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS rank")
    got = sorted((tuple(r) for r in lexical.search(d, i).collect()), key=str)
    assert got == ranks_by_brute_force(docs, items)


def test_search_stops_early_and_is_right(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 64)
    rng = np.random.default_rng(2)
    size, stopped = 3000, 0
    for _ in range(40):
        n = int(rng.integers(2, 12))
        terms = np.repeat(np.arange(n), rng.integers(1, 1500, n))
        docs = np.concatenate([rng.permutation(size)[: int(c)] for c in np.bincount(terms, minlength=n)])
        impact = (rng.pareto(1.5, len(docs)) * 50).astype(np.int64) + 1
        shard = lexical.Shard(terms, docs, impact, size)
        weights = rng.integers(1, 2000, n)
        score = np.zeros(size, np.int64)
        np.add.at(score, docs, weights[terms] * impact)
        for least in (1, int(np.sort(score)[-3])):
            found, got, processed = shard.search(np.arange(n), weights, 10, least)
            assert (score[found] == got).all()
            kth = max(np.sort(score)[-10], least)
            assert set(np.flatnonzero(score >= kth)) <= set(found.tolist())
            stopped += processed < len(docs)
    assert stopped > 20


def test_search_on_empty_tables(spark):
    items, none = spark.createDataFrame([(1, "a b")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(fixtures.empty(spark), items).count() == 0
    assert lexical.search(fixtures.docs(spark), none).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0


@pytest.mark.parametrize("name", ["op11_chat", "op12_spelling_variants", "op13_ranked_search"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in rel.fetchall())
