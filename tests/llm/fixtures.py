"""Small tables with every odd case: nulls, empty and long texts, copies, near copies, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stock="abcdefgh"):
    return " ".join("".join(rng.choice(stock) for _ in range(rng.randint(1, 6))) for _ in range(n))


def edited(rng, text, share=0.03):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(99))
    return " ".join(w)


def rows(seed=0):
    rng = random.Random(seed)
    base = [words(rng, rng.choice([3, 8, 60, 150])) for _ in range(25)]
    passage = words(rng, 90)
    texts = base + [base[2], base[2].upper(), base[3] + " ", edited(rng, base[4] * 3), base[4] * 3]
    long = words(rng, 200)
    texts += [long] + [edited(rng, long, 0.01) for _ in range(6)]
    texts += [words(rng, 20) + "\n" + passage + "\n" + words(rng, 15) for _ in range(3)]
    texts += [None, "", "   \n\t", "one two", "One\ttwo", "x" * 1500, "ab" * 700, "quele " * 300, "ünï cödé " * 80, words(rng, 4000)]
    return [(i * 3, t, rng.choice(["aa", "bb", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


def docs(spark, seed=0):
    r = rows(seed)
    r.append((None, "a document without a number but with five words", "aa", "s1", 10))
    r.append(r[4])  # a repeated row
    return spark.createDataFrame(r, SCHEMA).selectExpr("*", "'x' AS extra", "1 AS node", "2 AS key")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
