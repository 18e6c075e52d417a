"""Small inputs with the awkward cases, and plain versions of the operators."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))


def rows(seed=5, n=60):
    """Prose with exact and near copies, shared passages, a hot source, and the awkward cases."""
    rng = random.Random(seed)
    out = []
    base = [prose(rng, rng.randrange(60, 300)) for _ in range(8)]
    passage = prose(rng, 70)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = rng.choice(base)
        elif kind == 1:
            ws = rng.choice(base).split(" ")
            for _ in range(rng.randrange(1, 12)):
                ws[rng.randrange(len(ws))] = "edit" + str(rng.randrange(1000))
            t = " ".join(ws)
        elif kind == 2:
            t = prose(rng, rng.randrange(5, 40)) + " " + passage + "\t" + prose(rng, rng.randrange(5, 40))
        else:
            t = prose(rng, rng.randrange(1, 200))
        out.append((i, t, "en", "hot" if i % 3 == 0 else f"s{i % 4}", len(t)))
    out += [
        (1000, None, "en", "s1", None),
        (1001, "", "en", None, 0),
        (1002, " \n\t ", None, "s1", 4),
        (1003, "one", "en", "s2", 3),
        (1004, "one", "en", "s2", 3),
        (None, base[0], "en", "s1", 1),
        (1005, "a b " * 3000, "en", "s1", 12000),
        (1006, "z" * 50_000, "en", "s1", 50_000),
        (1007, "naïve 中文 😀\x85 x\xa0y", "zh", "s3", 15),
        (1008, base[1].upper(), "en", "s1", 1),
        (5, out[5][1], "en", out[5][3], 1),
        (5, out[5][1], "en", out[5][3], 1),
    ]
    return out


def documents(spark, seed=5, n=60):
    return spark.createDataFrame(rows(seed, n), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
