"""The operators do the whole job: no row is left out by number, by a shared id or by size of the input."""

import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import jaccard, quality

WORDS = ["".join(p) for p in itertools.product("bdgk", "aeiou", "mnr")]


def prose(n, seed):
    own = random.Random(seed)
    return " ".join(own.choice(WORDS) for _ in range(n))


def test_quality_learns_from_all_unlabelled_documents(spark):
    """Documents behind the 8,000 smallest hashes change what is learned."""
    good = F.col("doc_id") % 3 > 0
    text = F.when(good, F.concat(F.lit("Bada demi "), F.repeat(F.lit("gon kur "), (F.col("doc_id") % 7).cast("int")), F.lit("."))).otherwise(F.concat(F.lit("#$ 9"), F.col("doc_id")))
    docs = spark.range(9200).toDF("doc_id").select("doc_id", text.alias("text"), F.lit("en").alias("lang"), F.when(good, "a").otherwise("b").alias("source"), F.length(text).cast("long").alias("n_chars"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if i % 10 else i // 10 % 2) for i in range(200)], "doc_id long, quality int")
    behind = {r.doc_id for r in docs.where("doc_id >= 200").orderBy(F.xxhash64("doc_id")).collect()[8000:]}
    changed = docs.withColumn("text", F.when(F.col("doc_id").isin(behind), F.lit("BADA DEMI, GON KUR! " * 9)).otherwise(F.col("text")))
    a, b = ({r.doc_id: r.score for r in quality.score(docs, quality.fit(x, labels, rounds=2, fold_out=False)).collect()} for x in (docs, changed))
    assert max(abs(a[i] - b[i]) for i in a) > 1e-3


def test_quality_takes_exact_shares(spark):
    rng = np.random.default_rng(3)
    n = 500
    text, meta = (rng.integers(-3, 4, (n, d)).astype("f4") for d in (2, 3))  # many are equally sure
    tie = rng.integers(-(2**62), 2**62, n) // 2**60  # and many share a hash
    rows = spark.createDataFrame([(int(t), i, a.tobytes(), b.tobytes()) for i, (t, a, b) in enumerate(zip(tie, text, meta, strict=True))], "tie long, row long, text binary, meta binary").repartition(3)
    views = [quality.Linear(np.array([0.5, 0.25, 0.1])), quality.Linear(np.array([1.0, 0.0, -0.5, 0.25]))]
    pool, taught = quality.Pool(rows), [{}, {}]
    for _ in range(3):
        pool.choose(views, (40, 70))
        for v, x in ((0, text), (1, meta)):
            p = views[v].logit(x)
            free = [i for i in sorted(range(n), key=lambda i: (round(p[i] * quality.GRAIN), tie[i], i)) if i not in taught[1 - v]]  # noqa: B023
            taught[1 - v] |= {i: 0 for i in free[:40] if p[i] <= 0} | {i: 1 for i in free[-70:] if p[i] > 0}
        got = quality.pseudo(pool.past, [text, meta], tie, np.arange(n))
        assert [{i: int(y) for i, y in enumerate(g.tolist()) if y >= 0} for g in got] == taught
    wanted = quality.sums(text[list(taught[0])], np.array(list(taught[0].values()), "f8"), views[0])
    assert np.allclose(pool.taught(views)[0], wanted)


def test_one_row_of_each_class_whatever_its_ids(spark):
    t = [prose(40, k) for k in range(6)]
    near = [x + " more" for x in t]
    rows = [
        (1, t[0], "a"), (None, t[0], "b"), (None, t[1], "c"), (None, None, "d"), (None, "", "e"),  # null shares an id with a class of 1
        (3, t[2], "f"), (7, t[2], "g"), (7, t[3], "h"), (7, None, "i"),  # 7 goes for one text and stays for another
        (9, t[4], "j"), (9, near[4], "k"), (9, near[4], "k"),  # near texts of one id
        (None, t[5], "l"), (None, near[5], "m"), (None, near[5], "n"), (2, "...", "o"), (2, "...", "o"),  # a class of null ids only; no words
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = Counter((r.doc_id, r.text, r.source) for r in jaccard.representatives(docs).collect())
    sure = Counter([rows[i] for i in (0, 2, 3, 4, 5, 7, 8, 15, 16)])
    assert sure <= got
    rest = list((got - sure).elements())
    assert len(rest) == 2 and sorted(x[0] or 0 for x in rest) == [0, 9]
    assert {x[1] for x in rest} <= {t[4], near[4], t[5], near[5]}


def test_one_row_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, prose(30, 9), i) for i in range(5)] + [(None, prose(30, 8), i) for i in range(5)], "doc_id long, text string, doc long")
    assert sorted(r.doc_id or 0 for r in jaccard.representatives(docs).collect()) == [0, 1]
