import math

import pytest
from pyspark.sql import functions as F

from pathloom.functions import stats


def test_fisher_follows_its_formula(spark):
    tables = [(1, 9, 11, 3), (5, 2, 8, 7), (10, 10, 10, 10), (0, 5, 5, 10), (3, 7, 2, 8)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    odds, p = stats.fisher(*map(F.col, "abcd"))
    for r in df.select("*", odds.alias("o"), p.alias("p")).collect():
        a, b, c, d = r.a, r.b, r.c, r.d
        n = a + b + c + d
        assert r.o == pytest.approx(a * d / (b * c))
        z = (a - (a + b) * (a + c) / n - 0.5) / math.sqrt((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)))
        assert r.p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-6)
    assert df.limit(1).select(stats.fisher(F.lit(1), F.lit(0), F.lit(2), F.lit(3))[0]).first()[0] == math.inf


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (1, 7, 40) for k in range(0, n + 1, 3) for p in (0.0, 0.05, 0.5, 0.99)]
    df = spark.createDataFrame(cases, "k long, n long, p double").withColumn("t", stats.binomial(F.col("k"), F.col("n"), F.col("p")))
    for r in df.collect():
        want = 1.0 if r.p == 0 else sum(math.comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.k, r.n + 1))
        assert r.t == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_proportion_of_nothing_is_not_enriched(spark):
    df = spark.createDataFrame([(0, 10, 5, 100), (5, 10, 0, 100), (5, 10, 10, 100)], "k long, n long, m long, t long")
    p = [r[0] for r in df.select(stats.proportion(*map(F.col, "knmt"))[2]).collect()]
    assert p[:2] == [1.0, 1.0]
    assert p[2] < 1e-3


def test_rates_with_ties(spark, rows):
    p = [0.01, 0.01, 0.04, 0.03, 0.5]
    out = stats.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p", "q")
    rank = lambda x: sum(y <= x for y in p)
    want = sorted((x, min(1.0, min(y * len(p) / rank(y) for y in p if y >= x))) for x in p)
    assert [(a, round(b, 12)) for a, b in rows(out)] == [(a, round(b, 12)) for a, b in want]


def test_midrank_quantiles(spark, rows):
    observed = spark.createDataFrame([("g1", 5.0), ("g2", 1.0), ("g3", 2.0)], "gene string, value double")
    null = spark.createDataFrame([("g1", 1.0), ("g1", 2.0), ("g2", 1.0), ("g2", 1.0), ("g3", 2.0), ("g3", 1.0)], "gene string, value double")
    assert rows(stats.midrank_quantile(observed, null, ["gene"])) == [("g1", 1.0), ("g2", None), ("g3", 0.75)]
