"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from pathloom.plans import catalog
from tools.compare import TABLES, norm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert mine
        return
    rel = duck.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert catalog.entry(spark, SF).count() > 0


@pytest.mark.parametrize("broadcast", [0, 500_000])
@pytest.mark.parametrize("name", ["match_features", "match_wide", "edgelist_to_species", "perturbed_species"])
def test_joins_of_repeated_keys(spark, duck, monkeypatch, name, broadcast):
    """Dealt by the rows that come out, in tiles and in broadcast lists."""
    from pathloom import runtime

    for what, value in (("PAIRS", 50), ("TILE", 3), ("LISTED", 4), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(runtime, what, value)
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert mine == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert df.rdd.getNumPartitions() >= 8  # one file gives one task, whatever comes out of it


def test_single_values_are_listed_without_structs(spark, monkeypatch):
    """Nulls among them stay; sides are counted in one query, a spread left side is not copied."""
    from pyspark.sql import functions as F

    from pathloom import runtime

    for what, value in (("PAIRS", 5), ("LISTED", 4)):
        monkeypatch.setattr(runtime, what, value)
    asked = []
    monkeypatch.setattr(type(spark.range(1)), "count", lambda df: asked.append(df) or df.agg(F.count(F.lit(1))).first()[0])
    left = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id").alias("l"))
    right = spark.createDataFrame([(0, None), (0, 7), (0, 7), (1, None), (5, 1), (None, 2)], "k long, r long")
    df = runtime.multiplied(left, right, ["k"])
    assert not asked
    assert "explode(__rows" in df._jdf.queryExecution().toString()
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted(((x % 3, x, r) for x in range(40) for k, r in ((0, None), (0, 7), (0, 7), (1, None)) if x % 3 == k), key=repr)
