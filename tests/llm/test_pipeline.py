"""The stages of the pipeline, each against a brute-force version on its own input."""

import hashlib
import os

import duckdb
import psutil
import pyarrow as pa
import pytest

import corpus_pipeline
from pathloom.llm import catalog, common, lines, packing, toxicity
from tools.compare import TABLES, norm

from . import test_lines, test_near_dups, test_repeats
from .fixtures import documents

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with labels, on disk."""
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    documents(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(4, 0), (7, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "lines", "near_dups", "repeats", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name == "packing":
            assert sum(r.offset == 0 for r in rows) == len({r.sequence_id for r in rows})
            break
        assert out.columns == docs.columns
        before = docs.collect()
        if name == "lines":
            want = test_lines.brute([(r.doc_id, r.source, r.text) for r in before], lines.MIN_SITES)
            assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((i, t) for i, t, _ in want), key=repr)
        if name == "near_dups":
            known = test_near_dups.brute([(r.doc_id, r.text) for r in before if r.doc_id is not None])
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(set(known.values()))
        if name == "repeats":
            want = test_repeats.brute([(r.text or "").encode() for r in before], corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)
            assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in rows) == sorted(hashlib.sha256(k.decode("utf-8", "ignore").encode()).hexdigest() for k, _ in want)
        docs = spark.createDataFrame(rows, docs.schema)


@needs_tables
def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and max(r.offset + r.length for r in out) <= packing.CAPACITY


@needs_tables
@pytest.mark.parametrize("name", list(catalog.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert mine == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)


def test_workers_get_bounded_batches_while_a_table_is_written(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    got = [r.n for r in common.materialise(spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n long"), "batches").collect()]
    assert sum(got) == 9000 and max(got) <= common.BATCH_ROWS < 9000
    assert spark.conf.get(key) == was


def heap(spark):
    """Committed MB of the JVM that runs the tasks."""
    return spark.sparkContext._jvm.java.lang.Runtime.getRuntime().totalMemory() / 1e6


def test_stages_begin_with_heaps_given_back(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        held = [spark.sparkContext._jvm.java.nio.ByteBuffer.allocate(300 << 20) for _ in range(4)]
        before = heap(spark)
        assert before > 1200
        for x in held:
            spark.sparkContext._gateway.detach(x)
        del held
        stage(spark, docs, folder)
        assert heap(spark) < before - 400


def test_learning_starts_no_other_workers(spark, folder):
    """Local rows go to the executors in Arrow: the workers' daemons are as many as for Arrow alone."""
    daemons = lambda: sum("pyspark.daemon" in " ".join(p.cmdline()) for p in psutil.Process().children(recursive=True) if p.status() != "zombie" and "pyspark.daemon" not in " ".join(p.parent().cmdline()))
    spark.range(3).mapInArrow(lambda batches: batches, "id long").collect()
    before = daemons()
    assert before
    toxicity.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert daemons() == before
