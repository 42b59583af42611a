import hashlib
import random
import zlib

import numpy as np
import pytest

from pathloom.llm import media

from .fixtures import documents, empty, texts


def test_round_trip(spark):
    got = media.round_trip(documents(spark)).collect()
    assert len(got) == len(texts()) + 3
    for r in got:
        if r.doc_id is None:
            continue
        data = (texts()[r.doc_id] or "").encode()
        p = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        wav = media.header(len(p)) + p
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(wav), hashlib.sha256(wav).hexdigest(), media.feature(p))


def test_empty_table(spark):
    assert media.round_trip(empty(spark)).count() == 0


def test_cuts_depend_on_the_content():
    r = random.Random(0)
    tail = bytes(r.randrange(32, 120) for _ in range(40_000))
    a, b = tail, bytes(r.randrange(32, 120) for _ in range(777)) + tail
    ends_a, ends_b = media.chunks([a])[0], media.chunks([b])[0]
    assert {e + 777 for e in ends_a[3:]} <= set(ends_b)
    sizes = np.diff([0, *ends_a])
    assert sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST
    assert media.chunks([b"", a])[1] == ends_a


def test_a_damaged_store_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    media.store(documents(spark), path)
    rows = spark.read.parquet(path)
    bad = f"file://{tmp_path}/bad"
    other = rows.orderBy("payload").limit(1).select("own").first().own
    from pyspark.sql import functions as F

    rows.withColumn("own", F.lit(bytearray(other))).write.parquet(bad)
    with pytest.raises(Exception):  # noqa: B017
        media.read(spark, bad).collect()
