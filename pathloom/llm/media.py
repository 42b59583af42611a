"""Media columns over content-defined chunks (operator 2).

A text's bytes, padded with zeros to a positive multiple of 64, are the 8-bit samples of a
mono WAV file.  The samples are cut where a rolling gear hash of the last 32 bytes hits a
pattern, so that equal passages give equal chunks.  Chunk digests are deduplicated by
joins: the first holder of a digest (by row hash and position) owns the chunk, all other
holders refer to it.  The store has a row for each distinct payload: the file's header,
the ordered list of chunk digests, and the bytes of the chunks it owns.

Reading back takes own chunks from the row itself and fetches the others by digest, checks
every chunk against its digest, puts the file together, and computes features.  Chunk
bytes move between tasks only where a payload refers to another one's chunk.

Defined results: a null text is empty; rows that repeat or have equal texts share one
stored payload and get equal values; doc_id may be null or repeat; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_table, materialise, new_path, slices, small_or_shuffled, utf8

PAD = 64
#: Least and most bytes of a chunk, and the bits of the hash that must be zero at a cut.
LEAST, MOST, BITS = 512, 8192, 11
RATE = 8000
_GEAR = (byte_table(5) >> np.uint64(32)).astype(np.uint32)


class MediaError(ValueError):
    """Stored media that isn't what its digests say."""


def payload(text: str) -> bytes:
    data = text.encode()
    return data + bytes(max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def header(n: int) -> bytes:
    """The head of a WAV file with ``n`` 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def samples(media: bytes) -> bytes:
    """The samples of a WAV file as made here, after a check of its head."""
    n = len(media) - 44
    if n < 0 or media[:44] != header(n):
        raise MediaError("not an 8-bit mono WAV file")
    return media[44:]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash at every byte, over the 32 bytes that end there."""
    h = _GEAR[data]
    width = 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(hits: list[int], n: int) -> list[int]:
    """Ends of the chunks of ``n`` bytes, given the places (in order) behind which the hash
    allows a cut."""
    out, at, k = [], 0, 0
    while n - at > LEAST:
        while k < len(hits) and hits[k] - at < LEAST:
            k += 1
        at = hits[k] if k < len(hits) and hits[k] - at <= MOST else at + MOST
        if at >= n:
            break
        out.append(at)
    out.append(n)
    return out


def chunks(payloads: list[bytes]) -> list[list[int]]:
    """The ends of the chunks of every payload."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    places = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
    ends = np.cumsum([len(p) for p in payloads])
    out, start = [], 0
    for end in ends.tolist():
        a, b = np.searchsorted(places, [start, end])
        out.append(cuts((places[a:b] - start).tolist(), end - start))
        start = end
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def feature(data: bytes) -> str:
    """Mean, loudness, zero crossings and histogram of the samples, as whole numbers."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    around = x - 128
    crossings = int(np.count_nonzero((around[1:] < 0) != (around[:-1] < 0)))
    bands = np.bincount(x >> 5, minlength=8)
    return f"mean={int(x.sum()) * 1000 // len(x)};rms={int((around * around).sum()) // len(x)};cross={crossings};hist={'-'.join(map(str, bands))}"


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _recipes(keyed: DataFrame) -> DataFrame:
    """rid, doc_id, n_bytes, payload digest and the chunk digests of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = utf8(b.column(2)).to_pylist()
            datas = [payload(t) for t in texts]
            lists = []
            for p, ends in zip(datas, chunks(datas), strict=True):
                lists.append([_digest(p[a:e]) for a, e in zip([0, *ends[:-1]], ends, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(list(map(_digest, datas)), pa.binary()), pa.array(lists, pa.list_(pa.binary()))],
                names=["rid", "doc_id", "n_bytes", "payload", "digests"],
            )

    return keyed.mapInArrow(work, "rid long, doc_id long, n_bytes long, payload binary, digests array<binary>")


def store(documents: DataFrame, path: str) -> DataFrame:
    """Write the store to ``path``; returns doc_id, n_bytes and payload of every row."""
    keyed = _keyed(documents)
    recipes = materialise(_recipes(keyed), "media-recipes")
    first = materialise(recipes.groupBy("payload").agg(F.min_by(F.struct("rid", "digests"), "rid").alias("r")).select("payload", "r.*"), "media-first")
    places = first.select("rid", F.posexplode("digests").alias("at", "digest"))
    owners = places.groupBy("digest").agg(F.min(F.struct("rid", "at")).alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "own")
    owners = materialise(owners, "media-owners")
    # what other rows own, and what of one's own others ask for
    refers = places.join(small_or_shuffled(owners), "digest").where((F.col("rid") != F.col("own.rid")) | (F.col("at") != F.col("own.at")))
    refers = materialise(refers.groupBy("rid").agg(F.collect_list("at").alias("others")), "media-refers")
    copies = materialise(recipes.join(first.select("payload", F.col("rid").alias("kept")), "payload").where("rid <> kept").select("rid").distinct(), "media-copies")
    rows = keyed.select("rid", "text").join(small_or_shuffled(copies), "rid", "left_anti").join(small_or_shuffled(refers, bound=200_000), "rid", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches):
            datas = [payload(t) for t in utf8(b.column(1)).to_pylist()]
            out: list[tuple] = []
            for p, ends, others in zip(datas, chunks(datas), b.column(2).to_pylist(), strict=True):
                skip = set(others or ())
                spans = list(zip([0, *ends[:-1]], ends, strict=True))
                own = b"".join(p[a:e] for k, (a, e) in enumerate(spans) if k not in skip)
                out.append((_digest(p), header(len(p)), [_digest(p[a:e]) for a, e in spans], [e - a for a, e in spans], sorted(skip), pack(own)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            names = ["payload", "head", "digests", "sizes", "others", "own"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "payload binary, head binary, digests array<binary>, sizes array<int>, others array<int>, own binary"
    rows.select("rid", "text", "others").mapInArrow(work, schema).write.option("compression", "none").parquet(path)
    return recipes.select("doc_id", "n_bytes", "payload")


def _own(sizes: list[int], others: list[int], own: bytes) -> dict[int, bytes]:
    """The chunks that a row of the store has itself, by their places."""
    skip, out, at = set(others), {}, 0
    data = zstandard.ZstdDecompressor().decompress(own, max_output_size=max(1, sum(sizes)))
    for k, n in enumerate(sizes):
        if k not in skip:
            out[k] = data[at : at + n]
            at += n
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """payload, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and
    feature of every stored payload, from the bytes read back."""
    rows = spark.read.parquet(path)
    asked = rows.where(F.size("others") > 0).select("payload", F.explode(F.transform("others", lambda k: F.get("digests", k))).alias("digest"))
    asked = materialise(asked.distinct(), "media-asked")
    wanted = materialise(asked.select("digest").distinct(), "media-wanted")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digests, sizes, others, own, want in zip(*[c.to_pylist() for c in b.columns], strict=True):
                have = _own(sizes, others, own)
                found = {digests[k]: c for k, c in have.items() if digests[k] in set(want)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "chunk"])

    # which rows own a wanted chunk: a join of digests only, then the rows that do
    holders = rows.select("payload", F.explode("digests").alias("digest")).join(small_or_shuffled(wanted), "digest", "left_semi")
    holders = materialise(holders.groupBy("payload").agg(F.collect_set("digest").alias("want")), "media-holders")
    given = rows.join(small_or_shuffled(holders, bound=100_000), "payload").select("digests", "sizes", "others", "own", "want")
    given = given.mapInArrow(give, "digest binary, chunk binary").dropDuplicates(["digest"])
    fetched = asked.join(given, "digest").groupBy("payload").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))
    none = F.lit(None).cast("array<struct<digest:binary,chunk:binary>>").alias("fetched")
    columns = ["payload", "head", "digests", "sizes", "others", "own"]
    alone = rows.where(F.size("others") == 0).select(*columns, none)
    joined = rows.where(F.size("others") > 0).join(fetched, "payload").select(*columns, "fetched")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for b in batches:
            out = []
            for key, head, digests, sizes, others, own, got in zip(*[c.to_pylist() for c in b.columns], strict=True):
                have = _own(sizes, others, own)
                if got:
                    by = {x["digest"]: x["chunk"] for x in got}
                    have |= {k: by[digests[k]] for k in others}
                parts = [have[k] for k in range(len(digests))]
                for d, c in zip(digests, parts, strict=True):
                    if _digest(c) != d:
                        raise MediaError("a chunk differs from its digest")
                media = head + b"".join(parts)
                data = samples(media)
                if _digest(data) != key:
                    raise MediaError("a payload differs from its digest")
                out.append((key, len(data), key.hex(), zlib.crc32(data[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return alone.unionByName(joined).mapInArrow(work, schema).dropDuplicates(["payload"])


def round_trip(documents: DataFrame) -> DataFrame:
    """Store all texts and read them back: a row for each document."""
    spark = documents.sparkSession
    path = new_path(spark, "media")
    listed = store(documents, path)
    return listed.join(materialise(read(spark, path), "media-read"), "payload").drop("payload")
