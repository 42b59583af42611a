"""Suffix-array dedup: removes every byte covered by a repeated string of ``length`` bytes,
400 unless another length is asked for (operator 7).

1. *Anchors* (:mod:`.anchors`) give each window of that length a name that equal windows
   share.  Windows whose name stands at one place only can't be repeated and are done.
2. Of the rest, the windows around an anchor are settled together where all bytes they
   cover are the same as around another anchor (the inside of a repeated passage).
3. What is left are the edges of repeated passages.  The shards of such strings, with the
   bytes of the shared name as one symbol, get Burrows-Wheeler transforms, which are
   merged by interleave refinement (:mod:`.bwt`); the repeated intervals of the merged
   transform say which windows are repeated.  A name with more than ``GROUP`` strings is
   first split into longer names over fewer windows, as often as needed.
4. The repeated windows of a document are united into spans, and their bytes removed.

Rows move only as hashes and places, except for the strings of step 3 and the documents
that have repeated windows.

Defined results: a null text is empty; texts below ``length`` bytes keep all bytes; rows that
repeat are texts of their own, so both lose what they share; doc_id may be null or
repeat (a row is known by a hash of doc_id and text); an empty table gives an empty
result; other columns are passed through by :func:`remove_repeats` (one that is named like
an added column is called ``NAME_input``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import anchors, bwt
from .common import as_long, bytes_of, drop, keep_clear, light_or_shuffled, materialise, slices, small_or_shuffled, trim, utf8

LENGTH = anchors.LENGTH
#: Strings of a name at most, and strings from which a merged transform is full (small ones
#: stay in the processor's caches: 0.4 ms a string against 0.6).
GROUP = 8000
MERGED = 1000
#: Shards whose transforms are merged in a task.
SHARDS = 3

_PLACES = "rid long, at long"


def _keyed(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__rid``, by which a row is known in both scans."""
    return documents.withColumn("__rid", F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))))


def _anchors(keyed: DataFrame, length: int) -> DataFrame:
    """Names of anchors with the places that have them: a row for each (name, all bytes
    covered) of a slice of a task, its places in an array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, ends = bytes_of(b.column(1))
            row, place, low, high, h1, h2, whole = anchors.find(data, ends, length)
            if not len(row):
                continue
            rid = b.column(0).to_numpy()[row]
            at = (low - ends[row]) << 16 | (place - low) << 8 | (high - low)
            order = np.lexsort((whole, h2, h1))
            new = np.ones(len(order), bool)
            same = np.ones(len(order) - 1, bool)
            for x in (h1, h2, whole):
                y = x[order]
                same &= y[1:] == y[:-1]
            new[1:] = ~same
            first = np.flatnonzero(new)
            places = pa.StructArray.from_arrays([pa.array(rid[order]), pa.array(at[order])], names=["rid", "at"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), places)
            top = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h1[top])), pa.array(as_long(h2[top])), pa.array(as_long(whole[top])), lists], names=["h1", "h2", "whole", "places"])

    return keyed.select("__rid", "text").mapInArrow(work, f"h1 long, h2 long, whole long, places array<struct<{_PLACES.replace(' long', ':long')}>>")


def _candidates(found: DataFrame) -> DataFrame:
    """The rows of names that stand at two places or more: ``settled`` if all that they
    cover stands elsewhere too, ``mixed`` if their name covers different bytes, ``lead`` for
    one row of each (name, bytes).  The window functions spill, so that a name may have
    any number of rows."""
    name = Window.partitionBy("h1", "h2")
    order = name.orderBy("whole")
    out = (
        found.withColumn("__before", F.lag("whole").over(order))
        .withColumn("__after", F.lead("whole").over(order))
        .withColumn("__least", F.first("whole").over(order))
        .withColumn("__most", F.max("whole").over(name))
    )
    lead = F.col("__before").isNull() | (F.col("__before") != F.col("whole"))
    return out.select(
        "h1",
        "h2",
        "places",
        ((F.size("places") > 1) | F.coalesce(F.col("__before") == F.col("whole"), F.lit(False)) | F.coalesce(F.col("__after") == F.col("whole"), F.lit(False))).alias("settled"),
        (F.col("__least") != F.col("__most")).alias("mixed"),
        lead.alias("lead"),
    ).where("settled or mixed")


def _strings(keyed: DataFrame, wanted: DataFrame, length: int, scratch: list[DataFrame]) -> DataFrame:
    """The strings around the ``wanted`` (rid, at, h1, h2, open) places: the bytes left of
    the name (``l``) and right of it (``r``); ``base`` is where ``l`` starts in the text."""
    per = wanted.groupBy("rid").agg(F.collect_list(F.struct("at", "h1", "h2", "open")).alias("wanted"))
    per = materialise(per, "repeats-wanted")
    scratch.append(per)
    rows = keyed.select(F.col("__rid").alias("rid"), "text").join(light_or_shuffled(per, 48 * F.size("wanted")), "rid")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for rid, text, places in zip(b.column(0).to_pylist(), utf8(b.column(1)).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode()
                for p in places:
                    low, left, span = p["at"] >> 16, p["at"] >> 8 & 255, p["at"] & 255
                    place = low + left
                    out.append((p["h1"], p["h2"], anchors.REACH, rid, p["open"], low, data[low:place], data[place + anchors.core(length) : low + span + length]))
            yield _batch(out)

    # repeated rows have equal ids and texts: one of them stands for all
    return rows.dropDuplicates(["rid"]).mapInArrow(work, _STRINGS)


_STRINGS = "h1 long, h2 long, reach int, rid long, open boolean, base long, l binary, r binary"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[x.split()[0] for x in _STRINGS.split(", ")])


def _renamed(h1: int, h2: int, tag: bytes, more: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(h1.to_bytes(8, "little", signed=True) + h2.to_bytes(8, "little", signed=True) + tag + more, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _split(strings: DataFrame) -> DataFrame:
    """Names over ``reach`` windows split into two, each over half of the windows and with
    the bytes that those have in common."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h1, h2, reach, rid, open_, base, left, right in zip(*[c.to_pylist() for c in b.columns], strict=True):
                half = reach // 2
                near, far = reach - half, half
                if len(right) >= near:  # windows that start less than `half` before the name
                    out.append((*_renamed(h1, h2, b"r%d" % reach, right[:near]), half, rid, open_, base + max(0, len(left) - (half - 1)), left[max(0, len(left) - (half - 1)) :], right[near:]))
                if len(left) >= far:  # windows that start `half` or more before it
                    out.append((*_renamed(h1, h2, b"l%d" % reach, left[len(left) - far :]), reach - half, rid, open_, base, left[: len(left) - far], right[: reach - 1 - half]))
            yield _batch(out)

    return strings.mapInArrow(work, _STRINGS)


def _single(strings: DataFrame) -> DataFrame:
    """Strings over one window are repeated if their name stands at two places."""
    count = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return strings.where("open").join(count, ["h1", "h2"], "left_semi").select("rid", (F.col("base") + F.octet_length("l")).alias("low"), (F.col("base") + F.octet_length("l")).alias("high"))


def merged_repeats(rows: list[tuple], reach: int, shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """(rid, first, last) runs of repeated windows of the open strings, from the merged
    transforms of the shards that the strings are dealt to."""
    names: dict[tuple[int, int], int] = {}
    parts: list[list[np.ndarray]] = [[] for _ in range(shards)]
    where: list[list[tuple]] = [[] for _ in range(shards)]
    sizes = [0] * shards
    for k, (h1, h2, _, rid, open_, base, left, right) in enumerate(rows):
        z = k % shards
        name = names.setdefault((h1, h2), 257 + len(names))
        s = np.empty(len(left) + len(right) + 2, np.uint16)
        s[: len(left)] = np.frombuffer(left, np.uint8)
        s[: len(left)] += 1
        s[len(left)] = name
        s[len(left) + 1 : -1] = np.frombuffer(right, np.uint8)
        s[len(left) + 1 : -1] += 1
        s[-1] = 0
        parts[z].append(s)
        if open_:
            where[z].append((sizes[z], len(s), rid, base, len(left)))
        sizes[z] += len(s)
    parts = [p for p in parts if p]
    found = bwt.repeats([np.concatenate(p) for p in parts], reach)
    out = []
    for z, again in enumerate(found):
        for at, n, rid, base, left in where[z]:
            # windows start up to the name itself, and have `reach` symbols in all
            hit = np.flatnonzero(again[at : at + min(left + 1, n)])
            if len(hit):
                cuts = np.flatnonzero(np.diff(hit) > 1)
                for a, c in zip(hit[np.append(0, cuts + 1)].tolist(), hit[np.append(cuts, len(hit) - 1)].tolist(), strict=True):
                    out.append((rid, base + a, base + c))
    return out


def _edges(strings: DataFrame, group: int, scratch: list[DataFrame]) -> DataFrame:
    """rid, low, high: the repeated windows of strings whose names differ in what they cover."""
    done: list[DataFrame] = []
    rest = strings
    while True:
        big = materialise(rest.groupBy("reach", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("reach", "h1", "h2"), "repeats-big")
        scratch.append(big)
        n = big.count()
        if not n:
            done.append(rest)
            break
        big = small_or_shuffled(big, n)
        done.append(rest.join(big, ["reach", "h1", "h2"], "left_anti"))
        hot = rest.join(big, ["reach", "h1", "h2"], "left_semi")
        done.append(hot.where("reach = 1"))
        rest = materialise(_split(hot.where("reach > 1").select(*[x.split()[0] for x in _STRINGS.split(", ")])), "repeats-split")
        scratch.append(rest)
    columns = [x.split()[0] for x in _STRINGS.split(", ")]
    every = done[0].select(*columns)
    for d in done[1:]:
        every = every.unionByName(d.select(*columns))
    singles = _single(every.where("reach = 1"))
    n = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = every.where("reach > 1").repartition(n, "reach", "h1", "h2").sortWithinPartitions("reach", "h1", "h2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give(rows: list[tuple]) -> pa.RecordBatch:
            found = merged_repeats(rows, rows[0][2]) if any(r[4] for r in rows) else []
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rid", "low", "high"])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (row[2] != held[-1][2] or (len(held) >= min(group, MERGED) and row[:2] != held[-1][:2])):
                    yield give(held)
                    held = []
                held.append(row)
        if held:
            yield give(held)
        held = []
        trim()

    return ordered.mapInArrow(work, "rid long, low long, high long").unionByName(singles)


def repeated_windows(keyed: DataFrame, group: int = GROUP, length: int = LENGTH, scratch: list[DataFrame] | None = None) -> DataFrame:
    """rid and the runs of its repeated windows: first and last start.  The tables that are to
    be dropped after use are added to ``scratch``."""
    scratch = [] if scratch is None else scratch
    known = materialise(_candidates(_anchors(keyed, length)), "repeats-known")
    at = F.col("p.at")
    low = F.shiftright(at, 16)
    settled = known.where("settled").select(F.explode("places").alias("p")).select(F.col("p.rid").alias("rid"), low.alias("low"), (low + at.bitwiseAND(255)).alias("high"))
    wanted = known.where("mixed and lead").select("h1", "h2", F.col("places")[0].alias("p"), (~F.col("settled")).alias("open"))
    wanted = wanted.select("h1", "h2", F.col("p.rid").alias("rid"), F.col("p.at").alias("at"), "open")
    # only names that still have an open string are worth a look
    open_ = materialise(wanted.where("open").select("h1", "h2").distinct(), "repeats-open")
    wanted = wanted.join(small_or_shuffled(open_), ["h1", "h2"], "left_semi")
    strings = materialise(_strings(keyed, wanted, length, scratch), "repeats-strings")
    scratch += [known, open_, strings]
    return settled.unionByName(_edges(strings, group, scratch))


def remove_repeats(documents: DataFrame, group: int = GROUP, length: int = LENGTH, words: int = 0) -> DataFrame:
    """``documents`` with ``__kept`` (the remaining bytes), ``__n_bytes``, ``__n_removed``,
    ``__n_spans``, and ``__text``: the remaining bytes as text, without the halves of
    characters that a span has cut.  ``length``: bytes of the strings that may not repeat.
    ``words``: united spans with fewer words than that stay."""
    if length <= anchors.REACH + anchors.GRAM:
        raise ValueError(f"strings of over {anchors.REACH + anchors.GRAM} bytes only")
    documents = keep_clear(documents, "__rid", "__runs", "__kept", "__n_bytes", "__n_removed", "__n_spans", "__text")
    keyed = _keyed(documents)
    scratch: list[DataFrame] = []
    runs = materialise(repeated_windows(keyed.select("doc_id", "text", "__rid"), group, length, scratch), "repeats-runs")
    for table in scratch:
        drop(table)
    per = materialise(runs.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list(F.struct("low", "high")).alias("__runs")), "repeats-per")
    drop(runs)
    known = small_or_shuffled(per.select("__rid"))
    hit = keyed.join(known, "__rid", "left_semi").join(per, "__rid")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    clean = keyed.join(known, "__rid", "left_anti").drop("__rid")
    clean = clean.select(*documents.columns, data.alias("__kept"), size.alias("__n_bytes"), F.lit(0).cast("long").alias("__n_removed"), F.lit(0).cast("long").alias("__n_spans"), F.coalesce("text", F.lit("")).alias("__text"))
    more = [T.StructField("__kept", T.BinaryType()), T.StructField("__n_bytes", T.LongType()), T.StructField("__n_removed", T.LongType()), T.StructField("__n_spans", T.LongType()), T.StructField("__text", T.StringType())]
    schema = T.StructType([*documents.schema.fields, *more])
    width = len(documents.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            kept, sizes, removed, spans, texts = [], [], [], [], []
            for text, runs in zip(utf8(b.column(at)).to_pylist(), b.column(width + 1).to_pylist(), strict=True):
                data = text.encode()
                found: list[list[int]] = []
                for low, high in sorted((r["low"], r["high"]) for r in runs):
                    if found and low <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], high + length)
                    else:
                        found.append([low, high + length])
                if words:
                    found = [x for x in found if len(data[x[0] : x[1]].split()) >= words]
                n, cuts = len(found), [0, *[at for x in found for at in x], len(data)]
                out = [data[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)]
                kept.append(b"".join(out))
                texts.append("".join(part.decode("utf-8", "ignore") for part in out))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                spans.append(n)
            columns = [c.cast(pa.string()) if i == at else c for i, c in enumerate(b.columns[:width])]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(texts, pa.string())],
                names=[f.name for f in schema.fields],
            )

    cut = hit.select(*documents.columns, "__rid", "__runs").mapInArrow(work, schema)
    return clean.unionByName(cut)
