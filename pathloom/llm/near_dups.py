"""Near-duplicate classes by BagMinHash, banding and verification (operator 6).

A document is the multiset of its runs of five words (fewer words: one run).  Documents
with equal multisets collapse into a node.  A node's BagMinHash signature is cut into
bands; nodes that agree in a band share a bucket.  Inside a bucket all pairs are held
against each other by their exact weighted Jaccard similarity, in blocks of bounded
size.  In a bucket of more than a block the nodes are held against its first node before
that; those similar to it are in one class and need no comparison with each other, and
the others are cut into blocks, of which every pair with any block is a task-sized group
of its own.  A pair is looked at only in the first band it shares, and of the
similar pairs a group keeps a spanning forest, so no group sends out more links than it
has nodes and yet none that joins two classes is lost.  Classes are the connected
components of the links.

Only nodes that share a bucket with another move beyond their band keys: their texts
are read a second time to make the multisets for the comparison.

Defined results: a document without words (null, empty, white space) is in no class but
its own; rows that repeat are copies; rows with equal doc_id are one node; a row with a
null doc_id has a null class and stays; ties go to the smallest doc_id; an empty table
gives an empty result; other columns are passed through by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bagminhash as bmh
from .common import bytes_of, drop, keep_clear, materialise, mix, original, slices, small_or_shuffled

SIMILARITY = 0.8
BANDS = 16
BAND_ROWS = 4
#: Nodes in a block.
BLOCK = 256


def _sketches(documents: DataFrame) -> DataFrame:
    """doc_id, digest (of the multiset, null without words), weight and band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = b.num_rows
            data, ends = bytes_of(b.column(1))
            e, row, w = bmh.bags(*bmh.shingles(data, ends))
            sig = bmh.signatures(e, row, w, n, BANDS * BAND_ROWS)
            keys = bmh.band_keys(sig, BANDS, BAND_ROWS)
            sums = np.zeros((2, n), np.uint64)
            for i in range(2):  # order-free digests: sums of mixed (element, count)
                np.add.at(sums[i], row, mix(mix(e + np.uint64(i + 11)) ^ w.astype(np.uint64)))
            weight = np.bincount(row, weights=w, minlength=n).astype(np.int64)
            digest = [a + c if k else None for a, c, k in zip(map(np.uint64.tobytes, sums[0]), map(np.uint64.tobytes, sums[1]), weight, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digest, pa.binary()), pa.array(weight), pa.array([k.tobytes() for k in keys], pa.binary())],
                names=["doc_id", "digest", "weight", "bands"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, digest binary, weight long, bands binary")


def _memberships(nodes: DataFrame) -> DataFrame:
    """A row for every (node, band): the bucket's key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(b.column(0).to_numpy(), BANDS)),
                    pa.array(np.repeat(b.column(1).to_numpy(), BANDS)),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)),
                    pa.array(keys),
                ],
                names=["node", "weight", "band", "bucket"],
            )

    return nodes.select("node", "weight", "bands").mapInArrow(work, "node long, weight long, band int, bucket long")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = first != held_key
        at = np.flatnonzero(new)
        if held and new[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = [*([0] if not new[0] else []), *at.tolist(), b.num_rows]
        for i in range(len(edges) - 2):
            part = b.slice(edges[i], edges[i + 1] - edges[i])
            yield pa.Table.from_batches([*held, part])
            held = []
        held.append(b.slice(edges[-2], edges[-1] - edges[-2]))
        held_key = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` (band, bucket, node, tied, n_free, n_tied, ...) dealt to pairs of blocks:
    ``i`` <= ``j`` name the pair, ``side`` (0: block i, 1: block j) a row's own block.  The
    first ``n_free`` blocks of a bucket are of nodes that aren't tied to its first node, the
    next ``n_tied`` of those that are; two of the latter make no pair."""
    at = F.xxhash64("node")
    own = F.when(F.col("tied"), F.col("n_free") + F.pmod(at, F.greatest("n_tied", F.lit(1)))).otherwise(F.pmod(at, F.greatest("n_free", F.lit(1)))).cast("int")
    others = F.when(F.col("tied"), F.col("n_free")).otherwise(F.col("n_free") + F.col("n_tied"))
    paired = members.withColumn("own", own).withColumn("others", others).where("others > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    return paired.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")).drop("own", "other", "others")


def _tied(documents: DataFrame, members: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The members of buckets of more than a block, with ``tied``: whether a node is similar
    to the bucket's first one, or is that; and those links (a, b).  Nodes tied to one are in
    one class whatever they are to each other, so a bucket of one class costs no more than
    its nodes.  The first node's multiset goes to the others' in blocks."""
    members = members.where(F.col("size") > BLOCK)
    first = members.groupBy("band", "bucket").agg(F.min("node").alias("first"))
    members = materialise(members.join(small_or_shuffled(materialise(first, "near-first")), ["band", "bucket"]), "near-large")
    pairs = members.where("node <> first").select("first", "node").distinct()
    sizes = materialise(pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts")), "near-salts")
    sizes = small_or_shuffled(sizes)
    dealt = pairs.join(sizes, "first").select("first", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
    lead = sizes.select("first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("first").alias("node"))
    bags = materialise(_bags(documents, small_or_shuffled(materialise(members.select("node").distinct(), "near-many")), False), "near-large-bags")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.withColumn("side", F.lit(1)).unionByName(lead.withColumn("side", F.lit(0))).join(bags, "node")
    ordered = rows.select("first", "salt", "side", "node", "e", "w").repartition(n, "first", "salt").sortWithinPartitions("first", "salt", "side", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2):
            bags = [(np.frombuffer(e, np.uint64), np.frombuffer(w, np.int32).astype(np.int64)) for e, w in zip(t.column("e").to_pylist(), t.column("w").to_pylist(), strict=True)]
            node = t.column("node").to_numpy()
            weight = np.array([w.sum() for _, w in bags])
            near = np.minimum(weight, weight[0]) >= similarity * np.maximum(weight, weight[0]) - 1e-9
            hit = []
            for k in np.flatnonzero(near[1:]) + 1:
                low = bmh.similarity(bags[0], bags[k])[0]
                if low >= similarity * (weight[0] + weight[k] - low) - 1e-9:
                    hit.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), node[0])), pa.array(node[hit])], names=["first", "node"])

    found = materialise(ordered.mapInArrow(work, "first long, node long"), "near-tied")
    flagged = members.join(found.withColumn("hit", F.lit(True)), ["first", "node"], "left")
    flagged = flagged.withColumn("tied", F.coalesce("hit", F.col("node") == F.col("first"))).drop("hit", "first")
    flagged = materialise(flagged, "near-flagged")
    counts = flagged.groupBy("band", "bucket").agg(F.ceil(F.count_if(~F.col("tied")) / BLOCK).cast("int").alias("n_free"), F.ceil(F.count_if("tied") / BLOCK).cast("int").alias("n_tied"))
    out = flagged.join(small_or_shuffled(materialise(counts, "near-counts")), ["band", "bucket"])
    drop(members)
    drop(bags)
    return out, found.select(F.col("first").alias("a"), F.col("node").alias("b"))


_GROUP = ["band", "bucket", "i", "j"]


def _sorted(blocks: DataFrame, rows: list[str]) -> DataFrame:
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.select(*_GROUP, *rows).repartition(n, *_GROUP).sortWithinPartitions(*_GROUP, "side", "node")


def _wanted(members: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The (band, bucket, i, j, side, node) in which a node has a pair to be looked at: the
    pair shares no earlier band, and its weights allow the similarity."""
    blocks = _sorted(_blocks(members).join(nodes.select("node", "bands"), "node"), ["side", "node", "weight", "bands"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 4):
            side, node, weight = (t.column(c).to_numpy() for c in ("side", "node", "weight"))
            if len(node) < 2:
                continue
            band, i, j = t.column("band")[0].as_py(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
            keys = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.int64).reshape(len(node), BANDS)
            fine = _allowed(keys, weight, band, side, i == j, similarity)
            need = np.flatnonzero(fine.any(0) | fine.any(1))
            if len(need):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(need), t.column(c)[0].as_py()), k) for c, k in zip(_GROUP, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                    + [pa.array(side[need], pa.int32()), pa.array(node[need])],
                    names=[*_GROUP, "side", "node"],
                )

    return blocks.mapInArrow(work, "band int, bucket long, i int, j int, side int, node long")


def _allowed(keys: np.ndarray, weight: np.ndarray, band: int, side: np.ndarray, same: bool, similarity: float) -> np.ndarray:
    """Which pairs (row < column) a group looks at."""
    n = len(weight)
    out = np.triu(np.ones((n, n), bool), 1)
    if not same:
        out &= side[:, None] != side[None, :]
    for c in range(band):
        out &= keys[:, c][:, None] != keys[:, c][None, :]
    low, high = np.minimum(weight[:, None], weight[None, :]), np.maximum(weight[:, None], weight[None, :])
    return out & (low >= similarity * high - 1e-9)


def _bags(documents: DataFrame, needed: DataFrame, keys: bool = True) -> DataFrame:
    """node, band keys (empty unless asked for), elements and counts of the documents that
    are some node's first."""
    with_keys = keys
    rows = documents.select(F.col("doc_id").cast("long").alias("node"), "text").join(needed, "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, ends = bytes_of(b.column(1))
            e, row, w = bmh.bags(*bmh.shingles(data, ends))
            keys = bmh.band_keys(bmh.signatures(e, row, w, b.num_rows, BANDS * BAND_ROWS), BANDS, BAND_ROWS) if with_keys else np.zeros((b.num_rows, 0), np.int64)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([k.tobytes() for k in keys], pa.binary()),
                    pa.array([e[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([w[x:y].astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ],
                names=["node", "bands", "e", "w"],
            )

    return rows.mapInArrow(work, "node long, bands binary, e binary, w binary")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sums of minima of all pairs: elements that only one bag has don't count, the
    rest is a product of bag by (element, level) matrices, some thousand columns a time."""
    n = len(bags)
    owner = np.repeat(np.arange(n), [len(e) for e, _ in bags])
    e, w = np.concatenate([e for e, _ in bags]), np.concatenate([w for _, w in bags])
    level = np.concatenate([np.arange(c) for c in w]) if w.max(initial=1) > 1 else np.zeros(len(w), np.int64)
    owner, e = np.repeat(owner, w), mix(np.repeat(e, w) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, column, count = np.unique(e, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    width = 8192
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, min(width, int(column[b - 1]) - at + 1) if b > a else 0), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out


def links(documents: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a < b: links between nodes, with the same components as all pairs of the similarity
    that share a bucket."""
    members = _memberships(nodes)
    sizes = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialise(members.join(small_or_shuffled(materialise(sizes, "near-sizes")), ["band", "bucket"]), "near-members")
    known = None
    one_block = members.where(F.col("size") <= BLOCK).withColumns({"tied": F.lit(False), "n_free": F.lit(1), "n_tied": F.lit(0)})
    if members.where(F.col("size") > BLOCK).isEmpty():
        members = one_block
    else:
        large, known = _tied(documents, members, similarity)
        members = one_block.unionByName(large)
    wanted = materialise(_wanted(members, nodes, similarity), "near-wanted")
    needed = materialise(wanted.select("node").distinct(), "near-needed")
    bags = _bags(documents, small_or_shuffled(needed))
    blocks = _sorted(wanted.join(bags, "node"), ["side", "node", "bands", "e", "w"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 4):
            node = t.column("node").to_numpy()
            if len(node) < 2:
                continue
            side = t.column("side").to_numpy()
            band, i, j = t.column("band")[0].as_py(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
            keys = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.int64).reshape(len(node), BANDS)
            bags = [(np.frombuffer(e, np.uint64), np.frombuffer(w, np.int32).astype(np.int64)) for e, w in zip(t.column("e").to_pylist(), t.column("w").to_pylist(), strict=True)]
            weight = np.array([w.sum() for _, w in bags], np.int64)
            fine = _allowed(keys, weight, band, side, i == j, similarity)
            if not fine.any():
                continue
            if len(node) == 2:
                low = np.zeros((2, 2))
                low[0, 1] = bmh.similarity(*bags)[0]
            else:
                low = overlaps(bags)
            high = weight[:, None] + weight[None, :] - low
            x, y = np.nonzero(fine & (low >= similarity * high - 1e-9))
            forest = Forest(len(node))
            kept = [(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True) if forest.join(p, q)]
            if kept:
                p, q = np.array(kept).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[p], node[q])), pa.array(np.maximum(node[p], node[q]))], names=["a", "b"])

    out = blocks.mapInArrow(work, "a long, b long").where("a < b")
    return (out if known is None else out.unionByName(known)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of the nodes that ``edges`` (a < b)
    name.  Alternating large-star and small-star steps, in a number of rounds that grows
    with the logarithm of a component's size; no node's neighbours meet in one place, the
    smallest of them is an aggregate."""
    e = materialise(edges.select("a", "b").distinct(), "cc")
    n = e.count()
    while n:
        # large star: each node's larger neighbours are tied to its smallest neighbour or itself
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: each node's smaller neighbours, and itself, are tied to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x < y")
        nxt = small.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).distinct()
        nxt = materialise(nxt, "cc")
        # done when every node is tied to one smaller node, and that one to none
        roots = nxt.select("a").distinct().join(nxt.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        twice = nxt.groupBy("b").count().where("count > 1").limit(1).count()
        drop(e)
        e = nxt
        if not roots and not twice:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and keep (whether the row is the
    one of its class that stays) for every row of ``documents``."""
    sketches = materialise(_sketches(documents), "near-sketches")
    known = sketches.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    first = materialise(first, "near-nodes")
    # rows with equal doc_id are one node: the one of the smallest digest stands for them
    nodes = first.groupBy("node").agg(F.min_by("weight", "digest").alias("weight"), F.min_by("bands", "digest").alias("bands"))
    nodes = materialise(nodes, "near-reps")
    found = materialise(components(links(documents, nodes, similarity)), "near-classes")
    node_class = first.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("class_id"))
    node_class = materialise(node_class, "near-node-class")
    own = sketches.select("doc_id", "digest")
    # documents without words have no key that they could meet at
    out = own.where("digest IS NOT NULL").join(node_class, "digest", "left").unionByName(own.where("digest IS NULL").withColumn("class_id", F.lit(None).cast("long")))
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")).withColumn(
        "keep", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True))
    )


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` with one row of each class: that with the smallest doc_id, and of
    rows with equal doc_id in one class any one."""
    columns = documents.columns
    documents = keep_clear(documents, "__n")
    gone = materialise(classes(documents, similarity).where("not keep").select("doc_id").distinct(), "near-gone")
    left = documents.join(small_or_shuffled(gone), "doc_id", "left_anti")
    again = materialise(documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("doc_id"), "near-again")
    n = again.count()
    if not n:
        return original(left, columns)
    again = small_or_shuffled(again, n)
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(c) for c in documents.columns if c != "doc_id"]))
    twice = left.join(again, "doc_id", "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return original(left.join(again, "doc_id", "left_anti").select(*documents.columns).unionByName(twice.select(*documents.columns)), columns)
