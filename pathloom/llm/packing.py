"""Best-fit packing by a grouping genetic algorithm (operator 3).

Documents are tokenised (ids, then id 0), those longer than ``CAPACITY`` are cut into
pieces, and pieces are packed into sequences of at most ``CAPACITY`` tokens.

Pieces are dealt at random into shards of about ``SHARD`` pieces.  On every shard several
islands evolve a few solutions each.  A crossover injects whole well-filled bins of one
parent into the other, empties the bins that lost a document to them, and puts the
displaced documents back best fit, the longest first.  Between epochs each island's best
solution migrates to the next island.  The best solution of a shard's islands wins; its
bins that stay below ``FULL`` are opened again, and their pieces are dealt into fewer
shards and packed together in the next round.

Defined results: a null or empty text is one piece of one token (id 0); rows that repeat
are packed each; a null doc_id is packed like any other; ties in length are broken by
doc_id, piece and crc; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, utf8

CAPACITY = 2048
SHARD = 8192
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
#: Share of the capacity from which a bin is kept as it is.
FULL = 0.98
ROUNDS = 4
#: Bytes of text encoded at once.
ENCODED = 1 << 20
#: Words, and runs without white space, whose ids a Python worker remembers, at most.
REMEMBERED = 150_000
REMEMBERED_RUNS = 100_000

#: Stands between the ids of two runs; no id has four such bytes.
_APART = b"\xff" * 4

# --- tokens ----------------------------------------------------------------------


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The ids of whole texts, as little-endian unsigned 32-bit integers.

    Normalising and cutting into words never looks across white space, so a text is cut
    into runs without white space, and the ids of a different run are looked up once and remembered.
    A new run goes through the tokenizer's own normaliser, pre-tokenizer and merges; runs of
    printable ASCII, which the same rules cut alike under any version of Unicode, are lowered
    and cut here.  Texts that spell an added token go through the tokenizer whole, as do
    those with separators that are white space to Python but not to the tokenizer."""

    _ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 ]+| ")
    _odd = re.compile("[\x1c-\x1f]")
    _made: dict[str, Encoder] = {}
    _lock = threading.Lock()

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([self._odd.pattern, *map(re.escape, added)]))
        self.words: dict[str, bytes] = {" ": _APART}
        self.runs: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        with cls._lock:
            if path not in cls._made:
                cls._made[path] = cls(path)
            return cls._made[path]

    def _plain(self, runs: str) -> list[str]:
        """The words of runs of printable ASCII with a space between two, spaces included."""
        return self._ascii.findall(runs.lower())

    def _other(self, runs: str) -> list[str]:
        """The same for any runs, in the alphabet of the vocabulary."""
        normal = self.tokenizer.normalizer.normalize_str(runs)
        ends = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), "<u4") == 32).tolist()
        words: list[str] = []
        at = 0
        for word, (start, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            while at < len(ends) and start > ends[at]:
                words.append(" ")
                at += 1
            words.append(word)
        return words + [" "] * (len(ends) - at)

    def _coded(self, words: list[str]) -> list[bytes]:
        """The ids of the runs that spaces part."""
        known, tokenize = self.words, self.tokenizer.model.tokenize
        new = set(words).difference(known)
        for w in new:
            ids = [t.id for t in tokenize(w)]
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        out = b"".join(map(known.__getitem__, words)).split(_APART)
        if len(known) > REMEMBERED:  # what came first is what is frequent: that stays
            for w in new:
                del known[w]
        return out

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(column):
            return []
        whole = pc.match_substring_regex(column, self.odd.pattern).to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(pc.if_else(pa.array(whole), "", column) if whole.any() else column)
        coded = split.flatten().dictionary_encode()
        # the different runs as strings: one string cut at its spaces is made faster than each of them
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        runs = pc.binary_join(every, pa.scalar(" ", coded.dictionary.type))[0].as_py().split(" ")
        known = self.runs
        ids = list(map(known.get, runs))
        plain, others = [], []
        for i, x in enumerate(ids):
            if x is None:
                (plain if runs[i].isascii() and runs[i].isprintable() else others).append(i)
        for at, words in ((plain, self._plain), (others, self._other)):
            if at:
                new = [runs[i] for i in at]
                for i, x in zip(at, self._coded(words(" ".join(new))), strict=True):
                    ids[i] = x
                known.update(zip(new[: max(0, REMEMBERED_RUNS - len(known))], map(ids.__getitem__, at)))
        # every run's ids in their places, from those of the different runs
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        ends = np.cumsum(size[which])
        placed = np.arange(ends[-1]) + np.repeat(first[which] - ends + size[which], size[which])
        flat = np.frombuffer(b"".join(ids), "<u4")[placed]
        cuts = np.append(0, ends)[split.offsets.to_numpy()]
        out = [flat[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(whole):
            out[i] = np.array(self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    path = path or tokenizer_path()
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.at(path)
        for b in slices(batches, most=ENCODED):
            docs, piece, start, length, crc = [], [], [], [], []
            for doc, ids in zip(b.column(0).to_pylist(), encode(utf8(b.column(1))), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    docs.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((docs, piece, start, length, crc), kinds, strict=True)], schema=kinds)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm -------------------------------------------------------


def best_fit(items: np.ndarray, lengths: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put ``items``, the longest first, each into the fullest bin that has room; a new
    bin opens if none has.  ``bins`` (of every item) and ``fill`` are changed in place."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fill):
        room = capacity - f
        if room > 0:
            by_room[room].append(b)
            mask |= 1 << room
    for i in items[np.argsort(-lengths[items], kind="stable")].tolist():
        need = int(lengths[i])
        ahead = mask >> need
        if ahead:
            room = need + (ahead & -ahead).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i] = b
        fill[b] += need
        room -= need
        if room:
            by_room[room].append(b)
            mask |= 1 << room


def fitness(fill: np.ndarray, capacity: int) -> float:
    """Mean square of how full the bins are: few full bins beat many half-full ones."""
    return float(np.mean((fill / capacity) ** 2)) if len(fill) else 1.0


def solution(bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins renumbered without gaps, and how full they are."""
    _, bins = np.unique(bins, return_inverse=True)
    return bins, np.bincount(bins, weights=lengths, minlength=bins.max(initial=-1) + 1).astype(np.int64)


def cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``a`` with well-filled bins of ``b``."""
    a, fill_a = solution(a, lengths)
    b, fill_b = solution(b, lengths)
    good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.5))
    chosen = rng.permutation(good)[: max(1, int(len(fill_b) * rng.uniform(0.1, 0.4)))]
    taken = np.zeros(len(fill_b), bool)
    taken[chosen] = True
    injected = taken[b]
    broken = np.zeros(len(fill_a), bool)
    broken[a[injected]] = True
    # the worst bins are opened as well, so that the displaced documents find other company
    broken[np.argsort(fill_a, kind="stable")[: max(1, len(fill_a) // 20)]] = True
    displaced = np.flatnonzero(broken[a] & ~injected)
    child = np.where(injected, b + len(fill_a), a)
    child[displaced] = -1
    kept = child >= 0
    _, at = np.unique(child[kept], return_inverse=True)
    child[kept] = at
    fill = np.bincount(at, weights=lengths[kept]).astype(np.int64).tolist() if kept.any() else []
    best_fit(displaced, lengths, child, fill, capacity)
    return child


def evolve(lengths: np.ndarray, capacity: int, seed: int, start: list[np.ndarray], generations: int = GENERATIONS) -> np.ndarray:
    """The best solution (the bin of every item) after some generations on an island."""
    rng = np.random.default_rng(seed)
    everything = np.arange(len(lengths))
    people = list(start)
    least = -(-int(lengths.sum()) // capacity)
    while len(people) < POPULATION:
        bins, fill = np.full(len(lengths), -1), []
        order = everything
        if people:  # all but the first individual place a random part of the items first
            first = rng.random(len(lengths)) < rng.uniform(0.05, 0.3)
            best_fit(everything[first], lengths, bins, fill, capacity)
            order = everything[~first]
        best_fit(order, lengths, bins, fill, capacity)
        people.append(bins)
    worth = [fitness(solution(p, lengths)[1], capacity) for p in people]
    for _ in range(generations):
        if min(p.max(initial=-1) + 1 for p in people) <= least:
            break
        i, j = rng.choice(len(people), 2, replace=False)
        child = cross(people[i], people[j], lengths, capacity, rng)
        w = fitness(solution(child, lengths)[1], capacity)
        worst = int(np.argmin(worth))
        if w > worth[worst]:
            people[worst], worth[worst] = child, w
    return people[int(np.argmax(worth))]


# --- islands ---------------------------------------------------------------------

_ORDER = ["length", "doc_id", "piece", "start", "ids_crc32"]


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's pieces in the one order that all its islands use."""
    return frame.sort_values(_ORDER, ascending=[False, True, True, True, True], kind="stable", na_position="first").reset_index(drop=True)


def _islands(dealt: DataFrame, elites: DataFrame | None, epoch: int, capacity: int) -> DataFrame:
    """One epoch on every (shard, island): its best solution, as the bins of the items."""
    items = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), *_ORDER)
    schema = "shard int, island int, worth double, bins binary"

    def give(key: tuple, frame: pd.DataFrame, others: pd.DataFrame | None) -> pd.DataFrame:
        lengths = _ordered(frame)["length"].to_numpy(np.int64)
        start = [np.frombuffer(x, np.int32).astype(np.int64) for x in others["bins"]] if others is not None else []
        best = evolve(lengths, capacity, 7919 * epoch + 104729 * int(key[0]) + int(key[1]), start)
        bins, fill = solution(best, lengths)
        return pd.DataFrame({"shard": [int(key[0])], "island": [int(key[1])], "worth": [fitness(fill, capacity)], "bins": [bins.astype(np.int32).tobytes()]})

    if elites is None:
        return items.groupBy("shard", "island").applyInPandas(lambda key, frame: give(key, frame, None), schema)
    # an island goes on with its own best solution and that of the island before it
    own = elites.select("shard", "island", "bins")
    moved = elites.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), "bins")
    groups = own.unionByName(moved).groupBy("shard", "island")
    return items.groupBy("shard", "island").cogroup(groups).applyInPandas(give, schema)


def _round(items: DataFrame, n: int, number: int, capacity: int, shard: int) -> DataFrame:
    """``items`` with a bin each: sequence_id, offset, and how full the bin is."""
    shards = max(1, -(-n // shard))
    salt = F.xxhash64(F.lit(number), *[F.col(c) for c in _ORDER])
    dealt = items.withColumn("shard", F.pmod(salt, F.lit(shards)).cast("int"))
    elites = None
    for epoch in range(EPOCHS):
        elites = materialise(_islands(dealt, elites, epoch, capacity), f"pack-{number}-{epoch}")
    best = elites.groupBy("shard").agg(F.max_by("bins", F.struct("worth", -F.col("island"))).alias("bins"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"

    def place(key: tuple, frame: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        bins = np.frombuffer(best["bins"].iloc[0], np.int32).astype(np.int64)
        lengths = frame["length"].to_numpy(np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.ones(len(order), bool)
        first[1:] = bins[order][1:] != bins[order][:-1]
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        frame["sequence_id"] = (number << 56) + (int(key[0]) << 24) + bins
        frame["offset"] = offset
        frame["fill"] = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        return frame.drop(columns="shard")[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]]

    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with the sequence and the offset that each is packed at."""
    done = None
    n = items.count()
    for number in range(rounds):
        placed = materialise(_round(items, n, number, capacity, shard), f"pack-{number}")
        last = number == rounds - 1 or n <= shard
        full = placed if last else placed.where(F.col("fill") >= FULL * capacity)
        done = full if done is None else done.unionByName(full)
        if last:
            break
        items = placed.where(F.col("fill") < FULL * capacity).drop("sequence_id", "offset", "fill")
        n = items.count()
        if not n:
            break
    return done.drop("fill")


def pack_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack ``documents``."""
    return pack(materialise(pieces(documents, path), "pack-pieces"))

