"""SentencePiece encoding and decoding over a relational lattice (operator 1).

1. Texts are cut into units that no piece of the model crosses (a run of letters, or of
   other characters, with the word marks before it); the model's pieces are held against
   that when it is read, and coarser units are taken if one crosses.
2. The distinct units' substrings of bounded length are exploded and equi-joined to the
   piece table: every match is an edge of the unit's lattice.  The rows stay where the
   units were dealt, so that edges are grouped by unit without another shuffle.
3. The lattice is folded in a higher-order ``aggregate``.  For a unigram model that is
   Viterbi.  A BPE model's scores are merge ranks, not log probabilities, and the path with
   the best sum is not what the model encodes; there the edges are folded in the order of
   their ranks, the state being the set of places at which the unit is still cut, as the
   bits of a number (:func:`fold`).  That gives the ids of the public library.
4. Each text is put together from its units' ids.  The most frequent units,
   ``BROADCAST_UNITS`` at most, are broadcast; the others are joined by unit, and their ids go
   to the slices of texts that ask for them, which stay in their buckets.

Defined results: a null or empty text has no ids; characters outside the model become
byte pieces, or the unknown piece where the model has none; units that the fold does not
cover (longer than ``LONGEST`` characters, with such characters, or with one of the few
pieces that are not made by ever worse merges) are merged one by one, by the same rule;
rows that repeat or share a doc_id are encoded each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bucketed, drop, materialise, numbers_in, release, slices, small_or_shuffled, utf8

MARK = "▁"
#: Characters of a unit up to which it goes through the joined lattice (the places between
#: them are bits of a long).
LONGEST = 61
#: Units whose ids are broadcast, at most (some 60 bytes each).
BROADCAST_UNITS = 700_000
_COUNTED = 500_000
#: Runs of units whose ids a Python worker remembers.
_REMEMBERED = 200_000
#: Bytes of text that are coded at once: Arrow hashes all remembered runs for each slice.
CODED_BYTES = 4 * SLICE_BYTES
#: Characters that begin a substring, from which its possible lengths are looked up.
HEAD = 4
#: Units that pieces may not cross, from fine to coarse.
PATTERNS = (rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}{MARK}]+|{MARK}+", rf"{MARK}*[^{MARK}]+|{MARK}+", r"(?s).+")


@dataclass
class Model:
    """What a model file says, as far as it is needed here."""

    pieces: list[str]
    scores: list[float]
    #: Ids that a text can be cut into.
    normal: list[int]
    byte: dict[int, int]
    unknown: int
    bpe: bool
    prefix: bool
    units: str = ""
    longest: int = 1
    ids: dict[str, int] = field(default_factory=dict)
    #: Places of the pieces by score, the best first, equal scores in one place.
    rank: list[int] = field(default_factory=list)
    #: Pieces of a BPE model that are not made by ever worse merges when they stand alone.
    odd: set[int] = field(default_factory=set)
    #: Made once in a Python worker.
    speller: Speller | None = None

    def __post_init__(self) -> None:
        places = {s: k for k, s in enumerate(sorted(set(self.scores), reverse=True))}
        self.rank = [places[s] for s in self.scores]
        self.ids = {self.pieces[i]: i for i in self.normal}
        self.longest = max((len(self.pieces[i]) for i in self.normal), default=1)
        self.units = next(p for p in PATTERNS if all(regex.fullmatch(p, self.pieces[i]) and len(regex.findall(p, self.pieces[i])) == 1 for i in self.normal))
        if self.bpe:
            self.odd = {i for i in self.normal if not self._steady(i)}

    def _steady(self, i: int) -> bool:
        piece = self.pieces[i]
        ranks: list[int] = []
        if merge(piece, edges_of(piece, self), self, ranks) != [i]:
            return False
        return all(a <= b for a, b in zip(ranks[:-2], ranks[1:-1], strict=True)) and (len(ranks) < 2 or ranks[-2] < ranks[-1])

    @classmethod
    def read(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are")
        return cls(
            pieces=[p.piece for p in m.pieces],
            scores=[p.score for p in m.pieces],
            normal=[i for i, p in enumerate(m.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)],
            byte={int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE},
            unknown=m.trainer_spec.unk_id,
            bpe=m.trainer_spec.model_type == pb.TrainerSpec.BPE,
            prefix=m.normalizer_spec.add_dummy_prefix,
        )

    def normalise(self, text: str) -> str:
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""

    def words(self, text: str) -> tuple[list[str], str]:
        """The text cut at its spaces, where no unit goes on: words that stand for themselves
        with a mark before them, and a normalised run: the first word if it has no mark, and
        all of a text in which marks follow each other."""
        if not text:
            return [], ""
        if self.units == PATTERNS[-1] or MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [], self.normalise(text)
        words = text.split(" ")
        return (words, "") if self.prefix else (words[1:], words[0])

    def spell(self, c: str) -> list[int]:
        """The ids of a character that is no piece."""
        return [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# --- folding a lattice -----------------------------------------------------------


#: Characters up to which :func:`merge` looks through all pairs at every step.
_SHORT = 128


def merge(unit: str, edges: dict[int, int], m: Model, ranks: list[int] | None = None) -> list[int]:
    """BPE: neighbours whose union is an edge are merged, the best score first, the
    leftmost of equals, until no union is an edge.  ``edges``: start * 65536 + end to id for
    short units, for longer ones start << 32 | end (see :func:`edges_of`).  ``ranks`` takes
    the ranks of the merges of a short unit."""
    n = len(unit)
    if n > _SHORT:
        return _merge_long(unit, edges, m)
    rank, get, none = m.rank, edges.get, len(m.pieces)
    cut = list(range(n + 1))  # where the parts start, and the end
    # the rank of the union of each part and the next one
    pairs = [none if (i := get(a << 16 | a + 2)) is None else rank[i] for a in range(n - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        if ranks is not None:
            ranks.append(best)
        k = pairs.index(best)
        del cut[k + 1], pairs[k]
        if k:
            pairs[k - 1] = none if (i := get(cut[k - 1] << 16 | cut[k + 1])) is None else rank[i]
        if k < len(pairs):
            pairs[k] = none if (i := get(cut[k] << 16 | cut[k + 2])) is None else rank[i]
    out = []
    for a, b in zip(cut, cut[1:]):  # noqa: B905
        i = get(a << 16 | b)
        if i is not None:
            out.append(i)
        else:
            out += m.spell(unit[a:b])
    return out


def _merge_long(unit: str, edges: dict[int, int], m: Model) -> list[int]:
    """The same with a heap of candidates, for units of any length."""
    n = len(unit)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n:
            i = edges.get(a << 32 | end[b])
            if i is not None:
                heapq.heappush(heap, (m.rank[i], a, b, end[b]))

    for a in range(n - 1):
        offer(a)
    gone = [False] * (n + 1)
    while heap:
        _, a, b, e = heapq.heappop(heap)
        if gone[a] or gone[b] or after[a] != b or end[b] != e:
            continue
        gone[b], end[a], after[a] = True, e, after[b]
        if after[a] < n:
            before[after[a]] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    out, at = [], 0
    while at < n:
        i = edges.get(at << 32 | end[at])
        if i is not None:
            out.append(i)
        else:
            out += m.spell(unit[at : end[at]])
        at = after[at]
    return out


def edges_of(unit: str, m: Model) -> dict[int, int]:
    """The lattice of one unit, made in place."""
    n, ids = len(unit), m.ids
    shift = 16 if n <= _SHORT else 32
    return {s << shift | e: ids[unit[s:e]] for s in range(n) for e in range(s + 1, min(n, s + m.longest) + 1) if unit[s:e] in ids}


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _inside(x: Column) -> Column:
    """The places strictly inside an edge."""
    return _bit(_end(x)) - F.call_function("shiftleft", F.lit(2).cast("long"), _start(x))


#: An edge of a BPE lattice is a long: whether its piece is odd, rank, start, end and id.
_ODD, _RANK, _START, _END, _ID = 60, 36, 30, 24, (1 << 24) - 1


def _start(x: Column) -> Column:
    return F.shiftright(x, _START).bitwiseAND(63).cast("int")


def _end(x: Column) -> Column:
    return F.shiftright(x, _END).bitwiseAND(63).cast("int")


def fold(units: DataFrame) -> DataFrame:
    """BPE: unit, n, edges to unit, n, ``ids``; null ids where the fold does not cover a unit.

    A piece that is made by ever worse merges when it stands alone can only be made, wherever
    it stands, when its rank is up: while its two ends stay cut, what happens between them is
    what happens there alone.  So the edges are folded by rank, the leftmost of equals first,
    and an edge merges if its ends are cut and one place between them is."""
    ordered = units.select("unit", "n", F.sort_array("edges").alias("edges"), F.length("unit").alias("size"))

    def step(cuts: Column, x: Column) -> Column:
        within = cuts.bitwiseAND(_inside(x))
        fits = (F.getbit(cuts, _start(x)) == 1) & (F.getbit(cuts, _end(x)) == 1) & (F.bit_count(within) == 1)
        return F.when(fits, cuts.bitwiseXOR(within)).otherwise(cuts)

    cut = ordered.withColumn("cuts", F.aggregate("edges", _bit(F.col("size") + 1) - 1, step))
    cuts = F.col("cuts")
    parts = F.filter("edges", lambda x: (F.getbit(cuts, _start(x)) == 1) & (F.getbit(cuts, _end(x)) == 1) & (cuts.bitwiseAND(_inside(x)) == 0))
    placed = cut.select("unit", "n", "size", "edges", F.sort_array(F.transform(parts, lambda x: x.bitwiseAND((1 << _RANK) - 1))).alias("parts"))
    covered = F.aggregate("parts", F.lit(0), lambda a, x: a + _end(x) - _start(x)) == F.col("size")
    ids = F.transform("parts", lambda x: x.bitwiseAND(_ID).cast("int"))
    return placed.select("unit", "n", F.when(covered & (F.element_at("edges", -1) < 1 << _ODD), ids).alias("ids"))


def viterbi(unit: Column, edges: Column, least: float, unknown: int) -> Column:
    """Unigram: the path with the best sum of scores, as one higher-order fold over the
    edges (structs of e, s, id, score) by their ends; a character without an edge of its
    own can be passed as the unknown piece at ``least`` minus 10."""
    state = "struct<score:double,ids:array<int>>"
    none = F.lit(None).cast(state)
    single = F.transform(
        F.filter(F.sequence(F.lit(0), F.length(unit) - 1), lambda i: ~F.exists(edges, lambda x: (x["s"] == i) & (x["e"] == i + 1))),
        lambda i: F.struct((i + 1).alias("e"), i.alias("s"), F.lit(unknown).alias("id"), F.lit(least - 10.0).alias("score")),
    )
    every = F.array_sort(F.concat(edges, single))
    start = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))
    begin = F.transform(F.sequence(F.lit(0), F.length(unit)), lambda i: F.when(i == 0, start).otherwise(none))

    def step(best: Column, x: Column) -> Column:
        came = F.get(best, x["s"])
        score = came["score"] + x["score"]
        made = F.struct(score.alias("score"), F.concat(came["ids"], F.array(x["id"])).alias("ids")).cast(state)
        old = F.get(best, x["e"])
        better = came.isNotNull() & (old.isNull() | (score > old["score"]))
        return F.transform(best, lambda v, i: F.when((i == x["e"]) & better, made).otherwise(v))

    return F.aggregate(every, begin, step, lambda best: F.element_at(best, -1)["ids"])


# --- the lattice of all units ----------------------------------------------------


def count_units(documents: DataFrame, m: Model) -> DataFrame:
    """unit, n of the units of all whole texts (those up to LONGEST characters)."""
    shared = documents.sparkSession.sparkContext.broadcast(m)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        find = regex.compile(m.units).findall
        held: Counter[str] = Counter()  # words that follow a space
        others: Counter[str] = Counter()  # other runs

        def give() -> pa.RecordBatch:
            plain = m.units == PATTERNS[0]
            units: dict[str, int] = {}
            runs = list(others.items())
            for w, k in held.items():
                if plain and w.isalpha():  # a unit as it is
                    if len(w) < LONGEST:
                        units[MARK + w] = k
                else:
                    runs.append((MARK + w, k))
            for run, k in runs:
                for u in find(run):
                    if len(u) <= LONGEST:
                        units[u] = units.get(u, 0) + k
            return pa.RecordBatch.from_arrays([pa.array(list(units), pa.string()), pa.array(list(units.values()), pa.int64())], names=["unit", "n"])

        for b in slices(batches):
            for t in utf8(b.column(0)).to_pylist():
                words, run = m.words(t)
                held.update(words)
                if run:
                    others[run] += 1
            if len(held) + len(others) > _COUNTED:  # counts are sums: a part of them can go on at any time
                yield give()
                held.clear()
                others.clear()
        yield give()

    return documents.select("text").mapInArrow(work, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def head_table(spark: SparkSession, m: Model) -> DataFrame:
    """The lengths of the pieces that begin with ``head``, and all lengths below HEAD."""
    sizes: dict[str, set[int]] = {}
    for i in m.normal:
        if len(m.pieces[i]) >= HEAD:
            sizes.setdefault(m.pieces[i][:HEAD], set()).add(len(m.pieces[i]))
    return spark.createDataFrame([(h, [*range(1, HEAD), *sorted(ls)]) for h, ls in sizes.items()], "head string, ls array<int>")


def piece_table(spark: SparkSession, m: Model) -> DataFrame:
    rows = [(m.pieces[i], i, float(m.scores[i]), m.rank[i] << _RANK | i | (i in m.odd) << _ODD) for i in m.normal]
    return spark.createDataFrame(rows, "piece string, id int, score double, edge long")


#: Units in a partition while their edges are grouped, and the groups that an aggregation
#: holds in memory for that before it sorts (and spills) all edges.
PART_UNITS = 20_000
_IN_MEMORY = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def lattice(units: DataFrame, m: Model) -> DataFrame:
    """unit, n and ``edges`` of every unit: longs for a BPE model, for a unigram
    model structs of e, s, id and score.

    Units are dealt by hash; exploding, the broadcast joins and the grouping all happen where
    they are.  Only substrings as long as a piece with their first HEAD characters are made."""
    size = F.length("unit")
    starts = units.select("unit", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("s")).withColumn("head", F.substr("unit", F.col("s") + 1, F.lit(HEAD)))
    heads = small_or_shuffled(head_table(units.sparkSession, m), len(m.normal))
    some = F.coalesce("ls", F.array(*map(F.lit, range(1, HEAD))))
    spans = starts.join(heads, "head", "left").select("unit", "n", "s", F.explode(some).alias("l")).where(F.col("s") + F.col("l") <= size)
    parts = spans.withColumn("piece", F.substr("unit", F.col("s") + 1, F.col("l")))
    table = small_or_shuffled(piece_table(units.sparkSession, m), len(m.normal))
    # a unit's first character stays even if it is no piece, so that no unit is lost
    found = parts.join(table, "piece", "left").where("id IS NOT NULL OR (s = 0 AND l = 1)")
    end = F.col("s") + F.col("l")
    if m.bpe:
        edge = F.col("edge").bitwiseOR(F.shiftleft(F.col("s").cast("long"), _START)).bitwiseOR(F.shiftleft(end.cast("long"), _END))
    else:
        edge = F.when(F.col("id").isNotNull(), F.struct(end.alias("e"), "s", "id", "score"))
    return found.groupBy("unit").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))


def encode_units(units: DataFrame, m: Model) -> tuple[DataFrame, list[DataFrame]]:
    """unit, n and ``ids`` of every unit of the materialised table ``units``, and the tables
    that they are in."""
    # a session of its own, so that the setting holds for these plans alone
    here = units.sparkSession
    spark = here.newSession()
    spark.conf.set("spark.sql.shuffle.partitions", here.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_IN_MEMORY, str(50 * PART_UNITS))
    mine = spark.read.schema(units.schema).parquet(units._pathloom_path)
    grouped = lattice(mine.repartition(max(2, -(-mine.count() // PART_UNITS)), "unit"), m)
    if m.bpe:
        folded = fold(grouped)
    else:
        ids = viterbi(F.col("unit"), F.col("edges"), min(m.scores[i] for i in m.normal), m.unknown)
        folded = grouped.select("unit", "n", ids.cast("array<int>").alias("ids"))
        if m.byte:
            folded = folded.withColumn("ids", F.when(~F.array_contains("ids", m.unknown), F.col("ids")))
    shared = spark.sparkContext.broadcast(m)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ids = [_in_place(u, m) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["unit", "n", "ids"])

    folded = materialise(folded, "pieces-folded")
    # the units that the fold does not cover
    left = materialise(folded.where("ids IS NULL").select("unit", "n").mapInArrow(work, "unit string, n long, ids array<int>"), "pieces-left")
    out = [here.read.schema(t.schema).parquet(t._pathloom_path) for t in (folded, left)]
    return out[0].where("ids IS NOT NULL").unionByName(out[1]), [folded, left]


def _in_place(unit: str, m: Model) -> list[int]:
    return merge(unit, edges_of(unit, m), m) if m.bpe else _plain_viterbi(unit, m)


def _spelt(unit: str, ids: list[int], m: Model) -> list[int]:
    out, at = [], 0
    for i in ids:
        if i == m.unknown:
            out += m.spell(unit[at])
            at += 1
        else:
            out.append(i)
            at += len(m.pieces[i])
    return out


# --- texts -----------------------------------------------------------------------


def _frequent(known: DataFrame, most: int) -> int:
    """A count above which ``most`` units lie at most, from a histogram of bounded size."""
    kind = F.floor(F.log2("n") * 8).cast("int")
    found = known.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("high")).orderBy(F.desc("kind")).collect()
    total = 0
    for r in found:
        total += r["k"]
        if total > most:
            return r["high"]
    return 0


class _Runs(dict[str, int]):
    """Numbers of runs; ``number_of`` numbers one that is new."""

    def __missing__(self, run: str) -> int:
        return self.number_of(run)


class Coder:
    """Texts as ids, with holes where a unit is not among the ``table``'s.

    All runs' ids lie in one array, ``flat``; those of runs that are not remembered lie behind
    the others until the next slice.  Words are looked up in Arrow, and only those that are not
    remembered, once in a slice, in Python.  A hole is ``HOLE`` plus the number of its unit among
    ``units``, the units that the slice at hand asks for."""

    HOLE = 1 << 31

    def __init__(self, m: Model, table: dict[str, bytes]) -> None:
        self.m, self.table = m, table
        self.find = regex.compile(m.units).findall
        self.seen = pa.array([], pa.large_string())  # the runs that are remembered, by number
        self.flat = np.zeros(0, "<u4")
        self.ends = np.zeros(1, np.int64)  # of each run's ids, after a 0

    def _ids(self, run: str, units: dict[str, int]) -> tuple[bytes, bool]:
        """A run's ids, and whether there is a hole among them."""
        parts, asks = [], False
        for u in self.find(run):
            got = self.table.get(u)
            if got is None:
                if len(u) <= LONGEST:
                    got = (self.HOLE + units.setdefault(u, len(units))).to_bytes(4, "little")
                    asks = True
                else:
                    got = np.array(_in_place(u, self.m), "<u4").tobytes()
            parts.append(got)
        return b"".join(parts), asks

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids, where each text starts in them (and the end), and the units of the holes."""
        m, units = self.m, {}
        words: list[str] = []
        cut = [0]
        whole: dict[int, str] = {}
        for t in texts:
            more, run = m.words(t)
            if run:
                whole[len(words)] = run
                words.append("")
            words += more
            cut.append(len(words))
        # runs with a hole are known for this slice alone, as the numbers of its units are
        table, find, kept = self.table, self._ids, len(self.seen)
        fresh = _Runs()
        plain = m.units == PATTERNS[0]
        names: list[str] = []
        remembered: list[bytes] = []
        local: list[bytes] = []
        room = _REMEMBERED - kept

        def number_of(w: str) -> int:
            got, asks = (table.get(MARK + w), False) if plain and w.isalpha() else (None, False)
            if got is None:
                got, asks = find(MARK + w, units)
            if not asks and len(remembered) < room:
                at = kept + len(remembered)
                names.append(w)
                remembered.append(got)
            else:
                local.append(got)
                at = -len(local)
            fresh[w] = at
            return at

        fresh.number_of = number_of
        number = np.zeros(0, np.int64)
        if words:
            found = pc.index_in(pa.array(words, pa.large_string()), value_set=self.seen)
            number = found.fill_null(-1).to_numpy().astype(np.int64)
            new = np.flatnonzero(number < 0)
            number[new] = np.fromiter(map(fresh.__getitem__, map(words.__getitem__, new.tolist())), np.int64, len(new))
        for at, run in whole.items():
            local.append(find(run, units)[0])
            number[at] = -len(local)
        number[number < 0] = kept + len(remembered) - 1 - number[number < 0]
        new = remembered + local
        used = self.ends[kept]
        self.flat = np.append(self.flat[:used], np.frombuffer(b"".join(new), "<u4"))
        self.ends = np.append(self.ends[: kept + 1], used + np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) // 4))
        if names:
            self.seen = pa.concat_arrays([self.seen, pa.array(names, pa.large_string())])
        start = self.ends[:-1][number]
        sizes = self.ends[1:][number] - start
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)]
        return ids, np.append(0, ends)[cut], list(units)


def encode(documents: DataFrame, path: str | None = None, broadcast_units: int = BROADCAST_UNITS, texts: bool = False) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit integers) of every document; with
    ``texts`` also the ``text`` that they decode to."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    m = Model.read(path or model_path())
    counts = materialise(count_units(documents, m), "pieces-counts")
    release(spark)
    known, tables = encode_units(counts, m)
    drop(counts)
    release(spark)
    above = _frequent(known, broadcast_units)
    top = known.where(F.col("n") > above).select("unit", "ids").toArrow()
    often = sc.broadcast({u: np.array(x, "<u4").tobytes() for u, x in zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)})
    del top
    rest = known.where(F.col("n") <= above).select("unit", "ids")
    shared = sc.broadcast(m)
    narrow = len(m.pieces) < 65535
    wide, hole = ("<u2", 65535) if narrow else ("<u4", (1 << 32) - 1)

    # a task's slices go into one bucket, so that rare units' answers come to them and no text is shuffled
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each slice of texts as ids, how many of them each text has, and the units that its
        holes stand for, each once, with the numbers of those in the order of the holes."""
        coder = Coder(shared.value, often.value)
        pack = zstandard.ZstdCompressor(level=3).compress
        task = TaskContext.get().partitionId()
        rids = numbers_in(task % buckets, buckets, task << 40)
        for b in slices(batches, most=CODED_BYTES):
            ids, cut, units = coder(utf8(b.column(1)).to_pylist())
            at = np.flatnonzero(ids >= Coder.HOLE)
            which = (ids[at] - Coder.HOLE).astype("<i4")
            coded = ids.astype(wide)
            coded[at] = hole
            row = [
                pa.array([next(rids)]),
                pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([np.diff(cut)], pa.list_(pa.int64())),
                pa.array([pack(coded.tobytes())], pa.binary()),
                pa.array([pack(which.tobytes())], pa.binary()),
                pa.array([units], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(row, names=["rid", "doc_ids", "sizes", "coded", "which", "units"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # slices are numbered when they are written, and read with these numbers ever after
    schema = "rid long, doc_ids array<long>, sizes array<long>, coded binary, which binary, units array<string>"
    coded = bucketed(rows.mapInArrow(code, schema), "pieces-coded", buckets, "rid")
    asked = coded.where(F.size("units") > 0).select("rid", F.posexplode("units").alias("k", "unit"))
    answers = materialise(asked.join(rest, "unit").select("rid", "k", "ids"), "pieces-answers")
    for table in tables:
        drop(table)
    release(spark)
    schema = "doc_id long, ids binary" + (", text string" if texts else "")

    def fill(row: pa.Table, got: pa.Table) -> pa.Table:
        """The texts of a slice, and the ids of its rare units in any order."""
        m = shared.value
        spell = m.speller = m.speller or Speller(m)
        unpack = zstandard.ZstdDecompressor().decompress
        ids, which = (np.frombuffer(unpack(row[c][0].as_py()), kind) for c, kind in (("coded", wide), ("which", "<i4")))
        cut = np.append(0, np.cumsum(row["sizes"][0].values.to_numpy(zero_copy_only=False)))
        if len(which):
            if len(got) != which.max() + 1:
                raise ValueError("a rare unit has no ids")
            place = np.argsort(got["k"].to_numpy())[which]
            whole = got["ids"].combine_chunks()
            ends = whole.offsets.to_numpy().astype(np.int64)
            flat, start, size = whole.values.to_numpy().astype(wide), ends[:-1][place], np.diff(ends)[place]
            sizes = np.ones(len(ids), np.int64)
            sizes[ids == hole] = size
            cut = np.append(0, np.cumsum(sizes))[cut]
            ids = np.repeat(ids, sizes)
            # what was repeated in a hole is what is still marked
            ids[ids == hole] = flat[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]
        each = [ids[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        out = {"doc_id": row["doc_ids"][0].values, "ids": pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())}
        if texts:
            out["text"] = pa.array([spell(x) for x in each], pa.string())
        return pa.table(out)

    filled = coded.select("rid", "doc_ids", "sizes", "coded", "which").groupBy("rid").cogroup(answers.repartition(buckets, "rid").groupBy("rid"))
    return filled.applyInArrow(fill, schema)


def _plain_viterbi(unit: str, m: Model) -> list[int]:
    """The unigram path of one long unit, position by position."""
    n, low = len(unit), min(m.scores[i] for i in m.normal) - 10
    best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(-np.inf, 0, -1)] * n
    for e in range(1, n + 1):
        for s in range(max(0, e - m.longest), e):
            i = m.ids.get(unit[s:e])
            if i is None and e - s > 1:
                continue
            score = best[s][0] + (low if i is None else m.scores[i])
            if score > best[e][0]:
                best[e] = (score, s, m.unknown if i is None else i)
    ids, at = [], n
    while at:
        _, at, i = best[at]
        ids.append(i)
    ids.reverse()
    return _spelt(unit, ids, m) if m.byte else ids


class Speller:
    """Texts of ids: pieces joined, byte pieces read as UTF-8, word marks as spaces."""

    def __init__(self, m: Model) -> None:
        self.table = [p.encode().replace(MARK.encode(), b" ") for p in m.pieces]
        for byte, i in m.byte.items():
            self.table[i] = bytes([byte])
        self.table[m.unknown] = " ⁇ ".encode()
        self.start = 1 if m.prefix else 0

    def __call__(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.table.__getitem__, ids.tolist())).replace(MARK.encode(), b" ")
        return (data[self.start :] if data[:1] == b" " else data).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and ``text`` again."""
    shared = encoded.sparkSession.sparkContext.broadcast(Model.read(path or model_path()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Speller(shared.value)
        for b in batches:
            text = [spell(np.frombuffer(ids, "<u4")) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids binary, text string")
