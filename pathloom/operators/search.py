"""Text search and embedding retrieval over documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import snippet
from ..runtime import materialise

#: How far over the wished size a chunk may be before it is cut.
TOLERANCE = 1.2
#: Queries that are broadcast at once, and their bytes (8 a component).
QUERIES = 100_000
QUERY_BYTES = 32 << 20
#: Pairs from which on vectors are dealt anew to all cores.
MANY = 100_000_000
#: Queries and vectors in a product, vectors for the first floors, and candidates scored at once.
ROWS = 256
COLUMNS = 2048
STARTERS = 1024
CANDIDATES = 1_000_000
_HEADER = re.compile(r"(?m)^(?=#{2,4} )")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _packed(parts: list[str], size: int, glue: str) -> list[str]:
    """Parts put together in order, as many as fit."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(glue) + len(p) <= size:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def break_point(text: str, start: int, end: int) -> int:
    """The best place to cut before ``end``: a paragraph's, line's, sentence's or word's end in
    the second half."""
    half = start + (end - start) // 2
    for mark in ("\n\n", "\n", ". ", " "):
        at = text.rfind(mark, half, end)
        if at > start:
            return at + len(mark)
    return end


def chunk(text: str, size: int = 1000) -> list[str]:
    """Chunks of about ``size`` characters: sections by their headers, long ones by paragraphs
    put together, long paragraphs by sentences, long sentences at break points."""
    out = []
    for section in filter(str.strip, _HEADER.split(text)):
        section = section.strip()
        if len(section) <= size * TOLERANCE:
            out.append(section)
            continue
        parts = []
        for p in filter(None, (x.strip() for x in section.split("\n\n"))):
            if len(p) <= size * TOLERANCE:
                parts.append(p)
                continue
            for s in _packed(_SENTENCE.split(p), size, " "):
                at = 0
                while len(s) - at > size * TOLERANCE:
                    to = break_point(s, at, at + size)
                    parts.append(s[at:to].strip())
                    at = to
                parts.append(s[at:].strip())
        out += _packed([p for p in parts if p], size, "\n\n")
    return out


def chunks(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000) -> DataFrame:
    """key, chunk_id, chunk of every document, in Arrow batches."""
    kind = dict(documents.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, texts = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, c in enumerate(chunk(t or "", size)):
                    keys.append(k)
                    ids.append(i)
                    texts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(ids, pa.int32()), pa.array(texts, pa.string())], names=[key, "chunk_id", "chunk"])

    return documents.select(key, text).mapInArrow(work, f"{key} {kind}, chunk_id int, chunk string")


def exact(documents: DataFrame, query: str, most: int | None = None, text: str = "text") -> DataFrame:
    """Documents that contain the query in any case, with a snippet; an error if more than
    ``most`` do."""
    found = documents.where(F.lower(text).contains(query.lower())).withColumn("snippet", snippet(F.col(text), F.lit(query)))
    if most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} documents contain {query!r}")
    return found


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query_id, key, score, rank of the k vectors most like each query; ties go to the smaller
    key.  Scores that are no number come first, those with a null vector (or one that holds
    nulls) last.  Keys are integers; vectors of different lengths are an error.

    Queries are broadcast, in blocks of about ``QUERY_BYTES`` by their key, and every task holds
    its vectors against all of a block (:func:`nearest_block`)."""
    spark = vectors.sparkSession
    vectors, queries = (df.select(F.col(key).cast("long").alias(key), "embedding") for df in (vectors, queries))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("embedding"), F.lit(0)).cast("long")).alias("x")).first()
    blocks = max(1, -(-int(size.x or 0) * 8 // QUERY_BYTES), -(-size.n // QUERIES))
    if size.n and vectors.count() * size.n >= MANY:
        vectors = materialise(vectors.repartition(4 * spark.sparkContext.defaultParallelism), "vectors")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    out = None
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else queries
        found = _nearest(vectors, asked.toArrow(), k, key)
        part = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        part = part if blocks == 1 else materialise(part, "nearest")
        out = part if out is None else out.unionByName(part)
    return out


def _nearest(vectors: DataFrame, queries: pa.Table, k: int, key: str) -> DataFrame:
    """The k best of each query in every task."""
    sent = vectors.sparkSession.sparkContext.broadcast(_arrays(queries.column(0), queries.column(1)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, q_null = sent.value
        best = Nearest(q_ids, q, q_null, k)
        for b in batches:
            best.add(*_arrays(b.column(0), b.column(1)))
        for rows, ids, score in best.result():
            nulls = np.isneginf(score)
            values = pa.array(np.where(np.isposinf(score), np.nan, score), mask=nulls)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(ids), values], names=["query_id", key, "score"])

    return vectors.mapInArrow(work, f"query_id long, {key} long, score double")


def _arrays(ids: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, vectors (null ones as zeros) as a matrix, and which are null or hold nulls."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n, sizes = len(lists), pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    dim = sorted(set(sizes[sizes >= 0].tolist()))
    if len(dim) > 1:
        raise ValueError(f"vectors of different lengths: {dim[:5]}")
    null = sizes < 0
    m = np.zeros((n, dim[0] if dim else 0), np.float32 if flat.type == pa.float32() else np.float64)
    whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, m.shape[1]) if flat.null_count else None
    if m.shape[1]:
        m[~null] = (pc.fill_null(flat, 0.0) if flat.null_count else flat).to_numpy(zero_copy_only=False).reshape(-1, m.shape[1])
    if whole is not None:
        null[~null] = ~whole.all(1)
    return np.asarray(ids.to_numpy()), m, null


class Nearest:
    """The k best of each query among vectors that come in batches.

    Products of unit vectors in single precision leave a few candidates: what lies below a
    query's k-th best score by more than their rounding can reach cannot be among its k best.
    Candidates are scored in double precision in the order of the components, as :func:`cosine`
    does.  Of equal vectors in a batch only the k + 1 smallest keys matter (one may be the
    query's own).  A score that is no number is held as infinity, that of a null as minus
    infinity."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, null: np.ndarray, k: int) -> None:
        self.ids, self.k, self.null = ids, k, null
        self.norm = _norms(q)
        self.fine = ~null & (self.norm > 0) & np.isfinite(self.norm)
        self.at = np.flatnonzero(self.fine)
        self.unit = (q[self.at] / self.norm[self.at, None]).astype(np.float32)
        self.columns = np.ascontiguousarray(q.T)
        #: twice the rounding of a product in single precision
        self.slack = 4 * (q.shape[1] + 4) * 2.0**-24
        self.floor = np.full(len(ids), -np.inf)
        self.rows, self.keys, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.begun = False
        #: the smallest keys of vectors that are null, no direction, and of all that are not null
        self.nulls, self.odd, self.some = (np.empty(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, v: np.ndarray, null: np.ndarray) -> None:
        k = self.k
        norm = _norms(v)
        fine = ~null & (norm > 0) & np.isfinite(norm)

        def least(known: np.ndarray, more: np.ndarray) -> np.ndarray:
            return np.sort(np.concatenate([known, more]))[: k + 1]

        self.nulls, self.odd, self.some = least(self.nulls, ids[null]), least(self.odd, ids[~null & ~fine]), least(self.some, ids[~null])
        ids, v, norm = ids[fine], v[fine], norm[fine]
        if not len(self.at) or not len(ids):
            return
        if v.shape[1] != len(self.columns):
            raise ValueError(f"vectors of different lengths: {v.shape[1]}, {len(self.columns)}")
        kinds, kind = np.unique(np.ascontiguousarray(v).view(f"V{v.shape[1] * v.itemsize}").ravel(), return_inverse=True)
        if len(kinds) < len(ids):
            order = np.lexsort((ids, kind))
            keep = order[np.arange(len(ids)) - np.searchsorted(kind[order], kind[order]) <= k]
            ids, v, norm = ids[keep], v[keep], norm[keep]
        unit, columns = (v / norm[:, None]).astype(np.float32), np.ascontiguousarray(v.T)
        if not self.begun:
            self.begun = True
            first = unit[:STARTERS]
            if len(first) > k:
                for a in range(0, len(self.at), ROWS):
                    s = self.unit[a : a + ROWS] @ first.T
                    self.floor[self.at[a : a + ROWS]] = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)]
        rows, cols, held = [], [], 0
        for a in range(0, len(self.at), ROWS):
            asked, at = self.unit[a : a + ROWS], self.at[a : a + ROWS]
            for b in range(0, len(ids), COLUMNS):
                s = asked @ unit[b : b + COLUMNS].T
                low = (self.floor[at] - self.slack).astype(np.float32)
                hit = np.flatnonzero(s.max(1) >= low)
                if len(hit):
                    r, c = np.nonzero(s[hit] >= low[hit, None])
                    rows.append(at[hit[r]])
                    cols.append(c + b)
                    held += len(r)
                    if held >= CANDIDATES:
                        self._merge(np.concatenate(rows), np.concatenate(cols), ids, norm, columns)
                        rows, cols, held = [], [], 0
        if rows:
            self._merge(np.concatenate(rows), np.concatenate(cols), ids, norm, columns)

    def _merge(self, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, norm: np.ndarray, columns: np.ndarray) -> None:
        keep = self.ids[rows] != ids[cols]
        rows, cols = rows[keep], cols[keep]
        dot = np.zeros(len(rows))
        for q, v in zip(self.columns, columns, strict=True):
            dot += q[rows].astype(np.float64) * v[cols]
        score = dot / (norm[cols] * self.norm[rows])
        self.rows, self.keys, self.score = self._best(np.concatenate([self.rows, rows]), np.concatenate([self.keys, ids[cols]]), np.concatenate([self.score, score]))
        last = np.flatnonzero(np.arange(len(self.rows)) - np.searchsorted(self.rows, self.rows) == self.k - 1)
        self.floor[self.rows[last]] = np.maximum(self.floor[self.rows[last]], self.score[last])

    def _best(self, rows: np.ndarray, keys: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((keys, -score, rows))
        rows, keys, score = rows[order], keys[order], score[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        return rows[top], keys[top], score[top]

    def result(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Position of the query, key and score, in parts."""
        odd = ~self.null & ~self.fine
        found = [(self.rows, self.keys, self.score)]
        for queries, keys, score in ((self.fine, self.odd, np.inf), (odd, self.some, np.inf), (~self.null, self.nulls, -np.inf), (self.null, np.sort(np.concatenate([self.some, self.nulls]))[: self.k + 1], -np.inf)):
            rows, at = np.repeat(np.flatnonzero(queries), len(keys)), np.tile(keys, int(queries.sum()))
            own = self.ids[rows] == at
            found.append((rows[~own], at[~own], np.full(int((~own).sum()), score)))
        rows, keys, score = self._best(*(np.concatenate(x) for x in zip(*found, strict=True)))
        for a in range(0, len(rows), 100_000):
            yield rows[a : a + 100_000], keys[a : a + 100_000], score[a : a + 100_000]


def _norms(v: np.ndarray) -> np.ndarray:
    """Lengths, the squares added in the order of the components."""
    out = np.zeros(len(v))
    for c in v.T:
        x = c.astype(np.float64)
        out += x * x
    return np.sqrt(out)


def index(documents: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, component: str, size: int = 1000) -> None:
    """Chunk a component's documents, embed the chunks (``embed`` adds ``embedding``) and write
    them as the component's partition, in place of what it had before."""
    rows = embed(chunks(documents, size=size)).withColumn("component", F.lit(component))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("component").parquet(path)


def search_index(spark: SparkSession, path: str, query: list[float], k: int = 5, component: str | None = None) -> DataFrame:
    """The k chunks of one component, or of all, most like a query vector."""
    rows = spark.read.parquet(path)
    if component:
        rows = rows.where(F.col("component") == component)
    return rows.withColumn("score", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))).orderBy(F.desc("score"), "doc_id", "chunk_id").limit(k)


def notebook_text(notebooks: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """Notebook files (JSON) as markdown: text cells as they are, code cells fenced."""
    schema = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
    cells = notebooks.select(key, F.from_json(column, schema).alias("x")).select(
        key,
        F.array_join(
            F.transform(
                F.filter("x.cells", lambda c: c["cell_type"].isin("markdown", "code")),
                lambda c: F.when(c["cell_type"] == "code", F.concat(F.lit("```python\n"), F.array_join(c["source"], ""), F.lit("\n```"))).otherwise(F.array_join(c["source"], "")),
            ),
            "\n\n",
        ).alias("text"),
    )
    return cells
