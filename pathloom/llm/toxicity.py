"""Toxic spans by a linear-chain conditional random field (operator 9).

Tokens are runs of letters and digits; a token's features are hashes of the word (ASCII
letters in lower case), of its first 4 to 7 bytes and of its last 3 bytes.  Documents are
labelled, tokens are not, so a token of a toxic document is labelled toxic if one of its
features is tied to toxic documents beyond chance (a likelihood ratio over the different
words that have it, against the number of features tested), and not much less than the best
one in the document; in further passes over the toxic documents that are left unexplained
rarer signs stand out.  The field is trained on those labelled tokens.  Forward-backward
marginals give offending spans; a logistic curve over the marginals of a document, fitted
on the same documents, gives its score.

Training takes a bounded sample, the ``TRAIN_DOCS`` labelled documents with the smallest
hash of their doc_id (see :func:`chosen` for long texts and rare labels), so it costs the
same at any size; scoring covers every whole text.
Labels, lang, source and doc_id are no input of a score.

Defined results: a null text becomes empty, an empty one has no tokens and gets the score
of that; labels that are null or whose doc_id is null are not learned from; a document with
several labels is learned from once for each; without labels of both kinds every score is
0; an empty table gives an empty result; other columns are passed through (one that is
named like an added column is called ``NAME_input``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, bytes_of, keep_clear, mix, powers, slices, utf8

#: Labelled documents that the model is trained on, and bytes of their texts, at most.
TRAIN_DOCS = 3000
TRAIN_BYTES = 12 << 20
#: Documents of each label that come first, and the share of the bytes from which a text
#: waits until the shorter ones are in.
EACH_LABEL = 100
LONG = 1 / 32
#: Feature buckets, training rounds and the marginal from which a token offends.
BUCKETS = 1 << 20
ROUNDS = 25
OFFENDS = 0.5
#: Share of its document's strongest tie that a token's tie must have to label it.
RIVAL = 0.4
THRESHOLD = 0.7
#: Log odds against a tie by chance, over the number of features tested, and passes over the
#: documents that no tie explains yet.
CHANCE = 2.0
PASSES = 6
#: Different words of a document that count for a feature at most, the share of all such words
#: that toxic documents must have, and the share of the bar that their mere number must pass.
WORDS = 4
RATE = 0.7
DOCS = 0.4
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_HEADS, _TAIL = (4, 5, 6, 7), 3
_KINDS = len(_HEADS) + 2
_LANE = 64


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the tokens, and the row of each."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = _TOKEN[data]
    first = np.empty(len(data) + 1, bool)
    first[0] = True
    first[1:-1] = ~inside[:-1]
    first[ends] = True
    starts = np.flatnonzero(inside & first[:-1])
    last = np.empty(len(data), bool)
    last[:-1] = ~inside[1:]
    last[-1] = True
    cut = ends[1:-1]
    last[cut[cut > 0] - 1] = True
    return starts, np.flatnonzero(inside & last) + 1, np.searchsorted(ends, starts, "right") - 1


def features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """(tokens, kinds) feature buckets."""
    if not len(starts):
        return np.zeros((0, _KINDS), np.int64)
    up, down = powers(len(data) + 1)
    table = mix(np.arange(1, 257, dtype=_U))[_LOWER]
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(table[data] * up[: len(data)], out=prefix[1:])

    def of(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        h = mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(_U) * _U(0x9E3779B97F4A7C15) + _U(kind))
        return (h & _U(BUCKETS - 1)).astype(np.int64)

    columns = [of(starts, stops, 1)]
    columns += [of(starts, np.minimum(stops, starts + n), 2 + i) for i, n in enumerate(_HEADS)]
    columns.append(of(np.maximum(starts, stops - _TAIL), stops, 99))
    return np.stack(columns, 1)


# --- the chain: ratios of state 1 to state 0 -------------------------------------


def forward(x: np.ndarray, reset: np.ndarray, a: np.ndarray, start: float) -> np.ndarray:
    """Forward ratios.  ``x``: emission ratios, ``a``: the 2 x 2 transitions, ``start``: the
    ratio of a first state; ``reset`` marks first tokens.

    A step is a fractional linear map of the ratio, so runs of 64 tokens are composed side
    by side, their results chained, and the steps inside all runs taken side by side."""
    n = len(x)
    if not n:
        return x
    k = -(-n // _LANE)
    xs, rs = np.ones(k * _LANE), np.zeros(k * _LANE, bool)
    xs[:n], rs[:n] = x, reset
    xs, rs = xs.reshape(k, _LANE).T.copy(), rs.reshape(k, _LANE).T.copy()
    p, q, s, t = np.ones(k), np.zeros(k), np.zeros(k), np.ones(k)
    for j in range(_LANE):
        m11, m12 = np.where(rs[j], 0.0, xs[j] * a[1, 1]), np.where(rs[j], xs[j] * start, xs[j] * a[0, 1])
        m21, m22 = np.where(rs[j], 0.0, a[1, 0]), np.where(rs[j], 1.0, a[0, 0])
        p, q, s, t = m11 * p + m12 * s, m11 * q + m12 * t, m21 * p + m22 * s, m21 * q + m22 * t
        if j % 8 == 7:
            top = np.maximum(np.maximum(p, q), np.maximum(s, t))
            p, q, s, t = p / top, q / top, s / top, t / top
    r, at = start, np.empty(k)
    for i, (p1, q1, s1, t1) in enumerate(zip(p.tolist(), q.tolist(), s.tolist(), t.tolist(), strict=True)):
        at[i] = r
        r = min(max((p1 * r + q1) / (s1 * r + t1), 1e-30), 1e30)
    out = np.empty((k, _LANE))
    r = at
    for j in range(_LANE):
        r = np.where(rs[j], xs[j] * start, xs[j] * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r))
        out[:, j] = r
    return out.ravel()[:n]


def backward(x: np.ndarray, reset: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Backward ratios, by the same scan over the reversed tokens."""
    n = len(x)
    if not n:
        return x
    # u_i = x_i * b_i with b_i = (a10 + a11 u_{i+1}) / (a00 + a01 u_{i+1}), b = 1 at a last token
    last = np.empty(n, bool)
    last[:-1] = reset[1:]
    last[-1] = True
    turned = np.array([[a[0, 0], a[1, 0]], [a[0, 1], a[1, 1]]])
    return forward(x[::-1], last[::-1], turned, 1.0)[::-1] / x


def marginals(score: np.ndarray, row: np.ndarray, a: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probability of state 1 of every token, and the emission, forward and backward ratios."""
    x = np.exp(np.clip(score, -30, 30))
    reset = np.ones(len(x), bool)
    reset[1:] = row[1:] != row[:-1]
    f, b = forward(x, reset, a, start), backward(x, reset, a)
    odds = f * b
    return odds / (1 + odds), x, f, b


@dataclass
class Model:
    """Feature weights, transitions, the first state's ratio, and the document curve."""

    weights: np.ndarray
    transitions: np.ndarray
    start: float
    curve: np.ndarray

    def tag(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, stops, row = tokens(data, ends)
        score = self.weights[features(data, starts, stops)].sum(1, dtype=np.float64) if len(starts) else np.zeros(0)
        return starts, stops, row, marginals(score, row, self.transitions, self.start)[0]


def document_inputs(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(documents, 3): one, the expected number of offending tokens (log), the largest
    marginal (log odds)."""
    most = np.zeros(n)
    np.maximum.at(most, row, p)
    count = np.bincount(row, weights=np.where(p > OFFENDS, p, 0.0), minlength=n)
    most = np.clip(most, 1e-5, 1 - 1e-5)
    return np.stack([np.ones(n), np.log1p(count), np.log(most / (1 - most))], 1)


def curve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


# --- training --------------------------------------------------------------------


def tied_features(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """How much each feature bucket speaks for toxic documents: a log likelihood ratio, 0 for
    those that also occur in others or could be tied by chance, given how many are tested.

    Toxic documents that a tied feature explains are left out of the next pass, in which the
    rarer signs of the others stand out, until a pass ties nothing more."""
    tied = np.zeros(BUCKETS)
    open_ = np.ones(len(toxic), bool)
    for _ in range(PASSES):
        found = _tied(texts, toxic, open_)
        tied = np.maximum(tied, found)
        explained = np.zeros(len(toxic), bool)
        for at, _, row, f in _sliced(texts):
            explained[at + row[found[f].any(1)]] = True
        before = int((open_ & toxic).sum())
        open_ &= ~(explained & toxic)
        left = int((open_ & toxic).sum())
        if left in (0, before):
            break
    return tied


def _tied(texts: list[str], toxic: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """One pass over the documents that are ``open_``."""
    total, hits, docs, bad = (np.zeros(BUCKETS) for _ in range(4))
    for at, _, row, f in _sliced(texts):
        here = open_[at + row]
        row, f = row[here].astype(np.int64), f[here].astype(np.int64)
        # the different words of a document that have a feature: a stem has several
        key = np.unique((row[:, None] << 40 | f << 20 | f[:, :1]).ravel()) >> 20
        key, words = np.unique(key, return_counts=True)
        words = np.minimum(words, WORDS)
        which, y = key & BUCKETS - 1, toxic[at + (key >> 20)].astype(float)
        total += np.bincount(which, words, BUCKETS)
        hits += np.bincount(which, words * y, BUCKETS)
        docs += np.bincount(which, minlength=BUCKETS)
        bad += np.bincount(which, y, BUCKETS)
    share = toxic[open_].mean()

    def speaks(n: np.ndarray, k: np.ndarray) -> np.ndarray:
        rate = k / np.maximum(n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = k * np.log(rate / share) + np.where(n > k, (n - k) * np.log((1 - rate) / (1 - share)), 0.0)
        return np.where(rate > share, np.nan_to_num(gain, nan=0.0, posinf=0.0, neginf=0.0), 0.0)

    # a feature of too few documents can't be tied whatever they are, so it isn't a test: the
    # tests are the features of as many documents as it takes for one among so many tests
    known = np.bincount(docs.astype(np.int64))
    tests = known[::-1].cumsum()[::-1]
    least = next((k for k in range(1, len(tests)) if k * -np.log(share) > np.log(max(2, tests[k])) + CHANCE), len(tests))
    bar = np.log(max(2, tests[least])) + CHANCE if least < len(tests) else np.inf
    gain = speaks(total, hits)
    return np.where((hits > RATE * total) & (gain > bar) & (speaks(docs, bad) > DOCS * bar), gain, 0.0)


def _sliced(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts with about a MB: the numbers of the first one and of the one after the
    last, and row (in the run) and features of the tokens."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_BYTES):
            size += len(texts[to])
            to += 1
        data, ends = bytes_of(utf8(pa.array(texts[at:to], pa.large_string())))
        starts, stops, row = tokens(data, ends)
        yield at, to, row, features(data, starts, stops).astype(np.int32)
        at = to


def train(texts: list[str], toxic: np.ndarray) -> Model | None:
    """Fit the field and the document curve; None without documents of both kinds."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    tied = tied_features(texts, toxic)
    # a token is toxic by the best of its features, unless others of its document are far
    # better: those are words that copies of toxic documents share
    parts, used = [], np.zeros(BUCKETS, bool)
    seen = np.zeros((2, 2))
    for at, to, row, f in _sliced(texts):
        best = tied[f].max(1, initial=0.0)
        top = np.zeros(to - at)
        np.maximum.at(top, row, best)
        y = toxic[at:to][row] & (best > 0) & (best >= RIVAL * top[row])
        used[f.ravel()] = True
        reset = np.ones(len(row), bool)
        reset[1:] = row[1:] != row[:-1]
        prev = np.flatnonzero(~reset)
        np.add.at(seen, (y[prev - 1].astype(int), y[prev].astype(int)), 1)
        parts.append((to - at, row, f, y, reset))
    # buckets in use, numbered anew, so that a round costs by the sample
    used = np.flatnonzero(used)
    number = np.zeros(BUCKETS, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    for _, _, f, _, _ in parts:
        f[:] = number[f]
    w, grad2 = np.zeros(len(used)), np.full(len(used), 1e-3)
    trans, trans2 = np.zeros((2, 2)), np.full((2, 2), 1e-3)
    begin, begin2 = -2.0, 1e-3
    size = max(1, sum(len(row) for _, row, _, _, _ in parts))

    def scores(w: np.ndarray, f: np.ndarray) -> np.ndarray:
        out = w[f[:, 0]]
        for k in range(1, _KINDS):
            out = out + w[f[:, k]]
        return out

    for _ in range(ROUNDS):
        a = np.exp(trans)
        # documents are chains of their own, so a round adds up what each run of them gives
        step, got, first = -0.02 * w, np.zeros((2, 2)), 0.0
        for _, row, f, y, reset in parts:
            p, x, fwd, back = marginals(scores(w, f), row, a, float(np.exp(begin)))
            miss = y - p
            for k in range(_KINDS):
                step += np.bincount(f[:, k], weights=miss, minlength=len(used))
            prev = np.flatnonzero(~reset)
            u = x[prev] * back[prev]
            each = np.stack([a[0, 0] * np.ones(len(prev)), a[0, 1] * u, fwd[prev - 1] * a[1, 0], fwd[prev - 1] * a[1, 1] * u])
            got += (each / each.sum(0)).sum(1).reshape(2, 2)
            first += float(miss[reset].sum())
        grad2 += step**2
        w += 0.5 * step / np.sqrt(grad2)
        t_step = (seen - got) / size * 100 - 0.01 * trans
        trans2 += t_step**2
        trans += 0.2 * t_step / np.sqrt(trans2)
        b_step = first - 0.1 * begin
        begin2 += b_step**2
        begin += 0.2 * b_step / np.sqrt(begin2)
    a = np.exp(trans)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    x = np.concatenate([document_inputs(marginals(scores(w, f), row, a, float(np.exp(begin)))[0], row, n) for n, row, f, _, _ in parts])
    c = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        s = curve(x, c)
        h = (x * (s * (1 - s))[:, None]).T @ x + 1e-1 * np.eye(len(c))
        c += np.clip(np.linalg.solve(h, x.T @ (toxic - s) - 1e-1 * c), -3, 3)
    return Model(weights, a, float(np.exp(begin)), c)


def chosen(n: np.ndarray, toxic: np.ndarray, most: int, most_bytes: int) -> np.ndarray:
    """Which of the labelled texts, of ``n`` bytes in the order of their hash, are trained on:
    the first ones of each label (a quarter of the bytes at most), then any.  A text that does
    not fit is passed over, and one of more than ``LONG`` of the bytes waits for the others."""
    take = np.zeros(len(n), bool)
    order = np.argsort(n > LONG * most_bytes, kind="stable").tolist()
    each = min(EACH_LABEL, most // 2)

    def fill(rows: list[int], docs: int, room: int) -> None:
        for i in rows:
            if docs > 0 and not take[i] and n[i] <= room:
                take[i] = True
                docs, room = docs - 1, room - int(n[i])

    for kind in (False, True):
        fill([i for i in order if toxic[i] == kind], each, most_bytes // 4)
    fill(order, most - int(take.sum()), most_bytes - int(n[take].sum()))
    return np.flatnonzero(take)


def learn(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model | None:
    """Train on the ``most`` labelled documents with the smallest hash among those whose
    crc32(doc_id as text) mod 3 is not 1, as far as they have ``most_bytes`` bytes of text."""
    key = F.col("doc_id").cast("string")
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(key) % 3 != 1)).select(
        "doc_id", (F.col("toxic") == 1).alias("__toxic"), F.xxhash64(F.concat(F.lit("train"), key)).alias("__order")
    )
    text = F.coalesce("text", F.lit("")).alias("text")
    sized = documents.select("doc_id", text).withColumn("__n", F.octet_length("text")).withColumn("__hash", F.xxhash64("text"))
    known = sized.where(F.col("__n") <= most_bytes).drop("text").join(marked, "doc_id")
    by = [F.col("__n") > LONG * most_bytes, "__order", "doc_id", "__n", "__hash"]
    first = [known.where(F.col("__toxic") == kind).orderBy(*by).limit(most) for kind in (False, True)]
    rows = first[0].unionByName(first[1]).toPandas().sort_values(["__order", "doc_id", "__n", "__hash", "__toxic"], kind="stable")
    rows = rows.iloc[chosen(rows["__n"].to_numpy(np.int64), rows["__toxic"].to_numpy(bool), most, most_bytes)]
    if not len(rows):
        return None
    same = ["doc_id", "__n", "__hash"]
    # as an Arrow table: rows of Python would be read by workers of another kind, which stay on the executors
    wanted = pa.Table.from_pandas(rows[same].drop_duplicates(), preserve_index=False)
    wanted = documents.sparkSession.createDataFrame(wanted, known.select(*same).schema)
    # rows with the same doc_id and text are one text here, learned from as often as chosen
    found = sized.join(F.broadcast(wanted), same).dropDuplicates(same).toArrow()
    texts = dict(zip(zip(*[found.column(c).to_pylist() for c in same], strict=True), found.column("text").to_pylist(), strict=True))
    return train([texts[k] for k in zip(*[rows[c].tolist() for c in same], strict=True)], rows["__toxic"].to_numpy(bool))


# --- scoring ---------------------------------------------------------------------


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with ``__score`` and ``__spans`` (start and end in bytes of UTF-8, and
    the marginal, of every offending token)."""
    spark = documents.sparkSession
    documents = keep_clear(documents, "__score", "__spans")
    shared = spark.sparkContext.broadcast(model)  # of fixed size: BUCKETS floats
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*documents.schema.fields, T.StructField("__score", T.DoubleType()), T.StructField("__spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            n = b.num_rows
            if m is None:
                scores, spans = np.zeros(n), pa.array([[]] * n, kind)
            else:
                data, ends = bytes_of(b.column(at))
                starts, stops, row, p = m.tag(data, ends)
                scores = curve(document_inputs(p, row, n), m.curve)
                found = np.flatnonzero(p > OFFENDS)
                inner = pa.StructArray.from_arrays([pa.array(starts[found] - ends[row[found]]), pa.array(stops[found] - ends[row[found]]), pa.array(p[found])], names=["start", "end", "p"])
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[found], minlength=n))]), pa.int32()), inner)
            columns = [c.cast(pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), spans], names=[*b.schema.names, "__score", "__spans"])

    return documents.mapInArrow(work, schema)
