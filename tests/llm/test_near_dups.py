import collections
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import bagminhash as bmh
from pathloom.llm import near_dups
from pathloom.llm.common import bytes_of, utf8

from .fixtures import documents, empty, prose


def bag(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(rows, least=0.8):
    """Classes of (id, text) rows by all pairs."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [(i, bag(t)) for i, t in rows]
    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if a and b and sum((a & b).values()) >= least * sum((a | b).values()):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(9999)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [4, 256])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    base = prose(100, 300)
    data = [(i, edited(base, 1 + i % 8, i)) for i in range(40)]  # a chain of copies, many below 0.8 to each other
    data += [(50 + i, prose(200 + i, 60)) for i in range(20)]
    data += [(90, "a b c"), (91, "a  b\nc"), (92, "a b"), (93, ""), (94, None), (95, "z " * 50), (96, "z " * 52), (97, "z " * 30)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dups.classes(df).collect()}
    assert got == brute(data)


def test_a_large_group_costs_no_pairs(spark, monkeypatch):
    """Near copies of one text in buckets of several blocks: no two of them are dealt to a
    pair of blocks, and the class is whole."""
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    base = prose(300, 120)
    data = [(i, edited(base, 1, i)) for i in range(150)] + [(500 + i, prose(600 + i, 40)) for i in range(5)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    dealt = []
    blocks = near_dups._blocks

    def counted(members):
        out = blocks(members)
        dealt.append(out.where("size > 16").count())
        return out

    monkeypatch.setattr(near_dups, "_blocks", counted)
    got = {r.doc_id: r.class_id for r in near_dups.classes(df).collect()}
    assert got == {i: 0 for i in range(150)} | {i: i for i, _ in data[150:]}
    assert dealt and dealt[0] == 0


def test_nodes_that_are_not_tied_meet_those_that_are(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    base = prose(400, 200)
    chain, text = [], base
    for i in range(30):  # each close to the one before, the last ones far from the first
        text = edited(text, 2, i)
        chain.append((i, text))
    df = spark.createDataFrame(chain, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in near_dups.classes(df).collect()} == brute(chain)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_recall_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    bags = {i: bag(t) for i, t in data}
    by = collections.defaultdict(list)
    for i, b in bags.items():
        for x in b or ():
            by[x].append(i)
    pairs = {(i, j) for rows in by.values() for k, i in enumerate(rows) for j in rows[:k]}
    similar = [(i, j) for i, j in pairs if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())]
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert len(similar) > 50 and np.mean([got[i] == got[j] for i, j in similar]) >= 0.99
    # no class without a link: every one hangs together by similar pairs
    want = brute_links(similar, got)
    assert all(want[i] == want[c] for i, c in got.items())


def brute_links(pairs, nodes):
    up = {i: i for i in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        x, y = root(i), root(j)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def test_one_of_each_class_stays(spark):
    df = documents(spark)
    kept = near_dups.keep_one(df).collect()
    assert near_dups.keep_one(df).columns == df.columns
    ids = collections.Counter(r.doc_id for r in kept)
    assert ids[4] == 1 and ids[5] == 0 and ids[6] == 0  # equal, equal, one word changed
    assert ids[None] == 2 and all(ids[i] == 1 for i in (0, 1, 2, 3, 7, 8, 9))


def test_empty_table(spark):
    assert near_dups.classes(empty(spark)).count() == 0
    assert near_dups.keep_one(empty(spark)).count() == 0


def test_signatures_estimate_the_weighted_similarity():
    a = [f"w{i}" for i in range(60) for _ in range(1 + i % 9)]
    b = [f"w{i}" for i in range(20, 75) for _ in range(1 + (i * 7) % 11)]
    ca, cb = collections.Counter(a), collections.Counter(b)
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    m = 4096
    element = np.array([hash_of(w) for c in (ca, cb) for w in c], np.uint64)
    row = np.array([k for k, c in enumerate((ca, cb)) for _ in c])
    sig = bmh.signatures(element, row, np.array([n for c in (ca, cb) for n in c.values()]), 2, m)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=4 * (want * (1 - want) / m) ** 0.5)


def hash_of(word):
    from pathloom.llm.common import prefix_hash, span_hash

    data, ends = bytes_of(utf8(pa.array([word])))
    return span_hash(prefix_hash(data, 7), ends[:1], ends[1:])[0]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.root for r in near_dups.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(got) == {*range(51), *range(100, 140)}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 140))
