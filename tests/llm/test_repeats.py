import collections
import hashlib
import random

import numpy as np
import pytest

from pathloom.llm import bwt, repeats

from .fixtures import documents, empty, prose, texts


def brute(data, n=400, words=0):
    """kept bytes and number of spans of every text."""
    count = collections.Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = 0
        for low, high in zip(turns[::2], turns[1::2], strict=True):
            if len(b[low:high].split()) < words:
                gone[low:high] = False
            else:
                spans += 1
        out.append((bytes(np.frombuffer(b, np.uint8)[~gone]), spans))
    return out


def same(df, group=repeats.GROUP, length=400, words=0):
    source = [r.text for r in df.collect()]
    want = sorted((len((t or "").encode()), spans, hashlib.sha256(kept).hexdigest()) for t, (kept, spans) in zip(source, brute([(t or "").encode() for t in source], length, words), strict=True))
    got = repeats.remove_repeats(df, group, length, words).collect()
    assert sorted((r["__n_bytes"], r["__n_spans"], hashlib.sha256(r["__kept"]).hexdigest()) for r in got) == want


def test_cases(spark):
    same(documents(spark))
    assert len(texts()) > 10


@pytest.mark.parametrize("group", [2, 8000])
def test_shared_passages_in_changing_company(spark, group):
    r = random.Random(3)
    passages = [prose(300 + i, 120) for i in range(4)]
    data = []
    for i in range(30):
        p = r.choice(passages)
        a, b = sorted(r.sample(range(len(p)), 2))
        cut = p[a : max(b, a + 410)] if r.random() < 0.6 else p
        data.append((i, prose(i, r.randrange(1, 30)) + cut + "é" * r.randrange(3) + prose(50 + i, r.randrange(1, 30))))
    data += [(90, "ab" * 700), (91, "x" + "ab" * 250), (92, prose(9, 100)[:399]), (93, prose(9, 100)[:399]), (94, prose(10, 100)[:400]), (95, prose(10, 100)[:400])]
    same(spark.createDataFrame(data, "doc_id long, text string").repartition(3), group)


def test_passages_of_many_words(spark):
    short, long, tail = prose(40, 45), prose(41, 51), prose(42, 80)
    data = [(i, prose(100 + i, 12) + " " + p + " " + prose(200 + i, 12)) for i, p in enumerate([short, long, long, short, tail, tail, prose(43, 60)])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    same(df, length=150, words=51)
    got = {r.doc_id: r["__n_spans"] for r in repeats.remove_repeats(df, length=150, words=51).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 6: 0}
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, length=100)


def test_a_merge_of_few_strings_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MERGED", 3)
    passage = prose(50, 90)
    data = [(i, prose(i, 9) + passage[i % 7 * 20 : 600 - i % 5 * 30] + prose(70 + i, 9)) for i in range(24)]
    same(spark.createDataFrame(data, "doc_id long, text string").repartition(2))


def test_empty_table(spark):
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_merged_transforms():
    rng = np.random.default_rng(0)
    for _ in range(60):
        shards, strings = [], []
        for z in range(rng.integers(1, 4)):
            parts = [rng.integers(1, 3, rng.integers(0, 12)).tolist() for _ in range(rng.integers(1, 7))]
            at = 0
            for s in parts:
                strings.append((z, at, s))
                at += len(s) + 1
            shards.append(np.array([x for s in parts for x in [*s, 0]], np.uint16))
        for depth in (1, 2, 4):
            count = collections.Counter(tuple(s[i : i + depth]) for _, _, s in strings for i in range(len(s) - depth + 1))
            want = [np.zeros(len(s), bool) for s in shards]
            for z, at, s in strings:
                for i in range(len(s) - depth + 1):
                    want[z][at + i] = count[tuple(s[i : i + depth])] > 1
            for a, b in zip(want, bwt.repeats(shards, depth), strict=True):
                assert (a == b).all()
