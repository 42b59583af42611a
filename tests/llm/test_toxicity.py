import itertools
import os
import random

import numpy as np
import pytest

from pathloom.llm import toxicity

from .fixtures import WORDS, documents, empty


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(5, 60))]
        bad = r.random() < 0.2
        for _ in range(2 * bad):
            words.insert(r.randrange(len(words)), r.choice(["Vile", "snarky", f"grumb{r.choice(['a', 'ow', 'lek'])}"]) + r.choice(["", ",", "."]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 200):
        score, row = rng.normal(size=n) * 2, np.sort(rng.integers(0, 4, n))
        a, start = np.exp(rng.normal(size=(2, 2))), float(np.exp(rng.normal()))
        p = toxicity.marginals(score, row, a, start)[0]
        for doc in np.unique(row):
            at = np.flatnonzero(row == doc)
            if len(at) > 12:
                continue
            total, hit = 0.0, np.zeros(len(at))
            for states in itertools.product((0, 1), repeat=len(at)):
                w = start if states[0] else 1.0
                for k, s in enumerate(states):
                    w *= np.exp(score[at[k]]) if s else 1.0
                    w *= a[states[k - 1], s] if k else 1.0
                total += w
                hit += w * np.array(states)
            assert p[at] == pytest.approx(hit / total, rel=1e-6)


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    new = corpus(300, 2)
    out = toxicity.score(spark.createDataFrame([(i, t, b) for i, t, b in new], "doc_id long, text string, toxic int"), model).collect()
    called = [(r.toxic, r["__score"] >= toxicity.THRESHOLD) for r in out]
    assert np.mean([t == c for t, c in called]) > 0.97
    assert not any(c for t, c in called if not t)
    for r in out:
        for s in r["__spans"]:
            assert r.text.encode()[s.start : s.end].lower().startswith((b"vile", b"snark", b"grumb"))


def test_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (4, 0), (5, 1), (5, 1), (99, 1)], "doc_id long, toxic int")
    for model in (toxicity.learn(docs, labels), toxicity.learn(docs, labels.limit(0)), toxicity.train(["ok fine", "vile"], np.array([False, True]))):
        out = toxicity.score(docs, model)
        assert out.columns == [*docs.columns, "__score", "__spans"]
        got = out.collect()
        assert len(got) == docs.count() and all(0 <= r["__score"] <= 1 for r in got)
        assert toxicity.score(empty(spark), model).count() == 0


def test_a_score_doesn_t_depend_on_what_stands_beside():
    model = toxicity.train([t for _, t, _ in corpus(400, 1)], np.array([b for _, _, b in corpus(400, 1)], bool))
    from pathloom.llm.common import bytes_of, utf8

    def scores(texts):
        import pyarrow as pa

        data, ends = bytes_of(utf8(pa.array(texts)))
        _, _, row, p = model.tag(data, ends)
        return toxicity.curve(toxicity.document_inputs(p, row, len(texts)), model.curve)

    texts = [t for _, t, _ in corpus(20, 5)] + ["", "one"]
    assert scores(texts) == pytest.approx(np.concatenate([scores([t]) for t in texts]))


def test_texts_that_do_not_fit_are_passed_over(spark):
    rows = corpus(900, 1)
    # the ids whose hash comes first, with texts of over the whole bound and of most of it
    first = spark.range(1000, 3000).where("crc32(string(id)) % 3 <> 1").orderBy("id").selectExpr("id", "xxhash64(concat('train', string(id))) AS h").orderBy("h").limit(2).collect()
    rows += [(r.id, "long text " * n, 0) for r, n in zip(first, (60_000, 45_000), strict=True)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, most_bytes=500_000)
    new = spark.createDataFrame(corpus(300, 2), "doc_id long, text string, toxic int")
    assert np.mean([(r["__score"] >= toxicity.THRESHOLD) == r.toxic for r in toxicity.score(new, model).collect()]) > 0.97


def test_the_sample_goes_down_the_hash_order():
    pick = lambda n, toxic, *bounds: toxicity.chosen(np.array(n), np.array(toxic, bool), *bounds).tolist()
    clean = [0] * 400
    assert pick([10] * 400, [*clean[:-1], 1], 300, 1 << 20) == [*range(299), 399]
    assert pick([2000, *[10] * 399], clean, 500, 1000) == list(range(1, 101))
    assert pick([900, *[1] * 399], clean, 500, 1000) == list(range(1, 400))
    assert pick([1] * 400, clean, 400, 1000) == list(range(400))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_recall_on_labelled_documents(spark):
    from pathloom.llm import catalog

    sf = "/root/testdata/sf0.01"
    out = catalog.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in out if r.toxic == 1]
    assert sum(toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in out if r.toxic == 0) <= 0.02 * len(out)


def test_stems_of_different_words_are_tied():
    r = random.Random(7)
    texts, toxic = [], []
    for i in range(240):
        words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(r.randrange(10, 80))]
        bad = i % 12 == 0
        for k in range(3 if bad else r.random() < 0.05):  # toxic texts have several words of the stem, some others have one
            words.insert(r.randrange(len(words)), "zorkel" + "".join(r.choice("mnopq") for _ in range(4)))
        texts.append(" ".join(words))
        toxic.append(bad)
    m = toxicity.train(texts, np.array(toxic))
    data, ends = toxicity.bytes_of(toxicity.utf8(toxicity.pa.array(texts, toxicity.pa.large_string())))
    starts, stops, row, p = m.tag(data, ends)
    called = toxicity.curve(toxicity.document_inputs(p, row, len(texts)), m.curve) >= toxicity.THRESHOLD
    assert (called == np.array(toxic)).mean() > 0.97
    assert all(data[a:z].tobytes().startswith(b"zorkel") for a, z in zip(starts[p > 0.5], stops[p > 0.5], strict=True))
