import itertools
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pathloom.llm import common, pieces

from .fixtures import documents, empty, texts


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.mark.parametrize("often", [0, 3, 100000])
def test_ids_are_those_of_the_library(spark, processor, often):
    got = pieces.encode(documents(spark), broadcast_units=often).collect()
    have = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got if r.doc_id is not None)
    want = sorted((i, processor.encode(t or "")) for i, t in [*enumerate(texts()), (4, texts()[4])])
    assert have == want
    assert sum(r.doc_id is None for r in got) == 2


def test_decoding_gives_the_text_back(spark, processor):
    encoded = pieces.encode(documents(spark))
    spell = pieces.Speller(pieces.Model.read(pieces.model_path()))
    for r in pieces.decode(encoded).where("doc_id is not null").collect():
        want = (texts()[r.doc_id] or "").replace("▁", " ")
        assert r.text == want
        assert spell(np.array(processor.encode(texts()[r.doc_id] or ""), np.int64)) == want


def test_empty_table(spark):
    assert pieces.decode(pieces.encode(empty(spark))).count() == 0


def test_the_fold_is_the_merging(spark):
    """Units of pieces, of parts of pieces and of noise, against merging one by one."""
    m = pieces.Model.read(pieces.model_path())
    assert 0 < len(m.odd) < 50
    r = random.Random(4)
    some = [m.pieces[i] for i in m.normal]
    units = {"".join(r.choice(some)[: r.randrange(1, 9)] for _ in range(r.randrange(1, 5)))[:61] for _ in range(4000)}
    units |= {m.pieces[i] + x for i in m.odd for x in ("", "a", "e", " ")} | {"a" * n for n in (1, 2, 3, 7, 60, 61)} | {"日本", "x日", "é" * 61, "0" * 61}
    units = {u.replace(" ", "▁") for u in units}
    df = pieces.materialise(spark.createDataFrame([(u, 1) for u in units], "unit string, n long"), "test-units")
    got = {x.unit: x.ids for x in pieces.encode_units(df, m)[0].collect()}
    assert got == {u: pieces.merge(u, pieces.edges_of(u, m), m) for u in units}
    folded = pieces.fold(pieces.lattice(df, m)).where("ids is null").count()
    assert folded < len(units) / 4


def test_texts_beside_ids(spark, processor):
    for r in pieces.encode(documents(spark), broadcast_units=5, texts=True).where("doc_id is not null").collect():
        assert r.text == (texts()[r.doc_id] or "").replace("▁", " ")


def test_long_units_and_many_rare_ones(spark, processor, monkeypatch):
    monkeypatch.setattr(pieces, "_REMEMBERED", 7)
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdeé日 ") for _ in range(n))
    data = [(i, word(r.randrange(0, 200)) + "y" * r.choice([0, 61, 62, 63, 400]) + " " + word(30)) for i in range(60)]
    for often in (0, 20):
        got = pieces.encode(spark.createDataFrame(data, "doc_id long, text string"), broadcast_units=often).collect()
        assert {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in got} == {i: processor.encode(t) for i, t in data}


def test_rare_units_come_to_texts_that_stay(spark, processor):
    """Texts are not shuffled to meet their rare units' ids (F1); more tasks than buckets, and several slices in a task."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé日7") for _ in range(r.randrange(1, 12)))
    data = [(i, " ".join(word() for _ in range(r.choice([0, 3, 40_000])))) for i in range(30)]
    got = pieces.encode(spark.createDataFrame(data, "doc_id long, text string").repartition(9), broadcast_units=5, texts=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Bucketed: true") < plan.index("Exchange")
    assert sorted((x.doc_id, np.frombuffer(x.ids, "<u4").tolist(), x.text) for x in got.collect()) == [(i, processor.encode(t), t) for i, t in data]
    some = [*range(-300, 300), 5 << 40, -(5 << 40) + 3, 2**63 - 1, -(2**63)]
    assert [r.h for r in spark.createDataFrame([(i,) for i in some], "i long").select(F.hash("i").alias("h")).collect()] == common.spark_hash(some).tolist()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pathloom")]


def test_viterbi_is_the_best_path(spark):
    table = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -2.0, "aba": -4.5, "bab": -9.0, "aa": -3.2}
    rows = [(u, [(s + n, s, k, table[u[s : s + n]]) for s in range(len(u)) for n in (1, 2, 3) for k, p in enumerate(table) if u[s : s + n] == p and s + n <= len(u)]) for n in range(1, 7) for u in map("".join, itertools.product("abc", repeat=n))]
    df = spark.createDataFrame(rows, "unit string, edges array<struct<e:int,s:int,id:int,score:double>>")
    out = df.select("unit", pieces.viterbi(F.col("unit"), F.col("edges"), -9.0, 99).alias("ids"))
    score, length = dict(enumerate(table.values())) | {99: -19.0}, dict(enumerate(map(len, table))) | {99: 1}

    def best(u):
        table_ids = {p: k for k, p in enumerate(table)}
        paths = [(0.0, 0, [])]
        top = {0: 0.0}
        for e in range(1, len(u) + 1):
            options = [top[s] + (score[table_ids[u[s:e]]] if u[s:e] in table_ids else -19.0) for s in range(e) if u[s:e] in table_ids or (e - s == 1 and u[s:e] not in table_ids)]
            top[e] = max(options)
        return top[len(u)], paths

    for r in out.collect():
        assert sum(length[i] for i in r.ids) == len(r.unit)
        assert sum(score[i] for i in r.ids) == pytest.approx(best(r.unit)[0])


def test_lattice_makes_only_substrings_that_a_piece_can_be(spark):
    """The edges are those of all substrings; a head gives the lengths of its pieces alone."""
    m = pieces.Model.read(pieces.model_path())
    heads = {r.head: r.ls for r in pieces.head_table(spark, m).collect()}
    want = {}
    for i in m.normal:
        if len(m.pieces[i]) >= pieces.HEAD:
            want.setdefault(m.pieces[i][: pieces.HEAD], {*range(1, pieces.HEAD)}).add(len(m.pieces[i]))
    assert heads == {h: sorted(ls) for h, ls in want.items()}
    units = ["▁", "a", "▁the", "▁international", "qzxj", "▁łódź", "日本", "▁" + "tion" * 15]
    got = pieces.lattice(spark.createDataFrame([(u, 1) for u in units], "unit string, n long"), m).collect()
    low = (1 << 24) - 1
    edges = {r.unit: sorted((x >> 30 & 63, x >> 24 & 63, x & low) for x in r.edges) for r in got}
    assert edges == {u: sorted((s, e, m.ids[u[s:e]]) for s in range(len(u)) for e in range(s + 1, len(u) + 1) if u[s:e] in m.ids) for u in units}
