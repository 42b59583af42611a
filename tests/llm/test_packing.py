import sys
import zlib

import numpy as np
from tokenizers import Tokenizer

from pathloom.llm import packing

from .fixtures import documents, empty, texts


def check(rows, capacity):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_the_tokenizer_s(spark):
    t = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(documents(spark)).collect()
    assert check(got, packing.CAPACITY) == -(-sum(r.length for r in got) // packing.CAPACITY)
    for i, text in enumerate(texts()):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        have = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i})
        assert have == want
    assert sum(r.doc_id == 4 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2


def test_empty_table(spark):
    assert packing.pack_documents(empty(spark)).count() == 0


def test_many_shards_and_rounds(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), 0, 0, int(n), 0) for i, n in enumerate(np.clip(r.lognormal(4, 1, 3000), 1, 400).astype(int))]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items, capacity=400, shard=300).collect()
    assert sorted(x.doc_id for x in got) == list(range(3000))
    total = sum(x.length for x in got)
    assert check(got, 400) <= 1.02 * total / 400 + 3


def test_crossover_keeps_every_document():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 90, 400)
    a, b = (packing.evolve(lengths, 100, s, [], 0) for s in (1, 2))
    child = packing.cross(a, b, lengths, 100, r)
    assert len(child) == 400 and child.min() >= 0
    assert packing.solution(child, lengths)[1].max() <= 100
    best = packing.evolve(lengths, 100, 3, [a, b], 30)
    worth = lambda x: packing.fitness(packing.solution(x, lengths)[1], 100)
    assert worth(best) >= max(worth(a), worth(b))


def test_words_beyond_the_memory_are_encoded_all_the_same(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    monkeypatch.setattr(packing, "REMEMBERED_RUNS", 5)
    e = packing.Encoder(packing.tokenizer_path())
    t = Tokenizer.from_file(packing.tokenizer_path())
    for text in texts():
        assert np.frombuffer(e([text or ""])[0], "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_plain_library_s():
    t = Tokenizer.from_file(packing.tokenizer_path())
    e = packing.Encoder(packing.tokenizer_path())
    odd = [
        "hi <|endoftext|> there <|startoftext|>x",
        "a\x00b \x01\x02 c\x7f",
        "tab\tnew\nline\x0b\x0c\r end\x85next\u2028x\u3000y\xa0z",
        "ΟΔΟΣ ΣΑΣ. Σ' İI ǅ ﬁ ß ẞ",
        "e\u0301 \u0301x A\u030a \u212b \u1100\u1161",
        "it's IT'S we'll '' 'S' x'd ١٢ ½ ² 1234",
        "😀👩‍👩‍👧 \u200d \u200b zero\u200bwidth \ufeff",
        "\u2000a\u2001b\u180ec",
        "",
        " ",
    ]
    got = e(odd)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_evolving_beats_best_fit_alone():
    r = np.random.default_rng(0)
    r.integers(10, 60, 300)
    # triplets that fill a bin each: best fit alone misses many of them
    a = r.integers(25, 45, 100)
    b = np.array([r.integers(20, 100 - x - 20 + 1) for x in a])
    lengths = np.concatenate([a, b, 100 - a - b])
    bins, fill = np.full(len(lengths), -1), []
    packing.best_fit(np.arange(len(lengths)), lengths, bins, fill, 100)
    evolved = packing.evolve(lengths, 100, 0, [], 400)
    worth = lambda x: packing.fitness(packing.solution(x, lengths)[1], 100)
    assert worth(evolved) > worth(bins)
    assert packing.solution(evolved, lengths)[0].max() + 1 < len(fill)


def test_what_an_encoder_remembers_is_small():
    e = packing.Encoder(packing.tokenizer_path())
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    name = lambda n: "".join(letters[n // 26**k % 26] for k in range(5))
    for at in range(0, 300_000, 20_000):
        e([" ".join(f"{name(7919 * n)}," for n in range(at, at + 20_000))])
    assert len(e.runs) >= 50_000
    size = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (e.words, e.runs))
    assert size < 48 << 20
