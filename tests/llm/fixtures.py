"""Small tables with the cases that every operator has to handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __n_spans long, rid long, unit string, digest string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions in tall towers near cold rivers".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def texts():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(2, 90)
    return [
        "",
        None,
        "   \n\t ",
        "one two",
        base,
        base,
        " ".join(near),
        prose(3, 40) + "\n" + passage + "\n" + prose(4, 40),
        prose(5, 30) + " " + passage + " " + prose(6, 10),
        "é日本語 ▁ ∑ 😀 naïve\u0000 Σίσυφος ΟΔΟΣ İstanbul \x1c odd",
        "aaaa " * 300,
        prose(7, 4000),
        "x" * 5000,
        "repeated line\n" * 3,
        "Don't we'll THEY'RE 1234 <s> </s>[INST] <|endoftext|>",
    ]


def documents(spark):
    """Rows with clashing extra columns, a null id and repeated rows."""
    rows = [(i, t, "en", f"s{i % 4}", len(t or ""), 7, 8, "u", "d") for i, t in enumerate(texts())]
    rows += [rows[4], (None, prose(8, 20), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
