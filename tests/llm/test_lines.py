import collections

from pathloom.llm import lines

from .fixtures import documents, empty


def brute(rows, least):
    sites = collections.defaultdict(set)
    for _, site, text in rows:
        for x in (text or "").split("\n"):
            if site is not None and x.strip(" "):
                sites[x].add(site)
    out = []
    for i, site, text in rows:
        parts = (text or "").split("\n")
        gone = [len(sites[x]) >= least for x in parts]
        own = any(x.strip(" ") for x, g in zip(parts, gone, strict=True) if not g)
        if i is None or not own or not any(gone):
            out.append((i, text, 0))
        else:
            out.append((i, "\n".join(x for x, g in zip(parts, gone, strict=True) if not g), sum(gone)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, rows):
    body = lambda i: f"own line number {i} of this document, which is long enough\nand another one, {i}"
    data = [(i, f"s{i % 12}", body(i) + "\nAccept cookies\n" + ("share this\n" if i % 3 else "") + " ") for i in range(40)]
    data += [(50, None, body(50) + "\nAccept cookies"), (51, "s1", "Accept cookies"), (52, "s1", None), (53, "s2", ""), (None, "s3", body(1) + "\nAccept cookies"), (54, "s1", body(54) + "\nAccept cookies"), (54, "s1", body(54) + "\nAccept cookies"), (54, "s2", "Accept cookies\nanother text under the same id\n\nAccept cookies")]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, source string, text string, line_id long, site string").repartition(3)
    for least in (2, 5, 12, 13):
        out = lines.remove_boilerplate(df, least)
        assert rows(out, "doc_id", "text", "__n_removed") == brute(data, least)
    assert out.columns[:5] == df.columns


def test_cases(spark):
    df = documents(spark)
    assert lines.remove_boilerplate(df, 2).count() == df.count()
    assert lines.remove_boilerplate(empty(spark), 2).count() == 0


def test_counts_far_from_the_threshold_are_sketched_well(spark):
    many = spark.range(0, 3000).selectExpr("id AS doc_id", "concat('s', id) AS source", "concat('wide\nown ', id, if(id < 40, '\nnear', '')) AS text")
    assert lines.boilerplate(many, 41).count() == 1
    assert lines.boilerplate(many, 40).count() == 2


def test_short_pages_of_much_boilerplate_lose_it(spark):
    wide = "This long line stands on every site\nand this one does as well"
    data = [(i, f"s{i}", f"{wide}\nown {i}") for i in range(12)] + [(20, "s1", wide), (21, "s2", f"{wide}\n \n")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in lines.remove_boilerplate(df).collect()}
    assert got == {**{i: f"own {i}" for i in range(12)}, 20: wide, 21: f"{wide}\n \n"}


def test_a_very_long_text_of_many_boilerplate_lines(spark):
    import time

    wide = [f"shared line number {k}" for k in range(40)]
    long = "\n".join(wide[k % 40] if k % 3 else f"own {k}" for k in range(120_000))
    data = [(i, f"s{i}", "\n".join([*wide, f"own line of {i}"])) for i in range(12)] + [(20, "s1", long)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    began = time.time()
    got = {r.doc_id: r for r in lines.remove_boilerplate(df).collect()}
    assert time.time() - began < 60
    assert got[20]["__n_removed"] == 80_000 and got[20].text == "\n".join(f"own {k}" for k in range(0, 120_000, 3))
    assert all(got[i].text == f"own line of {i}" for i in range(12))
