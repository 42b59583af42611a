import hashlib

import pytest

from pathloom.llm import warc


def test_round_trip(spark, rows):
    html = {i: f"<p>{i % 4} page " + "é" * 60 for i in range(12)} | {20: "short", 21: "short", 22: None, 23: "", 24: "a\r\n\r\nWARC/1.0\r\n\r\n" * 20, 25: "x" * 99, 26: "x" * 99, 27: "x" * 100, 28: "x" * 100}
    data = [(i, None if i == 5 else f"http://x/{i} é", h, 1, "clash") for i, h in html.items()] + [(None, "http://n", "<p>0 page " + "é" * 60, 1, "c"), (28, "http://x/28", "x" * 100, 1, "c")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, digest int, refers_to string").repartition(3)
    first = {}
    for i, _, h, *_ in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, *_ in data:
        b = (h or "").encode()
        again = i is not None and len(b) >= 100 and first[h or ""] < i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert rows(warc.convert(df)) == sorted(want, key=repr)
    assert warc.convert(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files(spark, tmp_path, version):
    payloads = [b"", b"one\ntwo\n", "é".encode() * 10, b"http://x 0.0.0.0 20000101000000 text/html 3\nabc"]
    data = warc.arc_header(version) + b"".join(warc.arc_record(f"http://h/{i} x", p, version, date=f"2001020304050{i}") for i, p in enumerate(payloads))
    (tmp_path / "a.arc").write_bytes(data)
    got = sorted(warc.read_arc(spark, str(tmp_path / "a.arc")).collect(), key=lambda r: r.date)
    assert [bytes(r.payload) for r in got] == payloads
    assert got[1].url == "http://h/1%20x" and got[1].date == "20010203040501"
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_arc(data[:-20]))
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_arc(b"nothing"))


def test_written_files_are_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://x/1", "<p>" + "a" * 200), (2, "http://x/2", "<p>" + "a" * 200)], "page_id long, url string, html string")
    warc.write_warc(df.coalesce(1), f"file://{tmp_path}/w")
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "w" / "small").glob("part-*")))
    records = list(warc.parse_warc(data))
    assert [h["warc-type"] for h, _ in records] == ["response", "revisit"]
    assert records[1][0]["warc-refers-to"] == records[0][0]["warc-record-id"]
    assert records[0][0]["warc-date"] == "2000-01-01T00:00:00Z"
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_warc(data[:-2]))


def test_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 5)
    monkeypatch.setattr(warc, "LARGE", 3000)
    df = spark.createDataFrame([(i, f"http://x/{i}", f"{i} " + "b" * (10 if i % 4 else 5000)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, f"file://{tmp_path}/w")
    files = list((tmp_path / "w").rglob("part-*"))
    assert max(f.stat().st_size for f in files) < 7000
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 40
