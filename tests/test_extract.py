"""Chains of extractors over made files, half of them broken."""

import time

from tarnwick.sources import extract

CHAIN = [("xml", extract.xml_pages), ("plain", extract.plain_pages)]


def slow(content):
    time.sleep(30)
    return ["never"]


def test_files(spark, tmp_path):
    long = "words of a page " * 4
    made = {
        "a.pdf": f"<doc><page>{long}one</page><page> </page><page>{long}two</page></doc>".encode(),
        "b.pdf": f"{long}one\f{long}two\f\f{long}three".encode(),
        "c.pdf": b"\xff\xfe broken",
        "d.pdf": b"<doc><page>short</page></doc>",
        "e.pdf": b"",
        "f.pdf": b"<doc>" + b"x" * 5000,
        "g.pdf": f"<doc><page>{long}".encode(),
        "h.txt": b"other",
    }
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    got = {}
    for r in extract.read_files(spark, str(tmp_path), CHAIN, min_chars=50, max_bytes=4000, max_pages=2).collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["page"], r["extractor"], (r["text"] or "")[-4:], len(r["reasons"]), r["n_pages"]))
    assert sorted(got["a.pdf"]) == [(1, "xml", " one", 0, 1)]  # two pages at most are looked at, one of them is blank
    assert sorted(got["b.pdf"]) == [(1, "plain", " one", 1, 2), (2, "plain", " two", 1, 2)]
    assert got["c.pdf"] == [(None, None, "", 2, 0)]
    assert got["d.pdf"] == [(None, None, "", 2, 0)]  # too short as XML, and as text under the limit
    assert got["f.pdf"] == [(None, None, "", 1, 0)]
    assert got["g.pdf"][0][:2] == (1, "plain") and set(got) == set(made) - {"e.pdf", "h.txt"}


def test_order_and_limits():
    name, pages, reasons = extract.chain(b"a\fb\fc", [("none", lambda c: 1 / 0), *CHAIN], 2, 1, 5)
    assert (name, pages) == ("plain", ["a", "b"]) and "ZeroDivisionError" in reasons[0] and len(reasons) == 2
    began = time.perf_counter()
    name, pages, reasons = extract.chain(b"text", [("slow", slow), ("plain", extract.plain_pages)], 9, 1, 0.3)
    assert name == "plain" and "TooLong" in reasons[0] and time.perf_counter() - began < 5


def test_odd_contents(spark):
    df = spark.createDataFrame([("n", None), (None, bytearray(b"text text"))], "path string, content binary")
    got = {r["path"]: r for r in extract.extracted(df, CHAIN, min_chars=1).collect()}
    assert got["n"]["reasons"] == ["no content"] and got[None]["text"] == "text text"
    assert extract.extracted(df.limit(0), CHAIN).collect() == []
