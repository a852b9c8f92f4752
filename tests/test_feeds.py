"""Feed documents: RSS, Atom and RDF, faults of all kinds; files in batch and as a stream with admission limits."""

from tarnwick.sources import feeds

RSS = "<rss version='2.0'><channel><title> News </title><item><title>A &amp; B</title><link> http://a/1 </link><description><![CDATA[<b>x</b>]]></description><pubDate>Mon</pubDate></item><item><title/><link>http://a/2</link></item></channel></rss>"
ATOM = "<?xml version='1.0' encoding='ISO-8859-1'?><feed xmlns='http://www.w3.org/2005/Atom'><title>Blög</title><entry><title>T</title><link rel='self' href='no'/><link href='http://b/1'/><content>C</content><summary>S</summary><updated>2026</updated></entry></feed>"
RDF = "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>R</title></channel><item><title>t</title><link>http://c/1</link><dc:date>2025</dc:date></item></rdf:RDF>"


def test_kinds():
    assert feeds.parse(RSS) == ([{"title": "A & B", "url": "http://a/1", "summary": "<b>x</b>", "published": "Mon", "source": "News"}, {"url": "http://a/2", "source": "News"}], None)
    assert feeds.parse(ATOM) == ([{"title": "T", "url": "http://b/1", "summary": "S", "published": "2026", "source": "Blög"}], None)
    assert feeds.parse(RDF) == ([{"title": "t", "url": "http://c/1", "published": "2025", "source": "R"}], None)


def test_faults():
    for text in (None, "", "  ", "no xml", "<html><body/></html>"):
        found, error = feeds.parse(text)
        assert found == [] and error
    found, error = feeds.parse(RSS[: RSS.index("</channel>")])
    assert len(found) == 2 and error  # entries before the fault stay
    found, error = feeds.parse(RSS.replace("<item><title/>", "<item><oops>"))
    assert len(found) == 1 and error
    assert feeds.parse(RSS, max_chars=50) == ([], "more than 50 characters")


def test_long_document():
    many = "".join(f"<item><title>é{k}</title><link>u{k}</link></item>" for k in range(20_000))
    found, error = feeds.parse(f"<rss><channel>{many}</channel></rss>")
    assert error is None and [x["title"] for x in found] == [f"é{k}" for k in range(20_000)]


def test_files_and_stream(spark, tmp_path):
    for k, text in enumerate((RSS, ATOM, RDF, "<rss><channel><item>", "")):
        (tmp_path / f"f{k}.xml").write_text(text, encoding="utf-8")
    (tmp_path / "other.txt").write_text("x")
    want = sorted((r["feed"], r["pos"] or 0, r["url"] or "", r["source"] or "") for r in feeds.read_feeds(spark, str(tmp_path)).collect())
    assert len([w for w in want if w[1]]) == 4
    assert {w[3] for w in want} >= {"News", "Blög", "R"}
    out = str(tmp_path / "out")
    query = feeds.stream_feeds(spark, str(tmp_path), files=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress is not None and len(query.recentProgress) >= 2  # admitted by twos
    got = sorted((r["feed"], r["pos"] or 0, r["url"] or "", r["source"] or "") for r in spark.read.parquet(out).collect())
    assert got == want
