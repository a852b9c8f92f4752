"""Repetition over whole hosts, and pages with no or several articles, against brute force."""

import random
from collections import defaultdict

from tarnwick.llm import html_text


def plain(n, seed):
    """Pages of one host without an article: each of 12 notices stands on a few pages, the rest is the page's own."""
    r = random.Random(seed)
    words = lambda k: " ".join(f"w{r.randrange(100_000)}" for _ in range(k))
    notices = [words(15) for _ in range(12)]
    return {k: [words(20), notices[r.randrange(12)], words(20)] for k in range(n)}


def uncovered(pages, m=10):
    """Words of each page outside windows of m words that stand on two pages."""
    on, split = defaultdict(set), {k: " ".join(b).split() for k, b in pages.items()}
    for k, ws in split.items():
        for i in range(len(ws) - m + 1):
            on[tuple(ws[i : i + m])].add(tuple(pages[k]))  # equal pages are one page
    out = {}
    for k, ws in split.items():
        gone = {i + j for i in range(len(ws) - m + 1) if len(on[tuple(ws[i : i + m])]) > 1 for j in range(m)}
        out[k] = " ".join(w for i, w in enumerate(ws) if i not in gone)
    return out


def test_repetition_over_a_large_host(spark):
    pages = plain(60, 3)
    rows = [(k, f"http://big.example.net/{k}", "".join(f"<p>{x}</p>" for x in b)) for k, b in pages.items()]
    rows += [(100 + k, f"http://other{k}.example.net/", f"<p>{pages[0][0]}</p>") for k in range(2)]  # other hosts share nothing
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    wanted = uncovered(pages) | {100: pages[0][0], 101: pages[0][0]}
    assert any(" ".join(b) != wanted[k] for k, b in pages.items())  # repetition decides
    for settings in ({}, {"chunk_bytes": 1000, "range_rows": 200}):
        assert {r.page_id: r.text for r in html_text.extract(df, **settings).collect()} == wanted, settings


def test_articles_do_not_decide_alone(spark):
    r = random.Random(11)
    words = lambda k: " ".join(f"w{r.randrange(100_000)}" for _ in range(k))
    notice, quote = words(15), words(15)
    rows, wanted = [], {}
    for k in range(30):
        url, body = f"http://news.example.net/{k}", words(60)
        if k < 10:  # the story is beside teaser cards: it outweighs them
            cards = [words(8), words(9)]
            page, text = f"<div>{body}</div><article>{cards[0]}</article><article>{cards[1]}</article>", [body, *cards]
        elif k < 25:  # unmarked boilerplate inside the article, on half of the host's pages
            page, text = f"<article><p>{body}</p><p>{notice}</p></article><div>{words(5)}</div>", [body]
        else:  # a quotation that a few articles share stays, and so does an article without anything else
            page, text = f"<article><p>{body}</p><p>{quote}</p></article>", [body, quote]
        rows.append((k, url, page))
        wanted[k] = " ".join(text)
    rows += [(100 + k, f"http://copies.example.net/{k}", f"<article>{notice}</article>") for k in range(12)]
    wanted |= {100 + k: notice for k in range(12)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for settings in ({}, {"chunk_bytes": 1000, "range_rows": 200}):
        assert {r.page_id: r.text for r in html_text.extract(df, **settings).collect()} == wanted, settings


def test_short_runs_of_any_length(spark):
    """Runs of other lengths than the default, against brute force; one very long page, and pages that are copies."""
    r = random.Random(5)
    pages = {k: [" ".join(f"w{r.randrange(12)}" for _ in range(r.randrange(0, 40))) for _ in range(3)] for k in range(40)}
    pages[50], pages[51] = pages[3], [" ".join(f"v{r.randrange(100_000)}" for _ in range(60_000)), pages[4][0], ""]
    rows = [(k, f"http://h.example.net/{k}", "".join(f"<div>{x}</div>" for x in b)) for k, b in pages.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for m in (1, 3, 4, 7):
        wanted = uncovered({k: [" ".join(b)] for k, b in pages.items()}, m)
        got = {x.page_id: x.text for x in html_text.extract(df, min_words=m, chunk_bytes=2000, range_rows=300).collect()}
        assert got == wanted, m


def test_equal_pages_are_one(spark):
    """A page, its mirror and a repeated row keep their text; what another page has too goes from all of them."""
    r = random.Random(2)
    words = lambda k: " ".join(f"w{r.randrange(100_000)}" for _ in range(k))
    own, shared, other, lone = words(40), words(15), words(30), words(25)
    page = f"<p>{own}</p><p>{shared}</p>"
    rows = [(1, "http://m.example.net/a", page), (2, "https://m.example.net/a", page), (2, "https://m.example.net/a", page), (3, "http://m.example.net/b", f"<p>{other}</p><p>{shared}</p>")]
    rows += [(k, f"http://n.example.net/{k}", f"<p>{lone}</p>") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    wanted = {1: own, 2: own, 3: other} | dict.fromkeys(range(10, 40), lone)
    for settings in ({}, {"chunk_bytes": 300, "range_rows": 20}):
        got = html_text.extract(df, **settings).collect()
        assert len(got) == len(rows) and {x.page_id: x.text for x in got} == wanted
