"""HTML extraction: host suffix array.

The pages of a host are one long stream of words, and runs of `min_words` or more that occur in two of its pages or more
are covered; the uncovered runs of each block stay. The stream is worked on in chunks of pages. A chunk sorts its
suffixes by prefix doubling, as deep as the shortest run that counts, which puts equal runs side by side; the hosts'
classes of equal runs are added up over all chunks by their hashes, so repetition is decided over whole hosts.

Two rounds keep that exchange small and lose nothing. Equal runs hold equal words at the place where the hash of five
words in a row is least; the first round counts on how many pages of its host each such anchor stands. A run whose
anchor stands on one page repeats on no other, so only the others are sorted and sent.

A structural check follows, because repetition alone is wrong in both directions: menus and adverts whose words change
from page to page are no content, and an article that quotes a passage keeps it. So marked-up boilerplate goes whether
it repeats or not, and a marked-up article loses only what stands on half of its host's pages; what is outside it has to
outweigh it to stay.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import materialize, pick
from tarnwick.llm.packed import answers, by_range, gathered, key_ranges, sent_schema, squeeze, to_ranges, totals, write_chunks
from tarnwick.llm.words import Words, mix, slices, trim

#: Elements whose content is never text of the page.
_RAW = "script style noscript template textarea title svg iframe object canvas math select button"
#: Elements that hold boilerplate.
_CHROME = set("nav footer aside form menu dialog".split())
_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id names that mark boilerplate.
_MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr login masthead menu nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements that begin and end a block.
_BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that can be boilerplate by their name, role, class or id, and so are followed to their ends.
_FOLLOWED = set("address article aside blockquote dd details dialog div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main menu nav ol p section span table td ul".split())
#: Elements that end where one of their kind, or one of the blocks named with them, begins.
_IMPLIED = {"p": _BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(_RAW.split())})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in _CHROME or name == "header" and not in_article:
        return True
    if not attributes or name in ("article", "main", "body", "html"):
        return False
    for key, *values in _NAMES.findall(attributes):
        value, key = "".join(values).lower(), key.lower()
        if key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and not _MARKS.isdisjoint(_SPLIT.split(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", "".join(values)).lower())):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """(text, inside an article) of a page's blocks in order, without marked-up boilerplate; character references are
    decoded, white space is one space, empty blocks are left out."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, article
    hidden = article = 0
    parts: list[str] = []

    def close():
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((text, article > 0))
            parts.clear()

    last = 0
    page = page or ""
    for m in _MARKUP.finditer(page):
        if not hidden and m.start() > last:
            parts.append(page[last : m.start()])
        last = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            close()
        while not m[2] and stack and name in _IMPLIED.get(stack[-1][0], ()):
            hidden -= stack.pop()[1]
        if name not in _FOLLOWED:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(x[1] or x[2] for x in stack[k:]):
                        close()
                    hidden -= sum(x[1] for x in stack[k:])
                    article -= sum(x[2] for x in stack[k:])
                    del stack[k:]
                    break
        elif not m[4].rstrip().endswith("/"):
            chrome, own = _is_chrome(name, m[4], article > 0), name in ("article", "main")
            if chrome or own:
                close()
            hidden += chrome
            article += own
            stack.append((name, chrome, own))
    if not hidden and last < len(page):
        parts.append(page[last:])
    close()
    return out


def suffix_classes(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the classes of equal runs of `width` words that begin at the positions `at`, in the order of the sorted suffixes.

    codes: numbers of the stream's words. Prefix doubling: ranks by 1, 2, 4, ... words, of the suffixes that a rank of the next
    level looks at.
    """
    widths = [1 << k for k in range((width - 1).bit_length())]
    needed = [at]
    for w in reversed(widths):
        wide = min(2 * w, width)
        needed.append(np.unique(np.concatenate([needed[-1], needed[-1] + (wide - w)])))
    needed.reverse()
    rank = np.zeros(codes.size, np.int64)
    rank[needed[0]] = np.unique(codes[needed[0]], return_inverse=True)[1]
    for k, w in enumerate(widths):
        wide, own = min(2 * w, width), needed[k + 1]
        pair = rank[own] * np.int64(codes.size + 1) + rank[own + (wide - w)]
        rank[own] = np.unique(pair, return_inverse=True)[1]
    return rank[at] if widths else np.unique(codes[at], return_inverse=True)[1]


#: What a page counts; of n equal pages of a host each counts UNIT div n.
UNIT = 1 << 40


def pages_of(classes: np.ndarray, page: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
    """What the pages that each of n classes stands on count together; page: that of each occurrence; weight: what each page counts."""
    key = np.unique(classes * (np.int64(page.max(initial=0)) + 1) + page)
    of, page = np.divmod(key, np.int64(page.max(initial=0)) + 1)
    out = np.zeros(n, np.int64)
    np.add.at(out, of, weight[page])
    return out


def whole_pages(counts: np.ndarray) -> np.ndarray:
    """Of what pages count together, their number: n equal pages lack less than n / UNIT of one."""
    return (counts + UNIT // 2) // UNIT


#: A run on so many pages of a host at least, and on half of them, is part of the host's template even inside articles.
TEMPLATE_PAGES = 10


def _assembled(n: int, flat: list[tuple[int, str, bool]], counts: np.ndarray, covered: np.ndarray, template: np.ndarray) -> list[str]:
    """Texts of n pages from their blocks (page, text, inside an article), with the masks of covered and of template words."""
    of, inside = np.array([k for k, _, _ in flat], np.int64), np.array([a for _, _, a in flat], bool)
    ends = np.cumsum(counts)
    of_word, in_article = np.repeat(of, counts), np.repeat(inside, counts)
    article = np.bincount(of_word[in_article], minlength=n)
    outweighed = 2 * np.bincount(of_word[in_article & template], minlength=n) < article
    beside = np.bincount(of_word[~in_article & ~covered], minlength=n) > article
    gone = np.where(in_article, template & outweighed[of_word], covered | ~beside[of_word] & (article > 0)[of_word])
    out: list[list[str]] = [[] for _ in range(n)]
    for (k, text, _), a, e in zip(flat, (ends - counts).tolist(), ends.tolist(), strict=True):
        own = gone[a:e]
        if own.any():
            text = " ".join(w for w, c in zip(text.split(" "), own.tolist(), strict=False) if not c)
        if text:
            out[k].append(text)
    return [" ".join(x) for x in out]


#: Words of an anchor.
ANCHOR = 5


class Stream:
    """The pages of a chunk, laid end to end: words, the first words of its runs of `min_words`, and their anchors."""

    def __init__(self, row: pa.Table, min_words: int):
        self.ids, self.urls, self.inside, hosts, self.n_blocks, self.texts, copies = (row.column(k).combine_chunks().flatten() for k in ("ids", "urls", "inside", "hosts", "n_blocks", "texts", "copies"))
        self.weight = UNIT // copies.to_numpy()
        n_blocks = self.n_blocks.to_numpy()
        words = [Words(self.texts.slice(k, n)) for k, n in slices(self.texts)] or [Words(self.texts)]
        self.counts, self.min_words = np.concatenate([w.counts for w in words]), min_words
        self.page = np.repeat(np.repeat(np.arange(n_blocks.size), n_blocks), self.counts)
        last = self.page.size - min_words + 1
        self.at = np.flatnonzero(self.page[: max(last, 0)] == self.page[min_words - 1 :]) if last > 0 else np.zeros(0, np.int64)
        self.host = mix(hosts.to_numpy().view(np.uint64))
        # words of a host: equal words of other hosts are others
        self.words = mix(np.concatenate([w.hashes for w in words]) + self.host[self.page])

    def _hash(self, first: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the runs of `width` words from the places `first` on."""
        h, odd = np.full(first.size, width, np.uint64), 0x9E3779B97F4A7C15
        for k in range(width):
            h += self.words[first + k] * np.uint64(pow(odd, k + 1, 1 << 64))
        return mix(h)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct hashes of anchors, what the chunk's pages with each count, number of each run's anchor)."""
        width = min(ANCHOR, self.min_words)
        every = self._hash(np.arange(max(self.page.size - width + 1, 0)), width)
        least = every[self.at]
        for k in range(1, self.min_words - width + 1):
            np.minimum(least, every[self.at + k], out=least)
        page = self.page[self.at]
        # runs side by side mostly have one anchor
        turn = np.ones(least.size, bool)
        turn[1:] = (least[1:] != least[:-1]) | (page[1:] != page[:-1])
        keys, of = np.unique(least[turn], return_inverse=True)
        return keys, pages_of(of, page[turn], keys.size, self.weight), of[np.cumsum(turn) - 1]

    def runs(self, told: pa.Table) -> None:
        """Keep the runs whose anchors stand on two pages of their host, and sort them into classes."""
        _, _, of = self.anchors()
        self.at = self.at[whole_pages(answers(told, "pages"))[of] > 1] if of.size else self.at
        classes = suffix_classes(self.words, self.at, self.min_words) if self.at.size else self.at
        n = int(classes.max(initial=-1)) + 1
        first = np.zeros(n, np.int64)
        first[classes] = self.at
        self.keys, place = np.unique(self._hash(first, self.min_words), return_inverse=True)
        self.of = place[classes] if n else classes

    def covered(self, at: np.ndarray) -> np.ndarray:
        """Words within the runs that begin at the positions `at`."""
        delta = np.zeros(self.page.size + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + self.min_words, -1)
        return np.cumsum(delta[:-1]) > 0


def _chunks(rows: DataFrame, kind: str, chunk_bytes: int) -> DataFrame:
    """Pages' blocks outside marked-up boilerplate, in chunks of about `chunk_bytes` of text."""
    names = ["chunk", "ids", "urls", "hosts", "sizes", "copies", "n_blocks", "texts", "inside", "n_words"]

    def parse(batches):
        task, seq, held = TaskContext.get().partitionId(), 0, 0
        ids, urls, hosts, sizes, copies, found = [], [], [], [], [], []

        def flush():
            flat = [x for b in found for x in b]
            lists = [pa.concat_arrays(x) for x in (ids, urls, hosts, sizes, copies)]
            lists += [pa.array([len(b) for b in found], pa.int32()), pa.array([t for t, _ in flat], pa.string()), pa.array([a for _, a in flat], pa.bool_())]
            own = [pa.array([(task << 24) + seq])] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays([*own, pa.array([sum(t.count(" ") + 1 for t, _ in flat)])], names)

        for b in batches:
            for k, n in slices(b.column(5)):
                cut = b.slice(k, n)
                for x, j in ((ids, 0), (urls, 1), (hosts, 2), (sizes, 3), (copies, 4)):
                    x.append(cut.column(j))
                got = [blocks(p) for p in cut.column(5).to_pylist()]
                found += got
                held += sum(len(t) for x in got for t, _ in x) + 64 * n
                if held >= chunk_bytes:
                    yield flush()
                    seq, ids, urls, hosts, sizes, copies, found, held = seq + 1, [], [], [], [], [], [], 0
        if found:
            yield flush()
        trim()

    schema = f"chunk long, ids array<{kind}>, urls array<string>, hosts array<long>, sizes array<long>, copies array<long>, n_blocks array<int>, texts array<string>, inside array<boolean>, n_words long"
    return write_chunks(rows.mapInArrow(parse, schema), "html_chunks")


def _added(group: pa.Table) -> pa.Table:
    """Of each key that a chunk sent: what all pages that it stands on count."""
    cuts, keys, of, _, (own,) = gathered(group, 1, 8)
    total = np.zeros(keys.size, np.int64)
    np.add.at(total, of, own)
    every = total[of]
    back = pa.array([squeeze(every[a:e], 8) for a, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    return pa.Table.from_arrays([group.column("chunk"), group.column("range"), group.column("size"), back], ["chunk", "range", "size", "pages"])


#: Beyond so many hosts, their page counts are joined instead of broadcast.
MAX_BROADCAST = 1_000_000


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_words: int = 10, chunk_bytes: int = 4_000_000, range_rows: int = 1_000_000) -> DataFrame:
    """Per row: id_col, url_col, text, n_chars.

    The text of a page without an article is its blocks outside boilerplate, less the runs that it shares with other pages of
    its host. Of a page with marked-up articles, these stay, less the runs that stand on at least half of the host's pages
    (and `TEMPLATE_PAGES`), if such runs are the lesser part of them; and so do the uncovered runs outside, if they have more
    words than the articles.

    Null and empty pages have an empty text, and an empty table has no rows. Pages without a host form a host of their own.
    Equal pages of a host, repeated rows among them, count as one page and keep the same text. A page of any length is read whole; it is a chunk of its own if it is longer than `chunk_bytes`. The result does
    not depend on how pages fall into chunks. Other columns are not read, whatever their names.
    """
    df = pick(pages, _id=id_col, _url=url_col, _html=html_col)
    df = df.withColumn("_host", F.lower(F.regexp_extract(F.coalesce(F.col("_url"), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1)))
    df = df.withColumn("_key", F.xxhash64("_host", F.sha2(F.coalesce(F.col("_html"), F.lit("")).cast("binary"), 256)))
    # equal pages of a host are one page: slim rows tell how many there are of each
    equal = materialize(df.groupBy("_host", "_key").agg(F.count("*").alias("_copies")), "html-pages")
    hosts = equal.groupBy("_host").agg(F.count("*").alias("_n"))
    small = hosts.count() <= MAX_BROADCAST
    sized = df.join(F.broadcast(hosts) if small else hosts, "_host")
    several = equal.filter("_copies > 1").select("_key", "_copies")
    few = several.count() <= MAX_BROADCAST
    sized = sized.join(F.broadcast(several) if few else several, "_key", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    kind = df.schema["_id"].dataType.simpleString()
    chunks = _chunks(sized.select("_id", "_url", F.xxhash64("_host").alias("_host"), "_n", "_copies", "_html"), kind, chunk_bytes)
    spark = chunks.sparkSession
    n_words = int(chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"])
    ranges = key_ranges(spark, n_words // 3, range_rows)
    content = chunks.drop("n_words")
    told = "chunk long, range int, size int, pages binary"

    def first(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = pa.Table.from_batches([b.slice(k, 1)])
                keys, own, _ = Stream(row, min_words).anchors()
                yield to_ranges(row.column("chunk")[0].as_py(), keys, [own], ranges, 8)
                trim()

    one = materialize(content.mapInArrow(first, sent_schema(1)).groupBy("range").applyInArrow(_added, told), "html-anchors")

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        stream = Stream(left, min_words)
        stream.runs(by_range(right))
        trim()
        return pa.Table.from_batches([to_ranges(left.column("chunk")[0].as_py(), stream.keys, [pages_of(stream.of, stream.page[stream.at], stream.keys.size, stream.weight)], ranges, 8)])

    sent = content.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(second, sent_schema(1))
    two = sent.groupBy("range").applyInArrow(_added, told)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, runs = (by_range(right.filter(pa.array(right.column("round").to_numpy() == k))) for k in (1, 2))
        stream = Stream(left, min_words)
        stream.runs(anchors)
        pages = whole_pages(answers(runs, "pages"))[stream.of] if stream.of.size else stream.of
        least = np.maximum(TEMPLATE_PAGES, (left.column("sizes").combine_chunks().flatten().to_numpy() + 1) // 2)
        covered = stream.covered(stream.at[pages > 1])
        template = stream.covered(stream.at[pages >= least[stream.page[stream.at]]])
        of = np.repeat(np.arange(len(stream.ids)), stream.n_blocks.to_numpy())
        flat = list(zip(of.tolist(), stream.texts.to_pylist(), stream.inside.to_pylist(), strict=True))
        made = _assembled(len(stream.ids), flat, stream.counts, covered, template)
        trim()
        return pa.Table.from_arrays([stream.ids, stream.urls, pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], ["_id", "_url", "text", "n_chars"])

    every = one.withColumn("round", F.lit(1)).union(two.withColumn("round", F.lit(2)))
    made = content.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(finish, f"_id {kind}, _url string, text string, n_chars long")
    return made.toDF(id_col, url_col, "text", "n_chars")
