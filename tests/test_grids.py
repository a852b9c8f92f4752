"""Page grids: a case for each strategy, and pages that are odd."""

import pytest

from tarnwick.operators import grids


def words(spark, rows):
    """(page, text, x0, top): characters are 5 wide."""
    return spark.createDataFrame([(p, t, float(x), x + 5.0 * len(t), float(y)) for p, t, x, y in rows], "page int, text string, x0 double, x1 double, top double")


def lines(spark, rows):
    return spark.createDataFrame([(p, *map(float, r)) for p, *r in rows], "page int, x0 double, y0 double, x1 double, y1 double")


def box(page, xs, ys):
    """All lines of a full grid."""
    return [(page, x, ys[0], x, ys[-1]) for x in xs] + [(page, xs[0], y, xs[-1], y) for y in ys]


def got(frame):
    return sorted((r["page"], r["table"], [list(c) for c in r["cells"]]) for r in frame.collect())


def test_lines(spark):
    """Two tables on a page, lines that are a little off, a cell over two columns, a cell of two text lines, an empty one."""
    w = words(spark, [(1, "a", 2, 2), (1, "b", 102, 2), (1, "two", 2, 21), (1, "words", 20, 22), (1, "below", 2, 31), (1, "wide", 2, 52), (1, "c", 2, 202), (1, "d", 102, 202), (1, "out", 500, 2)])
    ruled = box(1, [0, 100, 200], [0, 20, 50]) + [(1, 0, 50, 0, 70), (1, 200, 50, 200, 70), (1, 0, 71, 200, 70), (1, 1, 70, 201, 71)] + box(1, [0, 100, 200], [200, 220])
    assert got(grids.by_lines(w, lines(spark, ruled))) == [(1, 0, [["a", "b"], ["two words\nbelow", None], ["wide", None]]), (1, 1, [["c", "d"]])]


def test_open_lines_make_no_cells(spark):
    assert got(grids.by_lines(words(spark, [(1, "a", 2, 2)]), lines(spark, [(1, 0, 0, 100, 0), (1, 0, 20, 100, 20), (1, 0, 0, 0, 20)]))) == []


def test_edges(spark):
    rows = [(1, "name", 0, 0), (1, "of", 25, 0), (1, "it", 100, 0), (1, "x", 1, 20), (1, "y", 101, 20), (1, "z", 0, 40), (1, "stray", 60, 40)]
    assert got(grids.by_edges(words(spark, rows))) == [(1, 0, [["name of", "it"], ["x", "y"], ["z stray", None]])]


def test_blanks(spark):
    rows = [(1, "a", 0, 0), (1, "b", 7, 0), (1, "c", 90, 1), (1, "d", 33, 20), (1, "e", 140, 20), (1, "f", 300, 20)]
    assert got(grids.by_blanks(words(spark, rows))) == [(1, 0, [["a b", "c"], ["d", "e", "f"]])]


@pytest.fixture
def mixed(spark):
    table = [("a", 2), ("b", 102)]
    w = [(1, t, x, y) for y in (2, 22) for t, x in table] + [(2, t, x, y) for y in (2, 22) for t, x in table] + [(3, "p", 0, 0), (3, "q", 50, 0), (3, "r", 20, 20), (3, "s", 90, 20)] + [(4, "prose", 0, 0)]
    return words(spark, w), lines(spark, box(1, [0, 100, 200], [0, 20, 40]) + [(3, 0, 0, 90, 0)])


def test_choice(mixed):
    chosen = {r["page"]: (r["strategy"], r["cells"]) for r in grids.page_grids(*mixed).collect()}
    assert chosen == {1: ("lines", [["a", "b"], ["a", "b"]]), 2: ("edges", [["a", "b"], ["a", "b"]]), 3: ("blanks", [["p", "q"], ["r", "s"]]), 4: ("blanks", [["prose"]])}


def test_empty(mixed):
    w, ruled = mixed
    assert grids.page_grids(w.limit(0), ruled.limit(0)).collect() == []
    assert grids.page_grids(w.limit(0), ruled).count() == 1  # cells without words
