"""Texts that need more than one pattern: runs of capital words, and the first JSON object of an answer. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.vocab import CAPITALS_RUN

#: Characters that no text holds, to mark where a run begins and ends.
_OPEN, _CLOSE = "\ue000", "\ue001"


def normalise_switch(text: Column | str) -> Column:
    """Runs of three or more capital words get underscores for blanks; null stays null."""
    c = F.col(text) if isinstance(text, str) else text
    marked = F.split(F.regexp_replace(c, CAPITALS_RUN, f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    return F.array_join(F.transform(marked, lambda part, k: F.when(k % 2 == 1, F.replace(part, F.lit(" "), F.lit("_"))).otherwise(part)), "")


def extract_json(text: Column | str) -> Column:
    """The first JSON object of a fenced or plain text, re-emitted compactly; null where there is none.

    Spark's JSON reader reads one whole value from the first brace on and looks no further, so text after it does no harm.
    """
    c = F.col(text) if isinstance(text, str) else text
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.contains(fenced, F.lit("{")), fenced).otherwise(c)
    start = F.instr(body, "{")
    return F.when(start > 0, F.get_json_object(F.substring(body, start, F.length(body)), "$"))
