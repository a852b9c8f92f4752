"""Query expansion from dictionaries, which are parameters. Dictionaries are literals of the plan: at most `MAX_TERMS` entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import vocab as V

MAX_TERMS = 5_000


def _checked(table: dict[str, list[str]]) -> dict[str, list[str]]:
    if sum(map(len, table.values())) > MAX_TERMS:
        raise ValueError(f"a dictionary of more than {MAX_TERMS} entries")
    return table


def by_topic(triggers: dict[str, str]) -> dict[str, list[str]]:
    """Topic to triggers, of a table from trigger to topic."""
    out: dict[str, list[str]] = {}
    for word, topic in triggers.items():
        out.setdefault(topic, []).append(word)
    return out


def detect_topics(q: Column, triggers: dict[str, list[str]] | None = None) -> Column:
    """Topics with a trigger inside the lower-cased query (as a substring), sorted."""
    low = F.lower(q)
    found = []
    for topic, words in sorted(_checked(triggers or by_topic(V.TRIGGERS)).items()):
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        found.append(F.when(hit, F.lit(topic)))
    return F.array_compact(F.array(*found))


def all_terms(q: Column, terms: dict[str, list[str]] | None = None, triggers: dict[str, list[str]] | None = None) -> Column:
    """All terms of the query's topics, in topic order, distinct."""
    terms = _checked(terms or V.TERMS)
    known = F.create_map(*(x for t, ws in sorted(terms.items()) for x in (F.lit(t), F.array(*map(F.lit, ws)))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(detect_topics(q, triggers), lambda t: F.coalesce(F.element_at(known, t), none))))


def used_terms(q: Column, cap: int = 40, terms: dict[str, list[str]] | None = None, triggers: dict[str, list[str]] | None = None) -> Column:
    """The first `cap` terms that the query does not hold already (in lower case)."""
    return F.slice(F.filter(all_terms(q, terms, triggers), lambda t: ~F.contains(F.lower(q), F.lower(t))), 1, cap)


def expand_v2(q: Column, cap: int = 40, terms: dict[str, list[str]] | None = None, triggers: dict[str, list[str]] | None = None) -> Column:
    own = used_terms(q, cap, terms, triggers)
    return F.when(F.size(own) > 0, F.concat(q, F.lit(" "), F.array_join(own, " "))).otherwise(q)


def expand_v1(q: Column, table: dict[str, list[str]] | None = None) -> Column:
    """A keyword counts if the query has any of its words; terms are distinct and sorted."""
    words = F.split(F.trim(F.lower(q)), r"\s+")
    none = F.array().cast("array<string>")
    lists = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, k.split(" ")))), F.array(*map(F.lit, ws))).otherwise(none) for k, ws in _checked(table or V.KEYWORD_TERMS).items()]
    own = F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))
    return F.when(F.size(own) > 0, F.concat(q, F.lit(" "), F.array_join(own, " "))).otherwise(q)


def dictionary_sizes(dictionary: DataFrame, topic: str, term: str, trigger: str) -> DataFrame:
    """(topic, n_terms, n_triggers) of a dictionary that is a table, each counted once a topic."""
    return dictionary.groupBy(F.col(topic).alias("topic")).agg(F.countDistinct(term).alias("n_terms"), F.countDistinct(trigger).alias("n_triggers"))


def source_votes(q: Column) -> tuple[Column, Column]:
    low = F.lower(q)
    count = lambda ws: sum((low.contains(w).cast("int") for w in ws), F.lit(0))
    return count(V.HEDEX_WORDS), count(V.SPEC_WORDS)


def source_priority(q: Column) -> Column:
    h, s = source_votes(q)
    return F.when(h > s, "hedex").when(s > h, "3gpp").otherwise("both")
