"""URL filters, in DataFrame functions only.

Rules are rows of an index. Host and path rules are filed under their host; pattern rules are filed under their rarest
literal token: one pass counts how many urls hold each token that any rule names, and the lowest count decides. A url
asks for its host, for every parent domain and for each of its tokens by one equi-join with the broadcast index, and only
the patterns that it fetches run as regular expressions, so the work of a url does not depend on the number of rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import pick

#: Host and path rules: (verdict, rule).
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Pattern rules: (verdict, pattern over the lower-cased url). Every match holds all of the pattern's literal tokens whole.
PATTERN_RULES = (
    ("block", r"\bcheap-pills\b"),
    ("block", r"\bfree-bets\b"),
    ("block", r"\bcasino\b"),
    ("block", r"\bviagra\b"),
    ("block", r"\bporn\b"),
    ("block", r"\bxxx\b"),
    ("block", r"\bpayday-loans\b"),
    ("block", r"\bhot-singles\b"),
    ("block", r"\bwin-prizes?\b"),
    ("block", r"/wp-login\.php\b"),
    ("block", r"[?&]action=login\b"),
    ("allow", r"^[a-z]+://[^/?#]*\.edu/"),
)
#: The index is broadcast: at most so many rules of each kind, of some 200 bytes each; more are a mistake of the caller.
MAX_RULES = 200_000


def literal_tokens(pattern: str) -> list[str]:
    """Letter runs that every match of the pattern holds as whole tokens.

    Text under groups, classes, quantifiers or alternation is left out, so the answer may be short but is never wrong
    for patterns whose literal runs end at word boundaries or at literal punctuation.
    """
    if "|" in re.sub(r"\\.|\[[^\]]*\]", "", pattern):
        return []
    flat = re.sub(r"\[[^\]]*\]", "\x00", pattern)
    while (cut := re.sub(r"\([^()]*\)", "\x00", flat)) != flat:
        flat = cut
    flat = re.sub(r"\\b", "\x01", flat)
    flat = re.sub(r"\\[dwsDWSB.]", lambda m: "." if m[0] == r"\." else "\x00", flat)
    flat = re.sub(r"(.)(?:[?*]|\{[^}]*\})", "\x00", flat)
    found = []
    for m in re.finditer(r"[a-z0-9]+", flat):
        before, after = flat[m.start() - 1] if m.start() else "\x00", flat[m.end()] if m.end() < len(flat) else "\x00"
        if before not in "\x00+" and after not in "\x00+":
            found.append(m[0])
    return found


def _host(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    tail = F.expr("substring(_url, length(substring_index(_url, '://', 1)) + 4)")
    host = F.regexp_extract(tail, r"^([^/?#]*)", 1)
    return F.when(url.isNull() | (rest == url), "").otherwise(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _path(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    tail = F.expr("substring(_url, length(substring_index(_url, '://', 1)) + 4)")
    return F.when(url.isNull() | (rest == url), "").otherwise(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """How many urls hold each of the rules' tokens: at most as many rows as the rules have tokens."""
    if not tokens:
        return {}
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    held = pick(urls, _url=url_col).select(F.explode(_tokens(F.col("_url"))).alias("token")).join(F.broadcast(wanted), "token")
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_index(urls: DataFrame, host_rules, pattern_rules, url_col: str) -> DataFrame:
    """key, rules: host rules under their host, pattern rules under their rarest token, those without a token under "*".

    A rule is a struct of its number, kind ("h" or "p"), text, path and verdict. At most as many rows as there are rules.
    """
    literals = [literal_tokens(p) for _, p in pattern_rules]
    counts = token_counts(urls, url_col, sorted({t for x in literals for t in x}))
    rows = []
    for k, (verdict, rule) in enumerate(host_rules):
        host, slash, path = rule.partition("/")
        rows.append(("h:" + host, k, "h", rule, slash + path, verdict))
    for k, ((verdict, pattern), tokens) in enumerate(zip(pattern_rules, literals, strict=True)):
        key = "t:" + min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if tokens else "*"
        rows.append((key, k, "p", pattern, "", verdict))
    flat = urls.sparkSession.createDataFrame(rows, "key string, number int, kind string, text string, path string, verdict string")
    return flat.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("number", "kind", "text", "path", "verdict"))).alias("rules"))


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: `id_col`, host, path, rule, verdict, n_candidates, pattern.

    The longest host and path rule that fits decides (of rules of one length, the earlier); without one, the first pattern
    rule in their order that matches decides; else the verdict is allow. A url looks up its host, every parent domain and
    its tokens in the index, and only the rules that they fetch are tried: n_candidates counts the
    patterns among them, and pattern is the first that matches, also where a host rule decides.

    A null url, or one without "://", has an empty host and path and is allowed unless a pattern matches. Rows are judged
    one by one: repeated rows alike, null ids like others, a very long url whole; an empty table has no rows, and without
    rules all is allowed. Other columns are not read, whatever their names.
    """
    if len(host_rules) > MAX_RULES or len(pattern_rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    df = pick(pages, _id=id_col, _url=url_col).withColumn("_row", F.monotonically_increasing_id())
    df = df.select("_row", "_id", "_url", _host(F.col("_url")).alias("host"), _path(F.col("_url")).alias("path"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    keys = F.concat(F.array(F.lit("*")), F.array_distinct(parents), F.transform(_tokens(F.col("_url")), lambda t: F.concat(F.lit("t:"), t)))
    asked = df.withColumn("key", F.explode(keys))
    index = rule_index(pages, host_rules, pattern_rules, url_col)
    low = F.lower(F.coalesce("_url", F.lit("")))
    found = asked.join(F.broadcast(index), "key", "left")
    of_host = F.filter("rules", lambda r: (r["kind"] == "h") & F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(of_host, lambda r: F.struct(F.length(r["text"]).alias("size"), (-r["number"]).alias("order"), r["text"].alias("text"), r["verdict"].alias("verdict"))))
    tried = F.filter("rules", lambda r: r["kind"] == "p")
    first = F.array_min(F.transform(F.filter(tried, lambda r: F.regexp(low, r["text"])), lambda r: F.struct(r["number"].alias("order"), r["text"].alias("text"), r["verdict"].alias("verdict"))))
    found = found.select("_row", "_id", "host", "path", longest.alias("h"), first.alias("p"), F.coalesce(F.size(tried), F.lit(0)).alias("n"))
    # a url's rows come from one task, so all but one of them end before the shuffle
    best = found.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("h").alias("h"), F.min("p").alias("p"), F.sum(F.greatest("n", F.lit(0))).alias("n_candidates"))
    return best.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("h.text").alias("rule"),
        F.coalesce("h.verdict", "p.verdict", F.lit("allow")).alias("verdict"),
        "n_candidates",
        F.col("p.text").alias("pattern"),
    )
