"""DuckDB SQL for the operators that SQL can express."""

from tarnwick.llm.url_rules import HOST_RULES, PATTERN_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]"

#: A repeat of more than 40 words is a window of 41 words found twice.
REPETITION = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
grams AS (SELECT doc_id, n, k, array_to_string(ws[k + 1:k + n], chr(0)) AS g FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS k FROM w, (VALUES (8), (41)) s(n) WHERE len(ws) >= n)),
twice AS (SELECT doc_id, n, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM twice WHERE n = 8) GROUP BY doc_id),
long AS (SELECT DISTINCT doc_id, true AS is_long FROM twice WHERE n = 41),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(is_long, false) AS is_long
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN long USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT is_long AS kept FROM base"""

_BY_LENGTH = sorted(HOST_RULES, key=lambda x: -len(x[1]))


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


URL_RULES = rf"""
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE {" ".join(f"WHEN {_fits(rule)} THEN '{rule}'" for _, rule in _BY_LENGTH)} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{rule}' THEN '{verdict}'" for verdict, rule in _BY_LENGTH)}
 {" ".join(f"WHEN regexp_matches(low, '{pattern}') THEN '{verdict}'" for verdict, pattern in PATTERN_RULES)} ELSE 'allow' END AS verdict FROM r"""

#: The pages of these tables: one marked-up article each.
HTML_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1) AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c"""


def _words(alias: str, table: str, key: str) -> str:
    return rf"{alias} AS (SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {table})"


DECONTAMINATE = f"""
WITH {_words("d", "documents", "doc_id")}, {_words("i", "benchmark", "item_id")},
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k + 1:k + 13], ' ') AS g FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k + 1:k + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, k, n, item_id FROM dw JOIN win USING (g, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS digest FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

RANKED = f"""
WITH {_words("d", "documents", "doc_id")}, {_words("i", "benchmark", "item_id")},
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
tot AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, tot GROUP BY term),
m AS (SELECT doc_id, 10 + (90 * len(w) * n_all) // l_all AS m FROM d, tot),
q AS (SELECT item_id, unnest(list_distinct(w)) AS term FROM i),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN wt USING (term) JOIN post USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

def _edit(state: str, cost: str, letter: str, line: str = "''") -> str:
    """DuckDB: a state's cheapest edits (cost, audit, repaired lines), and one edit more."""
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', r := {state}.r || {line})"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"


def _inserted(s: str) -> tuple[str, str]:
    """DuckDB: states 2 and 3 after any insertions."""
    twos = ", ".join(_edit(f"{s}{k}", "3", "I", _USER) for k in (0, 1, 3))
    threes = ", ".join(_edit(f"{s}{k}", "6", "II", f"{_USER} || {_ASSISTANT}") for k in (0, 1))
    return f"list_min([{s}2, {twos}])", f"list_min([{s}3, {_edit(s + '2', '3', 'I', _ASSISTANT)}, {threes}])"


_TWO, _THREE = _inserted("s")
_OFF, _SAID = "CASE WHEN must THEN 1000000000 ELSE more END", "chr(10) || role || ':' || text"
_SET = "struct_pack(c := {}, a := '', r := '')"
#: One step a turn for all conversations; a thousand million stands for what can't be.
REPAIR = rf"""
WITH RECURSIVE crcs AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS d FROM keyed, crcs),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), text, copy) AS k FROM damaged),
told AS (SELECT conv_id, turn, k, role, text, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '([^ 	-])[ 	-]*\z', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
turns AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, lead(initial) OVER (PARTITION BY conv_id ORDER BY k) AS after FROM told),
st AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, {_SET.format("CAST(0 AS BIGINT)")} AS s0, {_SET.format("CAST(1000000000 AS BIGINT)")} AS s1, {_SET.format("CAST(1000000000 AS BIGINT)")} AS s2, {_SET.format("CAST(1000000000 AS BIGINT)")} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, k, {_edit("s0", "4", "D")}, list_min([{_edit("s1", "4", "D")}, {_edit("s0", f"CASE WHEN initial = 's' THEN {_OFF} ELSE 1000000000 END", "K", _SAID)}]),
   list_min([{_edit("t2", "4", "D")}, {", ".join(x for t in ("s0", "s1", "t3") for x in (_edit(t, f"3 + {_OFF}", "R", f"{_USER} || text"), _edit(t, f"CASE WHEN initial = 'u' THEN {_OFF} ELSE 1000000000 END", "K", _SAID)))}]),
   list_min([{_edit("t3", "4", "D")}, {_edit("t2", f"3 + {_OFF}", "R", f"{_ASSISTANT} || text")}, {_edit("t2", f"CASE WHEN initial = 'a' THEN {_OFF} ELSE 1000000000 END", "K", _SAID)}])
  FROM (SELECT st.conv_id, turns.k, role, text, initial, must, more, s0, s1, {_TWO} AS t2, {_THREE} AS t3 FROM st JOIN turns ON turns.conv_id = st.conv_id AND turns.k = st.k + 1)),
per AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (after IS NOT NULL AND initial || after NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
best AS (SELECT st.conv_id, list_min([s0, {_THREE}]) AS b FROM st LEFT JOIN per USING (conv_id) WHERE k = coalesce(n, 0))
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(substr(b.r, 2)) AS repaired_sha256
FROM best LEFT JOIN per USING (conv_id)"""

ORACLES = {"op2_repetition": REPETITION, "op3_url_rules": URL_RULES, "op4_host_suffix_array": HTML_TEXT, "op5_decontaminate": DECONTAMINATE, "op12_inverted_treaps": RANKED, "op13_turn_matrices": REPAIR}
