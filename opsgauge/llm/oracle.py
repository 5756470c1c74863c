"""The SQL that the text queries must equal, for those that SQL can express.

Not here: sharding and mixing (random draws), the classifier (hashed counts), the secret scan
(a compressor), the pseudonyms (a keyed network) and the token alignment (tokenizers).  They are tested by brute force, by
invariants and by held-out accuracy.
"""

from __future__ import annotations

from opsgauge.llm.quality_rules import (
    COMMON_WORDS,
    MAX_CHAR_DISTANCE,
    MAX_WORD_DISTANCE,
    MIN_CHARS,
    MIN_WORDS,
)
from opsgauge.llm.url_filter import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


def _normal_words(text: str) -> str:
    return f"regexp_extract_all(coalesce({_lower(text)}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_normal_words("text")} AS words FROM documents),
items AS (SELECT item_id, {_normal_words("text")} AS words FROM benchmark),
item_grams AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size,
         array_to_string(words[pos : pos + least(len(words), 10) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS t(pos) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM item_grams),
doc_grams AS (
  SELECT doc_id, size, pos, array_to_string(words[pos : pos + size - 1], ' ') AS gram
  FROM docs, sizes, unnest(range(1, len(words) - size + 2)) AS t(pos) WHERE len(words) >= size),
found AS (SELECT d.doc_id, d.pos, d.size, i.item_id FROM doc_grams d JOIN item_grams i USING (size, gram)),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT DISTINCT doc_id, pos, size FROM found), unnest(range(pos, pos + size)) AS t(place) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_NEAR = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words(_lower("text"))} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos : pos + least(len(words), 4) - 1], ' ') AS s, least(len(words), 4) AS size
  FROM docs, unnest(range(1, greatest(len(words) - 4, 0) + 2)) AS t(pos) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.size = b.size AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * pairs.n >= 80 * (x.n + y.n - pairs.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
found AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM found LEFT JOIN sizes USING (doc_id)
"""

_REPEATS = f"""
WITH docs AS (SELECT doc_id, {_words("text")} AS words FROM documents),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos : pos + 19], ' ') AS gram
  FROM docs, unnest(range(1, len(words) - 18)) AS t(pos) WHERE len(words) >= 20),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS place FROM windows),
gone AS (
  SELECT DISTINCT doc_id, word_at FROM ranked, unnest(range(pos, pos + 20)) AS t(word_at) WHERE place > 1),
spread AS (SELECT doc_id, word_at, words[word_at] AS word FROM docs, unnest(range(1, len(words) + 1)) AS t(word_at)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word_at) AS text
  FROM spread ANTI JOIN gone USING (doc_id, word_at) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


def _quality() -> str:
    def count(pattern: str) -> str:
        return f"length(regexp_replace(t, '{pattern}', '', 'g'))"

    order = ["[a-z]", "[\\x20\\x09-\\x0D]", "[A-Z]", "[0-9]", "[^\\x00-\\x7F]", "[#*$%&|<>]"]
    chars = ", ".join(f"length(t) - {count(pattern)}" for pattern in order)
    listed = " ".join(
        f"WHEN '{lang}' THEN [" + ", ".join(f"'{word}'" for word in words) + "]" for lang, words in COMMON_WORDS.items()
    )
    cased = sorted({form for words in COMMON_WORDS.values() for word in words for form in (word, word.capitalize())})
    known = "[" + ", ".join(f"'{word}'" for word in cased) + "]"

    def distance(p: str, q: str) -> str:
        # Both as shares; 0 x log 0 is 0.
        def part(x: str, y: str) -> str:
            return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"

        x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
        terms = f"list_transform(range(1, len({p}) + 1), lambda i: {part(x, y)} + {part(y, x)})"
        return f"sqrt(greatest(list_sum({terms}) / 2, 0))"

    return f"""
WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {_words("text")} AS words, CASE lang {listed} END AS listed FROM documents),
shaped AS (
  SELECT *, [{chars}] AS parts,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         list_transform(list_filter(words, lambda w: list_contains({known}, w)), lambda w: lower(w)) AS hits
  FROM docs),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos : pos + 4], ' ') AS gram
  FROM docs, unnest(range(1, len(words) - 3)) AS s(pos) WHERE len(words) >= 5),
again AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM again, unnest(range(pos, pos + 5)) AS s(place) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, parts[6] AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         list_append(parts, length(t) - list_sum(parts)) AS chars,
         list_append(
           list_transform(listed, lambda c: len(list_filter(hits, lambda h: h = c))),
           len(words) - len(list_filter(hits, lambda h: list_contains(listed, h)))) AS common,
         length(t) AS n_chars, listed
  FROM shaped LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM counted),
spread AS (
  SELECT lang, i, sum(chars[i]) AS c, sum(common[i]) AS w
  FROM judged, unnest(range(1, 14)) AS s(i) WHERE listed IS NOT NULL AND NOT base_failed GROUP BY lang, i),
reference AS (
  SELECT lang, list(c ORDER BY i) FILTER (c IS NOT NULL) AS ref_chars, list(w ORDER BY i) AS ref_common
  FROM spread GROUP BY lang),
measured AS (
  SELECT judged.*, 
         CASE WHEN n_chars >= {MIN_CHARS} AND list_sum(ref_chars) > 0 THEN {distance("chars", "ref_chars")} END AS char_distance,
         CASE WHEN n_words >= {MIN_WORDS} AND list_sum(ref_common) > 0 THEN {distance("common", "ref_common")} END AS word_distance
  FROM judged LEFT JOIN reference USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(char_distance <= {MAX_CHAR_DISTANCE}, true)
       AND coalesce(word_distance <= {MAX_WORD_DISTANCE}, true) AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM measured
"""


def _urls() -> str:
    """Own rules; the tables' pages have neither redirects nor canonical links."""
    rules = ", ".join(
        f"('{verdict}', '{host}', '{path}', '{host + path}', {len(host + path)})" for verdict, host, path in RULES
    )
    return f"""
WITH rules(verdict, of_host, of_path, rule, size) AS (VALUES {rules}),
pages2 AS (
  SELECT page_id, {_lower("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^?#]*(\\?[^#]*)', 1) AS query
  FROM pages),
best AS (
  SELECT page_id, max_by(rule, 2 * size + (verdict = 'allow')::INT) AS rule,
         max_by(verdict, 2 * size + (verdict = 'allow')::INT) AS verdict
  FROM pages2 JOIN rules ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, of_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, host || path || query AS alias_of
FROM pages2 LEFT JOIN best USING (page_id)
"""


_TRIE = """
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (
  SELECT *, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                   lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS steps
  FROM turns),
shared AS (
  SELECT conv_id, turns,
         CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), steps),
              lambda crc, step: xor(xor(crc, step) >> 1, 3988292384 * (xor(crc, step) & 1))), 4294967295) % 6 AS INT) AS h
  FROM bits),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(t.turns[1 : s.h], []), s.turns[s.h + 1 :]) AS turns
  FROM shared s LEFT JOIN turns t ON t.conv_id = s.conv_id - s.conv_id % 100),
steps AS (SELECT conv_id, len(turns) AS size, d, turns[1 : d] AS path FROM rebuilt, unnest(range(0, len(turns) + 1)) AS t(d)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM steps GROUP BY path, d),
kids AS (SELECT path[1 : d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(path[d].text) END AS saved
  FROM nodes LEFT JOIN kids USING (path, d)),
sums AS (
  SELECT path[1 : up] AS path, up AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM own, unnest(range(0, d + 1)) AS t(up) GROUP BY ALL)
SELECT own.conv_id, own.d AS depth, above.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN sums USING (path, d) LEFT JOIN nodes above ON above.path = own.path[1 : own.d - 1] AND above.d = own.d - 1
"""

_LINES = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, {_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
many AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, pos, line, keeper IS NULL OR doc_id = keeper AS stays FROM keyed LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


ORACLE: dict[str, str] = {
    "op1_decontamination": _DECONTAMINATION,
    "op3_minhash_near_dedup": _NEAR,
    "op4_quality_rules": _quality(),
    "op6_substring_dedup": _REPEATS,
    "op8_url_filter": _urls(),
    "op11_prefix_trie": _TRIE,
    "op12_line_dedup": _LINES,
}
