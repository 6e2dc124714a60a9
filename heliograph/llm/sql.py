"""DuckDB SQL of the operators that SQL can express: windows and lines compared as they are, without hashes."""

from __future__ import annotations

from heliograph.llm.quality_rules import BOILERPLATE, SYMBOLS, Rules

_SPLIT = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM g),
f AS (SELECT gram, min(doc_id) AS first FROM s GROUP BY gram),
hit AS (SELECT doc_id, i FROM s JOIN f USING (gram) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def quality_sql(rules: Rules = Rules()) -> str:
    symbols = "[" + "".join("\\" + c for c in SYMBOLS) + "]"
    count = lambda text, form: f"(length({text}) - length(regexp_replace({text}, '{form}', '', 'g')))"
    phrases = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - {rules.window - 2})) AS i, w FROM d WHERE len(w) > {rules.window}),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {rules.window - 1}], ' ') AS gram FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1), (SELECT unnest(range(0, {rules.window})) AS k) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d),
l1 AS (SELECT doc_id, line, p, {_SPLIT.format("line")} AS w FROM l0),
l2 AS (SELECT doc_id, line, w, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) > 1 AS seen FROM l1 WHERE len(w) > 0),
l3 AS (SELECT doc_id, chars, seen, 100 * {count("line", symbols)} > {rules.max_symbol_percent} * chars
OR (len(list_filter(w, lambda x: x = '|')) >= {rules.min_bars} AND len(list_filter(w, lambda x: x = '|')) * {rules.words_per_bar} >= n)
OR (n >= {rules.min_shout_words} AND 2 * {count("line", "!")} >= n AND 10 * {count("line", "[A-Z]")} >= 9 * {count("line", "[A-Za-z]")})
OR (n >= {rules.min_stutter_words} AND 2 * len(list_filter(range(2, n + 1), lambda i: w[i] = w[i - 1])) > n)
OR (seen AND n >= {rules.min_bars}) OR (n <= 12 AND ({phrases})) AS fails FROM l2),
l4 AS (SELECT doc_id, count(*) FILTER (seen) AS dup, coalesce(sum(chars) FILTER (fails), 0) AS lost, sum(chars) AS chars FROM l3 GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, coalesce(chars, 0) AS word_chars, {count("text", symbols)} AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
FROM d LEFT JOIN l4 USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
base_failed, NOT base_failed AND 100 * lost <= {rules.max_lost_percent} * word_chars AS kept FROM b
"""
