"""DuckDB SQL for the corpus queries that SQL can express; the others are held against brute force in tests."""

from __future__ import annotations

from .quality_rules import BASE, FULL, RULES

_SPACE = r"[\x20\x09-\x0D]"

OP3 = """
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY 1),
r AS (SELECT source, CASE WHEN chars > 0 THEN pow(chars, 0.7) / (SELECT sum(pow(chars, 0.7)) FROM s) * (SELECT sum(chars) FROM s) / chars ELSE 1.0 END AS rate FROM s),
c AS (SELECT source, rate, list_transform(range(80), lambda k: exp(k * ln(rate) - rate - lgamma(k + 1))) AS pmf FROM r),
f AS (SELECT source, rate, list_transform(range(1, 81), lambda k: list_sum(pmf[1:k])) AS cdf FROM c),
d AS (SELECT doc_id, source, text, CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT doc_id, d.source, text, rate, CAST(len(list_filter(cdf, lambda x: x <= u)) AS INTEGER) AS n_copies FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, source, CAST(unnest(range(n_copies)) AS INTEGER) AS copy, n_copies, round(rate, 6) AS rate, text FROM n
"""

_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))

OP6 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM p),
x AS (SELECT r, count(DISTINCT i + d) AS n FROM q, (SELECT unnest([0, 1, 2]) AS d) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
 coalesce(x.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN x USING (r)),
b AS (SELECT *, {_BITS} AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
 n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed_bits, 'full-1' AS policy, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_upper AS BIGINT) AS n_upper FROM b
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS n FROM documents),
k AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, sha256(n) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

_RULE_ROWS = " UNION ALL ".join(
    f"SELECT '{policy.version}' AS version, '{rule}' AS rule, CAST(count(*) FILTER (WHERE (failed & {1 << list(RULES).index(rule)}) <> 0) AS BIGINT) AS n_failed,"
    f" CAST(count(*) FILTER (WHERE (failed & {policy.mask}) = {1 << list(RULES).index(rule)}) AS BIGINT) AS n_only FROM b"
    for policy in (BASE, FULL)
    for rule in policy.rules
)
LEDGER = OP6[: OP6.rindex("SELECT doc_id")] + _RULE_ROWS

OP10 = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM d),
p AS (SELECT doc_id, k, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS pair FROM l),
f AS (SELECT doc_id, k, pair, first_value(doc_id) OVER w AS fd, first_value(k) OVER w AS fk FROM p WHERE pair IS NOT NULL WINDOW w AS (PARTITION BY pair ORDER BY doc_id, k)),
g AS (SELECT DISTINCT doc_id, k + i AS k FROM f, (SELECT unnest([0, 1]) AS i) WHERE doc_id > fd OR k > fk + 1),
c AS (SELECT doc_id, count(*) AS gone, count(*) FILTER (WHERE NOT again) AS runs FROM (SELECT doc_id, k, coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k) = k - 1, FALSE) AS again FROM g) GROUP BY 1),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.k) AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.k = l.k WHERE g.k IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_chunks_removed, CASE WHEN gone IS NULL THEN text ELSE coalesce(kept, '') END AS text
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

ORACLE_SQL = {"op10_line_dedup": OP10, "quality_ablation": LEDGER, "op3_mixing": OP3, "op6_quality_rules": OP6, "op8_exact_dedup": OP8}
