"""DuckDB SQL of the operators that SQL can express, over the table documents."""

from __future__ import annotations

from quern.llm.quality_rules import FENCE, RULES, SKETCH_BITS, above, rate

_WORDS = r"list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda x: x <> '')"

NEAR_DEDUP = f"""
WITH RECURSIVE lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
worded AS (SELECT doc_id, {_WORDS} AS w FROM lowered),
shingled AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM worded UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""

_DROP = f"greatest(length(bin(value)) - {SKETCH_BITS}, 0)"
_RATES = ", ".join(f"({rate(k, '//')})::BIGINT AS {k}" for k in RULES)
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {k} AS value FROM measured WHERE NOT base_failed" for k in RULES)
_WIDE = ", ".join(f"max(lim) FILTER (WHERE rule = '{k}')::BIGINT AS {k}_limit" for k in RULES)
_ABOVE = " OR ".join(above(k) for k in RULES)

QUALITY_RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, {_WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS lines FROM docs),
runs AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS times FROM (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM worded WHERE len(w) >= 8))),
covered AS (SELECT r, sum(least(8, coalesce(after - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM runs WHERE times > 1) GROUP BY r),
counted AS (SELECT worded.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x09-\x0D\x20]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))::BIGINT AS n_echoes, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM worded LEFT JOIN covered ON worded.r = covered.r),
measured AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_RATES} FROM counted),
rates AS ({_LONG}),
sketch AS (SELECT lang, source, rule, (((value >> {_DROP}) + 1) << {_DROP}) - 1 AS bucket, count(*) AS n FROM rates GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM sketch),
quartiles AS (SELECT lang, source, rule, min(bucket) FILTER (WHERE seen >= (total + 3) // 4) AS q1, min(bucket) FILTER (WHERE seen >= (total * 3 + 3) // 4) AS q3 FROM ranked GROUP BY ALL),
limited AS (SELECT lang AS l, source AS s, {_WIDE} FROM (SELECT lang, source, rule, q3 + {FENCE} * (q3 - q1) AS lim FROM quartiles) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_ABOVE}) AS kept, {", ".join(RULES)}, {", ".join(f"{k}_limit" for k in RULES)}
FROM measured LEFT JOIN limited ON lang IS NOT DISTINCT FROM l AND source IS NOT DISTINCT FROM s
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: CRC-32 of a text in ASCII: one step for each byte, and in it one for each bit.
_BIT = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
_CRC = f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {_BIT})))"""

MANIFEST = f"""
WITH RECURSIVE hashed AS (SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bad FROM documents),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM hashed),
low(tree, lvl, i, d) AS (SELECT tree, 0, i, leaf FROM leaves UNION ALL
    SELECT * FROM (SELECT tree, lvl + 1, i // 8 AS j, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, lvl, i // 8)),
subroots AS (SELECT tree, max_by(d, lvl) AS d, max(lvl) AS height FROM low GROUP BY tree),
high(lvl, i, d) AS (SELECT 0, tree - 1, d FROM subroots UNION ALL
    SELECT * FROM (SELECT lvl + 1, i // 8 AS j, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY lvl, i // 8)),
roots AS (SELECT max_by(d, lvl) AS d FROM high),
nodes AS (SELECT tree, lvl, i, low.d FROM low JOIN subroots USING (tree) WHERE lvl < height UNION ALL
    SELECT subroots.tree, height + high.lvl, high.i, high.d FROM high, subroots WHERE high.lvl < (SELECT max(lvl) FROM high)),
runs AS (SELECT tree, lvl, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM nodes WINDOW w AS (PARTITION BY tree, lvl, i // 8 ORDER BY i)),
places AS (SELECT r, tree, k.lvl, CASE WHEN k.lvl < height THEN i // (8::BIGINT ** k.lvl)::BIGINT ELSE (tree - 1) // (8::BIGINT ** (k.lvl - height))::BIGINT END AS i
    FROM leaves l JOIN subroots USING (tree), (SELECT DISTINCT lvl FROM nodes) k),
paths AS (SELECT r, list(before ORDER BY p.lvl) AS b, list(after ORDER BY p.lvl) AS a FROM places p JOIN runs USING (tree, lvl, i) GROUP BY r),
folds(r, k, d) AS (SELECT r, 0, coalesce(bad, leaf) FROM leaves UNION ALL SELECT f.r, k + 1, sha256(b[k + 1] || d || a[k + 1]) FROM folds f JOIN paths USING (r) WHERE k < len(b)),
folded AS (SELECT r, max_by(d, k) AS d FROM folds GROUP BY r)
SELECT doc_id, leaf, s.d AS subroot, roots.d AS root, sha256(array_to_string(list_transform(coalesce(b, []), lambda x, i: x || a[i]), '')) AS proof_sha256, f.d AS folded_root, f.d = roots.d AS verified
FROM leaves JOIN subroots s USING (tree) JOIN folded f USING (r) LEFT JOIN paths USING (r), roots
"""

_P = "1 + 1000000000::HUGEINT * ({n} + 1) // ({all} + v)"
_F = "(p - q) * (p - q) // q"

DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang) LEFT JOIN cells c USING (lang, source) GROUP BY lang, source),
rates AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", all="total")} AS p FROM groups g JOIN kept USING (lang) LEFT JOIN cells c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({_F}) AS value FROM rates a JOIN (SELECT lang, source, term, p AS q FROM rates) b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
tops AS (SELECT lang, source, term AS item, {_F} AS value FROM (SELECT r.*, {_P.format(n="k.n", all="l.n")} AS q FROM rates r JOIN kept k USING (lang, term) JOIN langs l USING (lang) WHERE r.n > 0) WHERE p > q),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', item, value FROM tops)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts) WHERE part = 'pair' OR rank <= 200
"""
