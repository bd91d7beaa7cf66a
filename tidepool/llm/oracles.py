"""DuckDB SQL of those operators that SQL can express. Written from the contracts, not from the plans."""

from __future__ import annotations

from . import quality_rules as rules

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _distance(pairs: list[tuple[str, str]]) -> str:
    """Jensen-Shannon distance of two histograms given as pairs of shares."""
    part = lambda x, p, q: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0e0 END"
    return "sqrt(greatest(0e0, (" + " + ".join(f"{part(p, p, q)} + {part(q, p, q)}" for p, q in pairs) + ") / 2))"


def _rules() -> str:
    every = sorted({w for ref in rules.COMMON_WORDS.values() for w in ref})
    name = {w: f"c{i}" for i, w in enumerate(every)}
    share = {code: " + ".join(f"{name[w]} / np" for w in ref) for code, ref in rules.COMMON_WORDS.items()}
    of = {code: [(f"({name[w]} / np)", f"{q / 1000!r}e0") for w, q in ref.items()] + [("greatest(0e0, 1 - share)", f"{1 - sum(ref.values()) / 1000!r}e0")] for code, ref in rules.COMMON_WORDS.items()}
    total = sum(rules.CLASS_SHARES.values())
    classes = list(zip(("s1", "s2", "s3", "s4", "greatest(0e0, 1 - (s1 + s2 + s3 + s4))"), (f"{q / total!r}e0" for q in rules.CLASS_SHARES.values()), strict=True))
    codes = ", ".join(f"'{c}'" for c in rules.COMMON_WORDS)
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, {_WORDS})) AS w, generate_subscripts(regexp_extract_all(t, {_WORDS}), 1) AS i FROM d),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, unnest(range(i, i + 5)) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM twice GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM w GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, {_WORDS}) GROUP BY doc_id),
p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '')) AS p FROM d),
pc AS (SELECT doc_id, count(*) AS n, sum(length(p)) AS letters, {', '.join(f"count(*) FILTER (p = '{w}') AS {name[w]}" for w in every)} FROM p GROUP BY doc_id),
a AS (SELECT d.doc_id, lang, length(t) AS n_chars, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(pc.n, 0) AS n_plain, greatest(coalesce(pc.n, 0), 1) AS np, coalesce(letters, 0) AS letters, {', '.join(f'coalesce({c}, 0) AS {c}' for c in name.values())},
 length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[^.,;:!?''"()-]', '', 'g')) AS points FROM d LEFT JOIN cnt USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN pc USING (doc_id)),
b AS (SELECT *, letters / greatest(n_chars, 1) AS s1, digits / greatest(n_chars, 1) AS s2, (n_chars - word_chars) / greatest(n_chars, 1) AS s3, points / greatest(n_chars, 1) AS s4, list_max([{', '.join(f"{{'share': {s}, 'lang': '{c}'}}" for c, s in share.items())}]) AS near FROM a),
c AS (SELECT *, near.share AS share, near.lang AS nearest FROM b),
e AS (SELECT *, {_distance(classes)} AS class_distance, CASE nearest {' '.join(f"WHEN '{c}' THEN {_distance(x)}" for c, x in of.items())} END AS word_distance, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND ((lang IS NOT NULL AND lower(lang) NOT IN ({codes})) OR ((n_chars < {rules.MIN_CHARS} OR class_distance <= {rules.MAX_CLASS_DISTANCE}e0 + {rules.NOISE}e0 / sqrt(n_chars)) AND (n_words < {rules.MIN_WORDS} OR word_distance <= {rules.MAX_WORD_DISTANCE}e0 + {rules.NOISE}e0 / sqrt(greatest(n_plain, 1))))) AS kept FROM e"""


#: Bytes as pairs of hex digits, in slices of 561 bytes (512 strings): every string of 50 bytes with the least document it starts in, then the runs that go.
_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, b, substr(h, 2 * b + 1, 2 * 561) AS part FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 512)) AS b FROM d)),
s AS (SELECT doc_id, b + j AS i, substr(part, 2 * j + 1, 100) AS w FROM (SELECT doc_id, b, part, unnest(range(length(part) // 2 - 49)) AS j FROM c)),
f AS (SELECT w, min(doc_id) AS lo FROM s GROUP BY w HAVING count(*) > 1),
hit AS (SELECT s.doc_id, i, lag(i) OVER (PARTITION BY s.doc_id ORDER BY i) AS b FROM s JOIN f USING (w) WHERE lo < s.doc_id),
isl AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
runs AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM isl GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * y + 1 AS BIGINT), CAST(2 * (a - y) AS BIGINT)), '' ORDER BY a) || substr(max(h), CAST(2 * max(z) + 1 AS BIGINT)) AS rest, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Masks of failures by document, all orders as paths over the letters, and each step's counts from the masks.
_AUDIT = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
 CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
 || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f FROM d LEFT JOIN l USING (doc_id)),
e(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.k || b.k || c.k || g.k || h.k AS filter_order FROM e a, e b, e c, e g, e h WHERE len(list_distinct([a.k, b.k, c.k, g.k, h.k])) = 5),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
x AS (SELECT part, filter_order, step, n, good, toxic, contains(f, filter_order[step]) AS hit,
 len(list_filter(string_split(left(filter_order, step - 1), ''), lambda k: k <> '' AND contains(f, k))) > 0 AS gone, length(f) AS fails FROM c, s),
r AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
 coalesce(sum(n) FILTER (hit AND fails = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM r"""

#: CRC-32 byte by byte from its table, words counted, near words by what they have in common when a letter is left out, forms followed to their roots.
_SPELLING = """WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY doc_id, run),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c)::BIGINT >> 6), 128 | (unicode(c)::BIGINT & 63)] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tab),
w AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, n FROM h) WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
v AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
k AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS best FROM p GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN best.near END AS form, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n FROM w LEFT JOIN k USING (word)),
t AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT t.word, f.form, depth + 1 FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, depth) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, form_n FROM f JOIN t USING (word) GROUP BY f.word, form, f.n, f.n_near, form_n"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _rules(), "op4_suffix_dedup": _REPEATS, "op11_spelling": _SPELLING, "op12_filter_audit": _AUDIT}
