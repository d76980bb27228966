"""SQL for DuckDB that gives the rows of the native corpus queries, written by itself from their definitions."""

from __future__ import annotations

from plinth.llm import quality_rules as Q
from plinth.llm import secret_scan as S


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _term(p: str, q: str) -> str:
    half = lambda x: f"(CASE WHEN {x} > 0 THEN 0.5 * {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END)"
    return f"({half(p)} + {half(q)})"


def quality_rules_sql() -> str:
    listed = ", ".join(f"({_text(k)}, {_text(w)})" for k, ws in Q.COMMON_WORDS.items() for w in dict.fromkeys(ws))
    blank = "'[\\x20\\x09-\\x0D]+'"
    names = ", ".join(map(_text, Q.COMMON_WORDS))
    lower, upper, letter = r"\p{Ll}+", r"\p{Lu}+", r"\p{L}"
    count = lambda pattern: f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"
    return f"""
WITH fixed(lang, word) AS (VALUES {listed}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, {blank}), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
other AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(ws) AS word FROM w WHERE lang NOT IN ({names})) GROUP BY lang, word),
listed AS (SELECT * FROM fixed UNION ALL SELECT lang, word FROM other WHERE regexp_matches(word, {_text(letter)}) AND lang IN (SELECT lang FROM other GROUP BY lang HAVING sum(n) >= {Q.MIN_REFERENCE})
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {Q.COMMON}),
g AS (SELECT r, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1)) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count('[#*$%&|<>]+')} AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(text) AS n_chars,
    {count(lower)} AS low, {count(upper)} AS up, {count('[0-9]+')} AS dig, ws FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {Q.MIN_BASE_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed, [low, up, dig, n_symbols, n_chars - word_chars, word_chars - low - up - dig - n_symbols] AS cs FROM m),
ref AS (SELECT lang, sum(n_words) AS words, list_transform([sum(cs[1]), sum(cs[2]), sum(cs[3]), sum(cs[4]), sum(cs[5]), sum(cs[6])], lambda x: x / sum(n_chars)) AS q FROM b WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= {Q.MIN_REFERENCE}),
c AS (SELECT r, b.lang, word, count(*) AS n FROM (SELECT r, lang, unnest(ws) AS word FROM b WHERE NOT base_failed) b JOIN listed USING (lang, word) GROUP BY ALL),
rw AS (SELECT l.lang, l.word, coalesce(sum(c.n), 0) / any_value(ref.words) AS q FROM listed l JOIN ref USING (lang) LEFT JOIN c ON c.lang = l.lang AND c.word = l.word GROUP BY l.lang, l.word),
jw AS (SELECT r, sum({_term('p', 'q')}) + {_term('(1 - sum(p))', '(1 - sum(q))')} AS d FROM (SELECT b.r, coalesce(c.n, 0) / b.n_words AS p, rw.q FROM b JOIN rw ON b.lang = rw.lang LEFT JOIN c ON c.r = b.r AND c.word = rw.word WHERE b.n_words >= {Q.MIN_WORDS} AND NOT base_failed) GROUP BY r),
jc AS (SELECT r, list_sum(list_transform(list_zip(list_transform(cs, lambda x: x / n_chars), q), lambda z: {_term('z[1]', 'z[2]')})) AS d FROM b JOIN ref USING (lang) WHERE n_words >= {Q.MIN_WORDS} AND NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(sqrt(greatest(jc.d, 0)) > {Q.MAX_CHAR_DISTANCE}, FALSE)
    AND NOT coalesce(sqrt(greatest(jw.d, 0)) > CASE WHEN lang IN ({names}) THEN {Q.MAX_WORD_DISTANCE} ELSE {Q.MAX_COUNTED_DISTANCE} END, FALSE) AS kept
FROM b LEFT JOIN jc USING (r) LEFT JOIN jw USING (r)
"""


def secret_scan_sql() -> str:
    def places(kind: str, pattern: str, group: int) -> str:
        return f"(SELECT r, {_text(kind)} AS kind, {S.KINDS.index(kind)} AS k, string_split_regex(text, {_text(pattern)}) AS gaps, regexp_extract_all(text, {_text(pattern)}, 0) AS ms, regexp_extract_all(text, {_text(pattern)}, {group}) AS vs FROM d)"

    found = " UNION ALL ".join(f"SELECT * FROM {places(*x)}" for x in (("assign", S.ASSIGN, 2), ("access", S.ACCESS, 0), ("hex", f"[0-9a-f]{{{S.LEAST['hex']},}}", 0), ("entropy", S.CANDIDATE, 0)))
    allowed = " OR ".join(f"regexp_matches(v, {_text(p)})" for p in S.ALLOW)
    least = "CASE " + " ".join(f"WHEN regexp_full_match(v, {_text(p)}) THEN {x}" for _, p, _, x in S.CHARACTER_CLASSES) + " END"
    short = " ".join(f"WHEN {_text(k)} THEN {n}" for k, n in S.LEAST.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
s AS (SELECT r, kind, k, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS a, unnest(ms) AS m, unnest(vs) AS v FROM f),
base AS (SELECT r, kind, k, a, a + length(m) AS b FROM s WHERE kind <> 'entropy' AND length(v) >= CASE kind {short} END),
win AS (SELECT r, a AS c0, {least} AS least, v, unnest(range(0, length(v) - {S.WINDOW - 1})) AS i FROM s WHERE kind = 'entropy' AND NOT ({allowed})),
high AS (SELECT r, c0, i FROM win WHERE round(list_aggregate(string_split(substr(v, i + 1, {S.WINDOW}), ''), 'entropy'), 9) >= least),
runs AS (SELECT r, c0, i, sum(fresh) OVER (PARTITION BY r, c0 ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r, c0 ORDER BY i) + {S.WINDOW} THEN 0 ELSE 1 END AS fresh FROM high)),
more AS (SELECT r, 'entropy' AS kind, {S.KINDS.index('entropy')} AS k, c0 + min(i) AS a, c0 + max(i) + {S.WINDOW} AS b FROM runs GROUP BY r, c0, run),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE NOT EXISTS (FROM base WHERE base.r = more.r AND base.a <= more.a AND more.b <= base.b)),
t AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (kind <> 'entropy') AS bs, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM d LEFT JOIN t USING (r)
"""


def prefix_trie_sql() -> str:
    """Nodes as digests of whole beginnings; subtree totals by adding every node to all its ancestors."""
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_prepend(ascii(c)::BIGINT, list_transform(range(8), lambda k: (-1)::BIGINT))))), lambda a, x: {step}), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, length(role) || ':' || role || text AS said, length(text) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS donor, {crc} % 6 AS h FROM t GROUP BY conv_id),
g AS (SELECT c.conv_id, c.h, least(c.h, coalesce(d.n, 0)) AS got, c.donor FROM c LEFT JOIN c d ON d.conv_id = c.donor),
r AS (SELECT g.conv_id, o.pos, o.said, o.chars FROM g JOIN o ON o.conv_id = g.donor AND o.pos <= g.got
    UNION ALL SELECT g.conv_id, o.pos - g.h + g.got, o.said, o.chars FROM g JOIN o ON o.conv_id = g.conv_id AND o.pos > g.h),
p AS (SELECT conv_id, 0 AS depth, '' AS node, NULL AS up, 0 AS chars FROM c
    UNION ALL SELECT conv_id, pos, sha256(string_agg(sha256(said), '') OVER w), CASE WHEN pos = 1 THEN '' ELSE sha256(string_agg(sha256(said), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END, chars
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
s AS (SELECT conv_id, max(depth) AS size FROM p GROUP BY conv_id),
n AS (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256 FROM p JOIN s USING (conv_id) GROUP BY depth, node),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (SELECT p.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.own) AS saved_tokens FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node)
SELECT f.conv_id::BIGINT AS conv_id, f.depth::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
    u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (node) LEFT JOIN f up ON up.node = f.up
"""


def fill_in_middle_sql() -> str:
    """Units as a list of matches; parts are slices of it."""
    draw = lambda k: f"('0x' || substr(s, {8 * k + 1}, 8))::BIGINT"
    part = lambda a, b: f"array_to_string(us[{a}:{b}], '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS us, {draw(0)} AS h1, {draw(1)} AS h2,
    CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR {draw(2)} % 100 >= 90 THEN 'plain' WHEN {draw(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
p AS (SELECT *, {part(1, 'a')} AS prefix, {part('a + 1', 'b')} AS middle, {part('b + 1', 'n')} AS suffix FROM c)
SELECT doc_id::BIGINT AS doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
