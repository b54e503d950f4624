"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import licenses, quality_rules, spelling, substrings

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

# A byte goes when a string that covers it starts in a document with a smaller id.
OP3 = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, '')))::bigint AS n FROM documents),
s AS (SELECT doc_id, p, md5(x[p + 1:p + {substrings.LENGTH}]) AS h FROM (SELECT doc_id, x, unnest(generate_series(0, n - {substrings.LENGTH})) AS p FROM d WHERE n >= {substrings.LENGTH})),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.p FROM s JOIN f USING (h) WHERE f.first < s.doc_id),
o AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {substrings.LENGTH} THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM o),
a AS (SELECT doc_id, g, min(p) AS a, max(p) + {substrings.LENGTH} AS z FROM g GROUP BY doc_id, g),
k AS (SELECT a.doc_id, a.a, a.z, hex(d.x[coalesce(lag(a.z) OVER w, 0) + 1:a.a]) AS kept FROM a JOIN d USING (doc_id) WINDOW w AS (PARTITION BY a.doc_id ORDER BY a.a)),
t AS (SELECT doc_id, sum(z - a)::bigint AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY a) AS kept, max(z) AS z FROM k GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
       sha256(CASE WHEN t.kept IS NULL THEN d.x ELSE unhex(t.kept || hex(d.x[t.z + 1:n])) END) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""

OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
                  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{_WORD}')] AS lines FROM documents),
p AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
v AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS k, lead(w, 4) OVER o AS last FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM v WHERE last IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS j FROM m WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(lines) AS x FROM d),
t AS (SELECT doc_id, host, regexp_replace(lower(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), '{_WS}+', ' ', 'g') AS line, len(regexp_extract_all(x, '{_WORD}')) AS words, length(regexp_replace(x, '{_WS}', '', 'g')) AS chars FROM l),
h AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
b AS (SELECT t.host, t.line FROM t JOIN h USING (host) GROUP BY t.host, t.line, docs HAVING count(DISTINCT doc_id) > greatest({quality_rules.MIN_DOCS}, least({quality_rules.MAX_DOCS}, {quality_rules.SHARE} * docs))),
g AS (SELECT doc_id, sum(chars)::bigint AS lost_chars, sum(words)::bigint AS lost_words, count(*) AS lost_lines FROM t JOIN b USING (host, line) GROUP BY doc_id),
r AS (SELECT doc_id, len(words)::bigint AS n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::bigint AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, coalesce(lost_chars, 0)::bigint AS lost_chars, coalesce(lost_words, 0)::bigint AS lost_words,
             coalesce(lost_lines, 0)::bigint AS lost_lines FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND NOT (lost_lines > 0 AND (lost_chars > {quality_rules.MAX_LOSS} * word_chars OR n_words - lost_words < {quality_rules.MIN_WORDS})) AS kept FROM f"""


def _words(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]', '', 'g'), '{_WORD}')"


def _shingles(table: str, key: str) -> str:
    """``(key, i, s)``: shingles by their first word."""
    leads = ", ".join(f"lead(w, {k}) OVER o" for k in range(1, licenses.SHINGLE))
    return (
        f"SELECT {key}, i, concat_ws(' ', w, {leads}) AS s FROM (SELECT {key}, n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM {table})"
        f" WINDOW o AS (PARTITION BY {key} ORDER BY i) QUALIFY i <= greatest(n - {licenses.SHINGLE}, 0)"
    )


def _op8() -> str:
    notices = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in licenses.TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS words, len(words) AS n FROM documents),
n AS (SELECT template_id, {_words("text")} AS words, len(words) AS n FROM (VALUES {notices}) AS t(template_id, text)),
a AS ({_shingles("d", "doc_id")}), b AS (SELECT DISTINCT template_id, s FROM ({_shingles("n", "template_id")})),
m AS (SELECT doc_id, template_id, count(DISTINCT s) AS matched, min(i)::bigint AS first_word FROM a JOIN b USING (s) GROUP BY doc_id, template_id)
SELECT doc_id, template_id, round(matched / shingles, 6) AS containment, matched, shingles, first_word
FROM m JOIN (SELECT template_id, count(*)::int AS shingles FROM b GROUP BY template_id) USING (template_id) WHERE matched >= {licenses.THRESHOLD} * shingles"""


# CRC-32 by its table: one list of 256 numbers in one row, and a step for each byte.
CRC_TABLE = """c(i, k, v) AS (SELECT i, 0, i::ubigint FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::ubigint) ELSE v >> 1 END FROM c WHERE k < 8),
t AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8)"""


def _crc(text: str) -> str:
    """Of a text, beside a row of ``t``."""
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(h, {at}, 1)) - 1)"  # noqa: E731
    octets = f"[({digit('2 * j + 1')} * 16 + {digit('2 * j + 2')})::ubigint FOR j IN range(length(h) // 2)]"
    return f"(SELECT xor(list_reduce(list_prepend(4294967295::ubigint, {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::int + 1])), 4294967295::ubigint) FROM (SELECT hex(encode({text})) AS h))"


_LATIN = "".join(map(chr, range(0xC0, 0x100)))
# As many other signs, so that distances over bytes are those over characters.
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[: len(_LATIN)]

OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{spelling.RUN}')), '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents)
  WHERE length(run) >= {spelling.MIN_CHARS} GROUP BY ALL),
h AS (SELECT run, n, {_crc("coalesce(doc_id::varchar, '') || ':' || run")} AS h FROM r, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) ELSE run END AS word, sum(n)::bigint AS n FROM h GROUP BY 1
  HAVING length(word) >= {spelling.MIN_CHARS} AND sum(n) >= {spelling.MIN_COUNT}),
v AS (SELECT word, n, unnest(list_distinct(list_prepend(word, [substr(word, 1, j - 1) || substr(word, j + 1) FOR j IN range(1, length(word) + 1)]))) AS variant FROM w),
p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.variant = b.variant AND a.word <> b.word
  WHERE levenshtein(translate(a.word, '{_LATIN}', '{_SIGNS}'), translate(b.word, '{_LATIN}', '{_SIGNS}')) = 1),
f AS (SELECT word, count(*) AS n_near, arg_min(other, {{'n': -other_n, 'w': other}}) AS best, max(other_n) AS best_n FROM p GROUP BY word),
g AS (SELECT w.word, CASE WHEN best_n >= {spelling.RATIO} * n THEN best END AS form, n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN best_n >= {spelling.RATIO} * n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
o AS (SELECT word, word AS root FROM g WHERE form IS NULL UNION ALL SELECT g.word, o.root FROM g JOIN o ON g.form = o.word)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN o USING (word)"""

# The cheapest edits turn by turn: for each state the least (cost, audit), with up to two turns put in behind each edit.
OP12 = rf"""
WITH RECURSIVE {CRC_TABLE},
s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 AS h FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM s WHERE h <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(md5(text))) AS n FROM d),
m AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 3 ELSE 0 END AS fault FROM e),
ins(q, q2, c, a, o) AS (VALUES ('', '', 0, '', ''), ('', 'u', 3, 'I', chr(10) || 'user:'), ('', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 's', 0, '', ''), ('s', 'u', 3, 'I', chr(10) || 'user:'),
  ('s', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'u', 0, '', ''), ('u', 'a', 3, 'I', chr(10) || 'assistant:'), ('a', 'a', 0, '', ''), ('a', 'u', 3, 'I', chr(10) || 'user:')),
step(q, x, name) AS (VALUES ('', 's', NULL), ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
opt AS (SELECT conv_id, n, q, q AS q2, 4 AS c, 'D' AS a, '' AS o FROM m, (VALUES (''), ('s'), ('u'), ('a')) v(q)
  UNION ALL SELECT conv_id, n, q, x, CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM m JOIN step ON i = x WHERE fault NOT IN (1, 2)
  UNION ALL SELECT conv_id, n, q, x, CASE WHEN fault = 3 THEN 6 ELSE 3 END, 'R', chr(10) || name || ':' || text FROM m, step WHERE name IS NOT NULL AND fault NOT IN (1, 2)),
b AS (SELECT conv_id, 0::bigint AS n, q2 AS q, {{'c': c::bigint, 'a': a, 'o': o}} AS v FROM (SELECT DISTINCT conv_id FROM m), ins WHERE q = ''
  UNION ALL SELECT b.conv_id, b.n + 1, ins.q2, min({{'c': b.v.c + opt.c + ins.c, 'a': b.v.a || opt.a || ins.a, 'o': b.v.o || opt.o || ins.o}})
  FROM b JOIN opt ON b.conv_id IS NOT DISTINCT FROM opt.conv_id AND opt.n = b.n + 1 AND opt.q = b.q JOIN ins ON ins.q = opt.q2 GROUP BY ALL),
x AS (SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM m) GROUP BY conv_id),
z AS (SELECT x.*, v FROM x JOIN (SELECT conv_id, n, min(v) AS v FROM b WHERE q IN ('', 'a') GROUP BY ALL) y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.n = y.n)
SELECT k.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost,
  coalesce(v.a, '') AS audit, sha256(coalesce(substr(v.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN z ON k.conv_id IS NOT DISTINCT FROM z.conv_id"""


ORACLES = {"op3_substrings": OP3, "op4_line_rules": OP4, "op8_licenses": _op8(), "op11_spelling": OP11, "op12_conversations": OP12}
