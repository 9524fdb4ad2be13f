"""SQL of the queries that SQL can say, over whole tables.

Not among them: what the mix takes (pseudorandom draws; its targets are), SimHash (XXH64), PII (deobfuscation), URL filters (links read from
markup), the classifier (training). The tests hold these against brute force, round trips or held-out labels.
"""

from __future__ import annotations

from emberlog.llm.decontaminate import WINDOW
from emberlog.llm.line_dedup import MIN_WORDS as MIN_WORDS_OF_A_LINE
from emberlog.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, REPEAT_WINDOW, SYMBOLS

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = rf"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(v) AS line, generate_subscripts(v, 1) AS ix FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT doc_id, pos, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, pos) AS r FROM p WHERE b IS NOT NULL),
long AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS r FROM w WHERE len(regexp_extract_all(line, '{_WORD}')) >= {MIN_WORDS_OF_A_LINE}),
gone AS (SELECT doc_id, pos + k AS pos FROM f, (VALUES (0), (1)) t(k) WHERE r > 1 UNION SELECT doc_id, pos FROM long WHERE r > 1),
gl AS (SELECT w.doc_id, w.ix FROM w JOIN gone USING (doc_id, pos)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ix) AS t FROM l ANTI JOIN gl USING (doc_id, ix) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n FROM gl GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: CRC-32 of the bytes of a text: the table of a byte's eight steps, and a fold over bytes that are read from their hexadecimal digits.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS table_of_bytes)"


def _crc(text: str) -> str:
    digit = "instr('123456789ABCDEF', {s}[{i}])".format
    byte = f"{digit(s='hx', i='2 * k + 1')} * 16 + {digit(s='hx', i='2 * k + 2')}".replace("hx", f"hex(encode({text}))")
    bytes_of = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST({byte} AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_of}), lambda c, b: xor(c // 256, table_of_bytes[xor(c, b) % 256 + 1])), 4294967295)"


PERIODIC_RUNS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS v, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, {_CRC_TABLE}),
g AS (SELECT doc_id, v, len(v) AS n, h, h // 10 AS g FROM d), a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
m AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN v[i + 1] ELSE v[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE v END AS v FROM a),
w AS (SELECT doc_id, unnest(v) AS word, generate_subscripts(v, 1) - 1 AS i FROM m),
e AS (SELECT doc_id, i, word || ' ' || {" || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(1, 8))} AS eight FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.eight = y.eight AND x.i < y.i),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),
l AS (SELECT doc_id, q, min(i) AS a, max(i) + 8 - min(i) + q AS size FROM s GROUP BY doc_id, q, island),
r AS (SELECT doc_id, a, size, min(q) AS q FROM l WHERE size >= 24 AND size >= 3 * q GROUP BY doc_id, a, size),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(size AS DOUBLE) / q DESC, a, q) AS place FROM r),
t AS (SELECT doc_id, count(*) AS n, string_agg(a || ',' || size || ',' || q || chr(10), '' ORDER BY a, q) AS listed FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.a + r.q AND w.i < r.a + r.size) GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_runs, CAST(b.a AS BIGINT) AS start, CAST(b.size AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.size // b.q AS BIGINT) AS exponent_milli,
sha256(coalesce(t.listed, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM m LEFT JOIN t USING (doc_id) LEFT JOIN b ON b.doc_id = m.doc_id AND b.place = 1 LEFT JOIN k ON k.doc_id = m.doc_id
"""

SPELLING = rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
u AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM t GROUP BY doc_id, run),
h AS (SELECT run, n, {_crc("concat(doc_id, ':', run)")} AS h FROM u, {_CRC_TABLE}),
s AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT DISTINCT x.word, y.word AS near, y.n FROM d x JOIN d y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
    UNION SELECT DISTINCT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word UNION SELECT DISTINCT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word),
b AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM p),
w AS MATERIALIZED (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN b.near END AS form, CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n FROM v LEFT JOIN b ON b.word = v.word AND b.place = 1),
r AS (SELECT word, form FROM w WHERE form IS NOT NULL UNION ALL SELECT r.word, w.form FROM r JOIN w ON r.form = w.word WHERE w.form IS NOT NULL),
z AS (SELECT r.word, r.form AS root FROM r JOIN w ON r.form = w.word WHERE w.form IS NULL)
SELECT w.word, w.form, coalesce(z.root, w.word) AS root, w.n, w.n_near, w.form_n FROM w LEFT JOIN z ON z.word = w.word
"""

MIX_TARGETS = rf"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM s GROUP BY source),
w AS (SELECT *, pos % 3 + 1 AS weight, 3 * n AS cap, CAST(3 * n AS DOUBLE) / (pos % 3 + 1) AS ratio FROM g),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT max(CAST((SELECT sum(n) FROM g) - before AS DOUBLE) / rest) AS level FROM o)
SELECT doc_id, size, n AS source_size, least(CAST(cap AS DOUBLE), weight * level) AS target FROM s JOIN o ON s.source IS NOT DISTINCT FROM o.source, l
"""

QUALITY_RULES = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i : i + {REPEAT_WINDOW - 1}], ' ') AS g, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range({REPEAT_WINDOW})) AS k) GROUP BY doc_id),
f AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words FROM t LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS k FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS mean, avg(1.0::DOUBLE / n) AS inv FROM h), s AS (SELECT mean, inv, avg(pow(k / n - mean, 2)) AS spread FROM h, m GROUP BY ALL),
q AS (SELECT mean, mean * (1 - mean) AS noise, greatest(spread - mean * (1 - mean) * inv, mean * (1 - mean) * 1e-6) AS between_ FROM s),
z AS (SELECT mean, CASE WHEN between_ <= 0 THEN 1 ELSE greatest(noise / between_ - 1, 1) END AS strength FROM q),
bad AS (SELECT source FROM h, z WHERE (k + mean * strength) / (n + strength) > 0.8)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.source IS NULL AS kept FROM b LEFT JOIN bad USING (source)
"""

SUBSTRING_DEDUP = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN f USING (g), (SELECT unnest(range(13)) AS k) WHERE doc_id > first),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM p LEFT JOIN m ON m.d = p.d
"""

DECONTAMINATE = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ITEM_WORD}') AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[j : j + least(len(w), {WINDOW}) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS j FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ITEM_WORD}') AS w FROM documents), lengths AS (SELECT DISTINCT n FROM k),
g AS (SELECT doc_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, lengths WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.n, g.j, k.item FROM g JOIN k ON g.n = k.n AND g.g = k.g),
h AS (SELECT doc_id, count(DISTINCT j + o) AS n_hit FROM (SELECT DISTINCT doc_id, n, j FROM m), (SELECT unnest(range({WINDOW})) AS o) WHERE o < n GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"mix_targets": MIX_TARGETS, "op2_line_dedup": LINE_DEDUP, "op3_quality_rules": QUALITY_RULES, "op7_substring_dedup": SUBSTRING_DEDUP, "op8_warc": WARC, "op9_decontaminate": DECONTAMINATE, "op12_spelling_variants": SPELLING, "op13_periodic_runs": PERIODIC_RUNS}
