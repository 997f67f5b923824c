"""DuckDB SQL of those corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from .licenses import BASE, NOTICES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH texts AS (SELECT doc_id, source AS host, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
split AS (SELECT doc_id, host, unnest(string_split(s, chr(10))) AS line FROM texts),
worded AS (SELECT doc_id, host, line, regexp_extract_all(line, '{_WORDS}') AS w FROM split),
lines AS (
  SELECT doc_id, host, line, len(w) AS words, regexp_replace(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS key
  FROM worded WHERE len(w) > 0),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
held AS (SELECT lines.host, key, count(DISTINCT s) AS documents FROM lines JOIN texts USING (doc_id) GROUP BY lines.host, key HAVING count(DISTINCT s) > 20),
hosts AS (SELECT host, count(*) AS host_documents FROM texts GROUP BY host),
common AS (SELECT h.host, key FROM held h JOIN hosts o ON h.host IS NOT DISTINCT FROM o.host WHERE documents > 0.005 * host_documents),
removed AS (SELECT doc_id, sum(words) AS removed_words FROM lines l JOIN common c ON l.key = c.key AND l.host IS NOT DISTINCT FROM c.host GROUP BY doc_id),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) > 2),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM starts),
repeats AS (SELECT doc_id, count(DISTINCT word) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS word FROM windows WHERE times > 1) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(s, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM texts LEFT JOIN doubled USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * removed_words > 60 * n_words AS depleted FROM counted)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""

OP3 = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached(a, b) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
roots AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots ON doc_id = a
"""

OP5 = f"""
WITH items AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM benchmark),
texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM documents),
starts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM starts),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
lengths AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT doc_id, item_id, i, p.n FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM places JOIN lengths ON i + n - 1 <= len(w)) p
  JOIN windows ON p.n = windows.n AND p.words = windows.words),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_64 = "18446744073709551616::UHUGEINT"


def _mixed(x: str) -> str:
    """The finaliser of common.mix in whole numbers of 128 bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = f"(xor({x}, {x} // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT % {_64})"
    return f"xor({x}, {x} // {1 << 31}::UHUGEINT)"


OP6 = f"""
WITH RECURSIVE entries AS (
  SELECT k, list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS entry FROM range(256) t(k)),
crc_table AS (SELECT list(entry ORDER BY k) AS crcs FROM entries),
raw AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
sized AS (
  SELECT doc_id, len(b)::BIGINT + 1 AS size, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM raw CROSS JOIN crc_table),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS n FROM sized),
halves AS (SELECT count(*) AS total, 1::BIGINT << greatest(1, (length(bin(greatest(count(*), 2) - 1)) + 1) // 2) AS half FROM numbered),
seeds AS (SELECT i, (i::UHUGEINT * 11400714819323198485::UHUGEINT + 1::UHUGEINT) % {_64} AS x FROM range(1, 5) t(i)),
keys AS (SELECT i, {_mixed("x")} AS key FROM seeds),
walk(n, step, l, r, place) AS (
  SELECT n, 0::BIGINT, (n // half)::UHUGEINT, (n % half)::UHUGEINT, NULL::BIGINT FROM numbered CROSS JOIN halves
  UNION ALL
  SELECT n, step + 1, nl, nr, CASE WHEN (step + 1) % 4 = 0 THEN (nl * half::UHUGEINT + nr)::BIGINT END FROM (
    SELECT n, step, half, r AS nl, xor(l, {_mixed("x")} % half::UHUGEINT) AS nr FROM (
      SELECT n, step, half, l, r, (r + key) % {_64} AS x FROM walk CROSS JOIN halves JOIN keys ON i = step % 4 + 1 WHERE place IS NULL OR place >= total) y) z),
placed AS (SELECT n, place FROM walk CROSS JOIN halves WHERE place < total)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % 16)::INT AS shard, (place // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM numbered JOIN placed USING (n)
"""

OP8 = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM texts),
strings AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS string FROM starts),
later AS (SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY string ORDER BY doc_id, i) > 1),
breaks AS (SELECT doc_id, i, coalesce(i > lag(i) OVER o + 100, true) AS fresh FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM breaks),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER o, 0) AS lo, s.lo AS hi FROM spans s WINDOW o AS (PARTITION BY doc_id ORDER BY s.lo)
  UNION ALL SELECT doc_id, coalesce(max(hi), 0), any_value(n) FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo, hi) AS k FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id),
totals AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM texts JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""


_SPACE = r"[\x20\x09-\x0D]*"

OP9 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '{_SPACE}{_WORDS}') AS k FROM documents),
tokens AS (SELECT doc_id, unnest(range(1, len(k) + 1)) AS i, unnest(k) AS token FROM texts),
parts AS (SELECT doc_id, i, token, regexp_extract(token, '^{_SPACE}') AS lead, regexp_extract(token, '{_WORDS}') AS word FROM tokens),
ended AS (
  SELECT *, (regexp_matches(word, '[.!?]$') OR coalesce(contains(lead(lead) OVER o, chr(10)), true))::INT AS final FROM parts WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(final) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS n FROM ended),
sentences AS (
  SELECT doc_id, n, count(*) AS words, min(i) AS first, arg_min(lead, i) AS lead, translate(string_agg(word, ' ' ORDER BY i), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS said,
    substr(string_agg(token, '' ORDER BY i), length(arg_min(lead, i)) + 1) AS body
  FROM numbered GROUP BY doc_id, n),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM sentences),
pairs AS (
  SELECT a.doc_id, a.n AS a, b.n AS b FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n + 1 AND a.n + 15
  WHERE b.upto - a.upto + a.words >= 16),
runs AS (SELECT doc_id, a, min(b) AS b FROM pairs GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM pairs GROUP BY doc_id, b),
keyed AS (SELECT r.doc_id, a, b, md5(string_agg(said, chr(10) ORDER BY n)) AS run FROM runs r JOIN sentences s ON s.doc_id = r.doc_id AND s.n BETWEEN a AND b GROUP BY r.doc_id, a, b),
later AS (SELECT doc_id, a, b FROM keyed QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS n FROM later),
marked AS (
  SELECT s.*, g.n IS NOT NULL AS out, coalesce(lag(g.n IS NOT NULL) OVER o, false) AS before_out, coalesce(lead(s.lead) OVER o, regexp_extract(t.s, '{_SPACE}$')) AS after
  FROM sentences s JOIN texts t USING (doc_id) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.n = s.n WINDOW o AS (PARTITION BY s.doc_id ORDER BY s.n)),
made AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (out) AS n_removed, count(*) FILTER (out AND NOT before_out) AS n_spans,
    arg_min(lead, n) || coalesce(string_agg(body || after, '' ORDER BY n) FILTER (NOT out), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, s)) AS kept_sha256
FROM texts LEFT JOIN made USING (doc_id)
"""


def _given(at: str) -> str:
    j = f"({at} // block)"
    return f"((({j} + shift) * rest // blocks - shift * rest // blocks) * block + (({j} + 1 + shift) * rest // blocks - ({j} + shift) * rest // blocks) * ({at} % block))"


OP10 = f"""
WITH counted AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size, md5('1:' || coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))) AS key FROM documents),
sized AS (SELECT *, ('0x' || substr(key, 1, 12))::BIGINT % greatest(1, (count(*) OVER () + 499) // 500) AS shard FROM counted),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, row_number() OVER o AS place,
    (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM weighed
  WINDOW o AS (ORDER BY cap / weight, source NULLS LAST), p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT min(place) AS first_open, arg_min(level, place) AS open_level FROM levels WHERE level * weight <= cap),
targets AS (SELECT source, source_size, CASE WHEN place >= first_open THEN open_level * weight ELSE cap::DOUBLE END AS target FROM levels CROSS JOIN opened),
blocked AS (SELECT greatest(1, least(16, floor(min(target) FILTER (target > 0) / 16)))::BIGINT AS block FROM targets),
seated AS (
  SELECT source, source_size, target, block, (source_size + block - 1) // block AS own_blocks, least(floor(target / block + 0.5)::BIGINT, 2 * ((source_size + block - 1) // block)) AS quota
  FROM targets CROSS JOIN blocked),
shared AS (
  SELECT *, greatest(own_blocks, 1) AS blocks, CASE WHEN own_blocks > 0 THEN quota // own_blocks ELSE 0 END AS passes, CASE WHEN own_blocks > 0 THEN quota % own_blocks ELSE 0 END AS rest,
    ('0x' || substr(md5('1:' || coalesce(source, '-')), 1, 8))::BIGINT % greatest(own_blocks, 1) AS shift
  FROM seated),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY shard, key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM sized)
SELECT p.doc_id, p.size, source_size, target, (passes * size + {_given("upto")} - {_given("(upto - size)")})::BIGINT AS taken
FROM placed p JOIN shared q ON p.source IS NOT DISTINCT FROM q.source
"""


def _values(rows: list[tuple]) -> str:
    said = lambda x: "[" + ", ".join(map(said, x)) + "]" if isinstance(x, list) else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(said, row)) + ")" for row in rows)


OP13 = f"""
WITH notices AS (SELECT *, len(string_split(said, ' ')) AS words FROM (VALUES {_values([(k, *notice) for k, notice in enumerate(NOTICES)])}) t(k, label, said, phrases)),
posts AS (SELECT k, unnest(string_split(said, ' ')) AS word, unnest(range(words)) AS q FROM notices),
texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts),
own AS (SELECT * FROM places WHERE word IN (SELECT word FROM posts)),
counts AS (SELECT word, count(DISTINCT doc_id) AS n FROM own GROUP BY word),
ranked AS (SELECT k, p.word, row_number() OVER (PARTITION BY k ORDER BY coalesce(n, 0), p.word) AS r FROM (SELECT DISTINCT k, word FROM posts) p LEFT JOIN counts USING (word)),
rare AS (SELECT k, word FROM ranked WHERE r <= 6),
needs AS (SELECT k, (count(*) + 1) // 2 AS need FROM rare GROUP BY k),
asked AS (SELECT doc_id, k, need FROM (SELECT DISTINCT doc_id, word FROM own) JOIN rare USING (word) JOIN needs USING (k) GROUP BY doc_id, k, need HAVING count(*) >= need),
begins AS (SELECT DISTINCT doc_id, k, need, i - q AS b FROM asked JOIN rare USING (k) JOIN own USING (doc_id, word) JOIN posts USING (k, word)),
stand AS (
  SELECT DISTINCT s.doc_id, s.k, need, b, p.q, p.word, r.word IS NOT NULL AS votes
  FROM begins s JOIN posts p USING (k) JOIN own o ON o.doc_id = s.doc_id AND o.word = p.word AND o.i BETWEEN b + q - 2 AND b + q + 2 LEFT JOIN rare r ON r.k = s.k AND r.word = p.word),
shares AS (SELECT doc_id, k, b, count(*) AS standing FROM stand GROUP BY doc_id, k, b, need HAVING count(DISTINCT word) FILTER (votes) >= need),
windows AS (
  SELECT doc_id, label, phrases, standing / words AS share, ' ' || array_to_string(w[greatest(b - 2, 0) + 1 : b + words + 2], ' ') || ' ' AS near
  FROM shares JOIN notices USING (k) JOIN texts USING (doc_id)),
found AS (SELECT doc_id, label, share FROM windows WHERE len(list_filter(phrases, lambda f: NOT contains(near, ' ' || f || ' '))) = 0),
base AS (
  SELECT doc_id, b[1] AS label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)
  CROSS JOIN (SELECT unnest([{", ".join(f"['{label}', '{phrase}']" for phrase, label in BASE)}]) AS b)
  WHERE array_to_string(w[i : i + len(string_split(b[2], ' ')) - 1], ' ') = b[2]),
based AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found) GROUP BY doc_id),
scored AS (SELECT doc_id, max(share) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(coalesce(score, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM texts LEFT JOIN based USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN scored USING (doc_id)
"""

_CRC_TABLE = """entries AS (
  SELECT k, list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS entry FROM range(256) t(k)),
crc_table AS (SELECT list(entry ORDER BY k) AS crcs FROM entries)"""


def _crc32(text: str) -> str:
    """SQL: the crc32 of a text's bytes, given crcs of _CRC_TABLE."""
    b = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {b}), lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1])), 4294967295)"


OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations CROSS JOIN crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM placed),
turns AS MATERIALIZED (
  SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '{_WORDS}') THEN 'b' WHEN seen THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault
  FROM again),
ways(s, t, audit, cost, needs, inserted, reroled) AS (VALUES
  (0, 0, 'D', 4, NULL, NULL, NULL), (1, 1, 'D', 4, NULL, NULL, NULL), (2, 2, 'D', 4, NULL, NULL, NULL), (3, 3, 'D', 4, NULL, NULL, NULL), (0, 1, 'K', 0, 's', NULL, NULL),
  (0, 2, 'K', 0, 'u', NULL, NULL), (1, 2, 'K', 0, 'u', NULL, NULL), (3, 2, 'K', 0, 'u', NULL, NULL), (2, 2, 'IK', 3, 'u', 'assistant:', NULL),
  (2, 3, 'K', 0, 'a', NULL, NULL), (0, 3, 'IK', 3, 'a', 'user:', NULL), (1, 3, 'IK', 3, 'a', 'user:', NULL), (3, 3, 'IK', 3, 'a', 'user:', NULL),
  (0, 2, 'R', 3, NULL, NULL, 'user'), (1, 2, 'R', 3, NULL, NULL, 'user'), (3, 2, 'R', 3, NULL, NULL, 'user'), (2, 2, 'IR', 6, NULL, 'assistant:', 'user'),
  (2, 3, 'R', 3, NULL, NULL, 'assistant'), (0, 3, 'IR', 6, NULL, 'user:', 'assistant'), (1, 3, 'IR', 6, NULL, 'user:', 'assistant'), (3, 3, 'IR', 6, NULL, 'user:', 'assistant')),
steps(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, struct_pack(cost := 0::BIGINT, audit := '', said := '') FROM conversations
  UNION ALL
  SELECT p.conv_id, f.i, w.t, min(struct_pack(
    cost := p.best.cost + w.cost + CASE WHEN w.audit <> 'D' AND fault = 't' THEN 3 ELSE 0 END, audit := p.best.audit || w.audit,
    said := p.best.said || coalesce(chr(10) || inserted, '') || CASE WHEN w.audit = 'D' THEN '' ELSE chr(10) || coalesce(reroled, role) || ':' || text END))
  FROM steps p JOIN turns f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1 JOIN ways w ON w.s = p.state AND (w.audit = 'D' OR fault NOT IN ('b', 'd')) AND (needs IS NULL OR needs = c)
  GROUP BY p.conv_id, f.i, w.t),
counted AS (
  SELECT k.conv_id, count(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN turns ON k.conv_id IS NOT DISTINCT FROM turns.conv_id GROUP BY k.conv_id),
ended AS (
  SELECT s.conv_id, min(struct_pack(cost := best.cost + [0, 6, 3, 0][state + 1], audit := best.audit || ['', 'II', 'I', ''][state + 1],
    said := best.said || ['', chr(10) || 'user:' || chr(10) || 'assistant:', chr(10) || 'assistant:', ''][state + 1])) AS best
  FROM steps s JOIN counted n ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND i = rows GROUP BY s.conv_id)
SELECT n.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(substr(best.said, 2)) AS repaired_sha256
FROM counted n JOIN ended e ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""

OP12 = f"""
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
spoken AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS p, k FROM starts CROSS JOIN range(1, 4) r(k) WHERE i + k - 1 <= len(w)),
totals AS MATERIALIZED (SELECT lang, count(*) AS n FROM spoken WHERE k = 1 GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, p, any_value(k) AS words, count(*) AS f FROM spoken GROUP BY lang, p HAVING count(*) >= 10),
candidates AS MATERIALIZED (SELECT lang, p, string_split(p, ' ') AS w, f AS a FROM counts WHERE words > 1),
parted AS MATERIALIZED (
  SELECT lang, p, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : len(w)], ' ') AS rest FROM candidates CROSS JOIN range(1, 3) s(k) WHERE k < len(w)),
cuts AS (
  SELECT c.lang, c.p, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM parted c JOIN counts l ON l.lang = c.lang AND l.p = first JOIN counts r ON r.lang = c.lang AND r.p = rest),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (SELECT lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS p, a FROM candidates WHERE len(w) = 3),
most AS (SELECT lang, p, max(a) AS longer FROM held GROUP BY lang, p),
kept AS (SELECT t.lang, t.p AS phrase, a, l, r, score FROM lowest t LEFT JOIN most m ON m.lang = t.lang AND m.p = t.p WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op1_quality": OP1, "op3_minhash": OP3, "op5_decontamination": OP5, "op6_shards": OP6, "op8_suffixes": OP8, "op9_sentences": OP9, "op10_mixing": OP10, "op11_conversations": OP11, "op12_phrases": OP12, "op13_licenses": OP13}
