"""The same answers in DuckDB SQL, where SQL can express a query."""

WORD = r"'[^\x20\x09-\x0D]+'"

QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM repeated) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_exclaims,
    coalesce(lines.n, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
bits AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (10 * n_exclaims > 3 * n_words)::BIGINT
    + 32 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM bits
"""

SUBSTRING_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

MIXING_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS n
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
weighed AS (SELECT *, (n % 3 + 1)::DOUBLE AS w, sum(source_size) OVER ()::DOUBLE AS total FROM s),
-- sources that reach three times their size leave the rest to the others, until none is above
rounds AS (
  SELECT 0 AS step, n, w, source_size, total, false AS full_now, total / sum(w) OVER () AS level FROM weighed
  UNION ALL
  SELECT step + 1, n, w, source_size, total, full_now OR level * w >= 3 * source_size,
    (total - sum(CASE WHEN full_now OR level * w >= 3 * source_size THEN 3.0 * source_size ELSE 0 END) OVER ())
      / sum(CASE WHEN full_now OR level * w >= 3 * source_size THEN 0 ELSE w END) OVER ()
  FROM rounds WHERE step < 30),
t AS (SELECT n, CASE WHEN full_now THEN 3.0 * source_size ELSE level * w END AS target FROM rounds WHERE step = 30),
plan AS (SELECT weighed.source, source_size, target, floor(target + 0.5)::BIGINT AS goal, n % 3 AS schedule FROM weighed JOIN t USING (n)),
placed AS (
  SELECT doc_id, size, source_size, target, goal, schedule,
    (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
passes AS (
  SELECT *, greatest(0, least(size, goal - before)) AS p0, greatest(0, least(size, goal - before - source_size)) AS p1,
    greatest(0, least(size, goal - before - 2 * source_size)) AS p2 FROM placed)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (p0 + p1 + p2)::BIGINT AS taken,
  ((p0 > 0)::INT + (p1 > 0)::INT + (p2 > 0)::INT)::INT AS n_passes FROM passes
"""

#: CRC-32 by its reflected polynomial: the table of 256 remainders, and the fold over a list of bytes.
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""
CRC_FOLD = "xor(list_reduce([4294967295::BIGINT] || {bytes}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"

TRIE_SQL = rf"""
WITH crc AS ({CRC_TABLE}),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM turns),
plan AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    {CRC_FOLD.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 4 AS h
  FROM ids, crc),
rebuilt AS (
  SELECT plan.conv_id, place, role, text FROM plan JOIN turns ON turns.conv_id = base AND place < h
  UNION ALL SELECT plan.conv_id, place, role, text FROM plan JOIN turns ON turns.conv_id = plan.conv_id AND place >= h),
steps AS (
  SELECT conv_id, row_number() OVER c AS depth, md5(string_agg(md5(role) || md5(text), '') OVER (c ROWS UNBOUNDED PRECEDING)) AS k,
    len(regexp_extract_all(text, {WORD})) AS words
  FROM rebuilt WINDOW c AS (PARTITION BY conv_id ORDER BY place)),
members AS (SELECT conv_id, depth, k, words FROM steps UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
lengths AS (SELECT conv_id, max(depth) AS len FROM members GROUP BY conv_id),
nodes AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '') AS ends
  FROM members JOIN lengths USING (conv_id) GROUP BY depth, k),
edges AS (
  SELECT nodes.depth, nodes.k, parent.k AS parent_k FROM nodes JOIN members AS parent ON parent.conv_id = nodes.conv_id AND parent.depth = nodes.depth - 1),
children AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n FROM edges GROUP BY ALL),
sums AS (
  SELECT up.depth, up.k, sum((n_convs - 1) * nodes.words)::BIGINT AS saved, count(*) FILTER (children.n IS NULL) AS leaves
  FROM nodes JOIN members AS up ON up.conv_id = nodes.conv_id AND up.depth <= nodes.depth
  LEFT JOIN children ON children.depth = nodes.depth AND children.k = nodes.k GROUP BY up.depth, up.k)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs::BIGINT AS n_convs, coalesce(children.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN sums USING (depth, k) LEFT JOIN children USING (depth, k) LEFT JOIN edges USING (depth, k)
LEFT JOIN nodes AS parent ON parent.depth = nodes.depth - 1 AND parent.k = edges.parent_k
"""

SPELLING_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
found AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM found WHERE length(run) >= 5 GROUP BY ALL),
summed AS (
  SELECT run, c, {CRC_FOLD.format(bytes="""flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 | (unicode(x)::BIGINT >> 6), 128 | (unicode(x)::BIGINT & 63)] END))""")} AS h
  FROM runs, crc),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS x, b.word AS y, b.n AS n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT x, count(*) AS n_near, arg_min(struct_pack(y := y, n := n), struct_pack(r := -n, y := y)) AS b FROM pairs GROUP BY x),
formed AS (
  SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 2 * words.n THEN b.y END AS form, CASE WHEN b.n >= 2 * words.n THEN b.n END AS form_n
  FROM words LEFT JOIN best ON x = word),
chain AS (
  SELECT word, word AS tip, form AS next FROM formed
  UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN formed f ON f.word = chain.next)
SELECT formed.word, form, tip AS root, n, n_near, form_n FROM formed JOIN chain ON chain.word = formed.word AND chain.next IS NULL
"""

NEAR_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT row, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT row, count(*) AS n FROM shingles GROUP BY row),
shared AS (SELECT a.row AS x, b.row AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.row <> b.row GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.row = x JOIN sizes q ON q.row = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT row AS x, row AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT a.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b.doc_id) AS component_id, coalesce(a.doc_id = min(b.doc_id), false) AS kept
FROM reach JOIN d a ON a.row = reach.x JOIN d b ON b.row = reach.y LEFT JOIN sizes ON sizes.row = a.row GROUP BY a.row, a.doc_id
"""

ORACLE_SQL = {
    "op4_mixing": MIXING_SQL, "op5_quality_rules": QUALITY_SQL, "op7_substring_dedup": SUBSTRING_SQL,
    "op11_conversation_trie": TRIE_SQL, "op12_spelling": SPELLING_SQL, "op13_superminhash": NEAR_SQL,
}
