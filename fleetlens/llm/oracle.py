"""DuckDB statements of the corpus queries."""

#: Words of a text, A-Z read as a-z; the class is that of the operator.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLES = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM wins),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT p.doc_id, p.k, p.i, wins.item_id FROM places p JOIN wins USING (k, win)),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids
  FROM hits GROUP BY doc_id),
words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, k, i FROM hits))
  GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id)""",
    "op2_chat_format": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(text) + length(text) - length(translate(text, '~[]<', '')) AS n_text,
    length(role) + length(role) - length(translate(role, '~[]<', '')) AS n_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n_text + CASE role WHEN 'system' THEN 6 + 7 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 8 + 4 WHEN 'tool' THEN 7 + 8
    ELSE 6 + n_role + 2 + 8 END))::bigint AS formatted_chars,
  bool_and(coalesce(before, 'start') || ' ' || role IN ('start system', 'start user', 'system user', 'user assistant',
    'assistant user', 'assistant tool', 'tool tool', 'tool assistant') AND (NOT last OR role = 'assistant')) AS is_valid
FROM sized GROUP BY conv_id""",
    "op6_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: hash(array_to_string(w[i:i + 4], ' '))))) AS s
  FROM words WHERE len(w) > 0),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (n_a + n_b - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS low FROM documents
  UNION
  SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.low < e.b)
SELECT d.doc_id, coalesce(len(s), 0)::bigint AS n_shingles, d.low AS component_id
FROM (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id) d LEFT JOIN sets USING (doc_id)""",
    # A recursion from the last turn back over four columns: an even, an odd number of turns to come, behind the system turn, the start.
    "op12_turn_repair": r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c // 2, 3988292384 * (c % 2)))) AS t),
input AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key
  FROM conversations),
keyed AS (
  SELECT input.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: ascii(ch)::bigint)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 20 AS kind
  FROM input, steps),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM damaged),
repeated AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) AS again FROM ordered),
judged AS (
  SELECT *, left(role, 1) AS c, CASE WHEN core = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    (fault = 't')::int AS extra, fault IN ('b', 'd') AS gone
  FROM repeated),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
back AS (
  SELECT conv_id, n + 1 AS r, {'c': 0, 'a': ''} AS e, {'c': 2, 'a': 'I'} AS o, {'c': 4, 'a': 'II'} AS b, {'c': 0, 'a': ''} AS s FROM facts
  UNION ALL
  SELECT conv_id, r, least(e0, {'c': o0.c + 2, 'a': 'I' || o0.a}), o1, least(b0, {'c': o1.c + 2, 'a': 'I' || o1.a}), least(s0, {'c': o1.c + 2, 'a': 'I' || o1.a})
  FROM (
    SELECT *, least(o0, {'c': e0.c + 2, 'a': 'I' || e0.a}) AS o1
    FROM (
      SELECT j.conv_id, j.r,
        least({'c': k.e.c + 3, 'a': 'D' || k.e.a}, u) AS e0,
        least({'c': k.o.c + 3, 'a': 'D' || k.o.a}, CASE WHEN gone THEN far WHEN j.c = 'a' THEN {'c': k.e.c + extra, 'a': 'K' || k.e.a}
          ELSE {'c': k.e.c + extra + 2, 'a': 'R' || k.e.a} END) AS o0,
        least({'c': k.b.c + 3, 'a': 'D' || k.b.a}, u) AS b0,
        least({'c': k.s.c + 3, 'a': 'D' || k.s.a}, u, CASE WHEN NOT gone AND j.c = 's' THEN {'c': k.b.c + extra, 'a': 'K' || k.b.a} ELSE far END) AS s0
      FROM (SELECT back.*, CASE WHEN gone THEN {'c': 1000000000, 'a': ''} WHEN judged.c = 'u' THEN {'c': o.c + extra, 'a': 'K' || o.a}
              ELSE {'c': o.c + extra + 2, 'a': 'R' || o.a} END AS u, {'c': 1000000000, 'a': ''} AS far
            FROM back JOIN judged ON judged.conv_id IS NOT DISTINCT FROM back.conv_id AND judged.r = back.r - 1) k
      JOIN judged j ON j.conv_id IS NOT DISTINCT FROM k.conv_id AND j.r = k.r - 1))),
chosen AS (SELECT conv_id, s.c::bigint AS cost, s.a AS audit FROM back WHERE r = 1),
edits AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS r, count(*) FILTER (edit <> 'D') OVER w AS written_at
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p, substr(audit, p, 1) AS edit FROM chosen)
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
written AS (
  SELECT e.conv_id, e.p, CASE WHEN edit = 'K' THEN j.role WHEN (length(translate(audit, 'D', '')) - written_at) % 2 = 0 THEN 'assistant' ELSE 'user' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE j.text END AS line
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.r = e.r
  WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS repaired FROM written GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id""",
    "op13_hard_negatives": """
WITH fit AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::bigint AS score
  FROM fit a JOIN fit b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id, n.r) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5""",
}
