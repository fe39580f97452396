"""SQL for the operators that SQL can express, over the same tables."""

OP9 = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
w AS (SELECT k, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
g AS (
    SELECT k, pos, list_slice(words, pos + 1, pos + 5) AS gram
    FROM (SELECT k, words, unnest(range(greatest(len(words) - 4, 0))) AS pos FROM d)
),
found AS (SELECT k, pos FROM (SELECT k, pos, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT pos + step) AS n FROM found, (SELECT unnest(range(5)) AS step) GROUP BY k),
lines AS (
    SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
    FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
),
per AS (
    SELECT k, count(*) AS n_words, sum(length(word)) AS word_chars,
           count(*) FILTER (WHERE regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '[a-z]')) AS n_shouted
    FROM w GROUP BY k
),
m AS (
    SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
           coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_shouted, 0)::BIGINT AS n_shouted
    FROM d LEFT JOIN per USING (k) LEFT JOIN rep USING (k) LEFT JOIN lines USING (k)
),
f AS (
    SELECT *,
           ((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
            + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
            + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
            + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
            + (CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 16 ELSE 0 END)
            + (CASE WHEN 2 * n_shouted > n_words THEN 32 ELSE 0 END))::BIGINT AS failures
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures
FROM f
"""

OP11 = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
           list_inner_product(a.parts, c.parts)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
),
p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

# From the end of each conversation: per state of the grammar (0 start, 1 after system, 2 after user, 3 after assistant)
# the least (cost, audit, lines); inserted rows lead from 0, 1 and 3 to 2 and from 2 to 3.
OP12 = r"""
WITH RECURSIVE
bits AS (
    SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(
               [4294967295::BIGINT] || list_transform(
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                   lambda ch: ascii(ch)::BIGINT),
               lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, crc
),
repeated AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM keyed WHERE kind <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS rn,
           count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS i
    FROM repeated
),
judged AS (
    SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY rn) || i AS pair,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'd'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
    FROM placed
),
measured AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
           count(*) FILTER (WHERE fault = 't') AS truncated,
           count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
),
dp AS (
    SELECT conv_id, n AS place, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s0,
           {'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']} AS s1,
           {'c': 5::BIGINT, 'a': 'I', 't': ['assistant:']} AS s2, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s3
    FROM judged WHERE rn = 1
    UNION ALL
    SELECT conv_id, place - 1,
           list_min([b0, {'c': b2.c + 5, 'a': 'I' || b2.a, 't': ['user:'] || b2.t},
                     {'c': b3.c + 10, 'a': 'II' || b3.a, 't': ['user:', 'assistant:'] || b3.t}]),
           list_min([b1, {'c': b2.c + 5, 'a': 'I' || b2.a, 't': ['user:'] || b2.t},
                     {'c': b3.c + 10, 'a': 'II' || b3.a, 't': ['user:', 'assistant:'] || b3.t}]),
           list_min([b2, {'c': b3.c + 5, 'a': 'I' || b3.a, 't': ['assistant:'] || b3.t}]),
           list_min([b3, {'c': b2.c + 5, 'a': 'I' || b2.a, 't': ['user:'] || b2.t}])
    FROM (
        SELECT conv_id, place,
               list_min([{'c': s0.c + 2, 'a': 'D' || s0.a, 't': s0.t},
                         CASE WHEN dead THEN NULL WHEN i = 's' THEN {'c': s1.c + e, 'a': 'K' || s1.a, 't': [line] || s1.t}
                              WHEN i = 'u' THEN {'c': s2.c + e, 'a': 'K' || s2.a, 't': [line] || s2.t} END,
                         CASE WHEN dead THEN NULL ELSE {'c': s2.c + e + 1, 'a': 'R' || s2.a, 't': ['user:' || text] || s2.t} END
               ]) AS b0,
               list_min([{'c': s1.c + 2, 'a': 'D' || s1.a, 't': s1.t},
                         CASE WHEN NOT dead AND i = 'u' THEN {'c': s2.c + e, 'a': 'K' || s2.a, 't': [line] || s2.t} END,
                         CASE WHEN dead THEN NULL ELSE {'c': s2.c + e + 1, 'a': 'R' || s2.a, 't': ['user:' || text] || s2.t} END
               ]) AS b1,
               list_min([{'c': s2.c + 2, 'a': 'D' || s2.a, 't': s2.t},
                         CASE WHEN NOT dead AND i = 'a' THEN {'c': s3.c + e, 'a': 'K' || s3.a, 't': [line] || s3.t} END,
                         CASE WHEN dead THEN NULL ELSE {'c': s3.c + e + 1, 'a': 'R' || s3.a, 't': ['assistant:' || text] || s3.t} END
               ]) AS b2,
               list_min([{'c': s3.c + 2, 'a': 'D' || s3.a, 't': s3.t},
                         CASE WHEN NOT dead AND i = 'u' THEN {'c': s2.c + e, 'a': 'K' || s2.a, 't': [line] || s2.t} END,
                         CASE WHEN dead THEN NULL ELSE {'c': s2.c + e + 1, 'a': 'R' || s2.a, 't': ['user:' || text] || s2.t} END
               ]) AS b3
        FROM (
            SELECT dp.*, j.i, j.text, j.role || ':' || j.text AS line, j.fault IN ('b', 'd') AS dead,
                   CASE j.fault WHEN 't' THEN 5 ELSE 0 END AS e
            FROM dp JOIN judged j ON j.conv_id IS NOT DISTINCT FROM dp.conv_id AND j.rn = dp.place
        )
    )
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost,
       coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN measured m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM dp WHERE place = 0) d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

SQL = {"op9_quality_rules": OP9, "op11_kronecker_negatives": OP11, "op12_suffix_dawg": OP12}
