"""SQL that must give the rows of the queries that SQL can express."""

from __future__ import annotations

CHAT = r"""
WITH added AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), lengths AS (
    SELECT *,
        CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
            ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), ': ', ':\ '), '</turn>', '<\/turn>')) END
        + 4 + 2 + 8 + length(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>')) AS written
    FROM added
), said AS (
    SELECT conv_id, count(*) AS n_turns, sum(written)::BIGINT AS formatted_chars,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt,
        list(role ORDER BY turn NULLS FIRST, role, text) AS roles
    FROM lengths GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars,
    regexp_full_match(array_to_string(list_transform(roles, lambda r: CASE WHEN r IN ('system', 'user', 'assistant') THEN r[1] ELSE 'x' END), ''), 's?(ua)+') AS accepted
FROM said
"""

TRIE = r"""
WITH ordered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns FROM ordered GROUP BY conv_id
), hashed AS (
    SELECT conv_id, turns, conv_id - conv_id % 100 AS source,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
                lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 6 AS h
    FROM whole
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
    FROM hashed a LEFT JOIN whole b ON b.conv_id = a.source
), prefixes AS (
    SELECT conv_id, d AS depth, len(turns) = d AS ends, coalesce(length(turns[d].text), 0) AS chars,
        sha256(turns[1:d]::JSON::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(turns[1:d - 1]::JSON::VARCHAR) END AS parent
    FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)
), nodes AS (
    SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, depth, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY node, depth
), children AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n FROM nodes GROUP BY parent) c ON c.parent = n.node
), sums AS (
    SELECT p.node, count(*) FILTER (c.n_children = 0) AS n_leaves, sum(c.saved)::BIGINT AS saved_tokens
    FROM children c JOIN prefixes p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.node
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM children c JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = c.parent
"""

AUDIT = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS doc_id FROM texts GROUP BY text
), known AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failures AS (
    SELECT t.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic,
        (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
        + 4 * (100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text))::INT
        + 8 * regexp_matches(t.text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > f.doc_id, false)::INT AS mask
    FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN known k ON k.doc_id = t.doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failures GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM orders, unnest(range(1, 6)) AS u(k)
), found AS (
    SELECT part, filter_order, step, bit,
        sum(n) FILTER (mask & (before | bit) = 0) AS kept,
        sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
        sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
        sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost,
        sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM found
"""
