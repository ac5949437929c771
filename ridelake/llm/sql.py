"""DuckDB SQL that checks the training-text queries SQL can express."""

CHAT_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), k AS (
    SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
        length(role) + length(regexp_replace(role, '[^\\<\[' || chr(10) || ']', '', 'g')) AS role_chars,
        length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS text_chars
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
    SELECT *, sum(7 + role_chars + 1 + text_chars + 8) OVER (PARTITION BY conv_id ORDER BY k) AS end_at FROM k
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(end_at) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

QUALITY_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words
    FROM documents
), lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY r
), windows AS (
    SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), hits AS (
    SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), covered AS (
    SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM hits, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r
), m AS (
    SELECT doc_id, source, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
), b AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
    SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM b WHERE source IS NOT NULL GROUP BY source
), p AS (
    SELECT sum(failed) / sum(n) AS mean, var_pop(failed / n) AS spread, avg(1 / n) AS noise FROM h
), q AS (
    SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * noise, 1e-9) - 1, 1), 10000) AS strength
    FROM p
), v AS (
    SELECT source, (failed + mean * strength) / (n + strength) > 0.5 AS bad FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM b LEFT JOIN v USING (source)
"""

AUDIT_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words
    FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS first_id FROM d GROUP BY text
), said AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
    FROM d JOIN firsts USING (text) LEFT JOIN said USING (doc_id)
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS earlier
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), c AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
    FROM m GROUP BY part, mask
), r AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0) | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & coalesce(earlier, 0) <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(n_good) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
        coalesce(sum(n_toxic) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
    FROM c, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

_ENCODED = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_ENCODED.format(c) for c in ("doc_id", "source", "lang", "{n}", "text"))
MERKLE_SQL = f"""
WITH RECURSIVE rows AS (
    SELECT doc_id, lang, sha256({_LEAF.format(n="n_chars")}) AS leaf,
        sha256({_LEAF.format(n="(n_chars::HUGEINT + 1)")}) AS raised,
        xor(list_reduce(
            [4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
            lambda crc, b: list_reduce(
                [xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)
            )
        ), 4294967295) AS crc
    FROM documents
), placed AS (
    SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r
    FROM rows WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)
), low AS (
    SELECT 0 AS level, lang, i, n, leaf AS h FROM placed
    UNION ALL
    SELECT level + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
    FROM low WHERE n > 1 GROUP BY level, lang, i // 2, n
), parts AS (
    SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
    SELECT 0 AS level, i, n, subroot AS h FROM parts
    UNION ALL
    SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2, n
), beside AS (
    SELECT r, low.level, placed.i >> low.level AS spot, low.n, other.h
    FROM placed JOIN low ON low.lang IS NOT DISTINCT FROM placed.lang AND low.i = placed.i >> low.level AND low.n > 1
    LEFT JOIN low AS other ON other.lang IS NOT DISTINCT FROM placed.lang AND other.level = low.level AND other.i = xor(low.i, 1)
    UNION ALL
    SELECT r, 1000 + high.level, parts.i >> high.level, high.n, other.h
    FROM placed JOIN parts ON parts.lang IS NOT DISTINCT FROM placed.lang JOIN high ON high.i = parts.i >> high.level AND high.n > 1
    LEFT JOIN high AS other ON other.level = high.level AND other.i = xor(high.i, 1)
), ways AS (
    SELECT r, coalesce(string_agg(h, '' ORDER BY level), '') AS path,
        list({{'odd': spot % 2 = 1, 'h': coalesce(h, '')}} ORDER BY level) AS steps
    FROM beside GROUP BY r
), walk AS (
    SELECT placed.r, steps, 1 AS k, CASE WHEN crc % 7 = 0 THEN raised ELSE leaf END AS h
    FROM placed LEFT JOIN ways ON ways.r = placed.r
    UNION ALL
    SELECT r, steps, k + 1, CASE WHEN steps[k].odd THEN sha256(steps[k].h || h) ELSE sha256(h || steps[k].h) END
    FROM walk WHERE k <= len(steps)
), ends AS (
    SELECT r, h FROM walk QUALIFY k = max(k) OVER (PARTITION BY r)
)
SELECT doc_id, leaf, subroot, root.h AS root, sha256(coalesce(path, '')) AS proof_sha256, ends.h AS folded_root,
    ends.h = root.h AS verified
FROM placed JOIN parts ON parts.lang IS NOT DISTINCT FROM placed.lang JOIN ends ON ends.r = placed.r
LEFT JOIN ways ON ways.r = placed.r, (SELECT h FROM high WHERE n = 1) AS root
"""

TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id,
    (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id))::INT AS rank,
    c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""
