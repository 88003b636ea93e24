"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_warc"] = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
        CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM f"""

ORACLES["op3_quality_rules"] = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t-\r]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^ \t-\r]+'), 1) AS i FROM d),
    t AS (SELECT doc_id, word, i, lead(word, 2) OVER o AS third, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM t WHERE third IS NOT NULL),
    r AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM c WHERE n > 1) GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (regexp_matches(word, '[A-Za-z\x{80}-\x{10FFFF}]')) AS plain FROM w GROUP BY doc_id),
    m AS (SELECT doc_id, max(n) AS top_word FROM (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_kinds FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY doc_id),
    a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            coalesce(n_lines - n_kinds, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(plain, 0) AS plain, coalesce(top_word, 0) AS top_word, coalesce(n_lines, 0) AS n_lines,
            length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_, strlen(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters
        FROM d LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND 100 * n_symbols <= 20 * n_words AND 100 * n_dup_lines <= 50 * n_lines AND 100 * upper_ <= 50 * letters AND 100 * plain >= 60 * n_words
            AND 100 * top_word <= 40 * n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AS kept
    FROM b"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op4_decontamination"] = f"""
    WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
    spots AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM sized, unnest(range(1, len(w) - n + 2)) AS r(i)),
    placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM dw),
    ahead AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS a FROM placed),
    runs AS (SELECT doc_id, i, n, array_to_string(a[1:n], ' ') AS s FROM ahead, (SELECT DISTINCT n FROM spots) WHERE len(a) >= n),
    hits AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN spots ON runs.n = spots.n AND runs.s = spots.s),
    hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)"""

ORACLES["op5_line_dedup"] = """
    WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS dn FROM documents),
    l AS (SELECT doc_id, dn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
    g AS (SELECT *, row_number() OVER (ORDER BY dn, i) AS g FROM l),
    w AS (SELECT *, min(g) OVER (PARTITION BY line) AS f,
            CASE WHEN lead(i, 3) OVER o IS NOT NULL
            THEN md5(line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o || chr(10) || lead(line, 3) OVER o) END AS run
        FROM g WINDOW o AS (PARTITION BY dn ORDER BY i)),
    v AS (SELECT *, CASE WHEN run IS NOT NULL AND min(g) OVER (PARTITION BY run) < g THEN 1 ELSE 0 END AS late FROM w),
    m AS (SELECT *, length(line) >= 50 AND f < g OR max(late) OVER (PARTITION BY dn ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 AS gone FROM v)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
    FROM m GROUP BY doc_id"""

ORACLES["op8_substring_dedup"] = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
    placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    ahead AS (SELECT doc_id, word, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS a FROM placed),
    named AS (SELECT doc_id, word, i, CASE WHEN len(a) = 13 THEN sha256(array_to_string(a, ' ')) END AS s FROM ahead),
    late AS (SELECT *, CASE WHEN s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN 1 ELSE 0 END AS late FROM named),
    gone AS (SELECT *, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM late),
    kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS words FROM gone GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

ORACLES["op13_fill_in_middle"] = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
            regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS u
        FROM documents),
    r AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS two,
            CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM d),
    c AS (SELECT *, array_to_string(u[1:least(one, two)], '') AS p, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m,
            array_to_string(u[greatest(one, two) + 1:], '') AS s
        FROM r)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM c"""

ORACLES["op11_conversation_repair"] = """
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
        FROM conversations),
    -- the checksum of the key, byte by byte and bit by bit
    c AS (SELECT *, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT)),
                lambda a, b: list_reduce(
                    list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS d
        FROM k),
    r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM c),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
            CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS t, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS kept
        FROM r),
    f AS (SELECT *, CASE WHEN kept = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
            lag(t) OVER (PARTITION BY conv_id ORDER BY i) || t NOT IN ('su', 'ua', 'au') AS illegal
        FROM o),
    n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
            count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
        FROM f GROUP BY conv_id),
    -- states: 0 nothing, 1 after system, 2 after user, 3 after assistant; up to two rows inserted lead from one to another
    ahead(s, s2, ins) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (2, 2, 'II'), (3, 3, ''), (3, 2, 'I'), (3, 3, 'II')),
    edit(s2, t, e, price, s3) AS (
        SELECT s, t, 'D', 2, s FROM range(4) AS a(s), (VALUES ('s'), ('u'), ('a'), ('o')) AS b(t)
        UNION ALL SELECT s, t, 'R', 1, CASE WHEN s = 2 THEN 3 ELSE 2 END FROM range(4) AS a(s), (VALUES ('s'), ('u'), ('a'), ('o')) AS b(t)
        UNION ALL VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (3, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3)),
    p AS (
        SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS s, {'c': 0::BIGINT, 'e': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT p.conv_id, f.i, edit.s3::BIGINT,
            min({'c': p.best.c + 5 * length(ins) + price + CASE WHEN fault = 't' AND e <> 'D' THEN 5 ELSE 0 END, 'e': p.best.e || ins || e})
        FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1 JOIN ahead USING (s) JOIN edit ON edit.s2 = ahead.s2 AND edit.t = f.t
        WHERE e = 'D' OR fault NOT IN ('b', 'd')
        GROUP BY ALL),
    z AS (SELECT p.conv_id, min({'c': best.c + 5 * length(ins), 'e': best.e || ins}) AS best
        FROM p LEFT JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id JOIN ahead USING (s) WHERE p.i = coalesce(n.n, 0) AND s2 IN (0, 3) GROUP BY ALL),
    -- the edits one by one, with the row that each is about
    l AS (SELECT conv_id, best.e AS e, unnest(range(1, length(best.e) + 1)) AS pos FROM z),
    m AS (SELECT *, e[pos:pos] AS x, length(replace(e[1:pos], 'I', '')) AS i FROM l),
    w AS (SELECT m.conv_id, pos, x, CASE WHEN x = 'I' THEN '' ELSE f.text END AS text, f.role, x = 'K' AND f.t = 's' AS sys
        FROM m LEFT JOIN f ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i WHERE x <> 'D'),
    y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 - max(sys::INT) OVER (PARTITION BY conv_id) AS place FROM w),
    h AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS lines
        FROM y GROUP BY conv_id)
    SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, best.c AS cost, best.e AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
    FROM z LEFT JOIN n ON z.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN h ON z.conv_id IS NOT DISTINCT FROM h.conv_id"""
