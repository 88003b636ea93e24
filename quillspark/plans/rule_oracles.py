"""DuckDB SQL that gives the same rows as the rule layer's queries."""

from __future__ import annotations

from quillspark.functions import fixed_values as V
from quillspark.plans.oracles import _CONTENT, _IDF, _PART, _STEM
from quillspark.plans.rule_queries import ANSWER, PAGE_1, PAGE_2, SPECULATION

ORACLES: dict[str, str] = {}


def _re(pattern: str) -> str:
    """The same pattern for DuckDB's matcher, which needs neither possessive repeats nor Java's flags, as the inside of a SQL string."""
    return pattern.replace("*+", "*").replace("(?U)", "").replace("(?md)", "(?m)").replace("'", "''")


def _strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_TRIM = "trim({x}, ' ' || chr(9) || chr(10) || chr(13))"
# fixed values, written for DuckDB's matcher on their own: a fault in the queries' patterns is not one of these too
_BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NUMBER = rf"\bIS(?:/[A-Z]+)?{_BLANK}*[0-9]{{2,6}}(?:(?:{_BLANK}|[-:])[0-9]+)?\b"
_ORDER = "First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth"
_HEAD_NUMBER = r"[0-9]+(?:\.[0-9]+)*"
_HEADING = rf"{_HEAD_NUMBER}{_BLANK}+[A-Z][A-Za-z0-9 ,\-/&()]{{2,80}}"
_EDITION = rf"(?i)\b({_ORDER}){_BLANK}+(Revision|Edition|Reprint)\b"
_TITLE_END = rf"(?i)^\(?{_BLANK}*({_ORDER}){_BLANK}+(Revision|Edition|Reprint){_BLANK}*\)?$|^ICS\b|^©|^{_HEAD_NUMBER}{_BLANK}+[A-Z]"
_PAGES = f"""pages_ AS (SELECT p_partkey AS document_id, 1 AS page_number, {PAGE_1} AS text FROM part UNION ALL SELECT p_partkey, 2, {PAGE_2} FROM part)"""
_BOTH = f"""{_PAGES}, both_ AS (SELECT document_id, string_agg(text, chr(10) ORDER BY page_number) AS text FROM pages_ GROUP BY ALL)"""
_META = f"""{_BOTH},
    l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '') AS lines FROM both_),
    b AS (SELECT *, lines[list_position(list_transform(lines, lambda x: lower(x)), 'indian standard') + 1 :][1:{V.TITLE_LINES}] AS after_, list_contains(list_transform(lines, lambda x: lower(x)), 'indian standard') AS marked FROM l),
    e AS (SELECT *, coalesce(list_position(list_transform(after_, lambda x: regexp_matches(x, '{_TITLE_END}')), true), 99) AS stop FROM b),
    meta AS (SELECT document_id, nullif(regexp_extract(text, '{_NUMBER}'), '') AS standard_number, CASE WHEN marked THEN nullif(array_to_string(after_[1 : stop - 1], ' '), '') END AS title,
        nullif(regexp_extract(text, '{_EDITION}'), '') AS edition, nullif(regexp_extract(regexp_replace(text, '{_NUMBER}', ' # ', 'g'), '\\b(19[5-9][0-9]|20[0-9][0-9])\\b', 1), '') AS publication_year FROM e)"""
ORACLES["standard_metadata"] = f"WITH {_META} SELECT * FROM meta"



def _lines(pages: str) -> str:
    return f"""{pages},
    lines AS (SELECT document_id, page_number, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM pages_),
    heads AS (SELECT *, regexp_full_match(line, '{_HEADING}') AS head FROM lines)"""


def _clauses(pages: str) -> str:
    return f"""{_lines(pages)},
    numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY document_id, page_number ORDER BY no) AS sec, bool_or(head) OVER (PARTITION BY document_id, page_number) AS any_ FROM heads),
    joined AS (SELECT document_id, page_number, sec, any_, {_TRIM.format(x="string_agg(line, chr(10) ORDER BY no)")} AS text FROM numbered GROUP BY ALL),
    clauses_ AS (SELECT document_id, page_number, sec, CASE WHEN sec > 0 THEN regexp_extract(text, '^{_HEAD_NUMBER}') END AS section, text FROM joined WHERE text <> '' AND (sec > 0 OR NOT any_))"""


def _upper(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '{_NUMBER}'), lambda y: upper({_TRIM.format(x='y')})))"


ORACLES["standard_scopes"] = f"""WITH {_lines(_PAGES)},
    starts AS (SELECT document_id, page_number, min(no) AS line_ FROM heads WHERE regexp_full_match(line, '(?:{_HEAD_NUMBER}[ \\t]+)?(?i:SCOPE)[ \\t]*') GROUP BY ALL),
    first_ AS (SELECT document_id, min(page_number) AS page_number, arg_min(line_, page_number) AS line_ FROM starts GROUP BY document_id),
    ends AS (SELECT f.document_id, f.page_number, f.line_, coalesce(min(h.no) FILTER (h.head), 1000000) AS stop FROM first_ f JOIN heads h ON h.document_id = f.document_id AND h.page_number = f.page_number AND h.no > f.line_ GROUP BY ALL)
    SELECT e.document_id, e.page_number, {_TRIM.format(x="string_agg(h.line, chr(10) ORDER BY h.no)")} AS scope_text
    FROM ends e JOIN heads h ON h.document_id = e.document_id AND h.page_number = e.page_number AND h.no >= e.line_ AND h.no < e.stop GROUP BY e.document_id, e.page_number"""
_PARTS = rf"(?m)^({_HEAD_NUMBER}){_BLANK}+([A-Z][A-Za-z0-9 ,\-/&()]{{2,80}})$"
ORACLES["standard_features"] = f"""WITH {_PAGES},
    n AS (SELECT document_id, page_number, list_transform(regexp_extract_all(text, '{_NUMBER}'), lambda x: {_TRIM.format(x='x')}) AS l FROM pages_),
    u AS (SELECT document_id, page_number, unnest(l) AS value, generate_subscripts(l, 1) AS i FROM n), f AS (SELECT document_id, page_number, value, min(i) AS i FROM u GROUP BY ALL),
    h AS (SELECT document_id, page_number, regexp_extract_all(text, '{_PARTS}', 1) AS a, regexp_extract_all(text, '{_PARTS}', 2) AS b FROM pages_)
    SELECT document_id, page_number, 'standard_number_mention' AS feature_type, row_number() OVER (PARTITION BY document_id, page_number ORDER BY i) - 1 AS pos, value, NULL AS section FROM f
    UNION ALL SELECT document_id, page_number, 'section_heading', generate_subscripts(a, 1) - 1, unnest(a) || ' ' || {_TRIM.format(x='unnest(b)')}, unnest(a) FROM h"""
ORACLES["standard_clauses"] = f"WITH {_clauses(_PAGES)} SELECT document_id, page_number, section, text FROM clauses_"
_CASES = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{k}' END" for k, words in V.REQUIREMENT_KEYWORDS.items())
ORACLES["standard_requirements"] = f"""WITH {_clauses(_META)},
    r AS (SELECT c.*, standard_number, list_transform(regexp_extract_all(text, '{_NUMBER}'), lambda x: {_TRIM.format(x='x')}) AS l, list_filter([{_CASES}], lambda x: x IS NOT NULL) AS k FROM clauses_ c JOIN meta USING (document_id) WHERE regexp_matches(text, '{V.OBLIGATION}')),
    u AS (SELECT document_id, page_number, sec, standard_number, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM r),
    f AS (SELECT document_id, page_number, sec, v, min(i) AS i FROM u WHERE v IS DISTINCT FROM standard_number GROUP BY ALL),
    s AS (SELECT document_id, page_number, sec, string_agg(v, ', ' ORDER BY i) AS refs FROM f GROUP BY ALL)
    SELECT document_id, page_number, unnest(k) AS category, section AS clause_number, text AS requirement_text, refs AS referenced_standards FROM r LEFT JOIN s USING (document_id, page_number, sec)"""

_ANSWERS = f"""a AS (SELECT p_partkey AS answer_id, {ANSWER} AS text, p_size, p_type, p_size % 10 < 8 AS backed FROM part)"""
ORACLES["answer_verdicts"] = f"""WITH {_ANSWERS},
    k AS (SELECT *, CASE WHEN backed THEN list_concat(['IS ' || (100 + answer_id)], {_upper("concat('says IS ', 2000 + p_size)")}) ELSE [] END AS known FROM a),
    c AS (SELECT answer_id, coalesce(array_to_string(list_sort(list_filter({_upper('text')}, lambda z: NOT list_contains(known, z))), '|'), '') AS fabricated,
        len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_matches(s, '{_re(V.MANDATORY_WORDS)}') AND NOT regexp_matches(s, '{_re(V.NEGATION_WORDS)}'))) > 0 AS mandatory_claim,
        p_size % 3 = 0 AND regexp_matches(text, '{_re(V.CHECKLIST_ITEM)}') AS checklist_claim, p_size % 2 = 1 AS profile_claim FROM k)
    SELECT *, fabricated = '' AND NOT mandatory_claim AND NOT checklist_claim AND NOT profile_claim AS is_safe FROM c"""
ORACLES["answer_unverified"] = f"""WITH {_ANSWERS},
    u AS (SELECT answer_id, p_size, backed, unnest(regexp_extract_all(text, '{_NUMBER}')) AS raw, generate_subscripts(regexp_extract_all(text, '{_NUMBER}'), 1) AS i FROM a),
    k AS (SELECT *, regexp_extract(raw, '\\d{{2,6}}') AS key, regexp_replace({_TRIM.format(x='raw')}, '\\s+', ' ', 'g') AS spelt FROM u),
    n AS (SELECT * FROM k WHERE NOT (backed AND key IN ((100 + answer_id)::VARCHAR, (200 + p_size)::VARCHAR, (2000 + p_size)::VARCHAR))),
    f AS (SELECT answer_id, key, arg_min(spelt, i) AS spelt FROM n GROUP BY ALL)
    SELECT a.answer_id, coalesce(string_agg(spelt, '|' ORDER BY spelt), '') AS unverified FROM a LEFT JOIN f USING (answer_id) GROUP BY ALL"""
_OPENERS = "^(?:" + "|".join(x.replace(".", r"\.") for x in V.SPECULATION_OPENERS) + ")"
ORACLES["answer_trims"] = f"""WITH w AS (SELECT p_partkey, {_TRIM.format(x=SPECULATION)} AS whole FROM part),
    p AS (SELECT p_partkey, whole, list_filter(string_split(regexp_replace(regexp_replace(whole, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: {_TRIM.format(x='x')} <> '') AS l FROM w),
    u AS (SELECT p_partkey, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM p),
    s AS (SELECT *, lag(piece) OVER (PARTITION BY p_partkey ORDER BY i) AS before_ FROM u),
    c AS (SELECT *, i > 1 AND (regexp_matches(regexp_replace(lower({_TRIM.format(x='piece')}), '^[*\\-•#0123456789. )]+', ''), '{_re(_OPENERS)}') OR regexp_matches(piece, '{_re(V.OUTSIDE_BODIES)}')
        OR regexp_matches(piece, '^\\s*(?:\\d+[.)]|[-*•])\\s+') AND NOT len(list_filter({_strings(V.SUMMARY_LEAD_INS)}, lambda x: contains(lower(before_), x))) > 0) AS ends FROM s),
    t AS (SELECT p_partkey, min(i) AS stop FROM c WHERE ends GROUP BY ALL),
    k AS (SELECT p_partkey, string_agg({_TRIM.format(x='piece')}, ' ' ORDER BY i) AS kept FROM c JOIN t USING (p_partkey) WHERE i < stop GROUP BY ALL)
    SELECT w.p_partkey, CASE WHEN stop IS NULL THEN whole ELSE kept || chr(10) || chr(10) || {_strings([V.TRIM_NOTICE])[1:-1]} END AS text FROM w LEFT JOIN t USING (p_partkey) LEFT JOIN k USING (p_partkey)"""
_TEXT = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
ORACLES["answer_notes"] = f"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || ' ' || chr(10) WHEN 1 THEN p_name || {_TEXT(V.UNVERIFIED_NOTE)} || 'IS ' || (100 + p_partkey) || {_TEXT(V.UNVERIFIED_ONE)}
        ELSE p_name || {_TEXT(V.UNVERIFIED_NOTE)} || 'IS ' || (100 + p_partkey) || ', IS 7' || {_TEXT(V.UNVERIFIED_MANY)} END AS warned,
    CASE WHEN p_size % 2 = 0 THEN {_TEXT(V.FALLBACK_HEAD)} || chr(10) || '- ' || p_name || CASE WHEN p_brand <> p_name THEN chr(10) || '- ' || p_brand ELSE '' END ELSE {_TEXT(V.FALLBACK_NONE)} END AS fallback FROM part"""
ORACLES["rephrases"] = """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN 6 * length(p_name) <= 1.5 * length(p_name) + 40 ELSE length(p_type) <= 1.5 * length(p_name) + 40 END AS safe FROM part"""
_QUESTIONS = " || ".join(["chr(10)"] + [f"'{i}. ' || {_TEXT(q)}" + (" || chr(10)" if i < len(V.FALLBACK_QUESTIONS) else "") for i, (_, q) in enumerate(V.FALLBACK_QUESTIONS, 1)])
ORACLES["prompt_texts"] = f"""SELECT p_partkey, {_TEXT(V.PROFILE_HEAD)} || CASE WHEN p_size % 2 = 0 THEN chr(10) || '- Product name: ' || p_name ELSE '' END || chr(10) || '- Category: ' || lower(p_type) AS profile,
    {_TEXT(V.QUESTIONS_HEAD)} || {_QUESTIONS} AS questions,
    CASE p_size % 3 WHEN 0 THEN {_TEXT(V.CHECKLIST_OPEN)} WHEN 1 THEN {_TEXT(V.CHECKLIST_NONE)} ELSE {_TEXT(V.CHECKLIST_HEAD)} || repeat(chr(10) || '- [MARKING] ' || p_name || ' — STATUS: CONFIRMED, REGULATORY STATUS: NOT_DETERMINED' || chr(10) || '  ' || p_type, 2) END AS checklist,
    {_TEXT(V.LANGUAGE_LINE[0])} || CASE p_size % 3 WHEN 0 THEN 'English (en' WHEN 1 THEN 'Hindi (hi' ELSE 'ta (ta' END || {_TEXT(V.LANGUAGE_LINE[1])} AS language FROM part"""
ORACLES["request_checks"] = """WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN repeat(c_name, 60) ELSE c_name END AS text FROM customer)
    SELECT k AS c_custkey, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 1000 THEN 'too long' WHEN k % 25 NOT BETWEEN 1 AND 20 THEN 'top_k out of range' END AS query,
        CASE WHEN 5 * length(text) > 4000 THEN 'too long' WHEN k % 4 = 1 THEN 'unsupported language' WHEN k % 7 = 1 THEN 'unsupported mode' END AS message, CASE WHEN trim(text) = '' THEN 'blank name' WHEN k % 3 <> 0 THEN 'bad pin' END AS user FROM t"""
ORACLES["parsed_profile_fields"] = """SELECT p_partkey, 3 - (p_size % 2 = 0)::INT AS n, trim(p_name) AS product_name, CASE WHEN p_size % 2 = 1 THEN p_size::VARCHAR END AS capacity, trim(p_type) AS materials, NULL AS technology FROM part"""
ORACLES["page_texts"] = f"""SELECT p_partkey, CASE WHEN length({_TRIM.format(x="CASE WHEN p_size % 3 = 0 THEN p_name[1:9] ELSE p_name END")}) >= 10 THEN 'native' ELSE 'ocr' END AS method,
    '[TABLE]' || chr(10) || 'Size | Type' || chr(10) || p_size || ' | ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END || chr(10) || '[/TABLE]' AS block FROM part"""
ORACLES["scanned_pages"] = f"""WITH w AS (SELECT item_id AS document_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark)
    SELECT document_id, pos % 3 AS page_number, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (pos % 11 <> 4 AND {_TRIM.format(x='word')} <> ''), '') AS text, round(avg(pos * 7 % 102 - 1) FILTER (pos * 7 % 102 >= 1) / 100, 6) AS ocr_confidence FROM w GROUP BY ALL"""
ORACLES["appended_rows"] = "SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id + 1000000000, quality, toxic FROM labels WHERE quality = 1"
ORACLES["document_types"] = "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'QCO' WHEN 2 THEN NULL ELSE 'OTHER' END AS document_type FROM part"
ORACLES["owned_fetch"] = "SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN user_id % 5 END AS owner FROM events WHERE user_id % 7 = 0 OR user_id % 5 = 3"
ORACLES["document_states"] = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 'failed' ELSE 'completed' END AS status FROM part"
_STAGES = """RECURSIVE e AS (
        SELECT user_id AS document_id, ts, event_id,
            ['processing', 'text_extracted', 'features_extracted', 'completed', 'failed', 'processing', 'paused'][event_id * 5 % 7 + 1] AS status,
            row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS i
        FROM events),
    legal(a, b) AS (VALUES
        ('uploaded', 'processing'), ('uploaded', 'failed'), ('processing', 'text_extracted'), ('processing', 'failed'), ('text_extracted', 'features_extracted'),
        ('text_extracted', 'failed'), ('features_extracted', 'completed'), ('features_extracted', 'failed')),
    f AS (
        SELECT document_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS status, NULL::VARCHAR AS before, 'uploaded' AS after FROM (SELECT DISTINCT document_id FROM e)
        UNION ALL
        SELECT e.document_id, e.i, e.event_id, e.status, f.after, CASE WHEN (f.after, e.status) IN (SELECT (a, b) FROM legal) THEN e.status ELSE f.after END
        FROM f JOIN e ON e.document_id = f.document_id AND e.i = f.i + 1)"""
ORACLES["stage_transitions"] = f"WITH {_STAGES} SELECT document_id, event_id, status, before, after, before <> after AS accepted FROM f WHERE i > 0"
ORACLES["stage_states"] = f"""WITH {_STAGES}
    SELECT document_id, max_by(after, i) AS state, count(*) FILTER (i > 0 AND before <> after) AS n_accepted, count(*) FILTER (i > 0 AND before = after) AS n_illegal
    FROM f GROUP BY document_id"""

ORACLES["external_attempts"] = """
    WITH RECURSIVE r AS (
        SELECT l_suppkey AS query_id, l_orderkey AS position, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS identifier,
            CASE WHEN l_quantity >= 8 THEN l_partkey % 97 END AS content, l_tax = 0 AS refused, l_returnflag <> 'N' AS completed
        FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, identifier) AS i FROM r),
    a AS (SELECT *, row_number() OVER (ORDER BY query_id, i) AS g FROM n WHERE i <= 3),
    -- one attempt after another: the contents known so far, and whether this search is over
    t AS (
        SELECT 0::BIGINT AS g, NULL::BIGINT AS query_id, NULL::BIGINT AS position, NULL::VARCHAR AS identifier, false AS over_, NULL::VARCHAR AS outcome,
            (SELECT list(DISTINCT p_partkey % 97) FROM part WHERE p_partkey < 5) AS known
        UNION ALL
        SELECT g, query_id, position, identifier, over_ OR outcome IN ('duplicate', 'ingested'), outcome,
            CASE WHEN outcome IN ('incomplete', 'ingested') THEN list_append(known, content) ELSE known END
        FROM (
            SELECT *, CASE WHEN over_ THEN 'not tried' WHEN content IS NULL THEN 'unreachable' WHEN refused THEN 'refused'
                WHEN list_contains(known, content) THEN 'duplicate' WHEN completed THEN 'ingested' ELSE 'incomplete' END AS outcome
            FROM (SELECT a.*, t.known, t.over_ AND t.query_id = a.query_id AS over_ FROM t JOIN a ON a.g = t.g + 1)))
    SELECT query_id, position, identifier, outcome FROM t WHERE g > 0"""

_WORDS = r"SELECT DISTINCT unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS word FROM benchmark"
ORACLES["dictionary_parts"] = f"""WITH w AS ({_WORDS})
    SELECT DISTINCT word, p_partkey FROM part JOIN w ON contains(lower(p_name), word) OR contains(lower(p_type), word)"""
ORACLES["dictionary_categories"] = f"""WITH w AS (SELECT * FROM ({_WORDS}) WHERE length(word) >= 9)
    SELECT DISTINCT doc_id, left(word, 1) AS category FROM documents JOIN w ON contains(lower(text), word)"""

ORACLES["reindex_completed"] = "SELECT doc_id, source, CASE WHEN lang = 'en' AND source <> 'src0' THEN -n_chars ELSE n_chars END AS n_chars FROM documents"
ORACLES["fallbacks"] = """WITH a AS (SELECT l_partkey AS query_id, bool_or(l_returnflag = 'A') AS any_ FROM lineitem GROUP BY ALL)
    SELECT p_partkey AS query_id, p_size % 4 <> 0 AND NOT coalesce(any_, false) AS fallback, CASE WHEN p_size % 2 = 1 AND p_type <> '' THEN p_type WHEN p_size % 3 = 0 THEN p_name ELSE lower(p_brand) END AS words FROM part LEFT JOIN a ON query_id = p_partkey"""
ORACLES["evidence_standards"] = "SELECT DISTINCT o_orderkey, p_partkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F'"
ORACLES["session_users"] = """SELECT sha256((l_orderkey * 2)::VARCHAR) AS token, c_custkey AS user_id, c_name AS username FROM lineitem JOIN orders ON o_orderkey = l_orderkey * 2 JOIN customer ON c_custkey = o_custkey"""
ORACLES["touched"] = "SELECT event_id, now() > ts AS later FROM events"
_HASHED = "list_sum(list_transform(string_split({x}, ''), lambda c: unicode(c)))::BIGINT"
ORACLES["unit_vectors"] = f"""WITH s AS (SELECT doc_id, {_HASHED.format(x="'passage: ' || text")} AS t FROM documents), v AS (SELECT doc_id, list_transform(range(8), lambda i: ((t + i) % 100) / 100) AS v FROM s)
    SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS v0, 1.0::DOUBLE AS norm FROM v WHERE doc_id IS NOT NULL"""

_VECTOR = "(SELECT list_transform(range(8), lambda i: ((t + i) % 100) / 100) FROM (SELECT {t} AS t))"
_WORLD = f"""ch AS (SELECT doc_id::VARCHAR AS chunk_id, 'D' || doc_id % 60 AS document_id, text || ' IS ' || (doc_id % 50 + 100) AS text FROM documents),
    chunks_ AS (SELECT *, {_HASHED.format(x="'passage: ' || text")} AS t FROM ch),
    vectors_ AS (SELECT *, list_transform(range(8), lambda i: ((t + i) % 100) / 100)::DOUBLE[] AS v FROM chunks_),
    docs_ AS (SELECT 'D' || id AS document_id, 'd' || id || '.pdf' AS document_name, CASE id % 3 WHEN 0 THEN 'TESTING_GUIDANCE' WHEN 1 THEN 'INDIAN_STANDARD' ELSE 'OTHER' END AS document_type, 's' || id % 7 AS standard_id FROM (SELECT DISTINCT doc_id % 60 AS id FROM documents) WHERE id % 5 <> 4)"""


def _nearest(asked: str, k: int, where: str) -> str:
    """top_: the k nearest chunks with a document of each question in asked (query_id, text, ...)."""
    return f"""asked_ AS (SELECT *, {_HASHED.format(x="'query: ' || text")} AS t FROM ({asked})),
    qv AS (SELECT *, list_transform(range(8), lambda i: ((t + i) % 100) / 100)::DOUBLE[] AS qv FROM asked_),
    pairs_ AS (SELECT query_id, chunk_id, c.document_id, document_name, document_type, c.text, list_cosine_similarity(v, qv) AS score FROM qv, vectors_ c JOIN docs_ d USING (document_id) WHERE {where}),
    top_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs_) WHERE rank <= {k})"""


ORACLES["table_pages"] = """
    WITH l AS (SELECT *, l_linenumber || ' part ' || l_partkey || CASE WHEN l_tax > 0 THEN ' ' || l_returnflag ELSE '' END AS flat,
            l_linenumber || ' | part ' || l_partkey || ' | ' || CASE WHEN l_tax > 0 THEN l_returnflag ELSE '' END AS cells
        FROM lineitem),
    p AS (SELECT l_orderkey, string_agg(flat, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS region,
            '[TABLE]' || chr(10) || string_agg(cells, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) || chr(10) || '[/TABLE]' AS block
        FROM l GROUP BY l_orderkey),
    t AS (SELECT *, 'Order ' || l_orderkey || chr(10) || CASE WHEN l_orderkey % 4 = 0 THEN upper(region) ELSE region END || chr(10) || region AS text FROM p)
    SELECT l_orderkey, sha256(left(text, position(region IN text) - 1) || block || substr(text, position(region IN text) + length(region))) AS sha256 FROM t"""
ORACLES["embedded_documents"] = """
    WITH c AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ''), lambda x: unicode(x)::BIGINT) AS p FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(p) - 1), lambda i: ((p[i] * 31 + p[i + 1]) * 31 + p[i + 2]) % 384)) AS place FROM c),
    n AS (SELECT doc_id, place, count(*) AS n FROM g GROUP BY ALL),
    s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm, sum(n * place) AS places, count(*) AS k FROM n GROUP BY doc_id)
    SELECT doc_id, 'hashed-grams-3-384' AS model, 384 AS dimension, (CASE WHEN k IS NULL THEN 0 ELSE 1 END)::DOUBLE AS norm,
        round(coalesce(places / norm / 384, 0.0), 2) AS mean_place, coalesce(k, 0)::DOUBLE AS n_places
    FROM documents LEFT JOIN s USING (doc_id)"""
ORACLES["restricted_retrieval"] = f"""WITH {_WORLD}, {_nearest("SELECT item_id AS query_id, text, CASE WHEN item_id % 3 = 1 THEN 'D' || (item_id % 60 - (item_id % 5 = 4)::INT) END AS want_doc, CASE WHEN item_id % 3 = 2 THEN 's' || item_id % 9 END AS want_std FROM benchmark", 4,
    "(want_doc IS NULL OR want_doc = c.document_id) AND (want_std IS NULL OR want_std = d.standard_id) AND d.document_type IN ('INDIAN_STANDARD', 'OTHER')")}
    SELECT query_id, rank, chunk_id, document_id, document_name, document_type, round(score, 6) AS score FROM top_"""

ORACLES["plain_turns"] = f"""WITH {_WORLD}, {_nearest("SELECT item_id AS query_id, text FROM benchmark", 5, "true")},
    w AS (SELECT item_id AS query_id, {_CONTENT} AS words FROM benchmark),
    e AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM top_),
    s AS (SELECT query_id, list(DISTINCT {_STEM.format(w='x')}) AS stems FROM e GROUP BY ALL),
    o AS (SELECT query_id, len(words) > 0 AND stems IS NOT NULL AND len(list_intersect(words, coalesce(stems, []))) / len(words) < 0.5 AS off_corpus FROM w LEFT JOIN s USING (query_id)),
    k AS (SELECT query_id, list(DISTINCT n) AS known FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '(?:^|[^a-z0-9])is[._\\-\\s]*([0-9]{{2,6}})', 1)) AS n FROM top_) GROUP BY ALL),
    c AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS citations FROM top_ GROUP BY ALL),
    a AS (SELECT query_id, off_corpus, coalesce(citations, '') AS citations,
            'The documents name IS ' || (query_id % 60 + 100) || '.' || CASE WHEN off_corpus THEN chr(10) || chr(10) || {_TEXT(V.TRIM_NOTICE)} ELSE ' Generally, IS 99999 and IS 77777 are asked for.' END AS text,
            list_filter(CASE WHEN off_corpus THEN [(query_id % 60 + 100)::VARCHAR] ELSE [(query_id % 60 + 100)::VARCHAR, '77777', '99999'] END, lambda x: NOT list_contains(coalesce(known, []), x)) AS bad
        FROM o LEFT JOIN k USING (query_id) LEFT JOIN c USING (query_id)),
    b AS (SELECT *, array_to_string(list_transform(bad, lambda x: 'IS ' || x), ',') AS unverified FROM a)
    SELECT query_id, off_corpus, unverified, citations,
        text || CASE WHEN len(bad) = 0 THEN '' ELSE {_TEXT(V.UNVERIFIED_NOTE)} || replace(unverified, ',', ', ') || CASE WHEN len(bad) > 1 THEN {_TEXT(V.UNVERIFIED_MANY)} ELSE {_TEXT(V.UNVERIFIED_ONE)} END END AS content
    FROM b"""

_TOKENS = r"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}]+')"
_SCALED = "CASE WHEN {v} IS NULL THEN NULL WHEN max({v}) OVER w = min({v}) OVER w THEN 1.0 ELSE ({v} - min({v}) OVER w) / (max({v}) OVER w - min({v}) OVER w) END"
ORACLES["discovery_candidates"] = f"""WITH {_WORLD},
    i AS (SELECT item_id AS query_id, {_TOKENS.format(x='text')} AS w FROM benchmark),
    raw AS (SELECT query_id, w, [concat_ws(' ', w[1], w[2]), w[3], w[4], w[4] || ' ' || w[3]] AS l, CASE WHEN query_id % 3 = 0 THEN ['IS ' || (query_id % 50 + 100)] ELSE []::VARCHAR[] END AS ids FROM i),
    uniq AS (SELECT query_id, w, ids, list_filter(l, lambda x, k: x IS NOT NULL AND x <> '' AND NOT list_contains(l[:k - 1], x)) AS terms FROM raw),
    {_nearest("SELECT query_id, array_to_string(terms, ' ') AS text FROM uniq WHERE len(terms) > 0", V.POOL_SEMANTIC, "true")},
    c AS (SELECT chunk_id, {_TOKENS.format(x='text')} AS toks FROM chunks_), stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM c),
    places AS (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS word FROM c),
    terms_ AS (SELECT query_id, unnest(list_concat(terms, ids)) AS term, generate_subscripts(list_concat(terms, ids), 1) AS pos FROM uniq),
    p AS (SELECT query_id, pos, term, unnest(string_split(lower(term), ' ')) AS word, generate_subscripts(string_split(term, ' '), 1) AS no FROM terms_),
    h AS (SELECT query_id, pos, term, no, chunk_id, dl, count(*) AS f FROM places JOIN p USING (word) GROUP BY ALL),
    d AS (SELECT *, count(*) OVER (PARTITION BY query_id, pos, no) AS df FROM h),
    bm AS (SELECT query_id, pos, term, chunk_id, -sum({_PART}) AS bm25, count(*) AS has FROM d CROSS JOIN stats GROUP BY ALL),
    full_ AS (SELECT bm.* FROM bm JOIN (SELECT query_id, pos, count(*) AS want FROM p GROUP BY ALL) USING (query_id, pos) WHERE has = want),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY round(bm25, 9), chunk_id) AS place FROM full_),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY bm25, pos) AS one FROM r WHERE place <= {V.POOL_KEYWORD}) WHERE one = 1),
    m AS (SELECT coalesce(t.query_id, b.query_id) AS query_id, coalesce(t.chunk_id, b.chunk_id) AS chunk_id, t.score AS semantic, b.bm25 AS keyword, b.term FROM top_ t FULL JOIN best b ON t.query_id = b.query_id AND t.chunk_id = b.chunk_id),
    x AS (SELECT m.*, k.document_id, dd.document_name, dd.document_type, k.text, {_SCALED.format(v='m.semantic')} AS ns, {_SCALED.format(v='(-m.keyword)')} AS nk FROM m JOIN chunks_ k USING (chunk_id) JOIN docs_ dd USING (document_id) WINDOW w AS (PARTITION BY m.query_id)),
    y AS (SELECT x.*, len(list_filter(ids, lambda v: contains(lower(x.text), lower(v)))) > 0 AS identified, contains(lower(x.text), u.w[3]) OR contains(lower(x.text), u.w[4]) AS matched, u.w[3] AS category_, u.w[4] AS type_ FROM x JOIN uniq u USING (query_id)),
    z AS (SELECT query_id, document_id, category_, type_, coalesce(max(ns), 0) AS ns, coalesce(max(nk), 0) AS nk, max(semantic) AS semantic_score, min(keyword) AS keyword_score,
        max((query_id % 3 = 0 AND document_type IN ('TESTING_GUIDANCE', 'INDIAN_STANDARD') OR query_id % 3 = 1 AND document_type IN ('REGULATORY_ORDER', 'QCO', 'CERTIFICATION_GUIDANCE'))::INT) AS document_type_boost,
        max(identified::INT) AS exact_identifier_boost, max(matched::INT) AS profile_attribute_boost, coalesce(array_to_string(list_sort(list(DISTINCT term) FILTER (term IS NOT NULL)), '|'), '') AS matched_terms, least(count(*), {V.TOP_CANDIDATES})::INT AS n_evidence,
        lower(array_to_string(list(text ORDER BY -(coalesce(ns, 0) + coalesce(nk, 0)), chunk_id)[1:{V.TOP_CANDIDATES}], ' ')) AS said FROM y GROUP BY query_id, document_id, category_, type_),
    f AS (SELECT *, 0.45 * ns + 0.35 * nk + 0.10 * document_type_boost + 0.20 * exact_identifier_boost + 0.10 * profile_attribute_boost AS final_score FROM z),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, document_id) AS rank FROM f) WHERE rank <= {V.TOP_CANDIDATES})
    SELECT query_id, rank, document_id, round(final_score, 6) AS final_score, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score, document_type_boost, exact_identifier_boost, profile_attribute_boost, matched_terms, n_evidence,
        CASE WHEN category_ IS NOT NULL AND (contains(said, category_) OR coalesce(contains(said, type_), false)) THEN 'POTENTIALLY_APPLICABLE' ELSE 'NEEDS_CLARIFICATION' END AS applicability_status FROM k"""
ORACLES["discovery_gate"] = """WITH q AS (SELECT item_id AS query_id, item_id % 6 <> 0 AS stated, item_id % 2 = 0 AS purifier, item_id % 4 = 0 AS conflict FROM benchmark),
    n AS (SELECT *, CASE WHEN purifier THEN CASE WHEN stated THEN 0 ELSE 4 END WHEN stated THEN 2 ELSE 3 END AS n_questions FROM q)
    SELECT query_id, n_questions, n_questions = 0 AND NOT conflict AS gated, CASE WHEN n_questions = 0 AND NOT conflict AND query_id % 8 <> 2 THEN 1 ELSE 0 END AS n_items FROM n"""
ORACLES["eval_topk_hits"] = """WITH q AS (SELECT vec_id AS query_id, label AS l, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM q, embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
    e AS (SELECT query_id, min(vec_id) AS vec_id FROM q JOIN embeddings ON label = l WHERE vec_id % 50 <> 0 GROUP BY ALL)
    SELECT count(*) AS cases, count(*) FILTER (rank <= 1) AS top_1, count(*) FILTER (rank <= 3) AS top_3, count(*) FILTER (rank <= 10) AS top_10, count(*) FILTER (rank <= 30) AS top_30 FROM e JOIN r USING (query_id, vec_id)"""

#: Paragraphs packed one after the other: a row a paragraph, with the chunk as it stands after it.
ORACLES["chunk_documents"] = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '') AS l FROM documents),
    s AS (SELECT doc_id, l, 1 AS i, 0 AS chunk, l[1] AS now FROM d WHERE len(l) > 0
        UNION ALL SELECT doc_id, l, i + 1, CASE WHEN length(now) + 2 + length(l[i + 1]) <= {V.CHUNK_CHARS} THEN chunk ELSE chunk + 1 END,
            CASE WHEN length(now) + 2 + length(l[i + 1]) <= {V.CHUNK_CHARS} THEN now ELSE right(now, {V.OVERLAP_CHARS}) END || chr(10) || chr(10) || l[i + 1] FROM s WHERE i < len(l))
    SELECT doc_id AS document_id, chunk AS chunk_index, length(arg_max(now, i)) AS chars, sha256(arg_max(now, i)) AS sha256 FROM s GROUP BY doc_id, chunk"""
