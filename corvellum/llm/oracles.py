"""DuckDB SQL with the results of this subpackage's queries, where SQL can express them.

Plain all-against-all formulations; they serve as an independent check at small scale.
"""

from __future__ import annotations

from corvellum.llm.looks import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}


def _form(text: str) -> str:
    form = f"regexp_replace({text}, '[\\p{{Cf}}]+', '', 'g')"
    for a, b in _LIGATURES.items():
        form = f"replace({form}, '{a}', '{b}')"
    form = f"translate({form}, '{_WIDE}{GREEK}{CYRILLIC}', '{_NARROW}{GREEK_AS}{CYRILLIC_AS}')"
    return f"nfc_normalize(regexp_replace({form}, '\\p{{Zs}}', ' ', 'g'))"


SQL = {
    # Code points; repeated rows of a key are one item.
    "p1_found": """
        SELECT DISTINCT 'chunk_text' AS item_kind, chunk_id AS item_id FROM chunks WHERE length(text) > 1600
        UNION SELECT DISTINCT 'chunk_embed_text', chunk_id FROM chunks WHERE length(embed_text) > 1700
        UNION SELECT DISTINCT 'full_text', paper_id FROM papers WHERE length(full_text) > 20000""",
    "p2_found": f"""
        WITH w AS (SELECT 'chunk' AS kind, chunk_id AS key, {WORDS.format('text')} AS w FROM chunks WHERE text IS NOT NULL),
        c AS (SELECT 'title' AS kind, paper_id AS key, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS t FROM papers WHERE title IS NOT NULL),
        g AS (SELECT DISTINCT kind, key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT kind, key, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)
              UNION SELECT kind, key, substring(t, i, 3) FROM (SELECT kind, key, t, unnest(generate_series(1, length(t) - 2)) AS i FROM c)),
        n AS (SELECT kind, key, count(*) AS n FROM g GROUP BY ALL),
        b AS (SELECT x.kind, x.key AS key_a, y.key AS key_b, count(*) AS n_both FROM g x JOIN g y ON x.kind = y.kind AND x.g = y.g AND x.key < y.key GROUP BY ALL)
        SELECT b.kind AS item_kind, key_a, key_b FROM b JOIN n p ON p.kind = b.kind AND p.key = key_a JOIN n q ON q.kind = b.kind AND q.key = key_b WHERE n_both >= 0.6 * (p.n + q.n - n_both)""",
    "p3_found": """
        WITH r AS (SELECT DISTINCT 'page:' || paper_id || ':' || page AS rec, paper_id, true AS is_page, text FROM paper_pages WHERE length(text) >= 160
                   UNION SELECT DISTINCT 'cite:' || citation_id, paper_id, false, quote FROM citations WHERE length(quote) >= 160),
        s AS (SELECT rec, paper_id, is_page, substring(text, i, 160) AS s FROM (SELECT *, unnest(generate_series(1, length(text) - 159)) AS i FROM r)),
        h AS (SELECT s FROM s GROUP BY s HAVING count(DISTINCT paper_id) > 1)
        SELECT DISTINCT a.rec AS rec_a, b.rec AS rec_b FROM s a JOIN h USING (s) JOIN s b USING (s) WHERE a.rec < b.rec AND a.paper_id <> b.paper_id AND (a.is_page OR b.is_page)""",
    "p3_coverage": """
        WITH r AS (SELECT DISTINCT 'page:' || paper_id || ':' || page AS rec, paper_id, true AS is_page, text FROM paper_pages WHERE length(text) >= 160
                   UNION SELECT DISTINCT 'cite:' || citation_id, paper_id, false, quote FROM citations WHERE length(quote) >= 160),
        s AS (SELECT rec, paper_id, is_page, i, substring(text, i, 160) AS s FROM (SELECT *, unnest(generate_series(1, length(text) - 159)) AS i FROM r)),
        h AS (SELECT s, min(paper_id) AS x, max(paper_id) AS y FROM s WHERE is_page GROUP BY s),
        k AS (SELECT rec, i, i - lag(i) OVER (PARTITION BY rec ORDER BY i) AS step FROM s JOIN h USING (s) WHERE x <> paper_id OR y <> paper_id),
        c AS (SELECT rec, sum(least(160, coalesce(step, 160)))::BIGINT AS n FROM k GROUP BY rec)
        SELECT rec, length(text)::INT AS n_chars, coalesce(n, 0) AS shared_chars, round(coalesce(n, 0) / length(text), 4) AS shared_share FROM r LEFT JOIN c USING (rec)""",
    "p4_places": f"""
        WITH q AS (SELECT DISTINCT citation_id, paper_id, quote, {_form('quote')} AS form FROM citations WHERE trim(regexp_replace(quote, '[\\s\\p{{Z}}\\p{{Cf}}]+', '', 'g')) <> ''),
        p AS (SELECT DISTINCT paper_id, page, text, {_form('text')} AS form FROM paper_pages)
        SELECT citation_id, page, bool_or(contains(text, quote)) AS is_exact FROM q JOIN p USING (paper_id) WHERE contains(p.form, q.form) GROUP BY ALL""",
    "p4_found": f"""
        WITH q AS (SELECT DISTINCT citation_id, paper_id, quote, {_form('quote')} AS form FROM citations WHERE trim(regexp_replace(quote, '[\\s\\p{{Z}}\\p{{Cf}}]+', '', 'g')) <> ''),
        p AS (SELECT DISTINCT paper_id, page, text, {_form('text')} AS form FROM paper_pages)
        SELECT citation_id FROM q JOIN p USING (paper_id) WHERE contains(p.form, q.form) GROUP BY 1 HAVING NOT bool_or(contains(text, quote))""",
    "p7_found": f"""
        WITH g AS (SELECT id, {WORDS.format('question')} AS w FROM golden UNION ALL SELECT id, {WORDS.format('ground_truth')} FROM golden),
        gw AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM g)),
        d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
        dw AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM d))
        SELECT DISTINCT doc_id, id AS item_id FROM dw JOIN gw USING (s)""",
    "p7_leaks": f"""
        WITH g AS (SELECT id, 'question' AS field, {WORDS.format('question')} AS w FROM golden UNION ALL SELECT id, 'ground_truth', {WORDS.format('ground_truth')} FROM golden),
        gw AS (SELECT DISTINCT id, field, len(w) - 11 AS n, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - 11)) AS i FROM g)),
        dw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)))
        SELECT doc_id, id AS item_id, field, count(*)::INT AS n_windows, max(n)::INT AS item_windows FROM dw JOIN gw USING (s) GROUP BY ALL""",
}
