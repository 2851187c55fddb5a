"""DuckDB SQL with the results of the queries in boundary.py, inputs derived by the same rules."""

from __future__ import annotations

from corvellum.plans.oracles import _CHUNKS, _CITED, _CONFUSION, _CORPUS, _PAGES, _RECALL, _RUNS, _SOURCES, _WINDOWS, BLANKS, _bm25, _folded

_LINE = rf"trim(regexp_replace(regexp_replace({{}}, '([\p{{{{L}}}}\p{{{{N}}}}\p{{{{M}}}}_])-[\s\p{{{{Z}}}}]*\n[\s\p{{{{Z}}}}]*([\p{{{{L}}}}\p{{{{N}}}}\p{{{{M}}}}_])', '\1\2', 'g'), '{BLANKS.replace('{', '{{').replace('}', '}}')}', ' ', 'g'))"
_BLOCKS = f"""{_PAGES},
line AS (SELECT paper_id, page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM pages WHERE text IS NOT NULL),
blocks AS (SELECT paper_id, page, CASE WHEN i % 2 = 1 THEN 320 ELSE 40 END AS x0, (i // 2) * 10 + 20 AS y0, NOT regexp_matches(text, '[0-9]$') AS level, CASE WHEN page = 1 AND i < 2 THEN 18 ELSE 10 END AS size, text FROM line
    UNION ALL SELECT paper_id, page, 40, 1, true, 8, 'Proceedings of the  library' FROM pages UNION ALL SELECT paper_id, page, 40, 9000, true, 8, 'Page ' || page FROM pages),
flat AS (SELECT *, {_LINE.format('text')} AS line FROM blocks WHERE level),
ordered AS (SELECT paper_id, page, line AS text, row_number() OVER (PARTITION BY paper_id, page ORDER BY x0 >= 300, y0, x0, line)::INT AS block_no FROM flat WHERE line <> ''),
n AS (SELECT paper_id, count(DISTINCT page) AS paper_pages FROM ordered GROUP BY 1),
repeated AS (SELECT paper_id, text, count(DISTINCT page) AS n_pages, any_value(paper_pages) AS paper_pages FROM ordered JOIN n USING (paper_id) WHERE length(text) < 120 GROUP BY 1, 2 HAVING any_value(paper_pages) >= 3 AND count(DISTINCT page) >= greatest(2, ceil(round(0.6 * any_value(paper_pages), 9)))),
body AS (SELECT paper_id, page, block_no, text FROM ordered WHERE NOT regexp_matches(text, '^([pP][aA][gG][eE]\\s*)?[0-9]{{1,4}}$') AND NOT EXISTS (SELECT 1 FROM repeated r WHERE r.paper_id = ordered.paper_id AND r.text = ordered.text))"""
_GRADED = f"""{_RUNS}, {_CITED},
graded AS (SELECT thread_id, citation_id, paper_id, page, coalesce(quote, '') AS text, coalesce(verified AND page IS NOT NULL, false) AS rel,
    CASE WHEN page IS NULL THEN false ELSE coalesce(match_type = 'fuzzy', coalesce(verified, false)) END AS topic, page IS NULL AS missing,
    CASE WHEN page IS NULL THEN NULL ELSE length(coalesce(quote, '')) END AS i, CASE WHEN page IS NULL THEN NULL ELSE length(coalesce(match_type, '')) END AS o FROM cited WHERE thread_id IS NOT NULL)"""
_USAGE = f"""{_RUNS}, u0 AS (SELECT thread_id, 'route' AS node, 1 AS seq, length(coalesce(question, '')) AS i, length(coalesce(route, '')) AS o FROM runs
    UNION ALL SELECT thread_id, 'grade', 2, 10 * coalesce(n_graded, 0), coalesce(n_graded, 0) FROM runs WHERE route <> 'direct'
    UNION ALL SELECT thread_id, 'grounding_1', 3, length(coalesce(answer, '')), coalesce(rewrite_count, 0) FROM runs
    UNION ALL SELECT thread_id, 'grounding_2', 4, 2 * length(coalesce(answer, '')), rewrite_count FROM runs WHERE rewrite_count > 0),
u AS (SELECT thread_id, node, seq, i::BIGINT AS input_tokens, o::BIGINT AS output_tokens, round_even((i + 5 * o) / 1e6, 6) AS cost_usd FROM u0)"""
_LABELS = f"""{_RUNS}, labels AS (SELECT id, max(expected) FILTER (WHERE arm = 'with_paper') AS with_paper, max(expected) FILTER (WHERE arm = 'no_paper') AS no_paper FROM runs WHERE id IS NOT NULL GROUP BY 1)"""
_THREADS = """threads AS (SELECT c.thread_id, c.paper_id, title, row_number() OVER (PARTITION BY c.thread_id ORDER BY c.at) AS rank FROM (SELECT thread_id, paper_id, min(citation_id) AS at FROM cited WHERE thread_id IS NOT NULL GROUP BY 1, 2) c LEFT JOIN papers p USING (paper_id))"""
_REFUSAL = "CASE WHEN route = 'single_paper' THEN 'That isn''t covered in this paper.' ELSE 'That isn''t covered in my library.' END"
_FACETS = r"""parts AS (SELECT id AS query_id, CASE WHEN regexp_matches(question, '(?i)\b(differ|differs|difference|differences|compare|compares|compared|comparison|contrast|contrasts|contrasted|versus|vs|both|either|respectively)\b')
    THEN list_filter([trim(question), trim(coalesce(ground_truth, ''))], lambda x: x <> '') ELSE [question] END AS p FROM golden WHERE question IS NOT NULL),
facets AS (SELECT query_id, (generate_subscripts(p, 1) - 1)::INT AS list_no, unnest(p) AS text FROM parts)"""
_WEB = f"""{_CITED}, w AS (SELECT thread_id, 'doc/' || doc_id AS url, coalesce(source, '') AS title, coalesce(left(text, 60), '') AS content, row_number() OVER (PARTITION BY thread_id ORDER BY n_chars DESC NULLS LAST, 'doc/' || doc_id)::INT AS rank
    FROM (SELECT DISTINCT thread_id, paper_id FROM cited WHERE thread_id IS NOT NULL) JOIN documents USING (paper_id) QUALIFY rank <= 5)"""
_SHARE = "printf('%.1f%%', round_even({} * 100, 1))"


def _fixed(x: str) -> str:
    return f"printf('%.3f', round_even({x}, 3))"


_CONFUSION_LINES = f"""SELECT 1 AS line_no, '| expected \\ predicted | single_paper | library | web | direct | total |' AS line UNION ALL SELECT 2, '|---|---|---|---|---|---|'
    UNION ALL SELECT 2 + list_position(['single_paper', 'library', 'web', 'direct'], expected), '| ' || expected || ' | ' || string_agg(CASE WHEN expected = predicted AND n > 0 THEN '**' || n || '**' ELSE n::VARCHAR END, ' | ' ORDER BY list_position(['single_paper', 'library', 'web', 'direct'], predicted)) || ' | ' || sum(n)::BIGINT || ' |' FROM m GROUP BY expected"""
_SCORES = """scores AS (SELECT r AS route, a.s::BIGINT AS support, a.h::BIGINT AS correct, round_even(a.h / nullif(a.s, 0), 4) AS recall, round_even(a.h / nullif(b.s, 0), 4) AS precision FROM dom
    JOIN (SELECT expected, sum(n) AS s, sum(n) FILTER (WHERE expected = predicted) AS h FROM m GROUP BY 1) a ON a.expected = r JOIN (SELECT predicted, sum(n) AS s FROM m GROUP BY 1) b ON b.predicted = r)"""
_SCORE_LINES = f"""SELECT 1 AS line_no, '| route | support | correct | recall | precision |' AS line UNION ALL SELECT 2, '|---|---|---|---|---|'
    UNION ALL SELECT 2 + list_position(['single_paper', 'library', 'web', 'direct'], route), '| ' || concat_ws(' | ', route, support, correct, coalesce({_fixed('recall')}, '—'), coalesce({_fixed('precision')}, '—')) || ' |' FROM scores"""
_STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"

SQL: dict[str, str] = {
    "blocks_in_order": f"WITH {_BLOCKS} SELECT paper_id, page, block_no, text FROM ordered",
    "repeated_blocks": f"WITH {_BLOCKS} SELECT paper_id, text, n_pages, paper_pages FROM repeated",
    "body_blocks": f"WITH {_BLOCKS} SELECT * FROM body",
    "pages_from_blocks": f"WITH {_BLOCKS}, t AS (SELECT paper_id, page, string_agg(text, chr(10) ORDER BY block_no) AS text FROM body GROUP BY 1, 2) SELECT p.paper_id, p.page, coalesce(t.text, '') AS text FROM pages p LEFT JOIN t USING (paper_id, page)",
    "title_lines": rf"""WITH {_BLOCKS}, top AS (SELECT paper_id, size, y0, x0, trim(text) AS text FROM blocks WHERE level AND page = 1 AND y0 < 421 AND trim(text) <> ''),
        big AS (SELECT * FROM top QUALIFY size > max(size) OVER (PARTITION BY paper_id) - 0.5), j AS (SELECT paper_id, string_agg(text, ' ' ORDER BY y0, x0, text) AS t FROM big GROUP BY 1) SELECT paper_id, left({_LINE.format('t')}, 200) AS title FROM j""",
    "enriched_pages": f"""WITH {_PAGES}, {_CITED}, t AS (SELECT paper_id, page, trim(CASE WHEN length(min(quote)) > 60 THEN min(quote) ELSE 'NONE' END) AS x FROM cited WHERE page IS NOT NULL GROUP BY 1, 2)
        SELECT paper_id, page, text || CASE WHEN coalesce(x, '') NOT IN ('', 'NONE') THEN chr(10) || chr(10) || '[TRANSCRIBED EQUATIONS (from page image)]' || chr(10) || x ELSE '' END AS text FROM pages LEFT JOIN t USING (paper_id, page)""",
    "located_quotes": f"""WITH {_PAGES}, {_CITED}, w AS (SELECT citation_id, text, list_filter(string_split(trim(regexp_replace(quote, '{BLANKS}', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM cited JOIN pages USING (paper_id, page) WHERE quote IS NOT NULL AND text IS NOT NULL),
        k AS (SELECT citation_id, text, unnest([array_to_string(w, ' '), CASE WHEN len(w) > 8 THEN array_to_string(w[1:8], ' ') END, CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ' ') END]) AS c, unnest([1, 2, 3]) AS i FROM w)
        SELECT citation_id, (strpos(lower(text), lower(c)) - 1)::INT AS start, length(c)::INT AS chars FROM k WHERE length(c) >= 12 AND contains(lower(text), lower(c)) QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY i) = 1""",
    "folded_quotes": f"WITH {_CITED} SELECT citation_id, {_folded('quote')} AS form FROM cited WHERE quote IS NOT NULL",
    "fenced_texts": f"SELECT id, {_STRIP.format('question')} AS text FROM golden",
    "library_scan": "SELECT left(sha256(n_name || chr(10)), 12) AS paper_id, n_nationkey::INT AS nation, (length(n_name) + 1)::BIGINT AS n_bytes FROM nation",
    "page_files": f"WITH {_PAGES} SELECT paper_id, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars FROM pages WHERE text IS NOT NULL GROUP BY 1",
    "index_rebuild": f"WITH {_CHUNKS} SELECT paper_id, count(*) AS n_chunks, max(chunk_index) AS last FROM kept WHERE year >= 2015 GROUP BY 1",
    "results_newest": "SELECT '20260110T000000Z.json' AS file_name, category, count(*) AS n FROM golden GROUP BY category",
    "question_source": "SELECT id, question, CASE WHEN category <> 'unanswerable' THEN coalesce(ground_truth, '') ELSE '' END AS ground_truth, coalesce(array_to_string(expected_paper_ids, ','), '') AS expected, category FROM golden",
    "ingest_twice": f"WITH {_WINDOWS} SELECT paper_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars, (count(*) - 1)::INT AS last FROM windows GROUP BY 1",
    "answer_frames": f"""WITH {_RUNS} SELECT thread_id, 'event: answer' || chr(10) || 'data: {{"thread_id":"' || thread_id || '","route":"' || coalesce(route, '') || '","verdict":"' || coalesce(verdict, '') || '"}}' || chr(10) || chr(10) AS frame FROM runs""",
    "labels_by_arm": f"WITH {_LABELS} SELECT id, arm, expected, question, category FROM (SELECT id, 'with_paper' AS arm, with_paper AS expected FROM labels UNION ALL SELECT id, 'no_paper', no_paper FROM labels) JOIN golden USING (id)",
    "known_labels": f"WITH {_LABELS} SELECT id, with_paper, no_paper FROM labels WHERE id IN (SELECT id FROM golden)",
    "configurations": "SELECT s AS strategy, m AS mode FROM (SELECT unnest(['fixed', 'section', 'section_context']) AS s), (SELECT unnest(['dense', 'bm25', 'hybrid', 'rerank']) AS m)",
    "rows_without_errors": f"WITH {_RUNS} SELECT thread_id, arm FROM runs WHERE verdict IS DISTINCT FROM 'api_refused'",
    "first_and_last_pass": f"WITH {_RUNS} SELECT thread_id, (1 + (n_retrieval_passes > 1)::INT)::BIGINT AS n_passes, recall_at_5_first_pass AS first, CASE WHEN n_retrieval_passes > 1 THEN recall_at_5_final_pass ELSE recall_at_5_first_pass END AS last FROM runs",
    "refusal_openings": f"WITH {_RUNS} SELECT thread_id, coalesce(is_unanswerable, false) OR coalesce(regexp_matches({_STRIP.format('answer')}, '^That isn''t covered in (this paper|my library)\\.'), false) AS is_refusal FROM runs",
    "refusals_by_claims": f"WITH {_RUNS} SELECT thread_id, coalesce(verdict, '') <> 'api_refused' AND NOT coalesce(n_citations > 0, true) AND coalesce(n_unsupported, 0) = 0 AS is_refusal FROM runs",
    "support_verdicts": f"""WITH {_RUNS}, v AS (SELECT *, coalesce(n_unsupported, 0) AS a, coalesce(n_unverified, 0) AS b, coalesce(n_citations, 0) - coalesce(n_unverified, 0) AS c, coalesce(n_citations > 0, true) AS s FROM runs)
        SELECT thread_id, CASE WHEN coalesce(verdict = 'api_refused', false) THEN 'api_refused' WHEN coalesce({_STRIP.format('answer')}, '') = '' THEN 'not_checked' WHEN a = 0 AND b = 0 THEN 'grounded' WHEN s AND c = 0 THEN 'ungrounded' ELSE 'partially_grounded' END AS support FROM v""",
    "refusal_texts": f"WITH {_RUNS} SELECT thread_id, {_REFUSAL} AS refusal FROM runs",
    "open_paper_citations": f"WITH {_CITED}, {_THREADS} SELECT c.citation_id FROM cited c JOIN threads t USING (thread_id, paper_id) JOIN threads o ON o.thread_id = c.thread_id AND o.rank = 1 WHERE t.title IS NULL OR t.title = o.title",
    "decoded_states": f"WITH {_RUNS} SELECT thread_id, CASE WHEN verdict IS NOT NULL THEN route END AS route, CASE WHEN verdict IS NOT NULL THEN rewrite_count END AS rewrite_count FROM runs",
    "unknown_papers": f"WITH {_CITED}, u AS (SELECT DISTINCT paper_id FROM cited WHERE paper_id IS NOT NULL AND paper_id NOT IN (SELECT paper_id FROM papers WHERE year IS NOT NULL)) SELECT (SELECT count(*) FROM u) AS n_unknown, (SELECT string_agg(paper_id, ',' ORDER BY paper_id) FROM (SELECT paper_id FROM u ORDER BY 1 LIMIT 5)) AS first_five",
    "isolated_rows": f"WITH {_RUNS} SELECT thread_id, round(cost_usd / nullif(n_graded, 0), 6) AS cost_a_passage, CASE WHEN cost_usd / nullif(n_graded, 0) IS NULL THEN 'nothing was graded' END AS error FROM runs",
    "node_usage_rows": f"WITH {_USAGE} SELECT thread_id, node, input_tokens, output_tokens, cost_usd FROM u",
    "usage_added": f"WITH {_USAGE} SELECT thread_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round_even(sum(cost_usd), 6) AS cost_usd FROM u GROUP BY 1",
    "total_costs": f"WITH {_USAGE} SELECT thread_id, round_even(sum(cost_usd), 6) AS total_usd FROM u GROUP BY 1",
    "last_node_usage": f"WITH {_USAGE}, n AS (SELECT *, CASE WHEN node LIKE 'grounding%' THEN 'grounding' ELSE node END AS name FROM u) SELECT thread_id, name AS node, input_tokens, output_tokens, cost_usd FROM n QUALIFY row_number() OVER (PARTITION BY thread_id, name ORDER BY seq DESC) = 1",
    "call_costs": f"WITH {_USAGE} SELECT thread_id, node, round_even(CASE WHEN node = 'route' THEN input_tokens + 5 * output_tokens ELSE 3 * input_tokens + 15 * output_tokens + 3.75 * seq END / 1e6, 6) AS usd FROM u",
    "trace_spans": f"WITH {_USAGE} SELECT left(sha256(thread_id || ':' || coalesce(question, '')), 32) AS trace_id, node, input_tokens, output_tokens FROM u JOIN runs USING (thread_id)",
    "traced_states": f"WITH {_RUNS}, {_CITED}, l AS (SELECT thread_id, count(*) AS c, count(DISTINCT paper_id) AS p FROM cited GROUP BY 1) SELECT thread_id, route, rewrite_count, coalesce(p, 0)::INT AS n_chunks, coalesce(c, 0)::INT AS n_citations, verdict AS grounding_verdict FROM runs LEFT JOIN l USING (thread_id)",
    "run_summaries": f"WITH {_RUNS}, {_CITED}, l AS (SELECT thread_id, string_agg(citation_id::VARCHAR, ',' ORDER BY citation_id) AS c FROM cited GROUP BY 1) SELECT thread_id, coalesce(question, '') AS question, route, coalesce(answer, '') AS answer, verdict, coalesce(rewrite_count, 0) AS rewrite_count, coalesce(c, '') AS citations FROM runs LEFT JOIN l USING (thread_id)",
    "graded_passages": f"WITH {_GRADED} SELECT citation_id, NOT rel AND topic AS partial, CASE WHEN rel OR topic OR missing THEN 'kept' ELSE 'rejected' END AS side FROM graded",
    "grade_rollup": f"""WITH {_GRADED}, s AS (SELECT thread_id, count(*) AS n_graded, count(*) FILTER (WHERE rel OR topic OR missing) AS n_kept, count(*) FILTER (WHERE NOT rel AND topic) AS n_partial, coalesce(sum(i), 0)::BIGINT AS input_tokens, coalesce(sum(o), 0)::BIGINT AS output_tokens FROM graded GROUP BY 1)
        SELECT *, round_even((input_tokens + 5 * output_tokens) / 1e6, 6) AS cost_usd FROM s""",
    "routed_threads": f"WITH {_RUNS} SELECT thread_id, CASE WHEN category = 'unanswerable' THEN 'library' WHEN predicted <> 'direct' THEN predicted WHEN arm = 'with_paper' THEN 'single_paper' ELSE 'library' END AS taken FROM runs",
    "decided_threads": f"WITH {_RUNS} SELECT thread_id, verdict = 'grounded' OR (verdict IN ('partially_grounded', 'ungrounded', 'api_refused') AND rewrite_count > 0) AS is_approved FROM runs WHERE verdict IS NOT NULL",
    "approval_gate": f"""WITH {_RUNS}, g AS (SELECT thread_id, route, CASE WHEN verdict IS NULL THEN 'awaiting' WHEN verdict = 'grounded' OR (verdict IN ('partially_grounded', 'ungrounded', 'api_refused') AND rewrite_count > 0) THEN 'approved' ELSE 'denied' END AS status FROM runs WHERE route = 'web')
        SELECT *, CASE status WHEN 'approved' THEN 'web' WHEN 'denied' THEN 'library' END AS effective_route FROM g""",
    "rewrite_loop": f"""WITH {_RUNS}, r AS (SELECT thread_id, question, category, coalesce(rewrite_count, 0) AS c, coalesce(n_graded, 0) AS n FROM runs WHERE question IS NOT NULL),
        k AS (SELECT *, CASE WHEN 0 < c THEN 1 ELSE n END AS k0, CASE WHEN 1 < c THEN 1 ELSE n END AS k1, CASE WHEN 2 < c THEN 1 ELSE n END AS k2 FROM r),
        s AS (SELECT *, CASE WHEN k0 >= 2 THEN 0 WHEN k1 >= 2 THEN 1 ELSE 2 END AS rewrite_count FROM k)
        SELECT thread_id, CASE WHEN rewrite_count = 0 OR coalesce(category = 'comparison', false) THEN question ELSE question || ' ' || rewrite_count END AS query, rewrite_count, [k0, k1, k2][rewrite_count + 1] AS n_kept, rewrite_count = 2 AND k2 < 2 AS is_thin FROM s""",
    "regenerated_answers": f"""WITH {_RUNS}, r AS (SELECT thread_id, route, coalesce(verdict = 'ungrounded', false) AS again, verdict, coalesce(answer, '') AS answer, coalesce(n_unsupported, 0) > 2 AS failed FROM runs)
        SELECT thread_id, CASE WHEN again THEN 2 ELSE 1 END AS attempt, CASE WHEN NOT again THEN verdict WHEN failed THEN 'ungrounded' ELSE 'grounded' END AS verdict, CASE WHEN NOT again THEN answer WHEN failed THEN {_REFUSAL} ELSE 'again: ' || answer END AS answer, again AND failed AS is_refused FROM r""",
    "fallback_answers": f"WITH {_RUNS}, r AS (SELECT thread_id, coalesce(answer, '') AS answer, coalesce(verdict = 'api_refused', false) AS no, arm FROM runs) SELECT thread_id, CASE WHEN no AND arm <> 'no_paper' THEN 'second: ' || answer ELSE answer END AS answer, no AND arm = 'no_paper' AS api_refused, CASE WHEN no AND arm <> 'no_paper' THEN 2 ELSE 1 END AS used FROM r",
    "merged_states": f"WITH {_RUNS} SELECT thread_id, coalesce(CASE WHEN arm = 'with_paper' THEN route END, predicted) AS route, verdict, rewrite_count FROM runs",
    "facet_parts": f"WITH {_FACETS} SELECT * FROM facets",
    "facet_search": f"""WITH {_FACETS}, {_bm25(_CORPUS, "SELECT query_id || '#' || list_no AS query_id, text FROM facets", 8)},
        f AS (SELECT string_split(query_id, '#')[1] AS q, id, min(rank * 10 + string_split(query_id, '#')[2]::INT) AS turn FROM hits GROUP BY ALL) SELECT q AS query_id, id, row_number() OVER (PARTITION BY q ORDER BY turn)::INT AS place FROM f QUALIFY place <= 8""",
    "papers_by_title": f"WITH {_CHUNKS} SELECT paper_id, first(paper_title ORDER BY chunk_index, chunk_id) AS paper_title, nullif(first(year ORDER BY chunk_index, chunk_id), 0) AS year, max(page) AS max_page, count(*) AS n_chunks FROM kept GROUP BY 1",
    "papers_for_authoring": rf"WITH {_CHUNKS} SELECT paper_id, first(paper_title ORDER BY chunk_index, chunk_id) AS paper_title, coalesce(first(year ORDER BY chunk_index, chunk_id), 0) AS year, regexp_extract(first(source_path ORDER BY chunk_index, chunk_id), '([^/]+)$', 1) AS file_name, count(*) AS n_chunks FROM kept GROUP BY 1",
    "read_section": f"""WITH {_CHUNKS}, s AS (SELECT paper_id, section, min(chunk_index) AS place, first(text ORDER BY chunk_index, chunk_id) AS text FROM kept WHERE section <> '' GROUP BY 1, 2),
        l AS (SELECT paper_id, string_agg(section, ' | ' ORDER BY place, section) AS available FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY place, section) <= 20) GROUP BY 1),
        f AS (SELECT paper_id, section, text FROM s WHERE lower(section) = 'method' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY place, section) = 1)
        SELECT paper_id, section, text, CASE WHEN section IS NULL THEN available END AS available FROM l LEFT JOIN f USING (paper_id)""",
    "paper_sample": f"""WITH {_CHUNKS}, c AS (SELECT DISTINCT paper_id FROM kept ORDER BY sha256(paper_id || ':7'), paper_id LIMIT 20), r AS (SELECT paper_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index, chunk_id)::INT AS a, row_number() OVER (PARTITION BY paper_id ORDER BY sha256(chunk_id || ':7'), chunk_id)::INT AS b FROM kept WHERE paper_id IN (SELECT paper_id FROM c))
        SELECT paper_id, 'head' AS part, a AS nth, chunk_id FROM r WHERE a <= 2 UNION ALL SELECT paper_id, 'drawn', b, chunk_id FROM r WHERE b <= 6""",
    "sampled_questions": """WITH c AS (SELECT greatest(100 - count(*) FILTER (WHERE category = 'unanswerable'), 0) AS room, count(DISTINCT category) FILTER (WHERE category <> 'unanswerable') AS k FROM golden),
        e AS (SELECT id, category FROM golden, c WHERE category <> 'unanswerable' QUALIFY row_number() OVER (PARTITION BY category ORDER BY sha256(id || ':7'), id) <= greatest(floor(room / k), 1)), t AS (SELECT *, row_number() OVER (ORDER BY sha256(id || ':7'), id) AS n FROM e)
        SELECT id, category FROM t, c WHERE n <= room UNION ALL SELECT id, category FROM golden WHERE category = 'unanswerable'""",
    "letter_vectors": f"""WITH l AS (SELECT paper_id, [{', '.join(f"(length(lower(title)) - length(replace(lower(title), '{c}', '')))::DOUBLE" for c in 'etaoinsh')}] AS v FROM papers), n AS (SELECT *, CASE WHEN list_sum(list_transform(v, lambda x: x * x)) > 0 THEN sqrt(list_sum(list_transform(v, lambda x: x * x))) ELSE 1 END AS s FROM l)
        SELECT paper_id, {', '.join(f'round(v[{k + 1}] / s, 5) AS v{k}' for k in range(8))} FROM n""",
    "answers_with_places": f"""WITH {_SOURCES}, {_THREADS}, q AS (SELECT thread_id, unnest([first(coalesce(quote, '') ORDER BY citation_id), last(coalesce(quote, '') ORDER BY citation_id)]) AS quote, unnest([1, 2]) AS n FROM cited WHERE thread_id IS NOT NULL GROUP BY 1),
        a AS (SELECT thread_id, n, {_STRIP.format('quote')} AS quote, {_folded('quote')} AS form FROM q),
        t AS (SELECT a.thread_id, n, quote, h.paper_id, title, strpos(source, form) - 1 AS position, rank FROM a JOIN threads h USING (thread_id) JOIN sources USING (paper_id) WHERE form <> '' AND contains(source, form)),
        w AS (SELECT *, (SELECT max(page) FROM starts s WHERE s.paper_id = t.paper_id AND s.at <= t.position) AS page FROM t QUALIFY row_number() OVER (PARTITION BY thread_id, n ORDER BY rank) = 1),
        r AS (SELECT a.thread_id, a.n, CASE WHEN w.page IS NULL THEN '[unverified]' ELSE '"' || a.quote || '" [' || concat_ws(', ', CASE WHEN length(coalesce(title, '')) > 40 THEN rtrim(left(title, 39)) || '…' ELSE coalesce(title, '') END, 'p. ' || w.page) || ']' END AS x, w.page IS NOT NULL AS ok FROM a LEFT JOIN w USING (thread_id, n))
        SELECT thread_id, 'It says ' || max(x) FILTER (WHERE n = 1) || ', then' || chr(10) || max(x) FILTER (WHERE n = 2) || '.' AS answer, count(*) FILTER (WHERE ok) AS n_verified, count(*) FILTER (WHERE NOT ok) AS n_unverified FROM r GROUP BY 1""",
    "web_contexts": f"""WITH {_WEB} SELECT thread_id, string_agg('<web_result title="' || title || '" url="' || url || '">' || chr(10) || content || chr(10) || '</web_result>', chr(10) || chr(10) ORDER BY rank) AS context FROM w GROUP BY 1""",
    "web_citations": f"WITH {_WEB} SELECT thread_id, 'web' AS source, title, url, false AS verified FROM w",
    "grading_prompts": f"""WITH {_GRADED} SELECT citation_id, '<excerpt paper="' || coalesce(title, 'unknown') || '" page="' || coalesce(page::VARCHAR, '?') || '">' || chr(10) || text || chr(10) || '</excerpt>' || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') AS prompt FROM graded LEFT JOIN papers USING (paper_id) JOIN runs USING (thread_id)""",
    "rewrite_prompts": f"""WITH {_GRADED}, x AS (SELECT thread_id, '- from "' || coalesce(title, 'unknown') || '": ' || left(text, 400) || chr(10) || '  rejected: no reason recorded' AS line, row_number() OVER (PARTITION BY thread_id ORDER BY citation_id) AS n FROM graded LEFT JOIN papers USING (paper_id) WHERE NOT (rel OR topic OR missing) QUALIFY n <= 8),
        l AS (SELECT thread_id, string_agg(line, chr(10) ORDER BY n) AS l FROM x GROUP BY 1), p AS (SELECT thread_id, question, CASE WHEN rewrite_count > 0 THEN lower(question) ELSE question END AS query, l FROM runs LEFT JOIN l USING (thread_id) WHERE question IS NOT NULL)
        SELECT thread_id, concat_ws(chr(10) || chr(10), 'Original question: ' || question, CASE WHEN query <> question THEN 'Query that just failed: ' || query END, CASE WHEN l IS NULL THEN 'Retrieval returned nothing at all — the query matched no excerpt.' ELSE 'Excerpts retrieval found, and why each was wrong:' || chr(10) || l END, 'Rewrite the query.') AS prompt FROM p""",
    "report_matrix": f"""WITH {_RECALL}, v AS (SELECT category, {', '.join(f'coalesce(round_even(avg(recall_at_{k}) FILTER (WHERE NOT none), 4), 0.0) AS r{k}' for k in (1, 3, 5, 10))}, coalesce(round_even(avg(rr) FILTER (WHERE NOT none), 4), 0.0) AS mrr FROM q GROUP BY 1 HAVING count(*) FILTER (WHERE NOT none) > 0)
        SELECT 1 AS line_no, '| Chunking | Retrieval | recall@1 | recall@3 | recall@5 | recall@10 | MRR |' AS line UNION ALL SELECT 2, '|---|---|---|---|---|---|---|' UNION ALL
        SELECT (2 + row_number() OVER (ORDER BY r5 DESC, category))::INT, '| ' || concat_ws(' | ', CASE WHEN r5 > 0 AND r5 = (SELECT max(r5) FROM v) THEN '**' || category || '**' ELSE category END, 'bm25', {_fixed('r1')}, {_fixed('r3')}, {_fixed('r5')}, {_fixed('r10')}, {_fixed('mrr')}) || ' |' FROM v""",
    "report_confusion": f"WITH {_CONFUSION} {_CONFUSION_LINES}",
    "report_per_route": f"WITH {_CONFUSION}, {_SCORES} {_SCORE_LINES}",
    "report_library": f"""WITH {_CHUNKS} SELECT '| ' || concat_ws(' | ', '`' || paper_id || '`', coalesce(nullif(first(year ORDER BY chunk_index, chunk_id), 0)::VARCHAR, '—'), max(page), count(*), coalesce(first(paper_title ORDER BY chunk_index, chunk_id), '')) || ' |' AS line FROM kept GROUP BY paper_id""",
    "report_graph": f"""WITH {_RUNS}, a AS (SELECT *, coalesce(rewrite_count, 0) AS rc FROM runs WHERE NOT coalesce(is_unanswerable, false)),
        w AS (SELECT count(*) AS n, count(*) FILTER (WHERE rc > 0) AS f, round_even(avg((rc > 0)::INT), 4) AS t, round_even(avg(recall_at_5) FILTER (WHERE rc > 0), 4) AS x, round_even(avg(recall_at_5) FILTER (WHERE rc = 0), 4) AS y FROM a),
        i AS (SELECT recall_at_5_first_pass AS p, recall_at_5_final_pass AS q FROM runs WHERE rewrite_count > 0 AND NOT coalesce(is_unanswerable, false) AND recall_at_5_first_pass IS NOT NULL AND recall_at_5_final_pass IS NOT NULL),
        v AS (SELECT unnest(['grounded', 'partially_grounded', 'ungrounded', 'api_refused', 'not_checked']) AS verdict, unnest([1, 2, 3, 4, 5]) AS o), c AS (SELECT v.verdict, o, count(thread_id) AS n FROM v LEFT JOIN runs USING (verdict) GROUP BY 1, 2),
        u AS (SELECT count(*) AS n, count(*) FILTER (WHERE refused_by_prefix) AS p, count(*) FILTER (WHERE refused_by_grounding) AS g FROM runs WHERE is_unanswerable),
        l AS (SELECT 0 AS s, unnest(['## Route accuracy (end to end)', '**' || {_SHARE.format("round_even((SELECT avg(coalesce((expected = predicted)::INT, 0)) FROM runs), 4)")} || '** over ' || (SELECT count(*) FROM runs) || ' runs']) AS line, unnest([1, 2]) AS k
            UNION ALL SELECT 1, unnest(['## Rewrite loop', '- trigger rate: **' || {_SHARE.format('t')} || '** (' || f || '/' || n || ' answerable questions)', '- recall@5 when it fired: ' || x, '- recall@5 when it did not: ' || y, '- delta: **' || round_even(x - y, 4) || '**']), unnest([1, 2, 3, 4, 5]) FROM w
            UNION ALL SELECT 2, unnest(['### Within-question, first pass vs final pass', '- improved ' || (SELECT count(*) FROM i WHERE q > p) || ', unchanged ' || (SELECT count(*) FROM i WHERE q = p) || ', worsened ' || (SELECT count(*) FROM i WHERE q < p) || ' (of ' || (SELECT count(*) FROM i) || ')', '- rescued from zero recall: ' || (SELECT count(*) FROM i WHERE p = 0 AND q > 0)]), unnest([1, 2, 3])
            UNION ALL SELECT 3, unnest(['## Grounding verdicts', '| verdict | n | share |', '|---|---|---|']), unnest([1, 2, 3]) UNION ALL SELECT 4, '| ' || concat_ws(' | ', verdict, n, {_SHARE.format('round_even(n / (SELECT sum(n) FROM c), 4)')}) || ' |', o FROM c
            UNION ALL SELECT 5, unnest(['## Refusal correctness on the unanswerable set (n=' || n || ')', '| prefix | ' || p || '/' || n || ' | ' || {_SHARE.format('round_even(p / n, 4)')} || ' |', '| grounding | ' || g || '/' || n || ' | ' || {_SHARE.format('round_even(g / n, 4)')} || ' |']), unnest([1, 2, 3]) FROM u)
        SELECT row_number() OVER (ORDER BY s, k)::INT AS line_no, line FROM l""",
    "report_routes": f"""WITH {_CONFUSION}, {_SCORES}, p AS (SELECT arm, count(*) AS n, round_even(avg(coalesce((expected = predicted)::INT, 0)), 4) AS a FROM runs GROUP BY 1),
        l AS (SELECT 0 AS s, unnest(['## Route accuracy', '**' || {_SHARE.format("round_even((SELECT avg(coalesce((expected = predicted)::INT, 0)) FROM runs), 4)")} || '** over ' || (SELECT count(*) FROM runs) || ' classifications']) AS line, unnest([1, 2]) AS k
            UNION ALL SELECT 1, '- `' || arm || '`: ' || {_SHARE.format('a')} || ' (' || n || ' questions)', CASE WHEN arm = 'with_paper' THEN 0 ELSE 1 END FROM p
            UNION ALL SELECT 2, line, line_no FROM ({_CONFUSION_LINES}) UNION ALL SELECT 3, line, line_no FROM ({_SCORE_LINES}))
        SELECT row_number() OVER (ORDER BY s, k)::INT AS line_no, line FROM l""",
}
