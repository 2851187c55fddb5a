"""Queries at the engine's boundaries: parsing, files and sinks, runs and their steps, reports."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.functions import text as T
from corvellum.functions.folding import fold
from corvellum.operators import corpus, layout, metrics, quotes, ranking, reports, retrieval, runs, workflow
from corvellum.plans import derived as D
from corvellum.plans import queries as Q
from corvellum.session import new_folder
from corvellum.sources import tables as S
from corvellum.streaming import ingest

# --- parsing ------------------------------------------------------------------------------


def blocks_in_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(D.blocks(spark, d)).select("paper_id", "page", "block_no", "text")


def repeated_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Headers and other texts on most pages of their paper."""
    return layout.repeated_texts(layout.reading_order(D.blocks(spark, d)))


def body_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.body_blocks(layout.reading_order(D.blocks(spark, d))).select("paper_id", "page", "block_no", "text")


def pages_from_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.pages_of(D.blocks(spark, d))


def title_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.titles(D.blocks(spark, d))


def enriched_pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.with_transcriptions(Q.pages(spark, d), D.transcriptions(spark, d))


def located_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Where on the page a citation names its quote, or its first words, stand."""
    rows = Q.citations(spark, d).select("citation_id", "paper_id", "page", "quote").join(Q.pages(spark, d).select("paper_id", "page", "text"), ["paper_id", "page"])
    return rows.withColumn("at", layout.locate(F.col("quote"), F.col("text"))).where("at is not null").select("citation_id", "at.start", "at.chars")


def folded_quotes(spark: SparkSession, d: str) -> DataFrame:
    return Q.citations(spark, d).where("quote is not null").select("citation_id", fold("quote").alias("form"))


def fenced_texts(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("\n```yaml\n"), "question", F.lit("\n```\n "))
    return Q.golden(spark, d).select("id", T.strip_fences(fenced).alias("text"))


# --- files ----------------------------------------------------------------------------------


def library_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder with the id that their content gives them: a file for every nation."""
    folder = new_folder(spark, "library")
    S.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    files = S.library_files(spark, f"{folder}/*", "*.txt")
    return files.select("paper_id", F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("nation"), F.col("length").alias("n_bytes"))


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as text files and read again by folder."""
    folder = new_folder(spark, "pages")
    S.write_pages(Q.pages(spark, d).where("text is not null").select("paper_id", F.translate("text", "\r\n", "  ").alias("text")).repartition("paper_id"), folder)
    return S.read_pages(spark, folder).groupBy("paper_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("value")).alias("n_chars"))


def index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The index written, then written anew without its old papers, and read."""
    folder = new_folder(spark, "index")
    rows = Q.chunks(spark, d)
    S.write_index(rows, folder)
    S.write_index(rows.where("year >= 2015"), folder)
    return spark.read.parquet(folder).groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.max("chunk_index").alias("last"))


def results_newest(spark: SparkSession, d: str) -> DataFrame:
    """Two runs' results as files named by time, of which the newest counts."""
    folder = new_folder(spark, "results")
    counts = Q.category_counts(spark, d)
    S.write_results(counts.withColumn("n", F.lit(0)), folder, datetime.datetime(2026, 1, 2, tzinfo=datetime.UTC))
    S.write_results(counts, folder, datetime.datetime(2026, 1, 10, tzinfo=datetime.UTC))
    return S.latest_results(spark, folder).select("file_name", "category", "n")


def question_source(spark: SparkSession, d: str) -> DataFrame:
    """Questions as a source file may leave them, with defaults for what is missing."""
    rows = Q.golden(spark, d)
    gaps = rows.select("id", "question", F.when(F.col("category") != "unanswerable", F.col("ground_truth")).alias("ground_truth"), F.when(F.size("expected_paper_ids") > 0, F.col("expected_paper_ids")).alias("expected_paper_ids"), F.when(F.col("category") != "factual", F.col("category")).alias("category"))
    return S.with_defaults(gaps).select("id", "question", "ground_truth", F.array_join("expected_paper_ids", ",").alias("expected"), "category")


def ingest_twice(spark: SparkSession, d: str) -> DataFrame:
    """Pages that arrive as files in two deliveries, the second one again with all that the
    first one brought, streamed into an index of fixed windows."""
    folder = new_folder(spark, "ingest")
    rows = Q.pages(spark, d).select("paper_id", "page", "text", "parsed_at")
    papers = S.table(spark, d, "papers")
    for part in (rows.where("paper_id < '8'"), rows):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/source")
        ingest.ingest_stream(spark, f"{folder}/source", f"{folder}/index", f"{folder}/state", papers, "fixed").awaitTermination()
    return ingest.read_index(spark, f"{folder}/index").groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.max("chunk_index").alias("last"))


def answer_frames(spark: SparkSession, d: str) -> DataFrame:
    """Answers as server-sent events."""
    payload = F.struct("thread_id", F.coalesce("route", F.lit("")).alias("route"), F.coalesce("verdict", F.lit("")).alias("verdict"))
    return Q.runs(spark, d).select("thread_id", S.event_frames(F.lit("answer"), payload).alias("frame"))


# --- labels and rows of runs -----------------------------------------------------------------


def labels_by_arm(spark: SparkSession, d: str) -> DataFrame:
    return runs.labels_by_arm(D.labels(spark, d), Q.golden(spark, d))


def known_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose question exists."""
    return D.labels(spark, d).join(Q.golden(spark, d), "id", "left_semi")


def configurations(spark: SparkSession, d: str) -> DataFrame:
    return runs.configurations(spark)


def rows_without_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.runs(spark, d).select("thread_id", "arm", F.when(F.col("verdict") == "api_refused", "declined").alias("error"))
    return runs.without_errors(rows).select("thread_id", "arm")


def first_and_last_pass(spark: SparkSession, d: str) -> DataFrame:
    return runs.first_and_last_pass(D.retrieval_passes(spark, d))


def refusal_openings(spark: SparkSession, d: str) -> DataFrame:
    """Which answers open with a refusal; those of unanswerable questions are given theirs."""
    given = F.when(F.col("is_unanswerable"), F.concat(F.lit(" "), runs.refusal(F.col("route")), F.lit(" Sorry."))).otherwise(F.col("answer"))
    return Q.runs(spark, d).select("thread_id", runs.opens_with(given, [runs.PAPER_REFUSAL, runs.LIBRARY_REFUSAL]).alias("is_refusal"))


def refusals_by_claims(spark: SparkSession, d: str) -> DataFrame:
    return Q.runs(spark, d).select("thread_id", runs.invents_nothing(F.col("verdict"), F.col("n_citations") > 0, F.col("n_unsupported")).alias("is_refusal"))


def support_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts out of claims and quotes, with what isn't checked at all."""
    v = workflow.verdict(F.col("answer"), F.col("verdict") == "api_refused", F.col("n_citations") > 0, F.col("n_unsupported"), F.coalesce("n_citations", F.lit(0)) - F.coalesce("n_unverified", F.lit(0)), F.coalesce("n_unverified", F.lit(0)))
    return Q.runs(spark, d).select("thread_id", v.alias("support"))


def refusal_texts(spark: SparkSession, d: str) -> DataFrame:
    return Q.runs(spark, d).select("thread_id", runs.refusal(F.col("route")).alias("refusal"))


def open_paper_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the paper that is open, the one that a thread cites first."""
    papers = D.thread_papers(spark, d)
    opened = papers.where("rank = 1").select("thread_id", F.col("title").alias("open_title"))
    rows = Q.citations(spark, d).where("thread_id is not null").select("citation_id", "thread_id", "paper_id").join(papers.select("thread_id", "paper_id", F.col("title").alias("paper_title")), ["thread_id", "paper_id"]).join(opened, "thread_id")
    return runs.of_open_paper(rows, F.col("open_title")).select("citation_id")


def decoded_states(spark: SparkSession, d: str) -> DataFrame:
    """States sent as JSON: declared fields are kept, others passed over, broken ones are NULL."""
    sent = F.to_json(F.struct("route", "rewrite_count", F.lit(1).alias("added_later")))
    rows = Q.runs(spark, d).select("thread_id", F.when(F.col("verdict").isNull(), '{"route": ').otherwise(sent).alias("state"))
    return runs.decoded(rows, "state", "route string, rewrite_count int").select("thread_id", "state.route", "state.rewrite_count")


def unknown_papers(spark: SparkSession, d: str) -> DataFrame:
    """How many cited papers are not among those of a known year, and the first five."""
    known = S.table(spark, d, "papers").where("year is not null")
    return runs.unknown_ids(Q.citations(spark, d).where("paper_id is not null"), known).select("n_unknown", F.array_join("first", ",").alias("first_five"))


def isolated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cost of a graded passage; a row without one gets an error and leaves the others alone."""
    rows = Q.runs(spark, d).select("thread_id", "cost_usd", "n_graded")
    return workflow.isolated(rows, F.round(F.try_divide("cost_usd", "n_graded"), 6), "cost_a_passage", "nothing was graded").select("thread_id", "cost_a_passage", "error")


# --- usage and cost --------------------------------------------------------------------------


def node_usage_rows(spark: SparkSession, d: str) -> DataFrame:
    return runs.usage_rows(D.usage(spark, d)).select("thread_id", "node", "input_tokens", "output_tokens", "cost_usd")


def usage_added(spark: SparkSession, d: str) -> DataFrame:
    return runs.usage_totals(runs.usage_rows(D.usage(spark, d)).drop("seq"))


def total_costs(spark: SparkSession, d: str) -> DataFrame:
    return D.usage(spark, d).select("thread_id", metrics.total_cost(F.col("usage")).alias("total_usd"))


def last_node_usage(spark: SparkSession, d: str) -> DataFrame:
    """What each node used when it ran last."""
    return runs.node_usage(runs.usage_rows(D.usage(spark, d)), ["route", "grade", "grounding"])


#: Prices a million of input and output tokens, for the query only.
PRICES = {"large": (3.0, 15.0, 3.75, 0.3), "small": (1.0, 5.0, 0.0, 0.0)}


def call_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = runs.usage_rows(D.usage(spark, d))
    model = F.when(F.col("node") == "route", "small").when(F.col("node") == "grade", "large").otherwise("unheard of")
    return rows.select("thread_id", "node", runs.cost(model, [F.col("input_tokens"), F.col("output_tokens"), F.col("seq"), F.lit(None).cast("bigint")], PRICES, "large").alias("usd"))


def trace_spans(spark: SparkSession, d: str) -> DataFrame:
    return runs.spans(runs.usage_rows(D.usage(spark, d)).select("thread_id", "node", "input_tokens", "output_tokens"), Q.runs(spark, d))


def traced_states(spark: SparkSession, d: str) -> DataFrame:
    return runs.traced(D.states(spark, d), ["route", "rewrite_count"], ["chunks", "citations"])


def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    return runs.summaries(D.states(spark, d)).withColumn("citations", F.array_join("citations", ","))


# --- grading, loops, approval ------------------------------------------------------------------


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grade_passages(D.passages(spark, d), D.grades(spark, d), ["thread_id", "citation_id"])


def graded_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage, kept or rejected."""
    kept, rejected = runs.split_by_grade(_graded(spark, d))
    return kept.select("citation_id", "partial", F.lit("kept").alias("side")).unionByName(rejected.select("citation_id", "partial", F.lit("rejected").alias("side")))


def grade_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grade_rollup(_graded(spark, d), ["thread_id"], 1.0, 5.0)


def routed_threads(spark: SparkSession, d: str) -> DataFrame:
    """A route given wins, then the classifier's, then whether a paper is open."""
    forced = F.when(F.col("category") == "unanswerable", "library")
    classified = F.when(F.col("predicted") != "direct", F.col("predicted"))
    return Q.runs(spark, d).select("thread_id", workflow.route(forced, classified, F.col("arm") == "with_paper").alias("taken"))


def decided_threads(spark: SparkSession, d: str) -> DataFrame:
    return D.decisions(spark, d).select("thread_id", workflow.is_approved(F.col("decision")).alias("is_approved"))


def approval_gate(spark: SparkSession, d: str) -> DataFrame:
    """Questions for the web: awaiting a decision, approved, or left to the library."""
    asked = Q.runs(spark, d).where("route = 'web'").select("thread_id", "route")
    return workflow.approvals(asked, D.decisions(spark, d))


def rewrite_loop(spark: SparkSession, d: str) -> DataFrame:
    """Queries rewritten while too few passages are left, twice at most."""
    rows = Q.runs(spark, d).where("question is not null").select("thread_id", "question", "category", F.coalesce("rewrite_count", F.lit(0)).alias("c"), F.coalesce("n_graded", F.lit(0)).alias("n"))
    passes = rows.select("thread_id", F.explode(F.array(*map(F.lit, range(3)))).alias("pass_no"), "c", "n").select("thread_id", "pass_no", F.when(F.col("pass_no") < F.col("c"), 1).otherwise(F.col("n")).alias("n_kept"))
    rewrites = rows.select("thread_id", F.explode(F.array(*map(F.lit, (1, 2)))).alias("pass_no"), "question", "category").select("thread_id", "pass_no", F.when(F.col("category") == "comparison", " ").otherwise(F.concat_ws(" ", "question", F.col("pass_no").cast("string"))).alias("query"))
    return workflow.rewriting(rows, passes, rewrites)


def regenerated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers without support made anew, and declined if that doesn't help."""
    rows = Q.runs(spark, d).select("thread_id", "route", "verdict", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("n_unsupported", F.lit(0)).alias("u"))
    first = rows.select("thread_id", "route", F.lit(1).alias("attempt"), "verdict", "answer")
    second = rows.select("thread_id", "route", F.lit(2).alias("attempt"), F.when(F.col("u") > 2, "ungrounded").otherwise("grounded").alias("verdict"), F.concat(F.lit("again: "), "answer").alias("answer"))
    return workflow.regenerating(first.unionByName(second), runs.refusal(F.col("route")))


def fallback_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a second generator where the first one's service declined."""
    rows = Q.runs(spark, d).select("thread_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce(F.col("verdict") == "api_refused", F.lit(False)).alias("api_refused"), "arm")
    other = rows.select("thread_id", F.concat(F.lit("second: "), "answer").alias("answer"), (F.col("arm") == "no_paper").alias("api_refused"))
    return workflow.with_fallback(rows.drop("arm"), other).select("thread_id", "answer", "api_refused", "used")


def merged_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of every thread after two steps, saved, and found again by another reader."""
    folder = new_folder(spark, "state")
    rows = Q.runs(spark, d)
    workflow.save_state(rows.select("thread_id", F.col("predicted").alias("route"), F.lit(None).cast("string").alias("verdict"), "rewrite_count"), folder, 1)
    workflow.save_state(rows.select("thread_id", F.when(F.col("arm") == "with_paper", F.col("route")).alias("route"), "verdict", F.lit(None).cast("int").alias("rewrite_count")), folder, 2)
    return workflow.resumed_state(spark, folder)


# --- search and answers --------------------------------------------------------------------------


def facet_parts(spark: SparkSession, d: str) -> DataFrame:
    return workflow.facets(Q._questions(spark, d).where("text is not null"), D.splits(spark, d))


def facet_search(spark: SparkSession, d: str) -> DataFrame:
    """Questions of several parts searched by every part, the rankings interleaved to eight."""
    parts = facet_parts(spark, d)
    asked = parts.select(F.concat_ws("#", "query_id", F.col("list_no").cast("string")).alias("query_id"), "text")
    hits = retrieval.bm25_ranking(Q._corpus(spark, d), asked, 8)
    split = F.split("query_id", "#")
    return ranking.interleave(hits.select(split[0].alias("query_id"), split[1].cast("int").alias("list_no"), "id", "rank"), 8)


def papers_by_title(spark: SparkSession, d: str) -> DataFrame:
    return corpus.by_title(corpus.inventory(Q.chunks(spark, d), sections=False))


def papers_for_authoring(spark: SparkSession, d: str) -> DataFrame:
    return corpus.for_authoring(Q.chunks(spark, d))


def read_section(spark: SparkSession, d: str) -> DataFrame:
    """The section "method" of every paper, in any case, or the names of those it has."""
    return corpus.sections_or_list(D.read_sections(spark, d), "METHOD")


def paper_sample(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paper_sample(Q.chunks(spark, d), 20)


def sampled_questions(spark: SparkSession, d: str) -> DataFrame:
    """Which questions a sample of 100 holds."""
    return metrics.stratified_sample(Q.golden(spark, d), 100).select("id", "category")


def letter_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Titles through the embedding extension point; the function counts letters."""

    def letters(texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in "etaoinsh"] for t in texts]

    rows = retrieval.embedded(S.table(spark, d, "papers").select("paper_id", "title"), "title", letters)
    return rows.select("paper_id", *[F.round(F.col("vector")[k], 5).alias(f"v{k}") for k in range(8)])


def answers_with_places(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose marked quotes are replaced by themselves and their place, or marked."""
    cited = Q.citations(spark, d).where("thread_id is not null").groupBy("thread_id").agg(F.min_by(F.coalesce("quote", F.lit("")), "citation_id").alias("a"), F.max_by(F.coalesce("quote", F.lit("")), "citation_id").alias("b"))
    answers = cited.select("thread_id", F.concat(F.lit(" It says <quote>"), "a", F.lit("</quote>, then\n<quote> "), "b", F.lit("</quote>. ")).alias("answer"))
    return quotes.verified_answers(answers, D.thread_papers(spark, d), Q.pages(spark, d), fuzzy=False)


def web_contexts(spark: SparkSession, d: str) -> DataFrame:
    return workflow.web_context(workflow.web_results(D.found_on_web(spark, d)))


def web_citations(spark: SparkSession, d: str) -> DataFrame:
    return workflow.web_citations(workflow.web_results(D.found_on_web(spark, d)))


def grading_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a grader is shown of every passage."""
    rows = D.passages(spark, d).join(S.table(spark, d, "papers").select("paper_id", "title"), "paper_id", "left").join(Q.runs(spark, d).select("thread_id", F.coalesce("question", F.lit("")).alias("question")), "thread_id")
    return rows.select("citation_id", F.concat(workflow.excerpt(F.col("title"), F.col("page"), F.col("text")), F.lit("\n\nQuestion: "), "question").alias("prompt"))


def rewrite_prompts(spark: SparkSession, d: str) -> DataFrame:
    rejected = _graded(spark, d).where("not kept").join(S.table(spark, d, "papers").select("paper_id", F.col("title").alias("paper_title")), "paper_id", "left")
    threads = Q.runs(spark, d).where("question is not null").select("thread_id", "question", F.when(F.col("rewrite_count") > 0, F.lower("question")).otherwise(F.col("question")).alias("query"))
    return workflow.rewrite_inputs(threads, rejected.select("thread_id", F.col("citation_id").alias("rank"), "paper_title", "text", F.lit(None).cast("string").alias("reason")))


# --- reports -------------------------------------------------------------------------------------


def report_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.metric_aggregate(spark, d).where("n_answerable > 0")
    return reports.matrix(rows.select(F.col("category").alias("chunking"), F.lit("bm25").alias("retrieval"), "recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr"))


def report_confusion(spark: SparkSession, d: str) -> DataFrame:
    return reports.confusion(Q.confusion_dense(spark, d))


def report_per_route(spark: SparkSession, d: str) -> DataFrame:
    return reports.per_route(Q.per_class_scores(spark, d))


def report_library(spark: SparkSession, d: str) -> DataFrame:
    return reports.library_index(corpus.inventory(Q.chunks(spark, d), sections=False))


def report_graph(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.runs(spark, d)
    return reports.graph_report(metrics.route_accuracy(rows), metrics.rewrite_metrics(rows), metrics.within_question(rows), metrics.verdict_shares(rows), metrics.refusal_rates(rows))


def report_routes(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.runs(spark, d)
    matrix = metrics.confusion(rows)
    return reports.route_report(metrics.route_accuracy(rows), metrics.route_accuracy(rows, ["arm"]), matrix, metrics.route_scores(matrix))


ALL = (
    blocks_in_order, repeated_blocks, body_blocks, pages_from_blocks, title_lines, enriched_pages, located_quotes, folded_quotes, fenced_texts, library_scan, page_files, index_rebuild, results_newest, question_source,
    ingest_twice, answer_frames, labels_by_arm, known_labels, configurations, rows_without_errors, first_and_last_pass, refusal_openings, refusals_by_claims, support_verdicts, refusal_texts, open_paper_citations,
    decoded_states, unknown_papers, isolated_rows, node_usage_rows, usage_added, total_costs, last_node_usage, call_costs, trace_spans, traced_states, run_summaries, graded_passages, grade_rollup, routed_threads,
    decided_threads, approval_gate, rewrite_loop, regenerated_answers, fallback_answers, merged_states, facet_parts, facet_search, papers_by_title, papers_for_authoring, read_section, paper_sample, sampled_questions,
    letter_vectors, answers_with_places, web_contexts, web_citations, grading_prompts, rewrite_prompts, report_matrix, report_confusion, report_per_route, report_library, report_graph, report_routes,
)
