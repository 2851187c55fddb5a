"""The reference queries over whole tables.  Each takes the session and the tables' folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvellum.functions import text as T
from corvellum.operators import chunking, corpus, layout, metrics, quotes, ranking, retrieval
from corvellum.sources.tables import golden_violations, latest, merge_chunks, missing, numbered, table
from corvellum.streaming.ingest import event_windows


def pages(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "paper_pages"), ["paper_id", "page"], "parsed_at")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "chunks"), ["chunk_id"], "indexed_at")


def citations(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "citations"), ["citation_id"], "logged_at")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "route_rows"), ["thread_id"], "logged_at")


def golden(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "paper_id", "year", "text", "indexed_at"), ["id"], "indexed_at")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return golden(spark, d).select(F.col("id").alias("query_id"), F.col("question").alias("text"))


# --- text -------------------------------------------------------------------------------


def token_df(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the index in which each term occurs, and how often in all."""
    return retrieval.postings(_corpus(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def block_normalize(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("paper_id", "page", T.normalise_block(F.col("text")).alias("line"))


def sentence_units(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.units(pages(spark, d))
    return rows.groupBy("paper_id", "page").agg(F.count("*").alias("n_units"), F.sum(F.length("sentence")).alias("n_chars"), F.min("sentence").alias("least"), F.max("sentence").alias("greatest"))


def section_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Every page's lines under the heading that holds for them."""
    rows = chunking.with_sections(chunking.page_lines(pages(spark, d))).where("not is_header")
    return rows.groupBy("paper_id", "page", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def section_text(spark: SparkSession, d: str) -> DataFrame:
    return chunking.section_texts(chunking.units(pages(spark, d)))


def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(pages(spark, d))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """The whole index anew, sections packed and embedded behind their context."""
    return chunking.chunks(pages(spark, d), table(spark, d, "papers"))


def math_score(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("paper_id", "page", F.bround(T.math_score(F.col("text")), 6).alias("score"))
    return rows.withColumn("is_equation_page", F.col("score") >= 8.0)


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.token_estimate(F.col("full_text")).alias("estimate"), "n_tokens")


def page_full_text(spark: SparkSession, d: str) -> DataFrame:
    return layout.full_texts(pages(spark, d))


def year_detect(spark: SparkSession, d: str) -> DataFrame:
    first = pages(spark, d).where("page = 1").select("paper_id", F.col("text").alias("page1"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = table(spark, d, "papers").join(first, "paper_id", "left")
    return rows.select("paper_id", name.alias("file_name"), T.detect_year(name, F.col("page1")).alias("detected_year"))


def content_hash_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.content_id(F.col("full_text").cast("binary")).alias("content_id"))


def locate_candidates(spark: SparkSession, d: str) -> DataFrame:
    return citations(spark, d).select("citation_id", F.posexplode(T.locate_candidates(F.col("quote"))).alias("candidate_no", "candidate"))


def multi_part_gate(spark: SparkSession, d: str) -> DataFrame:
    return golden(spark, d).select("id", "category", T.is_multi_part(F.col("question")).alias("is_multi_part"))


def short_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.short_title(F.col("title")).alias("short_title"))


def renumbered_questions(spark: SparkSession, d: str) -> DataFrame:
    return numbered(golden(spark, d), ["category"], ["id"]).select("category", "number", "id")


# --- the index --------------------------------------------------------------------------


def paper_inventory(spark: SparkSession, d: str) -> DataFrame:
    return corpus.inventory(chunks(spark, d)).withColumn("sections", F.array_join("sections", " | "))


def distinct_papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").agg(F.count_distinct("paper_id").alias("n_papers"), F.count_distinct("chunk_id").alias("n_chunks"))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The index after fixed windows of all known papers replaced what it held of them."""
    new = chunking.chunks(pages(spark, d), table(spark, d, "papers"), "fixed")
    columns = ["chunk_id", "paper_id", "page", "section", "text"]
    return merge_chunks(chunks(spark, d).select(*columns), new.select(*columns)).groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.max("page").alias("max_page"))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Pages that no quote was ever found on, so that nothing of them is cached."""
    held = citations(spark, d).where("verified").select("paper_id", "page").distinct()
    return missing(pages(spark, d).select("paper_id", "page"), held, ["paper_id", "page"])


def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Where each paper that questions expect is kept; unknown papers have no row."""
    wanted = golden(spark, d).select(F.explode(F.array_distinct("expected_paper_ids")).alias("paper_id")).distinct()
    return wanted.join(corpus.inventory(chunks(spark, d), sections=False), "paper_id").select("paper_id", "source_path", "n_chunks")


# --- search -----------------------------------------------------------------------------


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight best chunks for every golden question."""
    return retrieval.bm25_ranking(_corpus(spark, d), _questions(spark, d), 8).select("query_id", "id", "rank", "score")


def bm25_recent(spark: SparkSession, d: str) -> DataFrame:
    """The same among papers of 2020 and later, term weights being those of all."""
    hits = retrieval.bm25_ranking(_corpus(spark, d), _questions(spark, d), 8, retrieval.scope(year_min=2020))
    return hits.select("query_id", "id", "rank", "score")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def dense_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all vectors to every one whose id is divisible by 50."""
    rows, asked = _vectors(spark, d)
    return retrieval.dense_ranking(rows, asked, 10).select("query_id", "id", "rank", "score")


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a vector, searched by text and vector of those divisible by 50."""
    rows, asked = _vectors(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    both = rows.join(docs, "id")
    query = asked.join(docs.withColumnRenamed("id", "query_id"), "query_id")
    hits = retrieval.hybrid_search(both, query, 8)
    return hits.select("query_id", "id", "dense_rank", "bm25_rank", "score", "rank")


def _by_age_and_size(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of the papers of each year: longest first, newest first."""
    rows = table(spark, d, "papers").where("year is not null").select(F.col("year").alias("query_id"), F.col("paper_id").alias("id"), "n_tokens", "added_at")
    size = ranking.ranked(rows, [F.col("n_tokens").desc(), "id"]).select("query_id", "id", "rank", F.lit(0).alias("list_no"))
    age = ranking.ranked(rows, [F.col("added_at").desc(), "id"]).select("query_id", "id", "rank", F.lit(1).alias("list_no"))
    return size.unionByName(age)


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rrf_fuse(_by_age_and_size(spark, d)).select(F.col("query_id").alias("year"), F.col("id").alias("paper_id"), F.round("score", 8).alias("score"))


def interleave_facets(spark: SparkSession, d: str) -> DataFrame:
    return ranking.interleave(_by_age_and_size(spark, d), 8).select(F.col("query_id").alias("year"), F.col("id").alias("paper_id"), "place")


def per_paper_cap(spark: SparkSession, d: str) -> DataFrame:
    """Eight hits for every question, at most two of one paper, out of a deep search."""
    hits = retrieval.bm25_ranking(_corpus(spark, d), _questions(spark, d), retrieval.deep_fetch_size(8))
    placed = hits.withColumn("paper_id", F.regexp_extract("id", "^(.*):", 1))
    return ranking.cap_per_group(placed, "paper_id", 2, 8).select("query_id", "id", "paper_id", "place")


def rerank_term_hits(spark: SparkSession, d: str) -> DataFrame:
    """The 15 best hits by BM25, reordered by shared words, eight kept."""
    docs, asked = _corpus(spark, d), _questions(spark, d)
    hits = retrieval.bm25_ranking(docs, asked, 15).withColumn("paper_id", F.regexp_extract("id", "^(.*):", 1))
    return retrieval.rerank(hits, retrieval.term_hits(hits, docs, asked), 8).select("query_id", "id", "model_score", "place")


def first_appearance_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = golden(spark, d).select(F.col("id").alias("query_id"), F.posexplode("expected_paper_ids").alias("rank", "paper_id"))
    return ranking.first_appearances(rows, "paper_id").select("query_id", "paper_id", "rank")


def answer_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The passages of every question's hits, put together by paper."""
    rows = chunks(spark, d).select(F.col("chunk_id").alias("id"), F.coalesce("paper_title", F.lit("")).alias("paper_title"), "page", "text")
    hits = retrieval.bm25_ranking(_corpus(spark, d), _questions(spark, d), 8).join(rows, "id")
    return corpus.contexts(hits)


# --- quotes -----------------------------------------------------------------------------


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return citations(spark, d).select(F.col("citation_id").alias("quote_id"), "paper_id", "quote")


def quote_exact_verify(spark: SparkSession, d: str) -> DataFrame:
    """First page on which each quote stands as it is; folded or over a page end it may
    also stand, which quote_verify tells."""
    rows = quotes.exact_places(_asked(spark, d), pages(spark, d))
    return rows.select(F.col("quote_id").alias("citation_id"), F.col("page").alias("found_page"), F.col("char_offset").alias("found_offset"))


def quote_verify(spark: SparkSession, d: str) -> DataFrame:
    """Whether each quote stands in its paper's folded source, and where first."""
    rows = quotes.verify_quotes(_asked(spark, d), pages(spark, d), fuzzy=False)
    return rows.select(F.col("quote_id").alias("citation_id"), "verified", "page", "position")


def quote_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Exact and fuzzy matches with page and offset; the alignment is tested by brute force."""
    return quotes.verify_quotes(_asked(spark, d), pages(spark, d)).drop("quote")


def first_paper_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes tried on all papers that their answer cites, in the order of citation."""
    cited = citations(spark, d).where("thread_id is not null")
    papers = cited.groupBy(F.col("thread_id").alias("answer_id"), "paper_id").agg(F.min("citation_id").alias("rank"))
    asked = cited.select(F.col("citation_id").alias("quote_id"), F.col("thread_id").alias("answer_id"), "quote")
    return quotes.first_verified(asked, papers, pages(spark, d), fuzzy=False).select(F.col("quote_id").alias("citation_id"), "paper_id", "page", "match_type")


def citation_render(spark: SparkSession, d: str) -> DataFrame:
    rows = citations(spark, d).where("trim(quote) != ''").join(table(spark, d, "papers").select("paper_id", "title"), "paper_id", "left")
    return rows.select("citation_id", quotes.render(F.trim("quote"), F.col("page"), F.col("verified") & F.col("page").isNotNull(), F.coalesce("title", F.lit(""))).alias("rendered"))


def match_types(spark: SparkSession, d: str) -> DataFrame:
    return citations(spark, d).groupBy("match_type").agg(F.count("*").alias("n"), F.count_if("verified").alias("n_verified"), F.count("page").alias("n_placed"))


# --- evaluation -------------------------------------------------------------------------


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.bm25_ranking(_corpus(spark, d), _questions(spark, d), 10).withColumn("paper_id", F.regexp_extract("id", "^(.*):", 1))
    return metrics.per_question(metrics.retrieved_lists(golden(spark, d), hits))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = _retrieved(spark, d)
    return rows.select("id", "category", *[F.round(f"recall_at_{k}", 6).alias(f"recall_at_{k}") for k in metrics.CUTS], F.round("rr", 6).alias("rr"))


def metric_aggregate(spark: SparkSession, d: str) -> DataFrame:
    refused = runs(spark, d).where("id is not null").groupBy("id").agg(F.max("refused_by_prefix").alias("refused"))
    return metrics.retrieval_summary(_retrieved(spark, d).join(refused, "id", "left"), ["category"])


def golden_violation(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the question set once its comparisons are delivered twice, its factual
    questions lose their papers, and runs' own categories are taken over."""
    rows = golden(spark, d).select("id", "category", F.when(F.col("category") == "factual", F.array().cast("array<string>")).when(F.col("category") == "unanswerable", F.array("id")).otherwise(F.col("expected_paper_ids")).alias("expected_paper_ids"))
    again = rows.where("category = 'comparison'").withColumn("category", F.lit("contrast"))
    return golden_violations(rows.unionByName(again), ["factual", "cross_paper", "comparison", "unanswerable"])


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return golden(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def route_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.route_accuracy(runs(spark, d), ["arm"])


def confusion_dense(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(runs(spark, d))


def per_class_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.route_scores(metrics.confusion(runs(spark, d)))


def misroutes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.misroutes(runs(spark, d)).select("thread_id", "expected", "predicted")


def rewrite_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rewrite_metrics(runs(spark, d))


def within_question_delta(spark: SparkSession, d: str) -> DataFrame:
    return metrics.within_question(runs(spark, d))


def fired_despite_good(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fired_despite_good(runs(spark, d)).select("thread_id", "rewrite_count", "recall_at_5_first_pass")


def grounding_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.verdict_shares(runs(spark, d))


def refusal_correctness(spark: SparkSession, d: str) -> DataFrame:
    return metrics.refusal_rates(runs(spark, d))


def refusal_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return metrics.refusal_disagreements(runs(spark, d))


def cost_latency_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_and_cost(runs(spark, d))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """How many questions of each category a sample of 100 holds."""
    return metrics.stratified_sample(golden(spark, d), 100).groupBy("category").agg(F.count("*").alias("n"))


def grade_split(spark: SparkSession, d: str) -> DataFrame:
    """Passages kept and rejected per route."""
    rows = runs(spark, d)
    return rows.groupBy("route").agg(F.sum("n_graded").alias("n_graded"), F.sum("n_rejected").alias("n_rejected"), F.sum(F.col("n_graded") - F.col("n_rejected")).alias("n_kept"))


def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    """The last six questions and answers on each golden question, oldest first."""
    rows = runs(spark, d).where("id is not null and question is not null")
    turns = rows.select(F.col("id").alias("conv_id"), F.struct("asked_at", "thread_id").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text"))
    return corpus.last_turns(turns)


# --- events (beyond the reference: what its traces would be analysed with) -----------------


def event_latency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.max("value").alias("max_value"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Visits of each user: a pause of half an hour begins a new one."""
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(over).cast("timestamp"))
    rows = table(spark, d, "events").withColumn("new", (F.coalesce(pause, F.lit(2**62)) > 1_800_000_000).cast("int")).withColumn("session", F.sum("new").over(over))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n_events"))


def event_windows_stream(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows by type, computed as a stream."""
    return event_windows(spark, f"{d}/events.parquet")


# --- relations ----------------------------------------------------------------------------


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Joins and aggregates over the star schema: the tables of an engine's sanity check."""
    item, order, customer, nation = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = item.join(order, item.l_orderkey == order.o_orderkey).join(customer, order.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


ALL = (
    token_df, block_normalize, sentence_units, section_carry_forward, section_text, fixed_windows, chunk_pack, math_score, token_estimate, page_full_text, year_detect, content_hash_id,
    locate_candidates, multi_part_gate, short_titles, renumbered_questions, paper_inventory, distinct_papers, upsert_merge, cache_misses, index_lookup, bm25_topk, bm25_recent, dense_topk_cosine, hybrid_rrf,
    rrf_fuse, interleave_facets, per_paper_cap, rerank_term_hits, first_appearance_dedup, answer_contexts, quote_exact_verify, quote_verify, quote_fuzzy, first_paper_quotes, citation_render, match_types, recall_at_k, metric_aggregate,
    golden_violation, category_counts, route_accuracy, confusion_dense, per_class_scores, misroutes, rewrite_metrics, within_question_delta, fired_despite_good, grounding_summary, refusal_correctness,
    refusal_disagreements, cost_latency_grouping_sets, stratified_sample, grade_split, history_last_n, event_latency, event_sessions, event_windows_stream, revenue_by_nation, pricing_summary,
)
