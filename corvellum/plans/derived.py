"""Inputs of queries that the tables hold only in parts: blocks of pages, passages with grades,
passes, usage, what models and people decided.  Every one is made of whole tables by a rule, and
plans/boundary_sql.py makes it by the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvellum.plans.queries import chunks, citations, golden, pages, runs
from corvellum.sources.tables import table


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages as blocks in two columns; some are turned, and every page bears a running
    head and its number."""
    line = pages(spark, d).where("text is not null").select("paper_id", "page", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    body = line.select("paper_id", "page", F.when(F.col("i") % 2 == 1, 320.0).otherwise(40.0).alias("x0"), (F.floor(F.col("i") / 2) * 10 + 20).cast("double").alias("y0"), F.when(F.col("text").rlike("[0-9]$"), 0.0).otherwise(1.0).alias("dir_x"), F.when((F.col("page") == 1) & (F.col("i") < 2), 18.0).otherwise(10.0).alias("font_size"), "text")
    sheet = pages(spark, d).select("paper_id", "page")
    edge = lambda y, text: sheet.select("paper_id", "page", F.lit(40.0).alias("x0"), F.lit(y).alias("y0"), F.lit(1.0).alias("dir_x"), F.lit(8.0).alias("font_size"), text.alias("text"))
    whole = body.unionByName(edge(1.0, F.lit("Proceedings of the  library"))).unionByName(edge(9000.0, F.concat(F.lit("Page "), F.col("page").cast("string"))))
    return whole.withColumn("page_width", F.lit(600.0)).withColumn("dir_y", 1.0 - F.col("dir_x"))


def transcriptions(spark: SparkSession, d: str) -> DataFrame:
    """What was read from a page's image: here the least quote that is placed on it, or nothing."""
    rows = citations(spark, d).where("page is not null").groupBy("paper_id", "page").agg(F.min("quote").alias("quote"))
    return rows.select("paper_id", "page", F.when(F.length("quote") > 60, F.col("quote")).otherwise("NONE").alias("transcription"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    return citations(spark, d).where("thread_id is not null").select("thread_id", "citation_id", "paper_id", "page", F.coalesce("quote", F.lit("")).alias("text"))


def grades(spark: SparkSession, d: str) -> DataFrame:
    """What a grader says of passages; of those without a page it says nothing."""
    rows = citations(spark, d).where("thread_id is not null and page is not null")
    return rows.select("citation_id", "thread_id", F.col("verified").alias("relevant"), (F.col("match_type") == "fuzzy").alias("on_topic"), F.length(F.coalesce("quote", F.lit(""))).alias("input_tokens"), F.length(F.coalesce("match_type", F.lit(""))).alias("output_tokens"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """The expected route of every question by arm, and one label without a question."""
    rows = runs(spark, d).where("id is not null").groupBy("id").agg(F.max(F.when(F.col("arm") == "with_paper", F.col("expected"))).alias("with_paper"), F.max(F.when(F.col("arm") == "no_paper", F.col("expected"))).alias("no_paper"))
    return rows.unionByName(spark.createDataFrame([("q-none", "web", "web")], rows.schema))


def retrieval_passes(spark: SparkSession, d: str) -> DataFrame:
    """(thread_id, pass_no, recall): the first and the last of a run's passes."""
    rows = runs(spark, d)
    first = rows.select("thread_id", F.lit(1).alias("pass_no"), F.col("recall_at_5_first_pass").alias("recall"))
    return first.unionByName(rows.where("n_retrieval_passes > 1").select("thread_id", F.col("n_retrieval_passes").alias("pass_no"), F.col("recall_at_5_final_pass").alias("recall")))


def usage(spark: SparkSession, d: str) -> DataFrame:
    """(thread_id, usage): a map of a run's nodes to what they used; direct runs don't grade."""
    used = lambda seq, i, o: F.struct(F.lit(seq).alias("seq"), i.cast("bigint").alias("input_tokens"), o.cast("bigint").alias("output_tokens"), F.bround((i + 5 * o) / 1e6, 6).alias("cost_usd"))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    n, m = F.coalesce("n_graded", F.lit(0)), F.coalesce("rewrite_count", F.lit(0))
    rows = runs(spark, d)
    entries = F.map_from_arrays(
        F.array(*map(F.lit, ("route", "grade", "grounding_1", "grounding_2"))),
        F.array(used(1, size("question"), size("route")), F.when(F.col("route") != "direct", used(2, 10 * n, n)), used(3, size("answer"), m), F.when(m > 0, used(4, 2 * size("answer"), m))),
    )
    return rows.select("thread_id", entries.alias("usage"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """(thread_id, seq, decision): what users said, in the shapes clients send; some say nothing."""
    said = (
        F.when(F.col("verdict") == "grounded", F.when(F.col("rewrite_count") > 0, '"Approved "').otherwise("yes"))
        .when(F.col("verdict") == "partially_grounded", F.when(F.col("rewrite_count") > 0, '{"approved": true}').otherwise('{"approved": null, "decision": "yes"}'))
        .when(F.col("verdict") == "ungrounded", F.when(F.col("rewrite_count") > 0, '{"decision": {"approve": " OK "}}').otherwise('{"other": "yes"}'))
        .when(F.col("verdict") == "api_refused", F.when(F.col("rewrite_count") > 0, "true").otherwise("certainly"))
    )
    return runs(spark, d).where("verdict is not null").select("thread_id", F.lit(1).alias("seq"), said.alias("decision"))


def found_on_web(spark: SparkSession, d: str) -> DataFrame:
    """(thread_id, score, title, url, content): documents that a question's paper's readers find."""
    asked = citations(spark, d).where("thread_id is not null").select("thread_id", "paper_id").distinct()
    docs = table(spark, d, "documents").where("paper_id is not null").select("paper_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), F.col("n_chars").alias("score"), F.left("text", F.lit(60)).alias("content"))
    return asked.join(docs, "paper_id").drop("paper_id")


def states(spark: SparkSession, d: str) -> DataFrame:
    """(thread_id, ...): a run's state with the lists that it gathered."""
    lists = citations(spark, d).where("thread_id is not null").groupBy("thread_id").agg(F.array_sort(F.collect_list("citation_id")).alias("citations"), F.array_sort(F.collect_set("paper_id")).alias("chunks"))
    none = F.array().cast("array<bigint>")
    rows = runs(spark, d).join(lists, "thread_id", "left")
    return rows.select("thread_id", "question", "route", "rewrite_count", "answer", F.struct("verdict").alias("grounding"), F.coalesce("citations", none).alias("citations"), F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))


def splits(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, queries): what a splitter makes of questions, blank parts included."""
    return golden(spark, d).select(F.col("id").alias("query_id"), F.array(F.col("question"), F.lit(" "), F.col("ground_truth")).alias("queries"))


def read_sections(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, section, place, section_text) of the index's chunks by section."""
    rows = chunks(spark, d).where("section != ''")
    return rows.groupBy("paper_id", "section").agg(F.min("chunk_index").alias("place"), F.min_by("text", F.struct("chunk_index", "chunk_id")).alias("section_text"))


def thread_papers(spark: SparkSession, d: str) -> DataFrame:
    """(thread_id, rank, paper_id, title): the papers of an answer in the order of citation."""
    cited = citations(spark, d).where("thread_id is not null").groupBy("thread_id", "paper_id").agg(F.min("citation_id").alias("at"))
    rank = F.row_number().over(Window.partitionBy("thread_id").orderBy("at"))
    return cited.withColumn("rank", rank).join(table(spark, d, "papers").select("paper_id", "title"), "paper_id", "left").select("thread_id", "rank", "paper_id", "title")
