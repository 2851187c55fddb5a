"""What the index holds: inventories, papers as texts, contexts of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvellum.operators.ranking import top_k


def inventory(chunks: DataFrame, sections: bool = True) -> DataFrame:
    """Papers of an index: first title, year (NULL if unknown) and path, last page on which
    a chunk begins, chunks, and the sections in order of first appearance."""
    first = lambda c: F.min_by(c, F.struct("chunk_index", "chunk_id")).alias(c)
    rows = chunks.groupBy("paper_id").agg(first("paper_title"), first("year"), first("source_path"), F.max("page").alias("max_page"), F.count("*").alias("n_chunks"))
    rows = rows.select("paper_id", "paper_title", F.expr("nullif(year, 0)").alias("year"), "source_path", "max_page", "n_chunks")
    if not sections:
        return rows
    # A section's first chunk is found before anything is gathered: a row a section, not a chunk.
    named = chunks.where("section != ''").groupBy("paper_id", "section").agg(F.min("chunk_index").alias("at"))
    lists = named.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("at", "section"))).alias("s"))
    return rows.join(lists, "paper_id", "left").select(*rows.columns, F.coalesce(F.col("s.section"), F.array().cast("array<string>")).alias("sections"))


def by_title(papers: DataFrame) -> DataFrame:
    """An inventory without sections in the order of titles, upper case before lower."""
    return papers.select("paper_id", "paper_title", "year", "max_page", "n_chunks").orderBy("paper_title", "paper_id")


def for_authoring(chunks: DataFrame) -> DataFrame:
    """Papers as authors of questions see them: with the file's name, an unknown year as 0."""
    rows = inventory(chunks, sections=False)
    return rows.select("paper_id", "paper_title", F.coalesce("year", F.lit(0)).alias("year"), F.regexp_extract("source_path", r"([^/]+)$", 1).alias("file_name"), "n_chunks")


def read_paper(sections: DataFrame, paper_id: str, section: str | None = None) -> DataFrame:
    """A paper's sections, or the one of a name, upper or lower case."""
    rows = sections.where(F.col("paper_id") == paper_id)
    return rows if section is None else rows.where(F.lower("section") == section.lower())


def sections_or_list(sections: DataFrame, name: str, most: int = 20) -> DataFrame:
    """(paper_id, section, text, available): of each paper's sections(paper_id, section, place,
    section_text) the first of a name in any case, else none and the first `most` names."""
    ranked = top_k(sections, most, ["place", "section"], ("paper_id",), "nth").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("nth", "section"))).alias("x"))
    found = sections.where(F.lower("section") == name.lower()).groupBy("paper_id").agg(F.min_by(F.struct("section", "section_text"), F.struct("place", "section")).alias("f"))
    rows = ranked.join(found, "paper_id", "left")
    return rows.select("paper_id", "f.section", F.col("f.section_text").alias("text"), F.when(F.col("f").isNull(), F.array_join(F.col("x.section"), " | ")).alias("available"))


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context): hits(query_id, rank, paper_title, page, text) put together by
    paper, papers in the order of their best hit."""
    passage = F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("] "), F.col("text"))
    papers = hits.groupBy("query_id", "paper_title").agg(F.min("rank").alias("best"), F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))).alias("x"))
    block = F.concat(F.lit('<paper title="'), F.col("paper_title"), F.lit('">\n'), F.array_join(F.col("x.p"), "\n\n"), F.lit("\n</paper>"))
    rows = papers.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("best", "paper_title", block.alias("b")))).alias("x"))
    return rows.select("query_id", F.array_join(F.col("x.b"), "\n\n").alias("context"))


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, history): the last n turns(conv_id, turn, role, text), oldest first."""
    last = top_k(turns, n, [F.col("turn").desc(), F.col("role").desc(), F.col("text").desc()], ("conv_id",), "_nth")  # cut off below the shuffle
    rows = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.col("x.line"), "\n").alias("history"))
