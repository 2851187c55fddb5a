"""Parsing as far as it is data processing: blocks of positioned text to pages of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvellum.functions import text as T


def is_horizontal(dx: Column, dy: Column) -> Column:
    return (F.abs(dx - 1) < 0.01) & (F.abs(dy) < 0.01)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Horizontal, non-blank blocks(paper_id, page, page_width, x0, y0, dir_x, dir_y,
    font_size, text), normalised and numbered: left column first, then top to bottom."""
    rows = blocks.where(is_horizontal(F.col("dir_x"), F.col("dir_y"))).withColumn("text", T.normalise_block(F.col("text"))).where("text != ''")
    column = F.when(F.col("x0") < F.col("page_width") / 2, 0).otherwise(1)
    return rows.withColumn("block_no", F.row_number().over(Window.partitionBy("paper_id", "page").orderBy(column, "y0", "x0", "text")))


def repeated_texts(blocks: DataFrame, least_pages: int = 3, share: float = 0.6, most_chars: int = 120) -> DataFrame:
    """(paper_id, text, n_pages, paper_pages): texts on most pages of a paper, its headers
    and footers."""
    pages = blocks.groupBy("paper_id").agg(F.count_distinct("page").alias("paper_pages"))
    seen = blocks.groupBy("paper_id", "text").agg(F.count_distinct("page").alias("n_pages"))
    least = F.greatest(F.lit(2), F.ceil(F.round(F.lit(share) * F.col("paper_pages"), 9)))
    return seen.join(pages, "paper_id").where((F.col("paper_pages") >= least_pages) & (F.col("n_pages") >= least) & (F.length("text") < most_chars))


def body_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks without repeated ones and bare page numbers."""
    return blocks.where(~T.is_page_number(F.col("text"))).join(repeated_texts(blocks).select("paper_id", "text"), ["paper_id", "text"], "left_anti")


def pages_of(blocks: DataFrame) -> DataFrame:
    """(paper_id, page, text) of raw blocks; a page of which nothing remains is empty."""
    ordered = reading_order(blocks)
    kept = body_blocks(ordered).groupBy("paper_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("x"))
    texts = kept.select("paper_id", "page", F.array_join(F.col("x.text"), "\n").alias("text"))
    return blocks.select("paper_id", "page").distinct().join(texts, ["paper_id", "page"], "left").select("paper_id", "page", F.coalesce("text", F.lit("")).alias("text"))


def titles(blocks: DataFrame, page_height: float = 842.0) -> DataFrame:
    """(paper_id, title): the largest lines in the upper half of page one, at most 200
    characters."""
    top = blocks.where((F.col("page") == 1) & (F.col("y0") < page_height / 2) & is_horizontal(F.col("dir_x"), F.col("dir_y")) & (F.trim("text") != ""))
    size = F.max("font_size").over(Window.partitionBy("paper_id"))
    lines = top.withColumn("largest", size).where("font_size > largest - 0.5").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))).alias("x"))
    return lines.select("paper_id", F.left(T.normalise_block(F.array_join(F.transform("x.text", lambda x: F.trim(x)), " ")), F.lit(200)).alias("title"))


def full_texts(pages: DataFrame) -> DataFrame:
    """(paper_id, full_text, n_tokens): pages behind their markers, parted by blank lines."""
    marked = F.concat(F.lit("[PAGE "), F.col("page").cast("string"), F.lit("]\n\n"), F.col("text"))
    rows = pages.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("page", marked.alias("text")))).alias("x"))
    full = F.array_join(F.col("x.text"), "\n\n")
    return rows.select("paper_id", full.alias("full_text"), T.token_estimate(full).alias("n_tokens"))


def locate(quote: Column, text: Column) -> Column:
    """Where on a page the first of a quote's candidates stands that stands there at all, case
    aside: struct(start, chars), NULL if none does."""
    found = F.filter(T.locate_candidates(quote), lambda c: F.contains(F.lower(text), F.lower(c)))
    return F.when(F.size(found) > 0, F.struct((F.instr(F.lower(text), F.lower(found[0])) - 1).alias("start"), F.length(found[0]).alias("chars")))


# Fixed value: the header of what was read from a page's image.
def with_transcriptions(pages: DataFrame, transcriptions: DataFrame, header: str = "[TRANSCRIBED EQUATIONS (from page image)]") -> DataFrame:
    """Pages with what was transcribed from their image appended, where there is anything."""
    rows = pages.join(transcriptions.select("paper_id", "page", F.trim("transcription").alias("extra")), ["paper_id", "page"], "left")
    some = F.coalesce((F.col("extra") != "") & (F.col("extra") != "NONE"), F.lit(False))
    return rows.select("paper_id", "page", F.when(some, F.concat(F.col("text"), F.lit(f"\n\n{header}\n"), F.col("extra"))).otherwise(F.col("text")).alias("text"))
