"""From pages to chunks: lines, sections, sentences, windows, packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvellum.functions import text as T

TARGET, OVERLAP = 1000, 200


def page_lines(pages: DataFrame) -> DataFrame:
    """(paper_id, page, line_no, line, is_header) of the non-blank lines."""
    rows = pages.where("text is not null").select("paper_id", "page", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))).where("line != ''").withColumn("is_header", T.is_section_header(F.col("line")))


def with_sections(lines: DataFrame) -> DataFrame:
    """Each line with the last heading before it and the number of headings so far.

    A heading holds until the next, over page ends too.  Done in two steps, within pages
    and over the pages' last headings, so no window spans all lines of a long paper.
    """
    in_page = Window.partitionBy("paper_id", "page").orderBy("line_no")
    head = F.when(F.col("is_header"), F.col("line"))
    rows = lines.withColumn("in_page", F.last(head, True).over(in_page)).withColumn("heads", F.sum(F.col("is_header").cast("int")).over(in_page))
    over = Window.partitionBy("paper_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy("paper_id", "page").agg(F.max_by(head, F.when(F.col("is_header"), F.col("line_no"))).alias("last"), F.max("heads").alias("n"))
    before = last.select("paper_id", "page", F.last("last", True).over(over).alias("carried"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("heads_before"))
    rows = rows.join(before, ["paper_id", "page"])
    return rows.select("paper_id", "page", "line_no", "line", "is_header", F.coalesce("in_page", "carried", F.lit("")).alias("section"), (F.col("heads") + F.col("heads_before")).alias("section_no"))


def units(pages: DataFrame) -> DataFrame:
    """(paper_id, page, line_no, sentence_no, section, section_no, sentence) in reading order;
    headings themselves are no units."""
    lines = with_sections(page_lines(pages)).where("not is_header")
    # Headings of one name in a row, or with nothing between, make one section.
    over = Window.partitionBy("paper_id").orderBy("section_no")
    named = lines.groupBy("paper_id", "section_no").agg(F.first("section").alias("name"))
    runs = named.withColumn("new", F.coalesce((F.col("name") != F.lag("name").over(over)).cast("int"), F.lit(0))).select("paper_id", "section_no", F.sum("new").over(over).alias("run"))
    lines = lines.join(runs, ["paper_id", "section_no"]).drop("section_no").withColumnRenamed("run", "section_no")
    rows = lines.select("paper_id", "page", "line_no", "section", "section_no", F.posexplode(T.sentences(F.col("line"))).alias("sentence_no", "sentence"))
    return rows.withColumn("sentence", F.trim("sentence")).where("sentence != ''")


def section_texts(unit_rows: DataFrame) -> DataFrame:
    """(paper_id, section, section_text): a section's sentences in order; sections of one
    name merge, and what stands before any is '(no section)'."""
    label = F.when(F.col("section") == "", "(no section)").otherwise(F.col("section")).alias("section")
    placed = F.array_sort(F.collect_list(F.struct("page", "line_no", "sentence_no", "sentence")))
    rows = unit_rows.groupBy("paper_id", label).agg(placed.alias("s"))
    return rows.select("paper_id", "section", F.array_join(F.col("s.sentence"), " ").alias("section_text"))


def fixed_windows(pages: DataFrame, size: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(paper_id, page, window_no, text): character windows of each page by itself, the last
    one being the first that reaches the page's end."""
    step = size - overlap
    flat = pages.where("text is not null").select("paper_id", "page", T.collapse(F.col("text")).alias("flat")).where("flat != ''")
    last = F.greatest(F.lit(0), F.ceil((F.length("flat") - size) / F.lit(step))).cast("int")
    rows = flat.select("paper_id", "page", "flat", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    return rows.select("paper_id", "page", "window_no", F.trim(F.substring("flat", F.col("window_no") * step + 1, F.lit(size))).alias("text")).where("text != ''")


def pack(lengths: list[int], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges of sentences greedily packed to the target, each taking over the sentences at
    the end of the one before that fit the overlap."""
    ranges, start, size = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > target:
            ranges.append((start, i))
            start, size = i, 0
            while start > ranges[-1][0] and size + lengths[start - 1] <= overlap:
                start -= 1
                size += lengths[start]
        size += n
    if start < len(lengths):
        ranges.append((start, len(lengths)))
    return ranges


def _packed(target: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted, a section after the other; only the open section is held.
        held: pd.DataFrame | None = None

        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for no, (a, b) in enumerate(pack(rows.sentence.str.len().tolist(), target, overlap)):
                first = rows.iloc[a]
                out.append((first.paper_id, first.section_no, no, first.page, first.section, " ".join(rows.sentence.iloc[a:b])))
            return pd.DataFrame(out, columns=["paper_id", "section_no", "piece_no", "page", "section", "text"])

        for batch in batches:
            for _, rows in batch.groupby(["paper_id", "section_no"], sort=False):
                same = held is not None and (held.paper_id.iloc[0], held.section_no.iloc[0]) == (rows.paper_id.iloc[0], rows.section_no.iloc[0])
                if held is not None and not same:
                    yield flush(held)
                held = pd.concat([held, rows]) if same else rows
        if held is not None:
            yield flush(held)

    return run


def section_chunks(unit_rows: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(paper_id, chunk_index, page, section, text): packed sentences, never over a section.

    Packing starts afresh at every heading, so a section and not a paper is what a task
    handles, one after the other in a sorted stream.
    """
    rows = unit_rows.select("paper_id", "section_no", "section", "page", "line_no", "sentence_no", "sentence").repartition("paper_id", "section_no").sortWithinPartitions("paper_id", "section_no", "page", "line_no", "sentence_no")
    pieces = rows.mapInPandas(_packed(target, overlap), "paper_id string, section_no bigint, piece_no int, page int, section string, text string")
    order = Window.partitionBy("paper_id").orderBy("section_no", "piece_no")
    return pieces.select("paper_id", (F.row_number().over(order) - 1).alias("chunk_index"), "page", "section", "text")


def embed_text(title: Column, section: Column, text: Column) -> Column:
    """A chunk's text behind its paper's title and section."""
    part = F.when(section == "", "unknown").otherwise(section)
    return F.concat(F.lit("From '"), title, F.lit("', section '"), part, F.lit("': "), text)


def chunks(pages: DataFrame, papers: DataFrame, strategy: str = "section_context") -> DataFrame:
    """The index's chunks of papers(paper_id, title, year, path) under a strategy: fixed
    windows, packed sections, or sections embedded behind their context."""
    if strategy == "fixed":
        order = Window.partitionBy("paper_id").orderBy("page", "window_no")
        rows = fixed_windows(pages).select("paper_id", (F.row_number().over(order) - 1).alias("chunk_index"), "page", F.lit("").alias("section"), "text")
    elif strategy in ("section", "section_context"):
        rows = section_chunks(units(pages))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = rows.join(papers.select("paper_id", F.coalesce("title", F.lit("")).alias("paper_title"), F.coalesce("year", F.lit(0)).alias("year"), F.col("path").alias("source_path")), "paper_id", "left")
    embedded = embed_text(F.coalesce("paper_title", F.lit("")), F.col("section"), F.col("text")) if strategy == "section_context" else F.col("text")
    return rows.select(F.concat_ws(":", "paper_id", "chunk_index").alias("chunk_id"), "paper_id", "paper_title", "page", "section", "chunk_index", "year", "source_path", "text", embedded.alias("embed_text"))
