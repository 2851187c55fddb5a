"""Splitting oversized items at natural boundaries (problem 1).

Every place where a text pauses is a node, and each node knows its successor: the farthest
legal end of the piece that begins one overlap before it.  The greedy cuts of all texts of
a batch are the nodes reached from the texts' starts; they are found by pointer doubling,
squaring the successor table until it no longer moves, so the number of passes grows with
the logarithm of the number of pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.codes import code_points, slices

# Marks that end a sentence, marks that may follow them, line breaks.
ENDERS = ".!?…。！？"
CLOSERS = ")]}\"'”’»"
BREAKS = "\n\r\x0b\x0c\x85  "

SCHEMA = "item_kind string, item_id string, piece_no int, n_pieces int, piece_start int, piece_end int, piece_text string"


@lru_cache(1)
def _tables() -> dict[str, np.ndarray]:
    def of(test: Callable[[str], bool]) -> np.ndarray:
        return np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)

    return {"space": of(str.isspace), "low": of(lambda c: c.islower() or c.isdigit()), "end": of(set(ENDERS).__contains__), "close": of(set(CLOSERS).__contains__), "line": of(set(BREAKS).__contains__)}


def boundaries(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places before which a word, a sentence and a line begin; each holds the later ones."""
    t = _tables()
    space = t["space"][cp]
    words = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.maximum.accumulate(np.where(space, -1, np.arange(len(cp))))[words - 1]  # the character before the blanks
    known = last >= 0
    lines = np.cumsum(t["line"][cp])
    is_line = lines[words - 1] > np.where(known, lines[np.maximum(last, 0)], 0)
    ended = t["end"][cp[last]] | t["close"][cp[last]] & t["end"][cp[np.maximum(last - 1, 0)]]
    is_sentence = known & ended & ~t["low"][cp[words]]
    return words, words[is_sentence | is_line], words[is_line]


def cut(texts: list[str], limit: np.ndarray, overlap: int) -> list[np.ndarray]:
    """The ends of the pieces of each text; a piece begins one overlap before the last end.

    A line or sentence end is taken if it leaves the new part of a piece at least half
    full, else the farthest blank, else the limit itself.  Texts must not be empty.
    """
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(length)
    begin = stop - length

    def owner_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(stop, at, "right").clip(max=len(texts) - 1)

    # No cut can leave less than an overlap before it.
    levels = [at[at - begin[owner_of(at)] > overlap] for at in boundaries(code_points("".join(texts)))]
    natural = np.unique(np.concatenate([begin, stop, levels[0]]))
    owner = owner_of(natural)
    room = np.where(natural == begin[owner], limit[owner], (limit - overlap)[owner])
    # Where a text doesn't pause within a piece's room, the hard cuts are nodes as well.
    gap, step = np.diff(natural, append=natural[-1]), (limit - overlap)[owner]
    extra = np.maximum(0, -((room - gap) // step))
    k = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
    node = np.unique(np.concatenate([natural, np.repeat(natural + room, extra) + k * np.repeat(step, extra)]))

    def successor(at: np.ndarray, room: np.ndarray, stop: np.ndarray) -> np.ndarray:
        reach = np.minimum(at + room, stop)
        best = node[np.searchsorted(node, reach, "right") - 1]
        for level, least in zip(levels, (at, at + room // 2, at + room // 2)):
            if len(level):
                far = level[np.maximum(np.searchsorted(level, reach, "right") - 1, 0)]
                best = np.where((far > least) & (far <= reach), far, best)
        return np.searchsorted(node, np.where(reach == stop, stop, best))

    owner = owner_of(node)
    jump = successor(node, (limit - overlap)[owner], stop[owner])
    end = np.searchsorted(node, stop)
    jump[end] = end
    # A start shares its place with the end of the text before, so it is a node apart.
    start = np.arange(len(texts)) + len(node)
    jump = np.concatenate([jump, successor(begin, limit, stop)])
    seen = np.zeros(len(jump), bool)
    seen[start] = True
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        squared = jump[jump]
        if np.array_equal(squared, jump) and np.array_equal(more, seen):
            break
        jump, seen = squared, more
    ends = node[seen[: len(node)]]
    parts = np.searchsorted(ends, [*begin, stop[-1]], "right")
    return [ends[a:b] - s for a, b, s in zip(parts[:-1], parts[1:], begin)]


def _pieces(overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, item, text, limit = (batch.column(c).to_pylist() for c in ("item_kind", "item_id", "text", "item_limit"))
            for i, j in slices(text):
                rows: list[tuple] = []
                for k, ends in enumerate(cut(text[i:j], np.array(limit[i:j], np.int64), overlap), i):
                    begins = np.maximum(0, np.concatenate([[overlap], ends[:-1]]) - overlap)
                    rows += [(kind[k], item[k], n, len(ends), int(a), int(b), text[k][a:b]) for n, (a, b) in enumerate(zip(begins, ends))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def split_oversized(items: DataFrame, overlap: int) -> DataFrame:
    """Pieces of items(item_kind, item_id, text, item_limit[, version]), none over its limit.

    Lengths are code points.  Each piece after the first begins with the last `overlap`
    characters of the one before, so the text is the first piece and the rest of the others.
    An item within its limit is one piece and stays in the JVM.  Defined results: a NULL text
    or limit gives no piece, an empty text one empty piece; of repeated rows of an oversized
    item the one of the latest version counts (then the greatest text); other columns are
    ignored.  A limit not above the overlap can't be kept and is an error.
    """
    version = F.col("version") if "version" in items.columns else F.lit(0)
    items = items.select("item_kind", "item_id", "text", F.col("item_limit").cast("int").alias("item_limit"), version.alias("version")).where("text is not null and item_limit is not null")
    items = items.withColumn("item_limit", F.when(F.col("item_limit") > overlap, F.col("item_limit")).otherwise(F.raise_error(F.lit(f"the limit must be above the overlap of {overlap}")).cast("int")))
    size = F.length("text")
    whole = items.where(size <= F.col("item_limit")).select("item_kind", "item_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_start"), size.alias("piece_end"), F.col("text").alias("piece_text")).distinct()
    large = items.where(size > F.col("item_limit")).groupBy("item_kind", "item_id").agg(F.max_by(F.struct("text", "item_limit"), F.struct("version", "text")).alias("x"))
    large = large.select("item_kind", "item_id", "x.text", "x.item_limit").mapInArrow(_pieces(overlap), SCHEMA)
    return whole.unionByName(large)


CHUNK_TEXT, CHUNK_EMBED, FULL_TEXT, OVERLAP = 1600, 1700, 20000, 200


def library_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    papers = spark.read.parquet(f"{sf_dir}/papers.parquet")

    def shaped(df: DataFrame, kind: str, key: str, text: Column, limit: int, version: str) -> DataFrame:
        return df.select(F.lit(kind).alias("item_kind"), F.col(key).alias("item_id"), text.alias("text"), F.lit(limit).alias("item_limit"), F.col(version).alias("version"))

    return (
        shaped(chunks, "chunk_text", "chunk_id", F.col("text"), CHUNK_TEXT, "indexed_at")
        .unionByName(shaped(chunks, "chunk_embed_text", "chunk_id", F.col("embed_text"), CHUNK_EMBED, "indexed_at"))
        .unionByName(shaped(papers, "full_text", "paper_id", F.col("full_text"), FULL_TEXT, "added_at"))
    )


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every chunk text, embedding text and full text."""
    return split_oversized(library_items(spark, sf_dir), OVERLAP)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be cut."""
    return p1_pieces(spark, sf_dir).where("n_pieces > 1").select("item_kind", "item_id").distinct()
