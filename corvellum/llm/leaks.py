"""Evaluation texts leaking into training text (problem 7).

MinHash finds a short item in a long document only if both sets are of like size, so both
sides are partitioned down to windows of the size that has to be found: a window of 12
words is a set of eight shingles of five words, and a window that stands in a document is
one of that document's windows.  Between windows of one size containment and Jaccard
similarity agree, so the minimum over the eight shingles is a signature that never misses.
Documents' minima are looked up among the items', and what is found is verified exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.codes import U64, Words, slices, sliding_minima
from corvellum.session import spread

#: Words of a passage that must be found, and words of a shingle.
WINDOW, SHINGLE = 12, 5
#: Characters of items that are sent to the executors at once; more items go in blocks.
BLOCK_CHARS = 8_000_000
_BITS = 22


def window_minima(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first word of every window, and the window's MinHash."""
    grams, at = w.grams(SHINGLE)
    span = WINDOW - SHINGLE + 1
    count = len(grams) - span + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    low = sliding_minima(grams, span)
    inside = np.flatnonzero(at[span - 1 :] - at[:count] == span - 1)
    return at[inside], low[inside]


class Items:
    """The windows of a block of evaluation texts, ready to be looked up."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.rows = rows  # (item_id, field, text)
        w = Words([r[2] for r in rows], str.casefold)
        first, low = window_minima(w)
        self.minima = np.unique(low)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.minima & U64((1 << _BITS) - 1)] = True
        owner = w.text_of()
        self.windows: dict[tuple[str, ...], list[int]] = defaultdict(list)
        words = [w.joined[a:b] for a, b in zip(w.start, w.end)]
        for i in first:
            mine = self.windows[tuple(words[i : i + WINDOW])]
            if not mine or mine[-1] != owner[i]:
                mine.append(int(owner[i]))
        self.count = np.bincount(owner[first], minlength=len(rows))

    def search(self, texts: list[str]) -> Iterator[tuple[int, str, str, int, int]]:
        """(text number, item_id, field, windows found, windows of the field)."""
        w = Words(texts, str.casefold)
        first, low = window_minima(w)
        near = np.flatnonzero(self.table[low & U64((1 << _BITS) - 1)])
        near = near[np.isin(low[near], self.minima)]
        owner = np.searchsorted(w.bounds, first[near], "right") - 1
        found: dict[tuple[int, int], set] = defaultdict(set)
        for text, i in zip(owner, first[near]):
            words = tuple(w.joined[a:b] for a, b in zip(w.start[i : i + WINDOW], w.end[i : i + WINDOW]))
            for item in self.windows.get(words, ()):
                found[int(text), item].add(words)
        for (text, item), seen in found.items():
            yield text, *self.rows[item][:2], len(seen), int(self.count[item])


SCHEMA = "doc_id bigint, item_id string, field string, n_windows int, item_windows int"


def _search(rows: list[tuple[str, str, str]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, j in slices(texts):
                out = [(ids[i + k], *rest) for k, *rest in items.search(texts[i:j])]
                if out:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents(doc_id, text) that hold 12 successive words of items(item_id, field, text).

    Gives (doc_id, item_id, field, n_windows, item_windows): how many of the field's distinct
    places to begin 12 words occur.  Words are runs of letters or digits, case is folded.
    Defined results: NULL texts, and texts under 12 words, neither hold nor leak anything; a
    passage in several items counts for each; repeated rows give one row; extra columns are
    ignored.  The items are the stated query set: their characters are counted first, and
    beyond BLOCK_CHARS they go over the documents in blocks, so that what an executor gets
    has a bound.  The documents are read once a block and never shuffled.
    """
    items = items.select(F.col("item_id").cast("string"), F.col("field").cast("string"), "text").where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // BLOCK_CHARS
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    block = F.pmod(F.xxhash64("item_id", "field", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        rows = [tuple(r) for r in items.where(block == b).orderBy("item_id", "field", "text").collect()]
        one = documents.mapInArrow(_search(rows), SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id", "field").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"))


def golden_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = spark.read.parquet(f"{sf_dir}/golden.parquet")
    return golden.selectExpr("id as item_id", "stack(2, 'question', question, 'ground_truth', ground_truth) as (field, text)")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and golden text it holds, with the part of the text that it holds."""
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return leaks(documents, golden_items(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()
