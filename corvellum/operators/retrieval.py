"""Search: BM25, exact cosine, their fusion, filters, caps and reranking.

All take a frame of queries, so an evaluation is one job and a single search its one-row
case.  Queries are a stated, small side; corpora are never broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvellum.functions import text as T
from corvellum.operators.ranking import cap_per_group, rrf_fuse, top_k

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Digits of a score that decide an order; beyond them sums depend on their sequence.
DIGITS = 6


def fetch_size(k: int) -> int:
    """How deep each ranking goes before fusion."""
    return max(3 * k, 20)


def deep_fetch_size(k: int) -> int:
    """How deep a search goes if a cap per paper follows."""
    return max(6 * k, 40)


def pool_size(k: int, depth: int = 15) -> int:
    """How many hits are reranked to keep k."""
    return max(depth, k)


def scope(paper_id: str | None = None, year_min: int | None = None, year_max: int | None = None) -> Column:
    """Filter of a search.  An unknown year counts as 0: excluded by a lower bound only."""
    year = F.coalesce("year", F.lit(0))
    keep = F.lit(True)
    if paper_id:
        keep = keep & (F.col("paper_id") == paper_id)
    if year_min is not None:
        keep = keep & (year >= year_min)
    if year_max is not None:
        keep = keep & (year <= year_max)
    return keep


def postings(corpus: DataFrame) -> DataFrame:
    """(term, id, tf, n_terms) of corpus(id, text)."""
    words = corpus.where("text is not null").select("id", T.tokens(F.col("text")).alias("words"))
    # explode_outer, as explode brings a filter that splits every text once more.
    return words.select("id", F.size("words").alias("n_terms"), F.explode_outer("words").alias("term")).where("term is not null").groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("n_terms").alias("n_terms"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def term_frequencies(corpus: DataFrame) -> DataFrame:
    """(term, df) of corpus(id, text), one row a text: counted before anything is shuffled."""
    words = corpus.where("text is not null").select(F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    return words.select(F.explode_outer("words").alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def bm25_scores(corpus: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, id, score) of Okapi BM25 for queries(query_id, text), positive scores only.

    A term in over half of the texts has a negative weight; it gets epsilon times the mean
    weight of all terms instead.  A word asked twice counts twice.  Texts without words
    count towards the mean length.  Statistics are of the whole corpus: filter afterwards.
    """
    posted = postings(corpus)
    asked = queries.where("text is not null").select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    sizes = corpus.where("text is not null").select(F.size(T.tokens(F.col("text"))).alias("n"))
    n_docs, mean_size = sizes.agg(F.count("*")).scalar(), sizes.agg(F.avg("n")).scalar()
    frequencies = document_frequencies(posted).withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean_weight = frequencies.agg(F.avg("raw")).scalar()
    weights = frequencies.select("term", F.when(F.col("raw") < 0, epsilon * mean_weight).otherwise(F.col("raw")).alias("idf"))
    terms = asked.select("term").distinct().join(weights, "term")
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / mean_size))
    hits = posted.join(terms, "term").select("term", "id", gain.alias("gain"))
    scored = hits.join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("gain") * F.col("qtf")).alias("score"))
    return scored.where(F.round("score", DIGITS) > 0)


class _Best:
    """What can be among a query's k best, batch by batch: scores below the k-th best that a
    task has seen so far stay there.  All ties with the k-th are kept; ids decide later."""

    def __init__(self, n_queries: int, k: int):
        self.best = np.full((n_queries, k), -np.inf)

    def keep(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.best.shape[1]
        both = np.concatenate([self.best, scores], axis=1)
        self.best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        return np.nonzero(scores >= self.best.min(axis=1, keepdims=True))


def _search(ids: list, k: int, scorer: Callable[[list], np.ndarray], columns: int, least: float) -> Callable:
    """Runs scorer, rows to a matrix of a row a query, over columns (id, x); columns is what
    else a row costs it, so that no matrix has more than some millions of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, best = pa.array(ids), _Best(len(ids), k)
        width = max(1, 4_000_000 // max(len(ids), columns))
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                scores = np.round(scorer(part.column("x").to_pylist()), DIGITS)
                q, d = best.keep(np.where(scores > least, scores, -np.inf))
                real = scores[q, d] > least
                q, d = q[real], d[real]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), part.column("id").take(pa.array(d)), pa.array(scores[q, d])], ["query_id", "id", "score"])

    return run


def _in_blocks(corpus: DataFrame, queries: DataFrame, k: int, block: int, least: float, scorer_of: Callable[[list], tuple[Callable[[list], np.ndarray], int]]) -> DataFrame:
    """The stated queries go over the corpus in blocks of a bounded number; only what can be
    among a query's k best leaves a task."""
    q_type, d_type = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["id"]
    blocks = 1 + queries.count() // block
    found = corpus.limit(0).select(F.lit(None).cast(q_type).alias("query_id"), "id", F.lit(0.0).alias("score"))
    for n in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).orderBy("query_id").collect()
        if part:
            run = _search([r.query_id for r in part], k, *scorer_of(part), least)
            found = found.unionByName(corpus.select("id", "x").mapInArrow(run, f"query_id {q_type}, id {d_type}, score double"))
    return top_k(found, k, [F.col("score").desc(), "id"])


def bm25_ranking(corpus: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank), the k best by the scores of bm25_scores.

    Joining postings and queries makes a row for every common word of a text and a query;
    here the queries' weights are a matrix by terms, and a batch of texts is one product
    with it.  keep filters after the weights are known, so it never changes them.
    """
    known = corpus.where("text is not null")
    queries = queries.where("text is not null").select("query_id", T.tokens(F.col("text")).alias("words"))
    n_docs, mean_size = known.select(F.size(T.tokens(F.col("text"))).alias("n")).agg(F.count("*"), F.avg("n")).first()
    raw = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    asked = queries.select(F.explode("words").alias("term")).distinct().withColumn("asked", F.lit(True))
    # The mean is over all terms; only those of the queries, a stated set, come back.
    frequencies = term_frequencies(known).withColumn("raw", raw).join(asked, "term", "left")
    mean_weight, told = frequencies.agg(F.avg("raw"), F.collect_list(F.when(F.col("asked"), F.struct("term", "raw")))).first()
    weights = {r.term: EPSILON * mean_weight if r.raw < 0 else r.raw for r in told}

    def scorer_of(part: list) -> tuple[Callable[[list], np.ndarray], int]:
        column = {t: i for i, t in enumerate(sorted({w for r in part for w in r.words if w in weights}))}
        matrix = np.zeros((len(part), len(column)))
        for i, r in enumerate(part):
            for w in r.words:
                if w in column:
                    matrix[i, column[w]] += weights[w]

        def score(texts: list) -> np.ndarray:
            gains = np.zeros((len(texts), len(column)))
            for i, text in enumerate(texts):
                words = re.findall("[a-z0-9]+", text.lower())
                at = np.array([column[w] for w in words if w in column], np.int64)
                if len(at):
                    terms, tf = np.unique(at, return_counts=True)
                    gains[i, terms] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_size))
            return matrix @ gains.T

        return score, len(column)

    rows = (known if keep is None else known.where(keep)).select("id", F.col("text").alias("x"))
    return _in_blocks(rows, queries, k, block, 0.0, scorer_of)


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """rows with a column vector: what embed, a function of a batch of texts, makes of a column,
    at length 1.  NULL texts have no vector; a vector of zeros stays one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            known = [t for t in texts if t is not None]
            made = np.array(embed(known) if known else [], np.float64).reshape(len(known), -1)
            size = np.linalg.norm(made, axis=1, keepdims=True)
            vectors = iter((made / np.where(size == 0, 1, size)).tolist())
            column = pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "vector"])

    rows = rows.drop("vector")
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, vector array<double>")


def dense_ranking(corpus: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the k rows of corpus(id, vector) nearest to each of
    queries(query_id, vector) by exact cosine.

    keep filters before the ranking.  NULL vectors are left out, a zero vector has cosine 0.
    """

    def unit(rows: list) -> np.ndarray:
        matrix = np.array(rows, np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms == 0, 1, norms)

    def scorer_of(part: list) -> tuple[Callable[[list], np.ndarray], int]:
        asked = unit([r.vector for r in part])
        return lambda rows: asked @ unit(rows).T, asked.shape[1]

    rows = (corpus if keep is None else corpus.where(keep)).where("vector is not null").select("id", F.col("vector").alias("x"))
    return _in_blocks(rows, queries.where("vector is not null").select("query_id", "vector"), k, block, -np.inf, scorer_of)


def fuse(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """The k best of two rankings by reciprocal rank fusion; of equal scores the better
    dense rank comes first, then the better BM25 rank."""
    both = dense.select("query_id", "id", F.col("rank").alias("dense_rank")).join(sparse.select("query_id", "id", F.col("rank").alias("bm25_rank")), ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (60 + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("dense_rank") + part("bm25_rank"), DIGITS))
    return top_k(scored, k, [F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last()])


def hybrid_search(corpus: DataFrame, queries: DataFrame, k: int = 8, mode: str = "hybrid", keep: Column | None = None) -> DataFrame:
    """Hits of corpus(id, text, vector) for queries(query_id, text, vector).

    mode: dense, bm25 or hybrid; only the rankings it needs are made.
    """
    if mode not in ("dense", "bm25", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    n = fetch_size(k)
    empty = F.lit(None).cast("int")
    if mode == "dense":
        return dense_ranking(corpus, queries, k, keep).select("query_id", "id", "score", F.col("rank").alias("dense_rank"), empty.alias("bm25_rank"), "rank")
    if mode == "bm25":
        return bm25_ranking(corpus, queries, k, keep).select("query_id", "id", "score", empty.alias("dense_rank"), F.col("rank").alias("bm25_rank"), "rank")
    return fuse(dense_ranking(corpus, queries, n, keep), bm25_ranking(corpus, queries, n, keep), k)


def rerank(hits: DataFrame, scores: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """Hits (query_id, id, rank, paper_id) in the order of a scorer's scores(query_id, id,
    model_score), rounded to five digits so that near ties keep the retrieval order."""
    rows = hits.join(scores, ["query_id", "id"]).withColumn("model_score", F.bround("model_score", 5))
    order = top_k(rows, 2**31 - 1, [F.col("model_score").desc(), "rank"], name="new_rank").drop("rank").withColumnRenamed("new_rank", "rank")
    return cap_per_group(order, "paper_id", most, k)


def term_hits(hits: DataFrame, texts: DataFrame, queries: DataFrame) -> DataFrame:
    """A lexical stand-in for a scoring model: how many words of the query a text has."""
    rows = hits.select("query_id", "id").join(texts.select("id", F.col("text").alias("_t")), "id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    shared = F.size(F.array_intersect(T.tokens(F.col("_q")), T.tokens(F.col("_t"))))
    return rows.select("query_id", "id", shared.cast("double").alias("model_score"))
