"""Filling fixed-capacity containers with items (problem 6).

The global histogram of sizes, at most one row a size, is all that reaches the driver.
Dynamic programming cuts it into length buckets with the least padding, and batches of the
token budget are formed of bucket sizes: equal ones first, from the longest bucket down,
then what is left of a container takes the longest batch of a shorter bucket that fits.
That gives patterns and how often each occurs; an item's rank within its bucket then tells
its container, so texts are read once and never shuffled.

Batches of one bucket only, the plain form of the method, would leave up to half of every
container of a long bucket empty.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvellum.llm.codes import slices
from corvellum.session import shared_folder, spread

CAPACITY, BUCKETS = 2048, 128
#: A public vocabulary of ranks and how it cuts text; both are parameters.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of a bucket that one task ranks, about.
RANKED = 250_000


@lru_cache(4)
def _encoding(vocabulary: bytes, cut: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("given", pat_str=cut, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY, cut: str = CUT) -> DataFrame:
    """(doc_id, n_tokens) of documents(doc_id, text); NULL texts have no row."""
    with open(vocabulary, "rb") as f:
        shipped = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, not data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shipped.value, cut).encode_ordinary
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [len(encode(t)) for i, j in slices(texts) for t in texts[i:j]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def choose_buckets(sizes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Upper ends of at most `most` buckets of the given sizes with the least padding."""
    n = len(sizes)
    if n <= most:
        return sizes
    items = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(float)
    # cost[i, j]: sizes i .. j-1 in one bucket, all padded to the largest of them.
    cost = sizes[None, :] * (items[None, 1:] - items[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    cost = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], cost, np.inf)
    best = cost[0].copy()
    cuts = []
    for _ in range(most - 1):
        total = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
        at = total.argmin(axis=0)
        better = total[at, np.arange(n)]
        cuts.append(np.where(better < best, at, -1))
        best = np.minimum(best, better)
    ends, j = [], n - 1
    for step in reversed(cuts):
        if step[j] >= 0:
            ends.append(j)
            j = step[j] - 1
    return sizes[np.array([j, *reversed(ends)])]


def form_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (containers, [(bucket, items in each)]) that hold all items of every bucket.

    Best fit from the longest bucket down, all equal containers at once: a bucket goes into
    the containers with the least room that suffices, as many to each as fit.
    """
    rooms: list[int] = []  # distinct rooms of open patterns, sorted
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def add(room: int, n: int, pattern: list[tuple[int, int]]) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((n, pattern))

    for bucket in range(len(bounds) - 1, -1, -1):
        bound, left = int(bounds[bucket]), int(counts[bucket])
        while left:
            k = bisect.bisect_left(rooms, bound)
            if k < len(rooms):
                room = rooms[k]
                n, pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, n, pattern = capacity, left, []
            each = min(room // bound, left)
            used = min(n, left // each)
            if used < n:
                add(room, n - used, pattern) if pattern else None
            add(room - each * bound, used, [*pattern, (bucket, each)])
            left -= used * each
    return [(n, p) for room in sorted(open_) for n, p in open_[room]]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]], buckets: int) -> list[np.ndarray]:
    """Per bucket rows (first rank, first container, items in each container)."""
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(buckets)]
    rank, base = [0] * buckets, 0
    for n, pattern in patterns:
        for bucket, each in pattern:
            rows[bucket].append((rank[bucket], base, each))
            rank[bucket] += n * each
        base += n
    return [np.array(r, np.int64).reshape(-1, 3) for r in rows]


def _assigned(slots: list[np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, rank = batch.column("bucket").to_numpy(), batch.column("bucket_rank").to_numpy()
            container = np.zeros(len(bucket), np.int64)
            for b in np.unique(bucket):
                mine = np.flatnonzero(bucket == b)
                first, base, each = slots[b].T
                k = np.searchsorted(first, rank[mine], "right") - 1
                container[mine] = base[k] + (rank[mine] - first[k]) // each[k]
            kept = [n for n in batch.schema.names if n not in ("bucket", "bucket_rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(container)], [*kept, "container_id"])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Containers for sizes(doc_id, n_tokens): one row a text, or a piece of a longer one.

    Gives (doc_id, piece_no, token_start, token_end, container_id).  Only a text longer than
    the capacity is cut, into full containers and a rest that is packed like a text.
    Defined results: a text of no tokens takes no room and has a NULL container; NULL sizes
    are left out; repeated rows of a doc_id count once, with the largest size; extra columns
    are ignored; of an empty table nothing is made.  The containers of equal input are equal.
    """
    shared_folder(sizes.sparkSession)
    sizes = sizes.where("n_tokens is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    full = F.floor(F.col("n_tokens") / capacity)
    last = F.when(F.col("n_tokens") % capacity > 0, full).otherwise(F.greatest(full - 1, F.lit(0)))
    pieces = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece_no"))
    start = F.col("piece_no") * capacity
    pieces = pieces.select("doc_id", "piece_no", start.alias("token_start"), F.least("n_tokens", start + capacity).alias("token_end")).withColumn("size", F.col("token_end") - F.col("token_start")).checkpoint()
    histogram = pieces.where("size > 0").groupBy("size").count().orderBy("size").collect()  # at most `capacity` rows
    kinds = "doc_id bigint, piece_no bigint, token_start bigint, token_end bigint"
    size, count = (np.array([r[k] for r in histogram], np.int64) for k in (0, 1))
    bounds = choose_buckets(size, count, buckets) if len(size) else size
    of_size = np.searchsorted(bounds, size)
    per = np.bincount(of_size, weights=count, minlength=len(bounds)).astype(np.int64)
    slots = _slots(form_batches(bounds, per, capacity), len(bounds))
    spread = max(1, int(per.max(initial=0)) // RANKED)
    edges = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) else F.array(F.lit(0))
    bucket = F.size(F.filter(edges, lambda b: b < F.col("size")))
    items = pieces.where("size > 0").select("doc_id", "piece_no", "token_start", "token_end", bucket.alias("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(spread)).alias("part"))
    within = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "piece_no"))
    sums = items.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = items.withColumn("within", within).join(sums.select("bucket", "part", before.alias("before")), ["bucket", "part"])
    ranked = ranked.select("doc_id", "piece_no", "token_start", "token_end", "bucket", (F.col("before") + F.col("within") - 1).alias("bucket_rank"))
    placed = ranked.mapInArrow(_assigned(slots), f"{kinds}, container_id bigint")
    return placed.unionByName(pieces.where("size = 0").select("doc_id", "piece_no", "token_start", "token_end", F.lit(None).cast("bigint").alias("container_id")))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_sizes(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled: their number, tokens, and the mean share used."""
    per = p6_containers(spark, sf_dir).where("container_id is not null").groupBy("container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    return per.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.min("used").alias("least_used"), F.max("used").alias("most_used"), F.round(F.avg(F.col("used") / CAPACITY), 4).alias("mean_fill"))
