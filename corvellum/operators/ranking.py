"""Ranking algebra: ranks, fusion, interleaving, caps.

A ranking is a DataFrame of (query_id, id, rank) with ranks from 1; several rankings of a
query are told apart by list_no.  Every order is total, so results are reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(df: DataFrame, by: Sequence[str | Column], within: Sequence[str] = ("query_id",), name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)))


def top_k(df: DataFrame, k: int, by: Sequence[str | Column], within: Sequence[str] = ("query_id",), name: str = "rank") -> DataFrame:
    """The first k of each group; the limit reaches below the sort's shuffle."""
    return ranked(df, by, within, name).where(F.col(name) <= k)


def rrf_fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over an item's lists."""
    return rankings.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def interleave(rankings: DataFrame, k: int) -> DataFrame:
    """Round robin over the lists of a query, the first place of an item counting, k items.

    An item belongs to where it first comes up: lowest rank, then lowest list.
    """
    first = rankings.groupBy("query_id", "id").agg(F.min(F.struct("rank", "list_no")).alias("at"))
    return top_k(first, k, ["at.rank", "at.list_no"], name="place").select("query_id", "id", "place")


def cap_per_group(hits: DataFrame, group: str, most: int | None, k: int) -> DataFrame:
    """At most `most` hits of one group, in rank order, then the first k of a query."""
    if most is not None:
        hits = top_k(hits, most, ["rank"], ("query_id", group), "_nth").drop("_nth")
    return top_k(hits, k, ["rank"], name="place")


def first_appearances(items: DataFrame, key: str, within: Sequence[str] = ("query_id",)) -> DataFrame:
    """The first row of each key, in rank order, ranks renewed."""
    first = items.groupBy(*within, key).agg(F.min("rank").alias("_first"))
    return ranked(first, ["_first"], within).drop("_first")
