"""The queries of this subpackage, as the entry point registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvellum.llm import language, leaks, looks, near, oracles, pack, pairs, spans, split

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": split.p1_found,
        "p1_pieces": split.p1_pieces,
        "p2_found": near.p2_found,
        "p2_groups": near.p2_groups,
        "p3_found": spans.p3_found,
        "p3_coverage": spans.p3_coverage,
        "p4_found": looks.p4_found,
        "p4_places": looks.p4_places,
        "p5_found": pairs.p5_found,
        "p5_labels": pairs.p5_labels,
        "p6_containers": pack.p6_containers,
        "p6_fill": pack.p6_fill,
        "p7_found": leaks.p7_found,
        "p7_leaks": leaks.p7_leaks,
        "p8_found": language.p8_found,
        "p8_documents": language.p8_documents,
        "p8_segments": language.p8_segments,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
