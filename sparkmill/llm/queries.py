"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkmill.llm import articles, brands, offers, packing, residue, splits, tokens, topn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": articles.p1_found,
    "p1_groups": articles.p1_groups,
    "p3_found": brands.p3_found,
    "p3_report": brands.p3_report,
    "p4_found": splits.p4_found,
    "p4_split": splits.p4_split,
    "p5_found": topn.p5_found,
    "p6_found": offers.p6_found,
    "p8_ids": tokens.p8_ids,
    "p8_roundtrip": tokens.p8_roundtrip,
    "p9_packed": packing.p9_packed,
    "p10_found": residue.p10_found,
}

SQL: dict[str, str] = {"p4_found": splits.P4_SQL, "p5_found": topn.P5_SQL}
