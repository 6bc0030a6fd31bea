"""Token ids of whole corpora (problem 8): the transducer of bpe in Arrow batches, one vocabulary for each worker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm.bpe import public_path, vocabulary
from sparkmill.session import spread, table


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, ids: the ids of each row's text without special tokens; an empty list for empty and for null text. Other columns are dropped, repeated rows are kept."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path or public_path())
        for d in batches:
            yield pd.DataFrame({key: d[key], "ids": [v.encode(t if isinstance(t, str) else None) for t in d[text]]})

    return spread(df.select(key, text), key).mapInPandas(run, f"{key} {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens; 0 for empty and for null text."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path or public_path())
        for d in batches:
            yield pd.DataFrame({key: d[key], "n_tokens": [len(v.encode(t if isinstance(t, str) else None)) for t in d[text]]})

    return spread(df.select(key, text), key).mapInPandas(run, f"{key} {kind}, n_tokens int")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key, text: the text of each row's ids; "" for an empty and for a null list."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path or public_path())
        for d in batches:
            yield pd.DataFrame({key: d[key], "text": ["".join(v.decode(() if x is None else map(int, x))) for x in d[ids]]})

    return df.select(key, ids).mapInPandas(run, f"{key} {kind}, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, same: whether decoding the ids gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs)
    back = decode(ids).select("doc_id", F.col("text").alias("back"))
    return docs.join(back, "doc_id").join(ids.select("doc_id", F.size("ids").alias("n_tokens")), "doc_id").select("doc_id", "n_tokens", F.coalesce("text", F.lit("")).eqNullSafe(F.col("back")).alias("same"))
