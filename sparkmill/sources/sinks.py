"""Idempotent sinks over Parquet: each computes the table that is to be and what changes on the way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.operators.keyed import one_per_key


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after the rows were put in by key: of several rows with one key the last by order holds, and it replaces the table's. Rows with a null in the key are kept as they are. Running it twice changes nothing."""
    new = one_per_key(rows.select(*table.columns), keys, order)
    kept = table.join(new.select(*keys), list(keys), "left_anti")
    return kept.select(*table.columns).unionByName(new.select(*table.columns))


def upsert_and_delete(table: DataFrame, rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, action of making the table equal to the rows: insert, update, delete or keep."""
    a = table.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_t"))
    b = rows.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_r"))
    j = a.join(b, list(keys), "full_outer")
    action = F.when(F.col("_t").isNull(), "insert").when(F.col("_r").isNull(), "delete").when(F.col("_a").eqNullSafe(F.col("_b")), "keep").otherwise("update")
    return j.select(*keys, action.alias("action"))


def append_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows to append: those whose key the table doesn't have, the first by all columns of each key."""
    return one_per_key(rows.join(table.select(key), key, "left_anti"), [key], [c for c in rows.columns if c != key], last=False)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes df over those partitions of a table that it has rows of; the others stay."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def backfill(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """df with the columns set, and one row with how many values of each change."""
    counts = df.agg(*[F.count_if(~F.col(k).eqNullSafe(v)).alias(k) for k, v in columns.items()])
    return df.withColumns(columns), counts


def ledger_violations(ledger: DataFrame, rows: DataFrame, key: str, again: str) -> DataFrame:
    """Rows that touch a key of the ledger again without saying so."""
    return rows.where(~F.coalesce(F.col(again), F.lit(False))).join(ledger.select(key), key, "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a head line each; quotes are doubled, so that any text comes back; null is an empty field and "" a quoted one. Replaces what is there."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue='""', nullValue="")


def write_json(df: DataFrame, path: str) -> None:
    """A folder of files with a JSON document a line, null fields kept. Replaces what is there."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
