"""Exact histogram of encoded lengths, and what it says about every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from curbside.llm.text import slices, word_encoder
from curbside.sources.staging import stage

BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and tokens (long) for each row of `docs` (doc_id, text). Null text has 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                lengths = pa.array(encoder.lengths(part.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lengths], names=["doc_id", "tokens"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each encoded length that occurs, with sums over that length and the longer ones.

    tokens, n_docs; docs_from and tokens_from (suffix sums); docs_all and tokens_all; truncated_total (tokens
    kept under a context limit of `tokens`); quantile (share of documents up to this length). The sums run
    inside blocks of lengths and over the blocks, so no task sees all lengths. No rows for an empty table.
    """
    counted = stage(lengths.groupBy("tokens").agg(F.count("*").alias("n_docs")), "lengths")  # read twice below
    counted = counted.withColumn("_block", F.floor(F.col("tokens") / BLOCK))
    sums = counted.groupBy("_block").agg(
        F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("tokens")).alias("_tokens")
    )
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = sums.select(
        "_block",
        F.coalesce(F.sum("_docs").over(later), F.lit(0)).alias("_docs_later"),
        F.coalesce(F.sum("_tokens").over(later), F.lit(0)).alias("_tokens_later"),
        F.sum("_docs").over(every).alias("docs_all"),
        F.sum("_tokens").over(every).alias("tokens_all"),
    )
    here = Window.partitionBy("_block").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counted.join(blocks, "_block")
        .withColumns(
            {
                "docs_from": F.sum("n_docs").over(here) + F.col("_docs_later"),
                "tokens_from": F.sum(F.col("n_docs") * F.col("tokens")).over(here) + F.col("_tokens_later"),
            }
        )
        .withColumns(
            {
                "truncated_total": F.col("tokens_all") - F.col("tokens_from") + F.col("tokens") * F.col("docs_from"),
                "quantile": (F.col("docs_all") - F.col("docs_from") + F.col("n_docs")) / F.col("docs_all"),
            }
        )
        .select("tokens", "n_docs", "docs_from", "tokens_from", "docs_all", "tokens_all", "truncated_total", "quantile")
    )


def _first_from(limit: int) -> list[Column]:
    reached = F.col("tokens") >= limit
    return [F.min_by(c, F.when(reached, F.col("tokens"))).alias(c) for c in ("docs_from", "tokens_from")]


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: how many documents are longer than or as long as `limit`, and the tokens kept under it (0 without rows)."""
    found = histogram.agg(*_first_from(limit), F.max("tokens_all").alias("tokens_all"))
    docs, tokens = F.coalesce("docs_from", F.lit(0)), F.coalesce("tokens_from", F.lit(0))
    return found.select(
        F.lit(limit).cast("bigint").alias("context_limit"),
        docs.alias("docs_from"),
        (F.coalesce("tokens_all", F.lit(0)) - tokens + docs * limit).alias("truncated_total"),
    )


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least `share` of the documents do not exceed (null without rows)."""
    return histogram.agg(F.min(F.when(F.col("quantile") >= share, F.col("tokens"))).alias("tokens"))
