"""Exact duplicates by a persistent index of text digests, with DataFrame operations only."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbside.sources.staging import stage, staged_path

#: A digest is hot when it has at least this share of a batch's rows, so there are at most 1 / HOT of them.
HOT = 1 / 1000


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.sha2(lowered, 256)


class DigestIndex:
    """A table of digests, bucketed and sorted by digest, one row for each distinct text ever added.

    `name` is its table, `path` a folder that all executors reach; a later application opens it again under
    the same name and path. Batches are added one at a time; `batch` tells which one brought a digest.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} (digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> str:
        """Append those of `groups` (digest, keep_id, group_size; digests distinct) that are new; return the batch's name.

        The index is read by its buckets, neither shuffled nor sorted again.
        """
        batch = uuid.uuid4().hex
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new = stage(new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")), "new-digests")
        # dealt by bucket, a bucket is one file however many partitions the shuffle has
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        (
            new.repartition(self.buckets, bucket)
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)
        return batch


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null equals empty. Of equal texts the
    largest doc_id is kept (a null one only where there is no other); rows that repeat a kept doc_id with the
    same text are kept alike. A text that `index` had before is not kept, and keep_id and group_size are those
    of the index. Columns of `docs` other than doc_id and text are not read. An empty table gives no rows.

    Rows whose digest is hot are joined to a broadcast of the hot digests, of which there are at most
    1 / HOT by definition; the other rows go to the buckets of the index, where no digest has many.
    """
    spark = docs.sparkSession
    if index is None:
        path = staged_path(spark, "digest-index")
        index = DigestIndex(spark, "digests_" + path.rsplit("-", 1)[1], path)
    rows = stage(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_digest(docs["text"]).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stage(groups, "digest-groups")
    batch = index.add(groups)
    limit = F.greatest(F.lit(2), groups.select(F.sum("group_size") * HOT).scalar())
    hot = groups.where(F.col("group_size") >= limit).select("digest")
    entries = index.table()
    hot = entries.join(F.broadcast(hot), "digest", "left_semi").withColumnRenamed("digest", "_hot")
    marked = rows.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
    cold = marked.where("_hot is null").select("doc_id", "digest").join(entries.hint("merge"), "digest")
    found = marked.where("_hot is not null").drop("_hot").unionByName(cold)
    return found.select(
        "doc_id", "keep_id", "group_size",
        ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with all their columns."""
    kept = exact_duplicates(docs, index).where("kept")
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_digest")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(kept["_kept_id"]) & (text_digest(docs["text"]) == kept["_kept_digest"])
    return docs.join(kept, same, "left_semi")
