"""Exact duplicates with a heavy-hitter split.

Misra-Gries summaries of the digests, one a partition, are merged into at most ``k`` candidates. Their groups are counted and their
winners found in an exact second pass with partial aggregation (so a hot digest is one row a task); these at most k
winners are broadcast, and rows of the heavy groups are settled where they are, without a shuffle. The other digests, each
with less than 2 N / (k + 1) rows, go through one ordinary shuffle of (digest, id), never of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _common as C

#: Counters of a summary; also the bound of what is broadcast.
HEAVY = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, digest (SHA-256 of the text in UTF-8, null as empty), check (a second hash and the length)."""
    raw = C.text_of(text_col).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(raw, 256)).alias("digest"), F.struct(F.xxhash64(raw).alias("hash"), F.octet_length(raw).alias("bytes")).alias("check")
    )


def merge_summary(counters: dict[bytes, int], more: dict[bytes, int], k: int) -> dict[bytes, int]:
    """The Misra-Gries merge: add, then take the (k + 1)-th largest count from all and keep what is left above zero."""
    for key, n in more.items():
        counters[key] = counters.get(key, 0) + n
    if len(counters) <= k:
        return counters
    least = sorted(counters.values(), reverse=True)[k]
    return {key: n - least for key, n in counters.items() if n > least}


def _summarise(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[bytes, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            counters = merge_summary(counters, dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], names=["digest", "estimate"])

    return run


def frequent(table: DataFrame, k: int = HEAVY) -> DataFrame:
    """At most k digests, among them every one with more than 2 N / (k + 1) of the N rows; estimates are too low, never too high.

    Estimates add up to N at most, so no more than k of them are over N / (k + 1): the bound needs no sort and no limit.
    """
    n = table.count()
    partial = table.select("digest").mapInArrow(_summarise(k), "digest binary, estimate bigint")
    return partial.groupBy("digest").agg(F.sum("estimate").alias("estimate")).filter((F.col("estimate") > 1) & (F.col("estimate") * (k + 1) > n))


def exact_dedup(table: DataFrame, k: int = HEAVY, largest: bool = True) -> DataFrame:
    """One row for each row of a materialized digests() table: doc_id, row, digest, keep_id, keep_row, group_size, kept.

    Of equal texts the row with the largest (or smallest) doc_id stays; null ids lose against any other, and rows that
    repeat id and text leave one, by row. All groups are exact: the summary only chooses the way. Digests are verified by
    a second hash and the length: a group in which they differ raises an error rather than losing a text.
    """
    spark = table.sparkSession
    best = F.max if largest else F.min
    # an ascending struct puts nulls first: for the largest that is right, for the smallest they get a mark that sorts last
    rank = F.struct(F.col("doc_id").isNotNull().alias("there") if largest else F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    same = F.when(F.min("check") == F.max("check"), F.count("*")).otherwise(F.raise_error(F.lit("texts with one SHA-256 digest differ")).cast("bigint"))
    candidates = [bytes(r.digest) for r in frequent(table, k).collect()]  # at most k of 32 bytes
    heavy = spark.createDataFrame([(bytearray(d),) for d in candidates], "digest binary")
    winners = table.join(F.broadcast(heavy), "digest").groupBy("digest").agg(best(rank).alias("best"), same.alias("group_size"))
    verified = spark.createDataFrame(winners.collect(), winners.schema)  # at most k rows
    split = table.join(F.broadcast(verified), "digest", "left")
    columns = ["doc_id", "row", "digest", F.col("best.keep_id").alias("keep_id"), F.col("best.keep_row").alias("keep_row"), "group_size"]
    settled = split.filter("best is not null").select(*columns)
    group = Window.partitionBy("digest")
    checked = F.when(F.min("check").over(group) == F.max("check").over(group), F.count("*").over(group)).otherwise(F.raise_error(F.lit("texts with one SHA-256 digest differ")).cast("bigint"))
    rest = split.filter("best is null").select("doc_id", "row", "digest", "check").select("*", best(rank).over(group).alias("best"), checked.alias("group_size")).select(*columns)
    return settled.unionByName(rest).withColumn("kept", F.col("row") == F.col("keep_row"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY) -> DataFrame:
    """The documents without exact copies, all their columns unchanged; of equal texts the largest id stays.

    Only ids and digests of the copies to drop are joined to the texts. Rows are told apart by id and digest; of rows that repeat
    both, the first by its other columns stays. Null texts are equal to empty ones; rows without an id lose against any other. An empty table gives no rows.
    """
    settled = exact_dedup(C.materialize(digests(docs, id_col, text_col), "digests"), k)
    digest, drop_id, drop_digest, nth = (C.fresh(docs, c) for c in ("q_digest", "q_drop_id", "q_drop_digest", "q_nth"))
    repeated = settled.filter("not kept and doc_id <=> keep_id").select("doc_id", "digest").distinct()
    dropped = settled.filter("not kept and not (doc_id <=> keep_id)").select("doc_id", "digest")
    marked = docs.withColumn(digest, F.unhex(F.sha2(C.text_of(text_col).cast("binary"), 256)))
    gone = dropped.select(F.col("doc_id").alias(drop_id), F.col("digest").alias(drop_digest))
    match = F.col(id_col).eqNullSafe(F.col(drop_id)) & (F.col(digest) == F.col(drop_digest))
    left = marked.join(gone, match, "left_anti")
    if repeated.isEmpty():
        return left.drop(digest)
    again = repeated.select(F.col("doc_id").alias(drop_id), F.col("digest").alias(drop_digest))
    once = left.join(again, match, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(id_col, digest).orderBy(*C.by_content(docs)))).filter(F.col(nth) == 1).drop(nth)
    return left.join(again, match, "left_anti").unionByName(once).drop(digest)
