"""Dataset summaries: the validity cascade of documents, grouped ids, counters, costs of batches, remaining work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The checks of a document log in order: (error, condition in SQL with the defaults of absent keys). Fixed values.
CHECKS = [
    ("invalid_raw_gt", "not ((coalesce(json_found, false) and coalesce(json_valid, false)) or coalesce(annotation_found, false))"),
    ("is_multipage", "coalesce(pages, -1) <> 1"),
    ("cannot_map_chars_to_words", "not coalesce(can_map, false)"),
    ("visual_elements_extraction_error", "coalesce(n_ve_errors, 1) <> 0"),
    ("handwriting_extraction_error", "coalesce(n_hw_errors, 1) <> 0"),
    ("missing_handwriting_images", "coalesce(n_missing_images, 1) <> 0"),
    ("missing_ocr", "not coalesce(ocr_found, false)"),
    ("gt_verification_failed", "not coalesce(gt_passed, false)"),
    ("no_text", "coalesce(n_words, -1) = 0"),
]


def first_error() -> Column:
    """AGG2: the first check that fails, null for a valid document."""
    out = F
    for name, condition in CHECKS:
        out = out.when(F.expr(condition), name)
    return out


def all_errors() -> Column:
    """Every check that fails, in order."""
    return F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in CHECKS]))


def groups_with_ids(df: DataFrame, key: str, id_col: str = "doc_id") -> DataFrame:
    """AGG3: for each key its number of ids and the ids in order."""
    return df.groupBy(key).agg(F.countDistinct(id_col).alias("total"), F.array_sort(F.collect_set(id_col)).alias("items"))


def categories(df: DataFrame) -> DataFrame:
    """AGG4: counts by overlapping categories of valid documents."""
    hw, ve = F.col("n_handwriting") > 0, F.col("n_visual") > 0
    tags = F.array_compact(F.array(F.when(hw, "handwriting").otherwise("no_handwriting"), F.when(ve, "visual").otherwise("no_visual"), F.when(hw & ve, "both")))
    return df.select("doc_id", F.explode(tags).alias("category")).groupBy("category").agg(F.count("*").alias("total"))


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG5, AGG6: sums and means of counters (-1 means unknown and is left out of sums), minima from 99999, maxima from 0."""
    out = [F.count("*").alias("n")]
    for c in columns:
        total = F.coalesce(F.sum(F.when(F.col(c) != -1, F.col(c))), F.lit(0))
        out += [total.alias(f"{c}_sum"), F.when(F.count("*") > 0, total / F.count("*")).alias(f"{c}_mean"), F.coalesce(F.min(c), F.lit(99999)).alias(f"{c}_min"), F.coalesce(F.greatest(F.max(c), F.lit(0)), F.lit(0)).alias(f"{c}_max")]
    return df.agg(*out)


def prompting_totals(messages: DataFrame) -> DataFrame:
    """AGG1: totals over messages (batch_id, result_type, tokens_in, tokens_out, expected, found); -1 tokens of failed messages count."""
    ok = F.col("result_type") == "succeeded"
    return messages.agg(
        F.countDistinct("batch_id").alias("batches"), F.count("*").alias("messages"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.count_if(ok).alias("succeeded"), F.count_if(F.col("result_type") == "errored").alias("errored"), F.sum(F.when(ok, F.col("expected"))).alias("expected"), F.sum(F.when(ok, F.col("found"))).alias("found"),
    )


def batch_costs(messages: DataFrame, cost: Column) -> DataFrame:
    """AGG8: cost and tokens of each batch over succeeded messages (refusals cost too)."""
    return messages.filter("result_type = 'succeeded'").groupBy("batch_id").agg(F.sum(cost).alias("cost"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("messages"))


def cost_roll_up(batches: DataFrame, n_valid: int, discount: float = 0.5) -> DataFrame:
    """AGG7: totals of ended batches; the batch discount, and the price of a valid document."""
    done = batches.filter("status = 'ended'").agg(F.count("*").alias("batches"), F.sum("messages").alias("messages"), F.sum("cost").alias("cost"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return done.withColumn("discounted", F.col("cost") * discount).withColumn("per_document", F.when(F.lit(n_valid) > 0, F.col("discounted") / n_valid))


def remaining_work(messages: DataFrame, target: int, solutions: int) -> DataFrame:
    """AGG9: documents that are left to the target besides those of succeeded and awaited messages, below zero where there are more; the messages that
    would give them, a fraction."""
    good, waiting = F.count_if(F.col("result_type") == "succeeded"), F.count_if(F.col("result_type").isNull())
    out = messages.agg(F.count("*").alias("messages"), good.alias("succeeded"), waiting.alias("awaited"))
    left = F.lit(target) - (F.col("succeeded") + F.col("awaited")) * solutions
    return out.withColumn("documents_left", left).withColumn("messages_left", F.col("documents_left") / solutions)


def refusals(expected: DataFrame, results: DataFrame) -> DataFrame:
    """JOIN8: ids of messages without a result, and of those whose result is a refusal."""
    missing = expected.select("message_id").join(results.select("message_id"), "message_id", "left_anti")
    return missing.unionByName(results.filter("error = 'refusal'").select("message_id")).distinct()


def cyclic_seeds(messages: DataFrame, seeds: DataFrame, n_seeds: int) -> DataFrame:
    """JOIN10, SAMP10: message i uses seed row i mod n."""
    return messages.join(seeds, F.pmod(F.col("message_idx"), F.lit(n_seeds)) == F.col("seed_idx"))
