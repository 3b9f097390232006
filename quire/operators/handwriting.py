"""Handwriting words: tasks from boxes or from text, lines of words, entries; seeds of messages in batch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: White space as Python's str.split() knows it.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
#: Word numbers of words without a box begin here.
FALLBACK = 100_000


def segments(word: Column, longest: int, digits: int) -> Column:
    """Parts at single spaces, then by length; (token, original_index, space_before)."""
    cut = (lambda p: T.digit_aware_parts(p, longest, digits)) if digits > 0 else (lambda p: T.balanced_parts(p, longest))
    parts = F.transform(T.spaced_parts(word), lambda p: F.transform(cut(p["part"]), lambda s, i: F.struct(s.alias("token"), (p["space_before"] & (i == 0)).alias("space_before"))))
    return F.transform(F.flatten(parts), lambda s, i: F.struct(s["token"].alias("token"), i.alias("original_index"), s["space_before"].alias("space_before")))


def handwriting_tasks(entries: DataFrame, longest: int, digits: int) -> tuple[DataFrame, DataFrame]:
    """STR16: word tasks and log rows of entries (source_json, pos, hw_id, author_id, text, bboxes).

    A box is ``x1,y1,x2,y2,text,block,line,word``. Entries without boxes give the words of their text, numbered from FALLBACK in each hw_id and left out
    of sentences; without text they give a log row only. A box of fewer than 8 parts is an error.
    """
    keys = ("source_json", "hw_id", "author_id", "pos")
    e = entries.withColumn("boxed", F.coalesce(F.size("bboxes") > 0, F.lit(False))).withColumn("found", F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != ""))
    p = F.split("rec", ",", -1)
    n = F.size(p)
    short = F.raise_error(F.concat(F.lit("Invalid bbox record: "), F.col("rec"))).cast("array<string>")
    boxed = e.filter("boxed").select(*keys, F.posexplode("bboxes").alias("idx", "rec")).withColumn("p", F.when(n < 8, short).otherwise(p))
    n, part = F.size("p"), lambda k: F.get("p", k)
    box = F.transform(F.slice("p", 1, 4), lambda x: x.cast("double"))
    token = F.array_join(F.slice("p", F.lit(5), n - 7), ",")
    numbers = [part(n - k).cast("int").alias(name) for k, name in ((3, "block_no"), (2, "line_no"), (1, "word_no"))]
    with_box = boxed.select(*keys, "idx", *numbers, token.alias("word"), box.alias("bbox"), F.lit(True).alias("include_in_sentence"), F.lit(None).cast("string").alias("sentence_exclusion_reason"))
    bare = e.filter(~F.col("boxed"))
    nth = F.row_number().over(Window.partitionBy("source_json", "hw_id").orderBy("pos", "idx"))
    without = bare.select(*keys, F.posexplode("found").alias("idx", "word")).select(
        *keys, "idx", F.lit(-1).alias("block_no"), F.lit(-1).alias("line_no"), (F.lit(FALLBACK - 1) + nth).alias("word_no"), "word", F.array_repeat(F.lit(0.0), 4).alias("bbox"),
        F.lit(False).alias("include_in_sentence"), F.lit("missing_bbox").alias("sentence_exclusion_reason"),
    )
    tasks = with_box.unionByName(without).withColumn("segments", segments(F.col("word"), longest, digits)).drop("word")
    some = F.size("found") > 0
    logs = bare.select(
        "source_json", "hw_id", "pos", F.when(some, "extraction_notice").otherwise("extraction_skip").alias("type"),
        F.when(some, "missing_bbox_generated").otherwise("missing_bbox_no_text").alias("reason"), F.when(some, F.size("found")).alias("num_words"),
    )
    return tasks, logs


def sentence_lines(words: DataFrame) -> DataFrame:
    """AGG12: text and number of the words of each (source_json, hw_id, block_no, line_no) that are not skipped and belong in sentences, by word_no."""
    used = words.filter(~F.coalesce("skipped", F.lit(False)) & F.coalesce("include_in_sentence", F.lit(True)))
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    lines = used.groupBy("source_json", "hw_id", "block_no", "line_no").agg(ordered.alias("w"))
    return lines.select("source_json", "hw_id", "block_no", "line_no", F.array_join("w.text", " ").alias("text"), F.size("w").alias("n_words"))


def entries(words: DataFrame, carried: tuple[str, ...] = ("image", "style_id")) -> DataFrame:
    """AGG13: the words of each (source_json, hw_id) by block, line and word, and the author of the one that comes first by ``pos``."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "line_no", "word_no", "pos", *carried)))
    return words.groupBy("source_json", "hw_id").agg(F.min_by("author_id", "pos").alias("author_id"), ordered.alias("words"))


def message_seeds(logs: DataFrame) -> DataFrame:
    """JOIN9: message_id, batch_id, seeds from batch logs (pos, batch_id, message_ids, seeds: message to JSON); of several logs the last by ``pos`` counts.

    Old logs saved the lists of all messages for each: there the list at the message's place counts.
    """
    each = logs.select("pos", "batch_id", "seeds", "message_ids", F.explode(F.array_distinct("message_ids")).alias("message_id"))
    last = each.groupBy("message_id").agg(F.max_by(F.struct("batch_id", "message_ids", F.element_at("seeds", F.col("message_id")).alias("json")), "pos").alias("b"))
    place = (F.array_position("b.message_ids", F.col("message_id")) - 1).cast("int")
    old = F.col("b.json").rlike(r"^\s*\[\s*\[")
    seeds = F.when(old, F.get(F.from_json("b.json", "array<array<string>>"), place)).otherwise(F.from_json("b.json", "array<string>"))
    return last.select("message_id", F.col("b.batch_id").alias("batch_id"), seeds.alias("seeds"))
