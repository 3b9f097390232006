"""Inputs of the registered queries, made from the shared tables; each with its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, words: the printable ASCII words of whole texts in order."""
    clean = F.trim(F.regexp_replace("text", r"[^!-~]+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ")).alias("words"))


WORD_ARRAYS = "wa as (select doc_id, case when trim(regexp_replace(text, '[^!-~]+', ' ', 'g')) = '' then [] else string_split(trim(regexp_replace(text, '[^!-~]+', ' ', 'g')), ' ') end as words from documents)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_arrays(spark, sf_dir).select("doc_id", F.posexplode("words").alias("idx", "word"))


WORDS = WORD_ARRAYS + ", w as (select doc_id, unnest(range(len(words)))::INT as idx, unnest(words) as word from wa)"


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on a grid of twelve columns; five lines are a block."""
    line, col = F.floor(F.col("idx") / 12).cast("int"), (F.col("idx") % 12).cast("int")
    df = words(spark, sf_dir).withColumn("line_no", line).withColumn("word_no", col).withColumn("block_no", F.floor(F.col("line_no") / 5).cast("int"))
    df = df.withColumn("x0", F.col("word_no") * 50.0).withColumn("y0", F.col("line_no") * 14.0)
    return df.withColumn("x2", F.col("x0") + F.length("word") * 4.0).withColumn("y2", F.col("y0") + 10.0)


WORD_BOXES = WORDS + """, wb as (select doc_id, idx, word, (idx // 12)::INT as line_no, (idx % 12)::INT as word_no, (idx // 60)::INT as block_no,
    (idx % 12) * 50.0::DOUBLE as x0, (idx // 12) * 14.0::DOUBLE as y0, (idx % 12) * 50.0::DOUBLE + length(word) * 4.0::DOUBLE as x2, (idx // 12) * 14.0::DOUBLE + 10.0 as y2 from w)"""


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each document from its length and labels; without a label the keys are absent."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id", "left")
    there = F.col("quality").isNotNull()
    return j.select(
        "doc_id", there.alias("json_found"), (F.col("quality") == 1).alias("json_valid"), F.lit(None).cast("boolean").alias("annotation_found"), (1 + F.floor(F.col("n_chars") / 20000)).cast("int").alias("pages"),
        F.when(F.col("doc_id") % 7 != 0, True).alias("can_map"), F.when(there, F.col("toxic")).alias("n_ve_errors"), F.when(F.col("doc_id") % 11 != 0, 0).alias("n_hw_errors"), (F.col("doc_id") % 13 == 0).cast("int").alias("n_missing_images"),
        (F.col("doc_id") % 17 != 0).alias("ocr_found"), (F.col("doc_id") % 5 != 0).alias("gt_passed"), F.when(F.col("doc_id") % 19 == 0, -1).otherwise(F.col("n_chars")).cast("bigint").alias("n_words"),
        (F.col("doc_id") % 3).cast("int").alias("n_handwriting"), (F.col("doc_id") % 2).cast("int").alias("n_visual"),
    )


DOCUMENT_LOG = """dl as (select d.doc_id, quality is not null as json_found, quality = 1 as json_valid, null::BOOLEAN as annotation_found, (1 + n_chars // 20000)::INT as pages,
    case when d.doc_id % 7 <> 0 then true end as can_map, toxic as n_ve_errors, case when d.doc_id % 11 <> 0 then 0 end as n_hw_errors, (d.doc_id % 13 = 0)::INT as n_missing_images,
    d.doc_id % 17 <> 0 as ocr_found, d.doc_id % 5 <> 0 as gt_passed, case when d.doc_id % 19 = 0 then -1 else n_chars end::BIGINT as n_words, (d.doc_id % 3)::INT as n_handwriting, (d.doc_id % 2)::INT as n_visual
    from documents d left join labels l on d.doc_id = l.doc_id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message a conversation: tokens are lengths of its texts, the last turn's role decides the result."""
    c = table(spark, sf_dir, "conversations")
    size = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.length("text"))), F.lit(0))
    per = c.groupBy("conv_id").agg(size("user").alias("tokens_in"), size("assistant").alias("tokens_out"), F.max_by("role", "turn").alias("last"), F.count("*").alias("turns"))
    kind = F.when(F.col("conv_id") % 10 == 9, None).when(F.col("last") == "user", "errored").otherwise("succeeded")
    return per.select(
        F.col("conv_id").alias("message_id"), F.floor(F.col("conv_id") / 50).alias("batch_id"), kind.alias("result_type"), F.when(F.col("last") == "user", -1).otherwise(F.col("tokens_in")).alias("tokens_in"), "tokens_out",
        F.lit(3).cast("bigint").alias("expected"), (F.col("turns") % 4).cast("bigint").alias("found"), F.when(F.col("conv_id") % 20 == 3, "refusal").alias("error"),
    )


MESSAGES = """per as (select conv_id, coalesce(sum(case when role = 'user' then length(text) end), 0)::BIGINT as ti, coalesce(sum(case when role = 'assistant' then length(text) end), 0)::BIGINT as tokens_out, arg_max(role, turn) as last, count(*) as turns from conversations group by 1),
    ms as (select conv_id as message_id, conv_id // 50 as batch_id, case when conv_id % 10 = 9 then null when last = 'user' then 'errored' else 'succeeded' end as result_type, case when last = 'user' then -1 else ti end as tokens_in, tokens_out, 3::BIGINT as expected, (turns % 4)::BIGINT as found, case when conv_id % 20 = 3 then 'refusal' end as error from per)"""

PRICE = (3.00, 15.00, 3.75, 0.30)


def unit_sql(*keys: str, salt: str, seed: int = 42) -> str:
    """SQL of functions.text.uniform."""
    text = " || '|' || ".join([f"({k})::VARCHAR" for k in keys] + [f"'{salt}'", f"'{seed}'"])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / {float(16**13)!r}::DOUBLE)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice(d, 1, 32).alias("starts"), F.slice(d, 33, 32).alias("ends"))


def layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Layout boxes (one for each block of lines) and visual elements (one for each three blocks, shifted)."""
    # the boxes of word_boxes, made in the row of a text: blocks are moved (an id may have several rows), words are not
    w = word_arrays(spark, sf_dir).filter(F.size("words") > 0).select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 60).cast("int"))).alias("block_no"))
    right = F.array_max(F.transform(F.slice("words", F.col("block_no") * 60 + 1, F.lit(60)), lambda word, i: (i % 12) * 50.0 + F.length(word) * 4.0))
    last = F.floor((F.least(F.size("words"), F.col("block_no") * 60 + 60) - 1) / 12)
    w = w.select("doc_id", "block_no", F.lit(0.0).alias("x0"), (F.col("block_no") * 5 * 14.0).alias("y0"), right.alias("x2"), (last * 14.0 + 10.0).alias("y2"))
    b = w.groupBy("doc_id", "block_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    boxes = b.select("doc_id", F.col("block_no").alias("elem"), "x0", "y0", "x2", "y2", F.lit("LE-TEXT").alias("label"))
    v = b.filter("block_no % 3 = 0").select("doc_id", F.col("block_no").alias("elem"), (F.col("x0") + (F.col("doc_id") % 5) * 60).alias("x0"), (F.col("y0") + 20).alias("y0"), (F.col("x0") + (F.col("doc_id") % 5) * 60 + 200).alias("x2"), (F.col("y0") + 60).alias("y2"))
    return boxes, v


LAYOUT = WORD_BOXES + """, bl as (select doc_id, block_no as elem, min(x0) x0, min(y0) y0, max(x2) x2, max(y2) y2 from wb group by 1, 2),
    ve as (select doc_id, elem, x0 + (doc_id % 5) * 60 as x0, y0 + 20 as y0, x0 + (doc_id % 5) * 60 + 200 as x2, y0 + 60 as y2 from bl where elem % 3 = 0)"""

INTER = "(case when least(a.x2, b.x2) > greatest(a.x0, b.x0) and least(a.y2, b.y2) > greatest(a.y0, b.y0) then (least(a.x2, b.x2) - greatest(a.x0, b.x0)) * (least(a.y2, b.y2) - greatest(a.y0, b.y0)) else 0 end)"
AREA_A, AREA_B = "((a.x2 - a.x0) * (a.y2 - a.y0))", "((b.x2 - b.x0) * (b.y2 - b.y0))"
