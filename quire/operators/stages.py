"""Which documents a stage takes, what it makes of messages and ground truth, and the sums that it reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: The system messages of prompts by task. Models were tuned on these words, so they are to be met letter by letter.
SYSTEM_MESSAGES = {
    "sequence_classification": "You are a document classification model. Classify the document into one of the given categories: {labels}.",
    "token_classification": "You are an information extraction model. Extract all the entities present in this document. Choose from the given entity categories: {labels}.",
    "extractive_qa": "You are a question answering model. Answer the question based on the content of the document.",
}


def _holds(condition: Column) -> Column:
    """A condition on a log: what is missing does not hold."""
    return F.coalesce(condition, F.lit(False))


def one_page() -> Column:
    return _holds(F.col("pages") == 1)


def handwriting_documents(log: DataFrame, char_boxes: DataFrame) -> DataFrame:
    """PRJ2: documents of one page whose characters map to words and have boxes. ``char_boxes`` may repeat a doc_id."""
    return log.filter(one_page() & _holds(F.col("can_map"))).join(char_boxes.select("doc_id"), "doc_id", "left_semi")


def ocr_route() -> Column:
    """PRJ3: ``ocr`` where handwriting or visual elements were found without an error, ``copy`` for other documents of one page, else null."""
    handwriting = _holds((F.col("n_handwriting") > 0) & (F.col("n_hw_errors") == 0))
    visual = _holds((F.col("n_visual") > 0) & (F.col("n_ve_errors") == 0))
    return F.when(one_page() & (handwriting | visual), "ocr").when(one_page(), "copy")


def verifiable() -> Column:
    """PRJ4: one page, with OCR, and ground truth as valid JSON or as annotations (errors of annotations don't matter here)."""
    truth = _holds(F.col("json_found") & F.col("json_valid")) | _holds(F.col("annotation_found"))
    return one_page() & _holds(F.col("ocr_found")) & truth


def word_boxes_due() -> Column:
    """PRJ5: documents whose word and segment boxes are normalised."""
    return one_page() & _holds(F.col("ocr_found"))


def layout_boxes_due() -> Column:
    """PRJ5: documents whose layout boxes are normalised; OCR is not asked for."""
    return one_page() & _holds(F.col("n_layout") > 0)


def stage_log(taken: DataFrame, made: DataFrame, name: str) -> DataFrame:
    """PRJ6: doc_id and the number of rows of ``made`` for each document that a stage took, zero included; rows of others don't count."""
    counts = made.groupBy("doc_id").agg(F.count("*").alias(name))
    return taken.select("doc_id").distinct().join(counts, "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def message_log(messages: DataFrame, expected: int) -> DataFrame:
    """PRJ7: message_id, result_type, expected, found, doc_ids of messages (message_id, result_type, error, response).

    Without success, or with an error (refusals are successes with one), both counts are -1 and there are no ids; a null response has no documents.
    """
    good = _holds(F.col("result_type") == "succeeded") & (F.coalesce("error", F.lit("")) == "")
    found = F.coalesce(F.size(T.html_documents(F.coalesce("response", F.lit("")))), F.lit(0))
    df = messages.select("message_id", "result_type", good.alias("good"), found.alias("n"))
    none = F.array().cast("array<string>")
    names = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.col("message_id").cast("string"), F.lit("_"), (i - 1).cast("string")))
    return df.select(
        "message_id", "result_type", F.when(F.col("good"), expected).otherwise(-1).alias("expected"), F.when(F.col("good"), F.col("n")).otherwise(-1).alias("found"),
        F.when(F.col("good") & (F.col("n") > 0), names).otherwise(none).alias("doc_ids"),
    )


def layout_truth(boxes: Column) -> Column:
    """PRJ9: label and [x0, y0, x2, y2] of each layout box, in order."""
    return F.transform(boxes, lambda b: F.struct(b.label.alias("label"), F.array(b.x0, b.y0, b.x2, b.y2).alias("bbox")))


def entity_questions(entities: Column) -> Column:
    """PRJ9: entities (key, value, bbox_indices) as questions: those without a box go, the others keep their place as id."""
    numbered = F.transform(entities, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    kept = F.filter(numbered, lambda n: F.size(n.e.bbox_indices) > 0)
    return F.transform(
        kept,
        lambda n: F.struct(
            n.i.alias("question_id"), n.e.key.alias("question"), F.array(n.e.value).alias("answers"), F.array(F.element_at(n.e.bbox_indices, 1)).alias("starts"), F.array(F.element_at(n.e.bbox_indices, -1)).alias("ends")
        ),
    )


def all_labels_known(labels: Column, known: list[str]) -> Column:
    """PRJ14: whether each label is one of the known; true without labels, a null label is unknown."""
    return F.forall(F.coalesce(labels, F.array().cast("array<string>")), lambda x: _holds(x.isin(known)))


def class_truth(annotation: Column, known: list[str]) -> Column:
    """PRJ15: (label, passed): the first value of a JSON object and whether it is a known class; a null label for an empty object and for what is none."""
    label = F.get(F.map_values(F.from_json(annotation, "map<string,string>")), F.lit(0))
    return F.struct(label.alias("label"), _holds(label.isin(known)).alias("passed"))


def handwriting_summary(tasks: DataFrame, results: DataFrame, logs: DataFrame) -> DataFrame:
    """AGG28: measure, n of a run: ``tasks``, ``results`` (skipped: the image was there), ``logs`` (kind: extraction_skip, generation_error or sentence_exclusion)."""
    of = lambda df, name, cond=None: df.agg(F.lit(name).alias("measure"), (F.count_if(cond) if cond is not None else F.count("*")).alias("n"))
    parts = [of(tasks, "total_tasks"), of(results, "words_generated", ~F.col("skipped")), of(results, "words_reused", F.col("skipped"))]
    parts += [of(logs, name, F.col("kind") == kind) for name, kind in (("extraction_skips", "extraction_skip"), ("generation_errors", "generation_error"), ("sentence_exclusions", "sentence_exclusion"))]
    return reduce(DataFrame.unionByName, parts)


def render_summary(log: DataFrame) -> DataFrame:
    """AGG29: documents of one page, of more, and with an error (a document may be in two of them; an empty error is none)."""
    failed = F.col("render_error") != ""
    return log.agg(F.count_if(F.col("pages") == 1).alias("successful"), F.count_if(F.col("pages") > 1).alias("multi_page"), F.count_if(failed).alias("failed"))


def cluster_overview(points: DataFrame, source: str, cluster: str) -> DataFrame:
    """AGG30: clusters and entropy (nats, not over ln K) of each source, to three digits; clusters under zero are noise, a source of noise only has 0 and null."""
    sizes = points.groupBy(source, cluster).agg(F.count("*").alias("q_n"))
    real = F.when(F.col(cluster) >= 0, F.col("q_n"))
    per = sizes.withColumn("q_n", real).groupBy(source).agg(F.count("q_n").alias("n_clusters"), F.sum("q_n").alias("total"), F.sum(F.col("q_n") * F.ln("q_n")).alias("weighted"))
    return per.select(source, "n_clusters", (F.round(F.ln("total") - F.col("weighted") / F.col("total"), 3) + F.lit(0.0)).alias("entropy"))


def first_of_group(df: DataFrame, key: str, order: str, n: int = 12) -> DataFrame:
    """SORT4: the first ``n`` rows of each group, with their place from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("place") <= n)


def rows_at(ids: DataFrame, places: DataFrame) -> DataFrame:
    """JOIN11: ids (idx, sample_id) of drawn places (idx); a place that is drawn twice gives two rows, one that isn't there none."""
    return places.select("idx").join(ids, "idx")


def class_from_text(predicted: Column, labels: list[str], *key: Column | str, seed: int = 42) -> Column:
    """ARR13: place of a generated text, stripped, among the labels; for any other text a label drawn by a hash of the key, so reruns agree."""
    drawn = F.floor(T.uniform(*key, salt="class", seed=seed) * len(labels)).cast("int")
    place = F.array_position(F.array(*map(F.lit, labels)), F.regexp_replace(predicted, r"(?U)^\s+|\s+$", "")).cast("int")
    return F.when(place > 0, place - 1).otherwise(drawn)


def one_hot(place: Column, n: int) -> Column:
    """ARR13: logits with 1 at a place."""
    return F.array(*[F.when(place == i, 1.0).otherwise(0.0) for i in range(n)])


def same_sizes(value: Column, *arrays: Column) -> Column:
    """ARR14: a value where all arrays are of one size (or all null); an error that names the sizes elsewhere."""
    sizes = [F.coalesce(F.size(a), F.lit(-1)) for a in arrays]
    alike = reduce(Column.__and__, [s == sizes[0] for s in sizes[1:]], F.lit(True))
    return F.when(alike, value).otherwise(F.raise_error(F.concat(F.lit("arrays differ in size: "), F.concat_ws(", ", *[s.cast("string") for s in sizes]))))


def system_message(task: str, labels: list[str] | None = None) -> str:
    """STR23: the system message of a task, its labels as JSON; an unknown task is an error. Layout analysis has no message here."""
    if task not in SYSTEM_MESSAGES:
        raise NotImplementedError(f"no prompt for {task}")
    return SYSTEM_MESSAGES[task].format(labels=json.dumps(labels))


def chat_sample(system: str | Column, image: Column, question: Column, target: Column) -> Column:
    """STR23: images and the messages of system, user (image, then text) and assistant."""
    part = lambda kind, img, txt: F.struct(F.lit(kind).alias("type"), img.cast("string").alias("image"), txt.cast("string").alias("text"))
    said = lambda role, *content: F.struct(F.lit(role).alias("role"), F.array(*content).alias("content"))
    system, none = F.lit(system) if isinstance(system, str) else system, F.lit(None)
    talk = F.array(said("system", part("text", none, system)), said("user", part("image", image, none), part("text", none, question)), said("assistant", part("text", none, target)))
    return F.struct(F.array(image).alias("images"), talk.alias("messages"))


def reference_path(template: str, split: str) -> str:
    """SRC19: the reference file of a split; files call the validation split dev."""
    return template.format(split="dev" if split == "validation" else split)
