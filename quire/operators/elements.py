"""Element records and words: error codes, ids, shapes of ground truth, greedy and in-order word matches, dataset information."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.labels import let

#: Types of visual elements, and other names that are given to them; fixed values.
VISUAL_TYPES = ["stamp", "logo", "figure", "barcode", "photo"]
VISUAL_SYNONYMS = {"chart": "figure", "diagram": "figure", "plot": "figure", "graph": "figure", "illustration": "figure", "infographic": "figure", "image": "photo", "seal": "stamp"}


def is_blank(text: Column) -> Column:
    """Null, empty or white space only, of any alphabet."""
    return text.isNull() | text.rlike(r"(?U)\A[\s\x1c-\x1f]*\z")


def key_value_error(classes: Column, text: Column, labels: list[str]) -> Column:
    """PRJ17: an empty text is ``missing-value``, overridden by ``multiple-labels`` for more than one valid label."""
    known = F.filter(F.split(F.coalesce(classes, F.lit("")), r"\s+"), lambda c: c.isin(labels))
    return F.when(F.size(known) > 1, "multiple-labels").when(F.trim(F.coalesce(text, F.lit(""))) == "", "missing-value")


def first_label(classes: Column, labels: list[str]) -> Column:
    """PRJ17: the first valid label among the classes, or null."""
    return F.get(F.filter(F.split(F.coalesce(classes, F.lit("")), r"\s+"), lambda c: c.isin(labels)), F.lit(0))


def visual_type(name: Column, synonyms: dict[str, str] | None = None) -> Column:
    """PRJ18: the type that a name stands for, null if unknown; letters count as they are."""
    pairs = [F.lit(x) for kv in (VISUAL_SYNONYMS if synonyms is None else synonyms).items() for x in kv]
    known = F.when(name.isin(VISUAL_TYPES), name)
    return F.coalesce(known, F.create_map(*pairs)[name]) if pairs else known


def visual_error(name: Column, width: Column, height: Column) -> Column:
    """PRJ18: ``unknown-type``, else ``invalid-size`` where a side is zero."""
    return F.when(visual_type(name).isNull(), "unknown-type").when((width == 0) | (height == 0), "invalid-size")


def author(classes: Column) -> Column:
    """PRJ20: the first class that begins with ``author``."""
    return F.get(F.filter(F.split(classes, r"\s+"), lambda c: c.startswith("author")), F.lit(0))


def is_signature(classes: Column) -> Column:
    return F.array_contains(F.split(classes, r"\s+"), "signature")


def handwriting_error(author_id: Column, text: Column, found: Column) -> Column:
    """PRJ19: the first of no author, no text (white space only is none), not found."""
    return F.when(author_id.isNull(), "no-authorid").when(is_blank(text), "no-text").when(~F.coalesce(found, F.lit(False)), "not-found")


#: What ids of visual elements begin with; a fixed value.
VISUAL_PREFIX = "&?ve"


def placeholder(number: Column, prefix: str = VISUAL_PREFIX) -> Column:
    """PRJ21."""
    return F.concat(F.lit(prefix), number.cast("string"))


def is_placeholder(value: Column, prefix: str = VISUAL_PREFIX) -> Column:
    """PRJ21: begins with the prefix, and digits alone are left without it."""
    return value.startswith(prefix) & F.replace(value, F.lit(prefix), F.lit("")).rlike(r"(?U)\A\d+\z")


def ground_truth_items(raw: Column) -> Column:
    """PRJ22: entries of a JSON object as (id, group, key, value, error): the id is the key, there is no group, a blank value is ``missing-value``."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))

    def item(e: Column) -> Column:
        return F.struct(e["key"].alias("id"), F.lit(None).cast("string").alias("group"), e["key"].alias("key"), e["value"].alias("value"), F.when(is_blank(e["value"]), "missing-value").alias("error"))

    return F.transform(entries, item)


def flat_answers(raw: Column) -> Column:
    """ARR4: entries of a JSON object, one level flattened: nested keys are ``key<<%?sub``."""
    nested = lambda e: F.from_json(e["value"], "map<string,string>")
    plain = lambda e: F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))
    inner = lambda e: F.transform(F.map_entries(nested(e)), lambda x: F.struct(F.concat(e["key"], F.lit("<<%?"), x["key"]).alias("key"), x["value"].alias("value")))
    return F.flatten(F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.when(e["value"].startswith("{"), inner(e)).otherwise(plain(e))))


def word_pieces(words: DataFrame, longest: int) -> DataFrame:
    """ARR1: words over ``longest`` letters cut into pieces, each from the box of its first character to that of its last; 0 and less leaves words whole.

    ``chars`` are the boxes (x0, y0, x2, y2) of a word's characters in order. A piece without characters has null sides.
    """
    if longest <= 0:
        return words.withColumn("piece", F.lit(0))
    n = F.greatest(F.ceil(F.length("word") / longest), F.lit(1)).cast("int")
    cut = words.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * longest).alias("at"), n.alias("n")))).alias("piece", "p"))
    part = F.substring(F.col("word"), F.col("p.at") + 1, F.lit(longest))
    first = F.get(F.col("chars"), F.col("p.at"))
    last = F.get(F.col("chars"), F.least(F.col("p.at") + F.lit(longest), F.size("chars")) - 1)
    whole = F.col("p.n") == 1
    sides = {c: F.when(whole, F.col(c)).otherwise(box[c]) for c, box in (("x0", first), ("y0", first), ("x2", last), ("y2", last))}
    return cut.withColumns({"word": part, **sides}).drop("p")


def in_order_matches(gold: Column, pred: Column) -> Column:
    """JOIN17: for each predicted word its first place in the gold words after the place of the last match, or -1."""

    def step(acc: Column, w: Column) -> Column:
        rest = F.slice(acc["g"], acc["last"] + 2, F.greatest(F.size(acc["g"]) - acc["last"] - 1, F.lit(0)))
        at = F.array_position(rest, w).cast("int")
        place = F.when(at > 0, acc["last"] + at).otherwise(F.lit(-1))
        return F.struct(acc["g"].alias("g"), F.when(at > 0, place).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(place)).alias("out"))

    start = F.struct(gold.alias("g"), F.lit(-1).alias("last"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(pred, start, step, lambda acc: acc["out"])


def ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100 by matching blocks of insertions and deletions: 200 LCS / (|a| + |b|)."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return 200.0 * row[-1] / (len(a) + len(b))


def greedy_matches(docs: DataFrame, cut_off: float = 80.0) -> DataFrame:
    """JOIN16: doc_id, pairs of (gold index, predicted index): each gold word in order takes the most similar predicted word that is left."""

    @F.pandas_udf("array<struct<g:int,p:int>>")
    def match(gold: pd.Series, pred: pd.Series) -> pd.Series:
        out = []
        for g, p in zip(gold, pred, strict=True):
            left, pairs = dict(enumerate(p)), []
            for i, w in enumerate(g):
                best = max(((ratio(w, x), -k) for k, x in left.items()), default=(0.0, 0))
                if best[0] >= cut_off:
                    pairs.append({"g": i, "p": -best[1]})
                    del left[-best[1]]
            out.append(pairs)
        return pd.Series(out)

    return docs.select("doc_id", match("gold", "pred").alias("pairs"))


def same_ids(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """JOIN12: number of ids that only one side has, or that stand at another position (pos)."""
    l, r = a.select(F.col(id_col).alias("a"), "pos"), b.select(F.col(id_col).alias("b"), "pos")
    return l.join(r, "pos", "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differences"))


def dataset_info(docs: DataFrame) -> DataFrame:
    """AGG17: mean pages (1 where unknown), whether any document has words."""
    return docs.agg(F.avg(F.coalesce("pages", F.lit(1))).alias("mean_pages"), F.bool_or(F.col("words").isNotNull()).alias("has_words"), F.count("*").alias("n"))


def page_word(words: Column) -> Column:
    """AGG25: OCR words (text, confidence) as one: texts joined by spaces, mean confidence."""
    total = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["confidence"])
    return F.struct(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), (total / F.size(words)).alias("confidence"))


def page_extent(elements: DataFrame) -> DataFrame:
    """GEO15: page size of each document from its visible elements (x, y, width, height) and body size: content with its padding where it is
    narrower than 0.7 of the body, else the body; five pixels more, whole pixels; the larger height."""
    e = elements.filter("width > 0 and height > 0").groupBy("doc_id").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.max("body_width").alias("bw"), F.max("body_height").alias("bh"))
    content = F.col("right") - F.col("left")
    width = F.when(content / F.col("bw") < 0.7, content + 2 * F.greatest(F.col("left"), F.lit(0.0))).otherwise(F.col("bw"))
    return e.select("doc_id", F.ceil(width + 5).alias("width"), F.ceil(F.greatest("bottom", "bh") + 5).alias("height"))


def baseline(ink: DataFrame, share: float) -> DataFrame:
    """GEO19: of ink pixels (id, x, y) the percentile of the lowest ink of each column, as a whole row."""
    low = ink.groupBy("id", "x").agg(F.max("y").alias("y"))
    return low.groupBy("id").agg(F.percentile("y", F.lit(share)).cast("int").alias("baseline"))


def ink_box(ink: DataFrame, images: DataFrame, pad: int = 0) -> DataFrame:
    """GEO20: the box of the ink pixels (id, x, y) of images (id, width, height), grown within the image, ends excluded; (0, 0, 1, 1) without ink."""
    found = ink.groupBy("id").agg(*(f(c).alias(f"{k}_{c}") for k, f in (("least", F.min), ("most", F.max)) for c in ("x", "y")))
    least = lambda c: F.greatest(F.col(f"least_{c}") - pad, F.lit(0))
    most = lambda c, side: F.least(F.col(f"most_{c}") + pad, F.col(side) - 1) + 1
    sides = {"x0": (least("x"), 0), "y0": (least("y"), 0), "x2": (most("x", "width"), 1), "y2": (most("y", "height"), 1)}
    empty = F.col("least_x").isNull()
    return images.join(found, "id", "left").select("id", *(F.when(empty, F.lit(other)).otherwise(x).alias(c) for c, (x, other) in sides.items()))


def line_width(parts: Column, gap_word: int, gap_part: int) -> Column:
    """GEO21: width of parts (width, space_before) side by side with gaps between words and between parts of a word."""
    widths = F.aggregate(parts, F.lit(0), lambda a, p: a + p["width"].cast("int"))
    gaps = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(0), lambda a, p: a + F.when(p["space_before"], gap_word).otherwise(gap_part))
    return widths + gaps


def grid_place(position: Column, columns: int) -> Column:
    """GEO23."""
    return F.struct(F.floor(position / columns).cast("int").alias("row"), (position % columns).cast("int").alias("col"))


def entity_counts(items: DataFrame) -> DataFrame:
    """AGG22: entities of each class of each document."""
    return items.groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def latest(checkpoints: DataFrame, by: str, order: str) -> DataFrame:
    """SORT3: the row with the largest number of each group."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return checkpoints.withColumn("q_nth", nth).filter("q_nth = 1").drop("q_nth")


def confirmed(values: Column) -> Column:
    """PRJ8: entries (answer, indices) that have indices, each with its original position and the first and last index."""
    kept = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("question_id"), v.alias("v"))), lambda x: F.size(x["v"]["indices"]) > 0)
    return F.transform(kept, lambda x: F.struct(x["question_id"].alias("question_id"), x["v"]["answer"].alias("answer"), F.element_at(x["v"]["indices"], 1).alias("start"), F.element_at(x["v"]["indices"], -1).alias("end")))


def harmonised(label: Column, dataset: str) -> Column:
    """PRJ10: label names of datasets: receipts use underscores, layouts upper case with a prefix, others as they are."""
    return {"receipts": F.replace(label, F.lit("."), F.lit("_")), "layout": F.concat(F.lit("LE-"), F.upper(label)), "letters": F.upper(label)}.get(dataset, label)


def prompt_rows(entries: Column) -> Column:
    """STR23: questions as one JSON text."""
    return let(entries, lambda e: F.to_json(e))
