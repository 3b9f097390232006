"""Token labels: segment ranks, first tokens, masking, overflow windows, answer spans. Inputs are arrays, one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def segment_ranks(tokens: DataFrame) -> DataFrame:
    """WIN5: (doc_id, pos, box, special) with rank, one more where the box differs from that of the token before; special tokens have 0."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    changed = ~F.col("box").eqNullSafe(F.lag("box").over(order))
    return tokens.withColumn("rank", F.sum(changed.cast("int")).over(order)).withColumn("rank", F.when(F.col("special"), 0).otherwise(F.col("rank")))


def run_positions(ranked: DataFrame) -> DataFrame:
    """WIN6: place of each token in its run of equal ranks: 1 first, 2 between, 3 last; of the last run of a document only the first token has one, the rest 0."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    run = F.sum(F.coalesce(F.col("rank") != F.lag("rank").over(order), F.lit(True)).cast("int")).over(order)
    df = ranked.withColumn("run", run)
    of = Window.partitionBy("doc_id", "run")
    nth, n, last = F.row_number().over(of.orderBy("pos")), F.count("*").over(of), F.max("run").over(Window.partitionBy("doc_id"))
    place = F.when(nth == 1, 1).when(F.col("run") == last, 0).when(nth == n, 3).otherwise(2)
    return df.withColumn("place", place).drop("run")


def first_tokens(ranked: DataFrame, most: int = 150) -> DataFrame:
    """WIN7: places where the rank changes to another than 0, cut or padded with zeros to ``most``, and how many are real."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    begins = (F.col("rank") != F.lag("rank").over(order)) & (F.col("rank") != 0)
    flagged = ranked.withColumn("begin", F.when(begins, F.col("pos")))
    firsts = flagged.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("begin")), 1, most).alias("firsts"))
    n = F.size("firsts")
    return firsts.select("doc_id", F.concat("firsts", F.array_repeat(F.lit(0), F.lit(most) - n)).alias("firsts"), n.alias("n_firsts"))


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once: inside a lambda an expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def first_piece_labels(word_ids: Column, labels: Column) -> Column:
    """WIN8: the label of its word for the first piece of each word, IGNORED for other pieces and for special tokens (null)."""

    def masked(s: Column) -> Column:
        same = lambda w, i: (i > 0) & w.eqNullSafe(F.get(s["w"], i - 1))
        return F.transform(s["w"], lambda w, i: F.when(w.isNull() | same(w, i), IGNORED).otherwise(F.get(s["l"], w)))

    return let(F.struct(word_ids.alias("w"), labels.alias("l")), masked)


def gather(word_ids: Column, values: Column, zero: Column) -> Column:
    """ARR6: the value of each token's word; ``zero`` for tokens of none (null or IGNORED)."""
    pick = lambda s: F.transform(s["w"], lambda w: F.when(w.isNull() | (w == IGNORED), zero).otherwise(F.get(s["v"], w)))
    return let(F.struct(word_ids.alias("w"), values.alias("v")), pick)


def masked_word_ids(word_ids: Column, sequence_ids: Column) -> Column:
    """ARR7: null is IGNORED, and with two sequences so are the tokens of the first."""
    two = F.exists(sequence_ids, lambda s: s == 1)
    return let(two, lambda t: F.zip_with(word_ids, sequence_ids, lambda w, s: F.when(w.isNull() | (t & s.eqNullSafe(F.lit(0))), IGNORED).otherwise(w)))


def overflow_windows(df: DataFrame, column: str, size: int, stride: int) -> DataFrame:
    """WIN10: one row a window of ``size`` items; windows share ``stride`` items; the last may be shorter."""
    step = size - stride
    n = F.size(column)
    starts = F.sequence(F.lit(0), F.greatest(n - stride - 1, F.lit(0)), F.lit(step))
    return df.select("*", F.posexplode(starts).alias("window", "at")).withColumn("items", F.slice(F.col(column), F.col("at") + 1, F.lit(size))).drop(column)


def new_items(windows: DataFrame) -> DataFrame:
    """WIN11: of each window of word ids only those past the largest of the windows before."""
    order = Window.partitionBy("doc_id").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.array_max("items")).over(order), F.lit(-1))
    return windows.withColumn("seen", seen).withColumn("fresh", F.filter("items", lambda w: w > F.col("seen"))).drop("seen")


def answer_tokens(word_ids: Column, start_word: Column, end_word: Column, context_at: Column, length: Column) -> Column:
    """ARR8: the first token of the start word and the last of the end word, from the context on; (-1, -1) without a start, the last place without an end."""

    def found(ids: Column) -> Column:
        places = F.filter(F.transform(ids, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["i"] >= context_at)
        of = lambda word: F.transform(F.filter(places, lambda x: x["w"].eqNullSafe(word)), lambda x: x["i"])
        first, last = F.array_min(of(start_word)), F.array_max(of(end_word))
        return F.struct(F.coalesce(first, F.lit(-1)).alias("start"), F.when(first.isNull(), -1).otherwise(F.coalesce(last, length - 1)).alias("end"))

    return let(word_ids, found)


def label_index(labels: list[str], value: Column) -> Column:
    """PRJ11: place of a label in the list; an unknown label is an error."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), value)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(value, F.lit("null")))).cast("bigint"))


def argmax(values: Column) -> Column:
    """ARR12: the first place of the largest."""
    return F.array_position(values, F.array_max(values)) - 1


def softmax(values: Column) -> Column:
    """ARR12."""

    def shares(v: Column) -> Column:
        e = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
        return let(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, b: a + b).alias("t")), lambda s: F.transform(s["e"], lambda x: x / s["t"]))

    return let(values, shares)


def n_best_spans(logits: DataFrame, n: int = 20, longest: int = 100) -> DataFrame:
    """SORT2: the n best (start, end) of each row (id, starts, ends): pairs of the n best starts and ends in order, at most ``longest`` apart.

    Score is the sum of the logits; ties go to the earlier start, then end. Probabilities are the softmax of the scores kept.
    """
    top = lambda c: F.slice(F.array_sort(F.transform(c, lambda x, i: F.struct((-x).alias("neg"), i.alias("at")))), 1, n)
    pairs = F.flatten(F.transform(top("starts"), lambda s: F.transform(top("ends"), lambda e: F.struct((s["neg"] + e["neg"]).alias("neg"), s["at"].alias("start"), e["at"].alias("end")))))
    good = F.filter(pairs, lambda p: (p["end"] >= p["start"]) & (p["end"] - p["start"] < longest))
    kept = logits.select("id", F.slice(F.array_sort(good), 1, n).alias("best"))
    weights = F.transform("best", lambda p: F.exp(F.get(F.col("best"), F.lit(0))["neg"] - p["neg"]))
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    rows = kept.withColumn("p", F.transform(weights, lambda w: w / total)).select("id", F.posexplode(F.arrays_zip("best", "p")).alias("nth", "x"))
    return rows.select("id", "nth", F.col("x.best.start").alias("start"), F.col("x.best.end").alias("end"), (-F.col("x.best.neg")).alias("score"), F.col("x.p").alias("probability"))


def answered_windows(df: DataFrame, start: str, end: str, others: list[str]) -> DataFrame:
    """ARR9: of arrays with an element a window, those of windows with a start and an end that are not -1; rows without such a window go. Null arrays stay."""
    for c in (end, *others):
        df = df.withColumn(c, F.when(F.size(c) != F.size(start), F.raise_error(F.lit(f"{c}: not as many windows as {start}")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    key = "q_windows"
    while key in df.columns:
        key += "_"
    found = F.filter(F.sequence(F.lit(0), F.size(start) - 1), lambda i: (F.get(start, i) != -1) & (F.get(end, i) != -1))
    kept = df.withColumn(key, F.when(F.size(start) > 0, found)).filter(F.size(key) > 0)
    pick = lambda c: F.transform(key, lambda i: F.get(c, i))
    picked = {c: F.when(F.col(c).isNotNull(), pick(c)) for c in (start, end, *others)}
    return kept.withColumns(picked).drop(key)


def gathered_labels(target: Column, logits: Column, names: Column) -> Column:
    """ARR11: names of target and of the largest logit (the first of equals), at places whose target is not IGNORED: (targets, predictions)."""

    def pick(s: Column) -> Column:
        both = F.filter(F.arrays_zip(s["t"].alias("t"), s["p"].alias("p")), lambda x: x["t"] != IGNORED)
        return let(F.struct(both.alias("b"), s["n"].alias("n")), lambda q: F.struct(F.transform(q["b"], lambda x: F.get(q["n"], x["t"])).alias("targets"), F.transform(q["b"], lambda x: F.get(q["n"], x["p"])).alias("predictions")))

    best = F.transform(logits, lambda row: (F.array_position(row, F.array_max(row)) - 1).cast("int"))
    return let(F.struct(target.alias("t"), best.alias("p"), names.alias("n")), pick)


def layout_target(labels: Column, boxes: Column) -> Column:
    """STR22: ``<x><y><x><y><label>`` of each object, coordinates of 0..1 times 1000 cut to integers, joined by commas."""
    coords = lambda b: F.array_join(F.transform(b, lambda x: F.concat(F.lit("<"), (x * 1000).cast("int").cast("string"), F.lit(">"))), "")
    each = F.zip_with(labels, boxes, lambda name, b: F.concat(coords(b), F.lit("<"), name, F.lit(">")))
    return F.array_join(F.slice(each, F.lit(1), F.least(F.size(labels), F.size(boxes))), ",")
