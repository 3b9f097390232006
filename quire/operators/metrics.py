"""Task metrics: classification, entities, answers, recognition errors, detection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators.verify import tag_spans


def classification_report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """STAT12: label, support, precision, recall, f1 of each class (0 where undefined)."""
    counts = df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(F.col("g").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp"))
    sides = sides.unionByName(counts.select(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("tp")))
    per = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    per = per.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return per.select("label", "support", "precision", "recall", f1.alias("f1"))


def classification_summary(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """STAT12: accuracy, macro precision and recall, and macro F1 as the mean of the F1 of classes."""
    macro = classification_report(df, gold, pred).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return df.agg(F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy")).join(F.broadcast(macro))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """STAT12: gold, pred, n and the share of the gold class."""
    counts = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gold")))


def entity_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """STAT13: exact entities (type, first, last) of IOB2 tags (doc_id, idx, tag): precision, recall and F1 of each label and of all ("micro")."""
    key = ["doc_id", "label", "first", "last"]
    g, p = tag_spans(gold).select(*key), tag_spans(pred).select(*key)
    rows = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), key, "full").select("label", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    both = rows.select(F.explode(F.array(F.col("label"), F.lit("micro"))).alias("label"), "g", "p")
    per = both.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum(F.col("g") * F.col("p")).alias("tp"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    per = per.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    return per.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def anls(pred: Column, gold: Column, threshold: float = 0.5) -> Column:
    """STAT11: 1 - normalised edit distance of the lower-cased strings if that distance is under the threshold, else 0; 0 for two empty ones."""
    a, b = F.lower(pred), F.lower(gold)
    most = F.greatest(F.length(a), F.length(b))
    nl = F.levenshtein(a, b) / most
    return F.when(most == 0, 0.0).when(nl < threshold, 1 - nl).otherwise(0.0)


def answers_scored(refs: DataFrame, preds: DataFrame) -> DataFrame:
    """JOIN7, STAT11: doc_id, question, anls: the best over gold answers; documents without any prediction are left out, a missing answer is empty.

    refs (doc_id, question, golds array), preds (doc_id, question, pos, answer): of several answers to a question the first counts.
    """
    first = preds.groupBy("doc_id", "question").agg(F.min_by("answer", "pos").alias("answer"))
    asked = refs.join(preds.select("doc_id").distinct(), "doc_id", "left_semi").join(first, ["doc_id", "question"], "left")
    best = F.array_max(F.transform("golds", lambda g: anls(F.coalesce("answer", F.lit("")), g)))
    return asked.select("doc_id", "question", F.coalesce(best, F.lit(0.0)).alias("anls"))


def recognition_errors(df: DataFrame, by: str) -> DataFrame:
    """STAT17, AGG24: word error (share of words that differ) and character error (mean of edit distance / gold length), by group."""
    cer = F.levenshtein("gold", "pred") / F.greatest(F.length("gold"), F.lit(1))
    return df.groupBy(by).agg(F.avg((F.col("gold") != F.col("pred")).cast("double")).alias("wer"), F.avg(cer).alias("cer"), F.count("*").alias("n"))


#: Area ranges, thresholds of IoU and recalls of detection scores; fixed values.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
THRESHOLDS = [0.5 + 0.05 * k for k in range(10)]
RECALLS = np.linspace(0, 1, 101)


def _greedy(iou: np.ndarray, size: np.ndarray, own: np.ndarray, scores: np.ndarray, threshold: float, area: tuple[float, float]) -> tuple[list[tuple[float, bool]], int]:
    """Detections of one image and class, best first, each to the free gold box of largest IoU; what is out of the area range is ignored."""
    ignored = (size < area[0]) | (size > area[1])
    free, out = np.ones(len(size), bool), []
    for row, a, score in zip(iou, own, scores.tolist(), strict=True):
        hit = -1
        for part in (~ignored, ignored):  # gold boxes that count go first
            able = np.where(free & part, row, -1.0)
            if len(able) and able.max() >= min(threshold, 1 - 1e-10):
                hit = int(able.argmax())
                break
        if hit >= 0:
            free[hit] = False
            if not ignored[hit]:
                out.append((score, True))
        elif area[0] <= a <= area[1]:
            out.append((score, False))
    return out, int((~ignored).sum())


def detection_matches(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """STAT15, first part: for each image and class, matches of detections at every threshold, area and limit.

    gold (image_id, label, x0, y0, x2, y2), pred (the same, det, score). Boxes of one image and class meet in one task, which an image bounds.
    """
    cols = ["image_id", "label", "x0", "y0", "x2", "y2", "score", "det", "is_gold"]
    both = gold.withColumns({"score": F.lit(0.0), "det": F.lit(-1), "is_gold": F.lit(True)}).select(*cols).unionByName(pred.withColumn("is_gold", F.lit(False)).select(*cols))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        gt, dt = pdf[pdf["is_gold"]], pdf[~pdf["is_gold"]].sort_values(["score", "det"], ascending=[False, True])
        g, d = gt[["x0", "y0", "x2", "y2"]].to_numpy(float), dt[["x0", "y0", "x2", "y2"]].to_numpy(float)[:100]
        scores = dt["score"].to_numpy(float)[:100]
        size, own = ((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) for b in (g, d))
        w = np.minimum(d[:, None, 2], g[None, :, 2]) - np.maximum(d[:, None, 0], g[None, :, 0])
        h = np.minimum(d[:, None, 3], g[None, :, 3]) - np.maximum(d[:, None, 1], g[None, :, 1])
        inter = np.where((w > 0) & (h > 0), w * h, 0.0)
        iou = inter / np.maximum(size[None, :] + own[:, None] - inter, 1e-12)
        rows: list[tuple] = []
        for name, area in AREAS.items():
            for most in (1, 10, 100) if name == "all" else (100,):  # limits of detections an image are part of the measure
                for t in THRESHOLDS:
                    found, n = _greedy(iou[:most], size, own[:most], scores[:most], t, area)
                    rows.append((label, name, most, round(t, 2), 0.0, False, n))
                    rows += [(label, name, most, round(t, 2), s, hit, 0) for s, hit in found]
        return pd.DataFrame(rows, columns=["label", "area", "most", "threshold", "score", "hit", "n_gold"])

    return both.groupBy("image_id", "label").applyInPandas(match, "label string, area string, most int, threshold double, score double, hit boolean, n_gold bigint")


#: Area, limit and threshold of each way that detections are scored; limits of detections an image are part of the measure.
_WAYS = [(name, most, t) for name in AREAS for most in ((1, 10, 100) if name == "all" else (100,)) for t in THRESHOLDS]
_LEAST, _MOST = (np.array([AREAS[name][k] for name, _, _ in _WAYS]) for k in (0, 1))
_LIMIT, _NEEDED = np.array([most for _, most, _ in _WAYS]), np.array([min(t, 1 - 1e-10) for _, _, t in _WAYS])


def _all_ways(g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_greedy of one image and class in all _WAYS side by side: hits and misses (detection, way), gold boxes that count (way)."""
    size, own = ((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) for b in (g, d))
    counts = (size >= _LEAST[:, None]) & (size <= _MOST[:, None])  # way, gold
    hits, misses = np.zeros((2, len(d), len(_WAYS)), bool)
    inside = (own[:, None] >= _LEAST) & (own[:, None] <= _MOST)
    if not len(g):
        return hits, inside & (np.arange(len(d))[:, None] < _LIMIT), counts.sum(axis=1)
    w = np.minimum(d[:, None, 2], g[None, :, 2]) - np.maximum(d[:, None, 0], g[None, :, 0])
    h = np.minimum(d[:, None, 3], g[None, :, 3]) - np.maximum(d[:, None, 1], g[None, :, 1])
    inter = np.where((w > 0) & (h > 0), w * h, 0.0)
    iou = inter / np.maximum(size[None, :] + own[:, None] - inter, 1e-12)
    free, way, least = np.ones(counts.shape, bool), np.arange(len(_WAYS)), _NEEDED.min()
    for k in range(len(d)):
        able = _LIMIT > k
        if iou[k].max() < least:
            misses[k] = able & inside[k]
            continue
        first, then = (np.where(free & part, iou[k], -1.0) for part in (counts, ~counts))
        a, b = first.argmax(axis=1), then.argmax(axis=1)
        hit = able & (first[way, a] >= _NEEDED)
        put = able & ~hit & (then[way, b] >= _NEEDED)
        free[way[hit], a[hit]] = False
        free[way[put], b[put]] = False
        hits[k], misses[k] = hit, able & ~hit & ~put & inside[k]
    return hits, misses, counts.sum(axis=1)


def _count_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of image, class and then best first: counts by class, score and way; a missing score counts as -1."""
    found: dict[tuple, np.ndarray] = {}  # (label, score): hits and misses; (label, None): gold boxes

    def add(key: tuple, row: np.ndarray) -> None:
        if key in found:
            found[key] += row
        else:
            found[key] = row.astype(np.int64)

    def settle(label, boxes: np.ndarray, scores: np.ndarray, is_gold: np.ndarray) -> None:
        d, s = boxes[~is_gold][:100], scores[~is_gold][:100].tolist()
        hits, misses, n = _all_ways(boxes[is_gold], d)
        add((label, None), np.stack([n, n]))
        for k, score in enumerate(s):
            add((label, -1.0 if math.isnan(score) else score), np.stack([hits[k], misses[k]]))

    def rows() -> pa.RecordBatch:
        keys, times = list(found), len(_WAYS)
        columns = [pa.array([x for x in column for _ in range(times)], kind) for column, kind in (([k[0] for k in keys], pa.string()), ([k[1] for k in keys], pa.float64()))]
        area, most, t = zip(*_WAYS)
        columns += [pa.array(list(area) * len(keys)), pa.array(np.tile(np.array(most, np.int32), len(keys))), pa.array(np.tile(np.round(t, 2), len(keys)))]
        columns += [pa.array(np.concatenate([found[k][side] for k in keys])) for side in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["label", "score", "area", "most", "threshold", "h", "f"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        label, is_gold, score = (table[c].to_numpy(zero_copy_only=False) for c in ("label", "is_gold", "score"))
        image = pc.dictionary_encode(table["image_id"].combine_chunks(), null_encoding="encode").indices.to_numpy()  # a null id is one image
        boxes = np.stack([table[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x2", "y2")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (label[1:] != label[:-1])]))
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            settle(label[lo], boxes[lo:hi], score[lo:hi], is_gold[lo:hi])
        held = table.slice(int(starts[-1]))  # the last group may go on in the next batch
        if len(found) > 4096:
            yield rows()
            found.clear()
    if held is not None:
        settle(held["label"][0].as_py(), np.stack([held[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x2", "y2")], 1), held["score"].to_numpy(zero_copy_only=False), held["is_gold"].to_numpy(zero_copy_only=False))
        yield rows()


def detection_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """STAT15: label, area, most, threshold, score, h, f: hits and misses of detections by score; without a score, h is the number of gold boxes.

    The same matches as detection_matches, counted where they are found.
    """
    cols = ["image_id", "label", "x0", "y0", "x2", "y2", "score", "det", "is_gold"]
    both = gold.withColumns({"score": F.lit(0.0), "det": F.lit(-1), "is_gold": F.lit(True)}).select(*cols).unionByName(pred.withColumn("is_gold", F.lit(False)).select(*cols))
    both = both.withColumn("score", F.col("score").cast("double")).repartition("image_id", "label").sortWithinPartitions("image_id", "label", F.desc("score"), "det")
    return both.mapInArrow(_count_ways, "label string, score double, area string, most int, threshold double, h bigint, f bigint")


def detection_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """STAT15: area, most, ap, ap50, ap75, ar: precision at 101 recalls under its envelope, means over classes and thresholds, all classes scored.

    Precision and recall run along the scores in a window; equal scores share the values of the last of them.
    """
    group = ["label", "area", "most", "threshold"]
    m = detection_counts(gold, pred).groupBy(*group, "score").agg(F.sum("h").alias("h"), F.sum("f").alias("f"))
    of = lambda gold_boxes: F.coalesce(F.sum(F.when(F.col("score").isNull() if gold_boxes else F.col("score").isNotNull(), F.col("h"))), F.lit(0))
    totals = m.groupBy(*group).agg(of(True).alias("n"), of(False).alias("hits")).filter("n > 0")
    steps = m.filter("score is not null")
    down = Window.partitionBy(*group).orderBy(F.desc("score"))
    curve = steps.filter("h + f > 0 and score > 0").withColumn("tp", F.sum("h").over(down)).withColumn("fp", F.sum("f").over(down)).join(totals, group)
    curve = curve.withColumn("recall", F.col("tp") / F.col("n")).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    up = Window.partitionBy(*group).orderBy("score")
    curve = curve.withColumn("envelope", F.max("precision").over(up)).withColumn("before", F.coalesce(F.lag("recall").over(down), F.lit(-1.0)))
    # the recalls of 0, 0.01, ..., 1 that this step is the first to reach
    reached = F.floor(F.col("recall") * 100 + 1e-9) - F.when(F.col("before") < 0, F.lit(-1)).otherwise(F.floor(F.col("before") * 100 + 1e-9))
    area = curve.groupBy(*group).agg((F.sum(F.col("envelope") * reached) / 101).alias("ap"))
    scored = totals.join(area, group, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))).withColumn("ar", F.col("hits") / F.col("n"))
    at = lambda t: F.avg(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    return scored.groupBy("area", "most").agg(F.avg("ap").alias("ap"), at(0.5).alias("ap50"), at(0.75).alias("ap75"), F.avg("ar").alias("ar"))


def iou_pairs(gold: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """image_id, label, gold_no, det, iou of overlapping boxes of one image and class."""
    g = gold.select("image_id", "label", "gold_no", G.box("x0", "y0", "x2", "y2").alias("g"))
    p = pred.select("image_id", "label", "det", G.box("x0", "y0", "x2", "y2").alias("p"))
    return g.join(p, ["image_id", "label"]).withColumn("iou", G.iou(F.col("g"), F.col("p"))).filter(F.col("iou") >= least).drop("g", "p")




def answer_coverage(questions: DataFrame, by: str) -> DataFrame:
    """AGG27: of each ``by``: questions, questions with an extractable answer, mean of the best ANLS of extracted and gold answers.

    questions (words, starts, ends, golds arrays): an answer is the words from start to end, both included; -1 is none.
    """
    spans = F.filter(F.arrays_zip("starts", "ends"), lambda s: (s["starts"] != -1) & (s["ends"] != -1))
    found = F.transform(spans, lambda s: F.array_join(F.slice("words", s["starts"] + 1, F.greatest(s["ends"] - s["starts"] + 1, F.lit(0))), " "))
    best = F.array_max(F.flatten(F.transform("found", lambda a: F.transform("golds", lambda g: anls(a, g)))))
    scored = questions.withColumn("found", F.coalesce(found, F.array().cast("array<string>"))).withColumn("best", F.coalesce(best, F.lit(0.0)))
    return scored.groupBy(by).agg(F.count("*").alias("n_questions"), F.count_if(F.size("found") > 0).alias("n_found"), F.avg("best").alias("anls"))
