"""Ground-truth verification: fuzzy spans, phrases, tags of entity spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import collapse_spaces
from quire.operators.labels import let

#: A span whose similarity is at least this is found.
CUT_OFF = 0.75


def window_distances(text: str, pattern: str) -> np.ndarray:
    """Edit distances of a pattern to all windows of its length in a text, row by row of the table for all windows at once."""
    t = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    p = np.frombuffer(pattern.encode("utf-32-le", "surrogatepass"), np.uint32)
    m, out = len(p), []
    step = np.arange(m + 1, dtype=np.int32)
    for lo in range(0, len(t) - m + 1, 4096):
        windows = np.lib.stride_tricks.sliding_window_view(t[lo : lo + 4096 + m - 1], m)
        row = np.broadcast_to(step, (len(windows), m + 1)).copy()
        for j, c in enumerate(p):
            new = np.empty_like(row)
            new[:, 0] = j + 1
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != c), out=new[:, 1:])
            row = np.minimum.accumulate(new - step, axis=1) + step  # insertions: each cell from the least before it
        out.append(row[:, m])
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _ranges(starts: np.ndarray, ends: np.ndarray, allowed: list[int]) -> list[tuple[int, int]]:
    """Stretches of text of allowed words: words that follow each other are one, from the first's start to the last's space."""
    out: list[tuple[int, int]] = []
    for k in sorted({k for k in allowed if 0 <= k < len(starts)}):
        if out and out[-1][1] + 1 == starts[k]:
            out[-1] = (out[-1][0], int(ends[k]))
        else:
            out.append((int(starts[k]), int(ends[k])))
    return out


def _best_window(text: str, pattern: str, ranges: list[tuple[int, int]] | None) -> tuple[int, int] | None:
    """The least distance and the first window that has it; an occurrence is found by search."""
    if not pattern or len(pattern) > len(text):
        return None
    if ranges is None:
        at = text.find(pattern)
        if at >= 0:
            return 0, at
        ranges = [(0, len(text) - 1)]
    best = None
    for lo, hi in ranges:
        d = window_distances(text[lo : min(hi, len(text) - 1) + 1], pattern)
        if len(d) and (best is None or d.min() < best[0]):
            best = (int(d.min()), lo + int(d.argmin()))
    return best


def _span_finder(cut_off: float):
    def find(words: pd.Series, text: pd.Series, pattern: pd.Series, allowed: pd.Series) -> pd.DataFrame:
        out = []
        for w, t, p, may in zip(words, text, pattern, allowed, strict=True):
            sizes = np.fromiter(map(len, w), np.int64, len(w))
            ends = np.cumsum(sizes + 1) - 1  # the place of the space after each word
            starts = ends - sizes
            best = _best_window(t, p, None if may is None else _ranges(starts, ends, list(may)))
            touched: list[int] = []
            if best and 1 - best[0] / len(p) >= cut_off:
                near = np.flatnonzero(~(ends < best[1]) & ~(starts > best[1] + len(p)))
                touched = near.tolist() if may is None else sorted(set(near.tolist()) & set(may))
            out.append((*(best or (None, None)), touched))
        df = pd.DataFrame(out, columns=["d", "i", "indices"])
        return df.astype({"d": "Int32", "i": "Int32"})

    return find


def fuzzy_spans(docs: DataFrame, cut_off: float = CUT_OFF, restricted: bool = False) -> DataFrame:
    """STR2, STR3: the best window for each (doc_id, pattern_id, words, pattern[, allowed]).

    The text is all words, each followed by a space; windows have the length of the pattern and go over the text with its white space
    normalised. Similarity is 1 - edit distance / length, the earliest best wins. Returned are the window as it is in the text, its
    similarity (-1 for an empty pattern or one longer than the text), whether it is found, and then the indices of the words that it touches.
    ``restricted`` looks only at windows all of whose characters are in words of ``allowed`` (null: no restriction).
    Distances of all windows of a row are computed side by side in an Arrow function; no window becomes a row.
    """
    text = F.array_join(F.transform("words", lambda w: F.concat(w, F.lit(" "))), "")
    df = docs.withColumn("clean", collapse_spaces(text)).withColumn("pat", F.lower(collapse_spaces(F.coalesce("pattern", F.lit("")))))
    allowed = F.col("allowed") if restricted else F.lit(None).cast("array<int>")
    find = F.pandas_udf(_span_finder(cut_off), "struct<d:int,i:int,indices:array<int>>")
    df = df.withColumn("best", find("words", F.lower("clean"), "pat", allowed)).withColumn("m", F.length("pat"))
    score = F.coalesce(1 - F.col("best.d") / F.col("m"), F.lit(-1.0))
    window = F.coalesce(F.substring(F.col("clean"), F.col("best.i") + 1, F.col("m")), F.lit(""))
    return df.select("doc_id", "pattern_id", window.alias("span"), score.alias("score"), (score >= cut_off).alias("found"), F.col("best.indices").alias("indices"))


def phrase_index(words: Column, phrase: Column, start: int = 0) -> Column:
    """ARR2: the first index from ``start`` at which the words of a phrase stand in a row, or null."""

    def find(s: Column) -> Column:
        n = F.size(s["p"])
        first = F.get(s["p"], F.lit(0))
        places = F.filter(F.transform(s["w"], lambda w, i: F.when((w == first) & (i >= start), i)), lambda i: i.isNotNull())
        return F.when(n > 0, F.get(F.filter(places, lambda i: F.slice(s["w"], i + 1, n) == s["p"]), F.lit(0)))

    return let(F.struct(words.alias("w"), phrase.alias("p")), find)


def bio_tags(words: DataFrame, spans: DataFrame) -> DataFrame:
    """ARR5: doc_id, idx, tag of every word: B- on the first and I- on the other indices of each entity (doc_id, key_order, label, indices).

    Entities that come later overwrite tags; words in no entity have O.
    """
    exploded = spans.select("doc_id", "key_order", "label", F.posexplode("indices").alias("pos", "idx"))
    tag = F.concat(F.when(F.col("pos") == 0, "B-").otherwise("I-"), F.col("label"))
    last = exploded.groupBy("doc_id", "idx").agg(F.max_by(tag, F.struct("key_order", "pos")).alias("tag"))
    return words.select("doc_id", "idx").join(last, ["doc_id", "idx"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def tag_islands(tags: DataFrame) -> DataFrame:
    """WIN4: island number of each tagged word: a new one at B- and where the type changes; an I- without its B- belongs to none (null)."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    kind = F.substring("tag", 3, 1000)
    typed = tags.withColumn("kind", F.when(F.col("tag") != "O", kind)).withColumn("before", F.lag("kind").over(order)).withColumn("begins", F.substring("tag", 1, 2) == "B-")
    broken = typed.withColumn("cut", F.col("begins") | ~F.col("kind").eqNullSafe(F.col("before")))
    numbered = broken.withColumn("island", F.sum(F.col("cut").cast("int")).over(order))
    led = F.first("begins").over(Window.partitionBy("doc_id", "island").orderBy("idx"))
    return numbered.withColumn("island", F.when(F.col("kind").isNotNull() & led, F.col("island"))).drop("before", "begins", "cut")


def tag_spans(tags: DataFrame) -> DataFrame:
    """AGG26: doc_id, label, first, last of each entity; ``tags`` with a word column adds the joined words."""
    islands = tag_islands(tags).filter("island is not null")
    more = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda s: s["word"]), " ").alias("text")] if "word" in tags.columns else []
    return islands.groupBy("doc_id", "island").agg(F.first("kind").alias("label"), F.min("idx").alias("first"), F.max("idx").alias("last"), *more).drop("island")
