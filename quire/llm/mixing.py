"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the rate at which each of its documents is wanted: its whole part is copies of every document, the rest a
probability. Probabilities are made whole in pairs: mass (probability times words) goes from one document to its partner, in the
direction that a coin with fair odds says, until one of the two is whole. The partner of a document is all the shorter ones of its group together,
each giving or getting its share, so a document that is longer than many others together is made whole first, and what is left
at last is a short one. Expectations and the source's total of words are kept, so all that a source can miss of its target is the last residual.

Documents are dealt by a hash into groups of bounded size within their source; each group leaves at most one residual, and residuals meet
in a reduction tree of groups of FAN until each source has one, which its own coin rounds. A source with a third of all documents has more groups, not a
larger one. All coins come from hashes of id, text and
source: they don't depend on files, partitions or cores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _common as C

#: Documents in a leaf of the reduction tree, about; residuals in an inner node.
LEAF, FAN = 8192, 1024
#: Sources whose targets are broadcast; beyond it they are joined by shuffling.
BROADCAST_SOURCES = 100_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row, key (a hash of id, text and source), source, size (words of the whole text, 0 for null)."""
    count = F.regexp_count(C.text_of(text_col), F.lit(C.WORD_PATTERN)).cast("bigint")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), key_of(id_col, text_col, source_col).alias("key"), F.col(source_col).cast("string").alias("source"), count.alias("size")
    )


def key_of(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")), C.text_of(text_col))


def numbered(table: DataFrame) -> DataFrame:
    """A materialized sizes() table with keys of its own for rows that repeat: the occurrence counts too (such rows are alike, so any order will do)."""
    twice = table.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    if twice.isEmpty():
        return table
    again = table.join(twice, "key", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("row")))
    again = again.withColumn("key", F.when(F.col("nth") == 1, F.col("key")).otherwise(F.xxhash64("key", "nth"))).drop("nth")
    return table.join(twice, "key", "left_anti").select(*table.columns).unionByName(again.select(*table.columns))


def targets(table: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, docs, source_size, target: shares of all words by weight, none above ``most`` times its source.

    Sources in order of code points, null last, take the weights in turn. What a capped source can't take is shared by weight
    among the others, until none is above its cap: with sources in order of size / weight, the level is the first at which
    the uncapped fit under their caps. One row a source, so these windows see sources, not documents.
    """
    per = table.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per.withColumn("weight", F.element_at(cycle, (turn % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    all_of = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(all_of) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = rest / (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    tried = weighed.withColumn("nth", F.row_number().over(order)).withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    # the first in order that fits under its cap gives the level of all that are not capped
    final = tried.withColumn("level", F.min(F.when(F.col("fits"), F.struct("nth", "level"))).over(all_of)["level"])
    target = F.least(most * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), most * F.col("source_size")))
    return final.select("source", "docs", "source_size", target.cast("double").alias("target"))


def _unit(seed: int, level: int, row: np.ndarray) -> np.ndarray:
    """Reproducible uniforms from ids by a 64-bit mix."""
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + level * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivotal(p: list[float], mass: list[int], u: list[float]) -> int:
    """Round probabilities in place along the list; the index of the one left fractional, or -1.

    In each step words go between a document and the rest of the list, its pool, whose members give or get in proportion to p (1 - p): as much as makes one
    of them all whole, one way or the other, with odds that keep every expectation. So there are no more steps than probabilities.
    """
    x = np.array(p, float)
    at = np.flatnonzero((x > 0.0) & (x < 1.0))
    now, words, step = x[at], np.array(mass, float)[at], 0
    while len(now) > 1:
        a, own, pool = words[0], now[0], now[1:]
        shares = pool * (1.0 - pool)
        all_of = float(words[1:] @ shares)
        up = min((1.0 - own) * a, all_of / (1.0 - pool.min()))  # words that can go to it
        down = min(own * a, all_of / pool.max())  # and from it
        moved = up if u[step] * (up + down) < down else -down
        step += 1
        now = np.concatenate([[own + moved / a], pool - moved / all_of * shares])
        edge = np.minimum(now, 1.0 - now)
        done = edge < max(1e-9, float(edge.min()))
        if not done.any():
            done[edge.argmin()] = True
        x[at[done]] = np.rint(now[done])
        at, now, words = at[~done], now[~done], words[~done]
    x[at] = now
    p[:] = x.tolist()
    return int(at[0]) if len(at) else -1


ROUND_SCHEMA = "row bigint, key bigint, source string, size bigint, p double, n_groups bigint, done boolean"


def _round_group(seed: int, level: int):
    def run(table: pa.Table) -> pa.Table:
        key, size, p = (table.column(c).to_numpy().copy() for c in ("key", "size", "p"))
        order = np.lexsort((key, _unit(seed, 3 * level, key), -size))
        probabilities = p[order].tolist()
        left = pivotal(probabilities, size[order].tolist(), _unit(seed, 3 * level + 1, key)[order].tolist())
        done = np.ones(len(key), bool)
        if left >= 0:
            at = order[left]
            if table.column("n_groups")[0].as_py() == 1:  # the last residual of a source
                probabilities[left] = float(_unit(seed, 3 * level + 2, key[at : at + 1])[0] < probabilities[left])
            else:
                done[at] = False
        p[order] = probabilities
        return table.select(["row", "key", "source", "size"]).append_column("p", pa.array(p)).append_column("n_groups", table.column("n_groups")).append_column("done", pa.array(done))

    return run


def mix(table: DataFrame, target_table: DataFrame, seed: int = 1) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies for each row of a materialized sizes() table.

    Every document of a source at rate r has floor(r) or ceil(r) copies, with the expectation r; empty documents have floor(r). Reruns agree, on any
    number of cores: coins come from the rows' keys. No rows give no rows.
    """
    table = numbered(table)
    target_table = C.materialize(target_table, "targets")
    n_sources = target_table.count()
    rates = target_table.select(F.col("source").alias("of"), "docs", "source_size", "target")
    rates = F.broadcast(rates) if n_sources <= BROADCAST_SOURCES else rates
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = table.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate))
    rated = rated.select("row", "key", "doc_id", "source", "size", "source_size", "target", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), F.ceil(F.col("docs") / LEAF).alias("n_groups"))
    open_rows = rated.filter("size > 0 and p > 0").select("row", "key", "source", "size", "p", "n_groups")
    level, decided = 0, []
    groups = (target_table.agg(F.max("docs")).first()[0] or 1) // LEAF + 1
    while True:
        keyed = open_rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(level)), F.col("n_groups")))
        rounded = C.materialize(keyed.groupBy("source", "part", "n_groups").applyInArrow(_round_group(seed, level), ROUND_SCHEMA), "rounded")
        decided.append(rounded.filter("done"))
        if groups <= 1:
            break
        left = rounded.filter("not done")
        groups, level = -(-groups // FAN), level + 1
        open_rows = left.select("row", "key", "source", "size", "p", F.ceil(F.col("n_groups") / FAN).alias("n_groups"))
    chosen = decided[0]
    for more in decided[1:]:
        chosen = chosen.unionByName(more)
    # half of the corpus: never broadcast, whatever its estimated size
    chosen = chosen.filter("p >= 0.5").select(F.col("row").alias("chosen_row"))
    joined = rated.join(chosen.hint("merge"), F.col("row") == F.col("chosen_row"), "left")
    copies = F.col("whole") + F.when(F.col("chosen_row").isNotNull(), 1).otherwise(0)
    return joined.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 1) -> DataFrame:
    """Sizes, targets and copies of all documents: doc_id, row, source, size, source_size, target, copies."""
    table = C.materialize(sizes(docs, id_col, text_col, source_col), "sizes")
    return mix(table, targets(table, weights, most), seed)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 1) -> DataFrame:
    """The mixed documents themselves: each as often as it has copies, all columns unchanged.

    Copies belong to rows by id, text and source; what rows have that share all three is dealt out among them in the order of their other columns. Null
    ids, texts and sources are values like others, a null text has no words. An empty table gives no rows.
    """
    table = C.materialize(sizes(docs, id_col, text_col, source_col), "sizes")
    copies = mix(table, targets(table, weights, most), seed)
    nth, own, key, at, n, each = (C.fresh(docs, c) for c in ("q_nth", "q_own", "q_key", "q_at", "q_copies", "q_each"))
    marked = docs.withColumn(own, key_of(id_col, text_col, source_col))
    plan = copies.join(table.select("row", F.col("key").alias("first_key")).hint("merge"), "row")
    if table.groupBy("key").count().filter("count > 1").isEmpty():
        joined = marked.join(plan.filter("copies > 0").select(F.col("first_key").alias(key), F.col("copies").alias(n)).hint("merge"), F.col(own) == F.col(key))
    else:
        plan = plan.withColumn("at", F.row_number().over(Window.partitionBy("first_key").orderBy(F.desc("copies")))).filter("copies > 0")
        plan = plan.select(F.col("first_key").alias(key), F.col("copies").alias(n), F.col("at").alias(at))
        ranked = marked.withColumn(nth, F.row_number().over(Window.partitionBy(own).orderBy(*C.by_content(docs))))
        joined = ranked.join(plan.hint("merge"), (F.col(own) == F.col(key)) & (F.col(nth) == F.col(at))).drop(nth, at)
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(own, key, n, each)
