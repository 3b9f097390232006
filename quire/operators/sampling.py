"""Reproducible sampling and splitting: every draw is a number made from keys by MD5, the same in any engine and in any order of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import uniform


def cluster_pool(docs: DataFrame, pool: int, seed: int = 42) -> DataFrame:
    """SAMP1: a pool of documents (doc_id, cluster): all if ``pool`` is -1 or their number and more.

    Otherwise one random member of each cluster, and the rest drawn without replacement with weights of the sizes of clusters (by the
    exponential race: the least -ln(u) / w win). A pool of at most the number of clusters has the guaranteed members only.
    """
    if pool == -1 or docs.count() <= pool:
        return docs.select("doc_id", "cluster")
    drawn = docs.select("doc_id", "cluster", uniform("doc_id", salt="member", seed=seed).alias("u1"), uniform("doc_id", salt="pool", seed=seed).alias("u2"))
    sure = drawn.groupBy("cluster").agg(F.min(F.struct("u1", "doc_id")).alias("m")).select(F.col("m.doc_id").alias("doc_id"), "cluster")
    n_sure = sure.count()
    if n_sure >= pool:
        return sure
    sizes = docs.groupBy("cluster").agg(F.count("*").alias("size"))
    race = drawn.join(sure.select("doc_id"), "doc_id", "left_anti").join(F.broadcast(sizes), "cluster")
    rest = race.withColumn("key", -F.ln(1 - F.col("u2")) / F.col("size")).orderBy("key", "doc_id").limit(pool - n_sure)
    return sure.unionByName(rest.select("doc_id", "cluster"))


def cluster_odds(docs: DataFrame, alpha: float) -> DataFrame:
    """SAMP2: cluster, size, p and the interval [lo, hi) of each cluster: p is proportional to size ** alpha. One row a cluster."""
    sizes = docs.groupBy("cluster").agg(F.count("*").alias("size")).withColumn("w", F.pow(F.col("size").cast("double"), F.lit(float(alpha))))
    order, everything = Window.orderBy("cluster"), Window.partitionBy()
    hi = F.sum("w").over(order) / F.sum("w").over(everything)
    out = sizes.withColumn("p", F.col("w") / F.sum("w").over(everything)).withColumn("hi", hi)
    out = out.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    top = F.when(F.row_number().over(Window.orderBy(F.desc("cluster"))) == 1, F.lit(2.0)).otherwise(F.col("hi"))  # the last takes what rounding leaves
    return out.withColumn("hi", top).drop("w")


def seed_table(docs: DataFrame, runs: int, slots: int, alpha: float, one_cluster_a_run: bool = False, seed: int = 42) -> DataFrame:
    """SAMP2, SAMP3, SAMP4: run, slot, doc_id, cluster: each slot (or each run) draws a cluster, then a member with replacement."""
    spark = docs.sparkSession
    odds = F.broadcast(cluster_odds(docs, alpha))
    grid = spark.range(runs).select(F.col("id").cast("int").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    draw = uniform("run", salt="cluster", seed=seed) if one_cluster_a_run else uniform("run", "slot", salt="cluster", seed=seed)
    drawn = grid.withColumn("u", draw).withColumn("v", uniform("run", "slot", salt="member", seed=seed))
    chosen = drawn.join(odds, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).withColumn("nth", F.floor(F.col("v") * F.col("size")).cast("int"))
    members = docs.select("cluster", "doc_id", (F.row_number().over(Window.partitionBy("cluster").orderBy("doc_id")) - 1).alias("nth"))
    return chosen.select("run", "slot", "cluster", "nth").join(members, ["cluster", "nth"]).select("run", "slot", "doc_id", "cluster")


def runs_needed(documents: int, solutions: int) -> int:
    """SAMP5."""
    return math.ceil(documents / solutions)


def random_subset(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """SAMP6: the first n rows of a random order; all rows if there are fewer."""
    return df.orderBy(uniform(id_col, salt="subset", seed=seed), id_col).limit(n)


def equal_sizes(a: DataFrame, b: DataFrame, id_col: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """SAMP7: the larger side cut at random to the size of the smaller."""
    n, m = a.count(), b.count()
    return (random_subset(a, m, id_col, seed), b) if n > m else (a, random_subset(b, n, id_col, seed)) if m > n else (a, b)


def split(df: DataFrame, ratio: float, id_col: str, shuffled: bool = True, seed: int = 42) -> DataFrame:
    """SAMP8, SAMP9: a split column: train for n - ceil(n * (1 - ratio)) rows in random (or id) order, validation for the rest.

    The border is the row of that rank, found by a sort without windows over all rows; both parts are disjoint and together whole.
    """
    n = df.count()
    k = n - math.ceil(n * (1 - ratio) - 1e-9)
    key = F.struct(uniform(id_col, salt="split", seed=seed).alias("u"), F.col(id_col).alias("i")) if shuffled else F.struct(F.lit(0.0).alias("u"), F.col(id_col).alias("i"))
    keyed = df.withColumn("q_key", key)
    if k <= 0 or k >= n:
        return keyed.drop("q_key").withColumn("split", F.lit("validation" if k <= 0 else "train"))
    border = keyed.select("q_key").orderBy("q_key").offset(k).limit(1)
    return keyed.join(F.broadcast(border.withColumnRenamed("q_key", "q_border"))).withColumn("split", F.when(F.col("q_key") < F.col("q_border"), "train").otherwise("validation")).drop("q_key", "q_border")


def pick(options: Column, *key: str, salt: str, seed: int = 42) -> Column:
    """SAMP11, SAMP12: one of an array of options, the same for the same key."""
    return F.get(options, F.floor(uniform(*key, salt=salt, seed=seed) * F.size(options)).cast("int"))
