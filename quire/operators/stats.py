"""Statistics of distributions: divergences, spatial differences, co-occurrence, empirical distributions, scaling and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.order import running_sum


def joined_counts(real: DataFrame, synthetic: DataFrame, key: str) -> DataFrame:
    """JOIN14: key, r, s: counts of classes on both sides, 0 where absent."""
    a = real.groupBy(key).agg(F.count("*").alias("r"))
    b = synthetic.groupBy(key).agg(F.count("*").alias("s"))
    return a.join(b, key, "full").select(key, F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("s", F.lit(0)).alias("s"))


def divergences(counts: DataFrame) -> DataFrame:
    """STAT5: Jensen-Shannon distance (the root, natural logarithm) and KL(real | synthetic), infinite where a real class is not synthetic."""
    w = Window.partitionBy()
    pq = counts.select((F.col("r") / F.sum("r").over(w)).alias("p"), (F.col("s") / F.sum("s").over(w)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda a, b: F.when(F.col(a) > 0, F.col(a) * F.ln(F.col(a) / F.col(b))).otherwise(0.0)
    kl = F.when(F.max((F.col("p") > 0) & (F.col("q") == 0)), F.lit(float("inf"))).otherwise(F.sum(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("p") * F.ln(F.col("p") / F.col("q"))).otherwise(0.0)))
    return pq.agg(F.sqrt((F.sum(term("p", "m")) + F.sum(term("q", "m"))) / 2).alias("js"), kl.alias("kl"))


def spatial(boxes: DataFrame, key: str) -> DataFrame:
    """Centroid and spread (population) of the box centres of each class."""
    x, y = (F.col("x0") + F.col("x2")) / 2, (F.col("y0") + F.col("y2")) / 2
    return boxes.groupBy(key).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))


def spatial_difference(real: DataFrame, synthetic: DataFrame, key: str) -> DataFrame:
    """STAT6, JOIN15: distance of centroids and differences of spread of the classes that both have."""
    a, b = spatial(real, key), spatial(synthetic, key)
    j = a.alias("a").join(b.alias("b"), key)
    d = F.sqrt(F.pow(F.col("a.cx") - F.col("b.cx"), 2) + F.pow(F.col("a.cy") - F.col("b.cy"), 2))
    return j.select(key, d.alias("centroid_distance"), F.abs(F.col("a.sx") - F.col("b.sx")).alias("spread_x"), F.abs(F.col("a.sy") - F.col("b.sy")).alias("spread_y"))


def co_occurrence(items: DataFrame, group: str, key: str) -> DataFrame:
    """AGG21: a, b, n, share of each ordered pair of different classes that a group has, from pairs within the distinct classes of each group.

    The classes of a group are a set in one row; the number of classes, not of rows, bounds it.
    """
    sets = items.groupBy(group).agg(F.array_sort(F.collect_set(key)).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice(F.col("ks"), i + 2, F.size("ks")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counted = sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    both = counted.unionByName(counted.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def histogram(df: DataFrame, key: str) -> DataFrame:
    """AGG14 to AGG16: count and share of each value."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def empirical_distribution(df: DataFrame, value: str) -> DataFrame:
    """STAT7: value and the share of rows up to it, one row a distinct value (of equal values the last, as i / n of sorted values).

    Counts are by value before any order is taken, and the order is taken by ranges of values, side by side.
    """
    there = df.filter(F.col(value).isNotNull())
    counts = there.groupBy(value).agg(F.count("*").alias("n"))
    total = there.agg(F.count("*").alias("total"))
    return running_sum(counts, F.col(value), F.col("n"), "upto", there).join(F.broadcast(total)).select(value, "n", (F.col("upto") / F.col("total")).alias("share"))


def min_max(column: str, *by: str, flip: bool = False) -> Column:
    """STAT18: (x - min) / (max - min) within groups, 0 for a constant; flipped for measures that should be small."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    scaled = F.when(hi == lo, 0.0).otherwise((F.col(column) - lo) / (hi - lo))
    return 1 - scaled if flip else scaled


def best_configs(metrics: DataFrame, by: str, config: str, up: list[str], down: list[str], n: int, scaled: bool) -> DataFrame:
    """WIN2, SORT1: the n configurations of each group with the highest mean of measures (min-max scaled or raw; ``down`` ones as 1 - x)."""
    parts = [min_max(c, by) if scaled else F.col(c) for c in up] + [min_max(c, by, flip=True) if scaled else 1 - F.col(c) for c in down]
    score = sum(parts[1:], parts[0]) / len(parts)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("final_score", 9)), config))  # sums in another order may differ in the last digits
    return metrics.withColumn("final_score", score).withColumn("nth", nth).filter(F.col("nth") <= n)


def rank_points(metrics: DataFrame, by: str, config: str, value: str, n: int) -> DataFrame:
    """WIN1, AGG20: points n, n - 1, ... for the n best of each group, summed by configuration and ranked."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), config))
    points = metrics.withColumn("points", n - (nth - 1)).filter("points > 0").groupBy(config).agg(F.sum("points").alias("points"))
    return points.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("points"), config)))


def otsu(histogram_of: DataFrame) -> DataFrame:
    """GEO18: id, threshold of each histogram (id, bin, n): the first bin of largest between-class variance.

    Variances are compared to six digits, halves away from zero: mirrored histograms have equal ones that differ in the last bits of a double.
    """
    w = Window.partitionBy("id").orderBy("bin")
    everything = Window.partitionBy("id")
    df = histogram_of.select("id", "bin", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"), F.sum("n").over(everything).alias("t"), F.sum(F.col("n") * F.col("bin")).over(everything).alias("s"))
    w1 = F.col("t") - F.col("w0")
    mean = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    df = df.withColumn("v", F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") * w1 * mean * mean))
    digits = F.col("v") * 1e6
    whole = F.rint(digits) - F.when(F.rint(digits) > digits, 1.0).otherwise(0.0)  # F.floor has the bounds of a bigint
    df = df.withColumn("v", (whole + F.when(digits - whole >= 0.5, 1.0).otherwise(0.0)) / 1e6)
    return df.groupBy("id").agg(F.max_by("bin", F.when(F.col("v").isNotNull(), F.struct("v", -F.col("bin")))).alias("threshold"))
