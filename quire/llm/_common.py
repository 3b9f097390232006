"""Shared helpers: scratch tables in the cluster's shared folder, collision-free column names, text splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ascii_lower_bytes(text: str, lower: bool = True) -> bytes:
    """UTF-8 of a text, A-Z in lower case if asked: bytes.lower() and bytes.split() know ASCII only, as wanted here."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.lower() if lower else raw


def split_words(text: str, lower: bool = False) -> list[bytes]:
    """The words of a text by WORD_PATTERN, in UTF-8."""
    return ascii_lower_bytes(text, lower).split()


def shared_folder(spark: SparkSession) -> str:
    """The session's folder in ``spark.checkpoint.dir``; it goes when the session's JVM ends.

    The setting is read from the session. Only a local session without one gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_quire_scratch", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="quire-")
            spark.sparkContext._quire_scratch = base
            spark.sparkContext.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/quire-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Remove the files behind a table of materialize() once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have, in any case."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def by_content(df: DataFrame) -> list[Column]:
    """An order of rows by what they hold, so that which one of some equal rows stays is the same on a retry: a hash of all columns without maps."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return [F.xxhash64(*plain)] if plain else [F.lit(1)]


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's decimal text, modulo a number; -1 for null, so that null ids are never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1).cast("bigint"))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tune(spark: SparkSession) -> None:
    """Arrow batches for long texts: 2000 rows unless the session has a setting of its own (10000 rows of text are a lot of memory for a worker)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "2000")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_large_cells(cells: DataFrame, point: str | list[str], block: int) -> DataFrame:
    """``cells`` (cell bigint, point columns) with cells over ``block`` rows cut into pairs of blocks, each a cell of its own.

    A row goes to every pair that its block makes, itself included, so each pair of rows of a cell meets in at least one.
    """
    large = materialize(cells.groupBy("cell").agg(F.count("*").alias("q_count")).filter(F.col("q_count") > block), "large")
    n_large = large.count()
    if not n_large:
        return cells
    marked = cells.join(F.broadcast(large) if n_large <= 10_000 else large, "cell", "left")
    blocks = F.ceil(F.coalesce("q_count", F.lit(1)) / block).cast("int")
    own = F.pmod(F.xxhash64(*([point] if isinstance(point, str) else point), F.lit(3)), blocks).cast("int")
    pairs = marked.withColumn("q_own", own).withColumn("q_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    named = F.when(F.col("q_count").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("q_own", "q_other"), F.greatest("q_own", "q_other")))
    return pairs.withColumn("cell", named).select(*cells.columns)


class Stars:
    """Links joined to stars: union-find over the numbers that have links."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.up.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def rows(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.up]


def join_cell(stars: Stars, values: np.ndarray, pairs) -> None:
    """Add the components of one cell: ``pairs`` yields arrays of linked places (p, q). Each place joins the least that it reaches, so n of them are
    n steps in Python at most, however many links they have: links are merged by whole arrays, minima first, then jumps."""
    n = len(values)
    labels = np.arange(n)
    for p, q in pairs:
        while True:
            a, b = labels[p], labels[q]
            apart = a != b
            if not apart.any():
                break
            up = np.arange(n)
            np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (up[up] != up).any():
                up = up[up]
            labels = up[labels]
    moved = np.flatnonzero(labels != np.arange(n))
    for x, y in zip(values[moved].tolist(), values[labels[moved]].tolist(), strict=True):
        stars.join(x, y)
