"""Sinks: shards by split, tables named by a hash of their parameters, upserts and additive logs, checked embedding tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """SNK1: records partitioned by split; an existing table stays unless it is to be overwritten."""
    df.write.mode("overwrite" if overwrite else "ignore").partitionBy("split").parquet(path)


def parameter_hash(parameters: dict) -> str:
    """JSN5, SNK2: eight hex digits of the parameters in order of their names."""
    return hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:8]


def materialise(df: DataFrame, transform, root: str, task: str, **parameters) -> DataFrame:
    """SNK2: the transformed table, written once under a name made of task and parameters."""
    path = f"{root}/dataset-{task}-{parameter_hash(parameters)}"
    write_records(df.transform(transform, **parameters), path)
    return df.sparkSession.read.parquet(path)


def merged_log(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """SNK4: additive update: values of the new log where it has them, else of the old; keys of both."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("n", new), ("o", old)) if c in df.columns]).alias(c)
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[pick(c) for c in columns])


def row_hash(*columns: str) -> Column:
    """SNK9: a key for a configuration row: MD5 of its values under their names."""
    return F.md5(F.to_json(F.struct(*sorted(columns))).cast("binary"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK9: rows of the new table, and of the old those whose key is not in the new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def appended_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK10: the old rows, and of the new those whose keys are not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def write_embeddings(df: DataFrame, path: str, id_col: str = "sample_id") -> None:
    """SNK8: ids must be unique and vectors of one length."""
    if not df.groupBy(id_col).count().filter("count > 1").isEmpty():
        raise ValueError("ids repeat")
    if df.select(F.size("embedding")).distinct().count() > 1:
        raise ValueError("vectors differ in length")
    df.write.mode("overwrite").parquet(path)


def summary_json(*parts: tuple[str, DataFrame]) -> DataFrame:
    """SNK11: one JSON document of several one-row summaries."""
    out = None
    for name, df in parts:
        one = df.select(F.struct(*df.columns).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out.select(F.to_json(F.struct(*[n for n, _ in parts])).alias("summary"))
