"""Sources: record tables by split, box text files, geometry and OCR JSON, document logs, dataset definitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX_LINE = r"^([^,]*),([^,]*),([^,]*),([^,]*),(.*),(-?\d+),(-?\d+),(-?\d+)$"
RECT = "struct<x:double,y:double,width:double,height:double>"
GEOMETRY = f"array<struct<id:string,tag:string,classes:string,rect:{RECT},visibility:string,dataContent:string,dataPlaceholder:string,style:string,text:string,selectorTypes:array<string>>>"
OCR = "struct<angle:double,width:int,height:int,words:array<struct<text:string,confidence:double,polygon:array<double>>>>"
#: Kinds of selectors that geometries are scanned for.
SELECTORS = ("visual_element", "handwriting", "layout_element", "custom")


@dataclass(frozen=True)
class DatasetConfig:
    """SRC3: an entry of a dataset catalogue."""

    name: str
    path: str
    task: str
    is_synthetic: bool = False


def find_config(catalogue: list[DatasetConfig], name: str, is_synthetic: bool) -> DatasetConfig:
    """SRC3: the first entry of that name; an unknown name is an error that lists the others."""
    mine = [c for c in catalogue if c.is_synthetic == is_synthetic]
    for c in mine:
        if c.name == name:
            return c
    raise ValueError(f"no dataset {name}; there are {sorted(c.name for c in mine)}")


def load_dataset(spark: SparkSession, config: DatasetConfig, split: str | None = None) -> DataFrame:
    """SRC1, SRC4: all records with their split column; one split reads its partition only."""
    df = spark.read.parquet(config.path)
    return df.filter(F.col("split") == split) if split else df


def load_with_validation(spark: SparkSession, config: DatasetConfig, id_col: str, ratio: float = 0.95) -> DataFrame:
    """SRC5: a real dataset without a validation split gets one from its training records."""
    from quire.operators.sampling import split

    df = load_dataset(spark, config)
    if config.is_synthetic or not df.filter("split = 'validation'").isEmpty():
        return df
    train = split(df.filter("split = 'train'").drop("split"), ratio, id_col)
    return train.unionByName(df.filter("split <> 'train'"))


def find_record(df: DataFrame, key: str, id_col: str = "sample_id") -> DataFrame:
    """SRC2: records whose id, with dots as underscores, is the key."""
    return df.filter(F.translate(F.col(id_col), ".", "_") == key)


def parse_box(line: Column) -> Column:
    """SRC7, SRC8: ``x0,y0,x2,y2,text,block,line,word``; the text may hold commas. Null for a line with fewer fields."""
    field = lambda i: F.regexp_extract(line, BOX_LINE, i)
    numbers = [field(i).try_cast("double").alias(n) for i, n in ((1, "x0"), (2, "y0"), (3, "x2"), (4, "y2"))]
    counts = [field(i).try_cast("int").alias(n) for i, n in ((6, "block_no"), (7, "line_no"), (8, "word_no"))]
    return F.when(line.rlike(BOX_LINE), F.struct(*numbers, field(5).alias("text"), *counts))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: box files, one a document, its name the id."""
    df = spark.read.text(path).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("doc_id"), parse_box(F.col("value")).alias("b"))
    return df.filter("b is not null").select("doc_id", "b.*")


def box_line(x0: Column, y0: Column, x2: Column, y2: Column, text: Column, block: Column, line: Column, word: Column) -> Column:
    """SNK6: a box as a line, the inverse of parse_box."""
    return F.concat_ws(",", *[c.cast("string") for c in (x0, y0, x2, y2)], text, *[c.cast("string") for c in (block, line, word)])


def elements(geometry_json: Column, selector: str) -> Column:
    """SRC9: elements of a geometry list whose selector types have ``selector``."""
    return F.filter(F.from_json(geometry_json, GEOMETRY), lambda g: F.array_contains(g["selectorTypes"], selector))


def polygon_box(polygon: Column) -> Column:
    """SRC12: (left, top, width, height) of x, y pairs, ends included; halves round to even."""
    xs, ys = F.filter(polygon, lambda v, i: i % 2 == 0), F.filter(polygon, lambda v, i: i % 2 == 1)
    lo = lambda v: F.bround(F.array_min(v)).cast("int")
    hi = lambda v: F.bround(F.array_max(v)).cast("int")
    return F.array(lo(xs), lo(ys), hi(xs) - lo(xs) + 1, hi(ys) - lo(ys) + 1)


def box_polygon(geo: Column) -> Column:
    """SNK7: the inverse of polygon_box."""
    x0, y0, x2, y2 = geo[0], geo[1], geo[0] + geo[2] - 1, geo[1] + geo[3] - 1
    return F.array(x0, y0, x2, y0, x2, y2, x0, y2)


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: OCR pages (doc_id, angle, width, height, words) from one JSON file each."""
    text = spark.read.text(path, wholetext=True)
    page = F.from_json(F.col("value"), f"struct<pages:array<{OCR}>>")["pages"]
    return text.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("doc_id"), F.get(page, F.lit(0)).alias("p")).select("doc_id", "p.*")


def ocr_boxes(words: Column) -> Column:
    """PRJ25: OCR words as boxes without numbers."""
    def one(w: Column) -> Column:
        g = polygon_box(w["polygon"])
        return F.struct(g[0].cast("double").alias("x0"), g[1].cast("double").alias("y0"), (g[0] + g[2]).cast("double").alias("x2"), (g[1] + g[3]).cast("double").alias("y2"), w["text"].alias("text"), *[F.lit(-1).alias(n) for n in ("block_no", "line_no", "word_no")])

    return F.transform(words, one)


def read_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC10: document logs, one JSON object a file, its name the id; absent keys are null."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("doc_id"), "*")


def running_batches(batches: DataFrame) -> DataFrame:
    """SRC11: batches in progress and their messages."""
    return batches.filter("processing_status = 'in_progress'").agg(F.count("*").alias("batches"), F.coalesce(F.sum(F.size("message_ids")), F.lit(0)).alias("messages"))


def task_words(log: DataFrame, gt: DataFrame, words: DataFrame, segments: DataFrame) -> DataFrame:
    """SRC6, JOIN1: documents with ground truth, word boxes and segment boxes; documents without words go."""
    return log.join(gt, "doc_id").join(words, "doc_id").join(segments, "doc_id").filter(F.size("words") > 0)
