"""Near copies by the similarity of their texts: pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 and more, and their components.

Texts with equal sets are one point. Candidates are the links of the SimHash operator (simhash.links: fingerprints of the same shingles that differ in
RADIUS bits at most) and, since these are few of the pairs of 0.8, points that share one of BANDS cells of ROWS minhashes; a pair of similarity
0.8 shares none with probability (1 - 0.8 ** 7) ** 40, one in 12,000. Candidates are joined to groups, the texts of a group meet in one place, and there
the exact intersections of all its pairs are counted: what is linked in the end are verified pairs only. A text is sent once, however many cells it
shares; groups over GROUP_BLOCK texts are cut into blocks, and each pair of blocks is verified on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _common as C
from quire.llm.components import components
from quire.llm.simhash import SEED, fingerprint_of, keep_least, links, shingle_hashes

#: Bits of a fingerprint that may differ; cells of minhashes, minhashes of a cell.
RADIUS, BANDS, ROWS = 4, 40, 7
#: Points of a group that are verified in one piece; larger groups are cut into blocks of about this size.
GROUP_BLOCK = 512
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Distinct XXH64 of the shingles of a text, in order."""
    return np.unique(shingle_hashes(text, words))


def point_of(hashes: np.ndarray) -> int:
    """A number for a whole set: XXH64 of its hashes, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """The least product with each factor, modulo 2 ** 64; zeros for an empty set."""
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    if not len(hashes):
        return np.zeros_like(least)
    for at in range(0, len(hashes), 256):  # bounded memory for very long texts
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + 256]).min(axis=1), out=least)
    return least


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, prints, bands = [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), words)
                prints.append(fingerprint_of(hashes))
                hashes = np.unique(hashes)
                points.append(point_of(hashes))
                least = minhashes(hashes).reshape(BANDS, ROWS)
                bands.append([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least)])
            flat = np.array(bands, np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.int64()), fp, lists], names=["doc_id", "point", "fp", "bands"])

    return run


def _star_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of a cell joined to stars: rows in order of cell."""
    stars, cell, first = C.Stars(), None, None
    for batch in batches:
        for at, point in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at == cell:
                stars.join(first, point)
            else:
                cell, first = at, point
    yield _rows(stars)


def _rows(stars: C.Stars) -> pa.RecordBatch:
    rows = np.array(stars.rows(), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["u", "v"])


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of some sets, exact: products of their incidence with the members that sets share."""
    sizes = [len(s) for s in sets]
    members, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times > 1
    column = np.cumsum(shared) - 1
    there = shared[place]
    owner, place = owner[there], column[place[there]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(place, [at, at + columns])
        part = np.zeros((len(sets), columns), np.float32)  # counts up to 4096 are exact
        part[owner[a:b], place[a:b] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verify(words: int, tenths: int):
    def settle(texts: list[str], stars: C.Stars) -> None:
        sets = {point_of(s): s for s in (shingle_set(t, words) for t in texts)}
        points, sets = np.array(list(sets), np.int64), list(sets.values())
        if len(points) < 2:
            return
        sizes = np.array([len(s) for s in sets], np.int64)
        both = intersections(sets)
        near = 10 * both >= tenths * (sizes[:, None] + sizes[None, :] - both)
        C.join_cell(stars, points, [np.nonzero(np.triu(near, 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars, cell, held = C.Stars(), None, []
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != cell:
                    settle(held, stars)
                    cell, held = at, []
                held.append(text.as_py())
        settle(held, stars)
        yield _rows(stars)

    return run


def candidate_links(table: DataFrame, points: DataFrame) -> DataFrame:
    """u, v: stars over points whose components are the groups of candidates; table (point, fp), points (point, bands), both materialized."""
    n = C.partitions_of(table.sparkSession)
    first = C.materialize(table.groupBy("fp").agg(F.min("point").alias("first")), "fingerprints")
    same = table.select("point", "fp").distinct().join(first, "fp").select(F.col("point").alias("u"), F.col("first").alias("v")).filter("u != v")
    at = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(c + "_point"))
    near = links(first, RADIUS).join(at("u"), "u").join(at("v"), "v").select(F.col("u_point").alias("u"), F.col("v_point").alias("v"))
    cells = points.select(F.explode("bands").alias("cell"), "point").repartition(n, "cell").sortWithinPartitions("cell")
    return same.unionByName(near).unionByName(cells.mapInArrow(_star_cells, "u bigint, v bigint"))


def near_copies(docs: DataFrame, words: int = 5, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text", block: int = GROUP_BLOCK) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links of a similarity of ``tenths`` / 10 and more reach, itself included.

    Null texts are empty texts; texts without words are copies of each other, texts under five words are one shingle. A null doc_id gets the
    component of its text and names none. Cells are made for 0.8: below it, more pairs share none.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), C.text_of(text_col).alias("text"))
    table = C.materialize(rows.mapInArrow(_prints(words), "doc_id bigint, point bigint, fp bigint, bands array<bigint>"), "prints")
    points = C.materialize(table.groupBy("point").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "points")
    n = C.partitions_of(docs.sparkSession)
    candidates = C.materialize(components(candidate_links(table, points)), "candidates")
    grouped = candidates.select(F.col("u").alias("point"), F.col("v").alias("cell")).unionByName(candidates.select(F.col("v").alias("point"), F.col("v").alias("cell")).distinct())
    members = C.materialize(C.split_large_cells(grouped.join(points.select("point", "least"), "point").select("cell", "point", "least"), "point", block), "members")
    # merged at every size: the growth of the shuffle is that of the texts
    named = rows.join(members.select(F.col("least").alias("doc_id"), "cell").hint("merge"), "doc_id").select("cell", "text")
    lost = members.filter("least is null")
    if not lost.isEmpty():  # points of rows without an id alone
        found = rows.filter("doc_id is null").mapInArrow(_points(words), "point bigint, text string").join(lost, "point").select("cell", "text")
        named = named.unionByName(found)
    verified = named.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_verify(words, tenths), "u bigint, v bigint")
    stars = components(verified)
    rooted = points.select("point", "least").join(stars.select(F.col("u").alias("point"), "v"), "point", "left").withColumn("root", F.coalesce("v", "point"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.select("doc_id", "point").join(rooted.select("point", "root").join(ids, "root").select("point", "component_id"), "point").select("doc_id", "component_id")


def _points(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [point_of(shingle_set(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(points, pa.int64()), batch.column(1)], names=["point", "text"])

    return run


def drop_near_copies(docs: DataFrame, words: int = 5, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies, all their columns unchanged: of each component the row with the smallest id stays.

    Rows without an id all stay; of rows that repeat id and text one stays.
    """
    return keep_least(docs, C.materialize(near_copies(docs, words, tenths, id_col, text_col), "near"), id_col, text_col)
