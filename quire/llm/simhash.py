"""SimHash near-duplicates: fingerprints, candidate search in an embedding of bit counts, exact verification, components.

A fingerprint of 64 bits is cut into SEGMENTS segments of two bits; the count of set bits in each is a point of a small integer grid. The Manhattan
distance of two points is a lower bound of the Hamming distance of the fingerprints. With the segments dealt to GROUPS groups, two points within
distance r agree exactly in at least GROUPS - r whole groups: each choice of that many groups, with its counts, is a cell, and fingerprints that
link share a cell. In a cell, points are ordered by their total count (the coarsest embedding: it differs by r at most), pairs within that range
are held against the Manhattan distance of the segments, and what passes is verified on all 64 bits. No pair is lost and none but links leave.

Equal fingerprints are one point, however many documents have it. A task joins the links it finds to stars before it hands them on, so a group of
n near copies gives about n rows and not n squared. Cells over CELL_BLOCK points are cut into blocks, and each pair of blocks is a cell of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _common as C
from quire.llm.components import components

SEED = 42
SEGMENTS, GROUPS = 32, 6
#: Points of a cell that are compared in one piece; larger cells are cut into blocks of about this size.
CELL_BLOCK = 8192
_TWO_BIT = np.uint64(0x5555555555555555)


def shingle_hashes(text: str, words: int = 4) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included: A-Z in lower case, words joined by spaces; a shorter text is one shingle."""
    found = C.split_words(text, lower=True)
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    n = len(found) - words + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    shingles = [joined[a:b] for a, b in zip(begins[:n].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * counts > len(hashes)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint_of(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer) of every whole text; null texts are empty and have fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), C.text_of(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id bigint, fp bigint")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The counts of all 32 two-bit segments, packed two bits each into one integer."""
    return fp - ((fp >> np.uint64(1)) & _TWO_BIT)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed counts: of each two-bit pair the larger less the smaller."""
    low = np.uint64(0x3333333333333333)
    total = np.zeros(a.shape, np.uint8)
    for shift in (np.uint64(0), np.uint64(2)):
        x, y = (a >> shift) & low, (b >> shift) & low
        d = (x | np.uint64(0x4444444444444444)) - y  # each nibble: 4 + x - y, from 2 to 6
        # |d - 4| of a nibble: its low bits count up above 4 and down below it
        above = (d >> np.uint64(2)) & np.uint64(0x1111111111111111)
        less = d & low
        magnitude = (less & (above * np.uint64(3))) | ((np.uint64(0x4444444444444444) - less) & ((above ^ np.uint64(0x1111111111111111)) * np.uint64(3)))
        total += np.bitwise_count(magnitude & np.uint64(0x1111111111111111)) + 2 * np.bitwise_count(magnitude & np.uint64(0x2222222222222222))
    return total


def _group_masks(groups: int) -> list[np.uint64]:
    cuts = [round(SEGMENTS * g / groups) for g in range(groups + 1)]
    return [np.uint64(sum(3 << (2 * s) for s in range(a, b))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _cells(radius: int, groups: int):
    masks = _group_masks(groups)
    choices = [np.uint64(sum(int(masks[g]) for g in chosen)) for chosen in combinations(range(groups), groups - radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            counts = segment_counts(fp)
            cell = np.concatenate([counts & m for m in choices]).view(np.int64)
            choice = np.repeat(np.arange(len(choices), dtype=np.int32), len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(choice), pa.array(cell), pa.array(np.tile(fp, len(choices)).view(np.int64))], names=["choice", "cell", "fp"])

    return run


def _links_in_cell(fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one large cell, by rows of blocks: a range join on the total count, then both distances."""
    total = np.bitwise_count(fp).astype(np.int16)
    order = np.argsort(total, kind="stable")
    fp, total = fp[order], total[order]
    counts = segment_counts(fp)
    until = np.searchsorted(total, total + radius, side="right")
    for a in range(0, len(fp), 256):
        b = min(a + 256, len(fp))
        end = int(until[b - 1])
        near = manhattan(np.broadcast_to(counts[a:b, None], (b - a, end - a)), np.broadcast_to(counts[None, a:end], (b - a, end - a))) <= radius
        i, j = np.nonzero(np.triu(near, 1))
        good = np.bitwise_count(fp[a + i] ^ fp[a + j]) <= radius
        yield order[a + i[good]], order[a + j[good]]


def _links(radius: int):
    def settle(cell: np.ndarray, fp: np.ndarray, stars: C.Stars) -> None:
        """Links of whole cells: rows in order of cell. Small cells go together, row i against row i + d for each d."""
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.append(starts, len(cell)))
        for k in np.flatnonzero(sizes > 64):
            part = fp[starts[k] : starts[k] + sizes[k]]
            C.join_cell(stars, part, _links_in_cell(part, radius))
        left = np.repeat(np.where(sizes > 64, 0, sizes), sizes)
        place = np.arange(len(cell)) - np.repeat(starts, sizes)
        counts = segment_counts(fp)
        for d in range(1, 64):
            i = np.flatnonzero(place + d < left)
            if not len(i):
                break
            j = i + d
            near = np.abs(np.bitwise_count(fp[i]).astype(np.int16) - np.bitwise_count(fp[j])) <= radius
            i, j = i[near], j[near]
            near = manhattan(counts[i], counts[j]) <= radius
            i, j = i[near], j[near]
            good = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            for x, y in zip(fp[i[good]].tolist(), fp[j[good]].tolist(), strict=True):
                stars.join(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars, held = C.Stars(), None
        for batch in batches:
            cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(cell):
                continue
            if held is not None:
                cell, fp = np.concatenate([held[0], cell]), np.concatenate([held[1], fp])
            last = int(np.searchsorted(cell, cell[-1], side="left"))  # the last cell may go on in the next batch
            if last:
                settle(cell[:last], fp[:last], stars)
            held = (cell[last:], fp[last:])
        if held is not None:
            settle(*held, stars)
        rows = np.array(stars.rows(), np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["u", "v"])

    return run


def links(points: DataFrame, radius: int = 4, groups: int = GROUPS, block: int = CELL_BLOCK) -> DataFrame:
    """u, v: stars over fingerprints whose components are those of all links within ``radius``; ``points`` has distinct fp, materialized."""
    if not 0 <= radius < groups:
        raise ValueError("there must be more groups than differing bits")
    cells = points.select("fp").mapInArrow(_cells(radius, groups), "choice int, cell bigint, fp bigint").withColumn("cell", F.xxhash64("choice", "cell")).drop("choice")
    cells = C.split_large_cells(cells, "fp", block)
    dealt = cells.repartition(C.partitions_of(points.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_links(radius), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of ``radius`` differing bits and fewer reach, itself included.

    Null texts are empty texts; texts without words have fingerprint 0 and link like any other. A null doc_id gets the component of its
    fingerprint and names none (a component of null ids alone has a null id). An empty table gives no rows.
    """
    table = C.materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    points = C.materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    stars = components(links(points, radius, groups))
    rooted = points.join(stars.select(F.col("u").alias("fp"), "v"), "fp", "left").withColumn("root", F.coalesce("v", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return table.join(named, "fp")


def drop_near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies, all their columns unchanged: of each component the row with the smallest id stays.

    Only the ids to keep are joined to the texts. Rows without an id all stay; of rows that repeat id and text one stays.
    """
    return keep_least(docs, C.materialize(near_duplicates(docs, words, radius, id_col, text_col), "near"), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each component of ``found`` (doc_id, component_id; materialized) the row with the smallest id, and rows without an id."""
    key, nth = C.fresh(docs, "q_key"), C.fresh(docs, "q_nth")
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(keep.hint("merge"), F.col(id_col) == F.col(key), "left_semi")
    if not found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        same = Window.partitionBy(id_col, F.xxhash64(C.text_of(text_col))).orderBy(*C.by_content(docs))
        kept = kept.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).drop(nth)
    return kept if found.filter("doc_id is null").isEmpty() else kept.unionByName(docs.filter(F.col(id_col).isNull()))
