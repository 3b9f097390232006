"""Best-fit packing of token pieces into sequences, online, with a bounded number of open bins.

A packer keeps a count of open bins for each possible free space and one big integer as a bitset of the spaces that have
bins. A piece goes to the open bin with the least sufficient space: the lowest set bit at or above its length. A new
bin that would be one too many first closes the fullest, the lowest set bit of all. Pieces are dealt to packers by a
hash, so each packer holds a bounded number of pieces (lengths, not ids) whatever the size of the corpus, and a third of
the corpus under one key is dealt like the rest. A packer takes its pieces from long to short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _common as C
from quire.llm.tokens import encoder, id_lists, slices_by_bytes, with_end

#: Pieces for one packer, about; open bins of one packer, at most.
PACKER_PIECES, OPEN_BINS = 25_000, 4096

#: What a worker remembers of the tokenizer: less than for the token store, as stages before have left their traces in the workers.
CACHE_UNITS = 300_000

PIECE_SCHEMA = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"


class BestFit:
    """Bounded-space online best fit: ``place(length)`` gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most, self.bins, self.open, self.set = capacity, open_bins, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        stack = self.by_space[space]
        found = stack.pop()
        if not stack:
            self.set &= ~(1 << space)
        return found

    def place(self, length: int) -> tuple[int, int]:
        if length > self.capacity:
            raise ValueError("a piece is longer than a bin")
        fits = self.set >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.set & -self.set).bit_length() - 1)
                self.open -= 1
            space, chosen = self.capacity, self.bins
            self.bins += 1
            self.open += 1
        left = space - length
        if left:
            self.by_space[left].append(chosen)
            self.set |= 1 << left
        else:
            self.open -= 1
        return chosen, self.capacity - space


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, CACHE_UNITS).encode
        for whole in batches:
            for batch in slices_by_bytes(whole, 2):
                ids, counts = with_end(*encode(batch.column(2).to_pylist()), end_id)
                of = np.repeat(np.arange(len(counts)), -(-counts // capacity))  # the text of each piece
                first = np.searchsorted(of, np.arange(len(counts)))
                piece = np.arange(len(of)) - first[of]
                start = piece * capacity
                length = np.minimum(counts[of] - start, capacity)
                begin = (np.cumsum(counts) - counts)[of] + start
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                lists = id_lists(ids, length) if with_ids else id_lists(ids[:0], np.zeros(len(of), np.int64))
                at = pa.array(of)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of whole texts, each text with an end id: only a longer text is cut, after every ``capacity`` ids.

    ``row`` tells rows with equal ids apart. Null texts count as empty (a piece of the end id alone).
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), C.text_of(text_col).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, capacity, with_ids), PIECE_SCHEMA)


def _pack(capacity: int, open_bins: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("row").to_numpy(), -lengths))
        fit, bins, offsets = BestFit(capacity, open_bins), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
            bins[i], offsets[i] = fit.place(length)
        packer = key[0].as_py()
        return table.drop_columns(["packer"]).append_column("sequence_id", pa.array(bins + (packer << 32))).append_column("offset", pa.array(offsets))

    return run


PACKED_SCHEMA = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(piece_table: DataFrame, capacity: int = 4096, packer_pieces: int = PACKER_PIECES, open_bins: int = OPEN_BINS) -> DataFrame:
    """Places for the rows of a materialized table of pieces: sequence_id and the gapless offset.

    Reads lengths, not ids. Ties (pieces as long as each other) go by row and piece, so reruns agree. An empty table gives
    no rows. Each packer leaves its last bins partly filled: the cost is a few sequences for each PACKER_PIECES pieces.
    """
    packers = max(1, -(-piece_table.count() // packer_pieces))
    dealt = piece_table.drop("ids").withColumn("packer", F.pmod(F.xxhash64("row", "piece", F.lit(7)), F.lit(packers)))
    return dealt.groupBy("packer").applyInArrow(_pack(capacity, open_bins), PACKED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; ``with_ids`` adds the ids by a join on (row, piece)."""
    cut = C.materialize(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    placed = pack(cut, capacity)
    return placed.join(cut.select("row", "piece", "ids"), ["row", "piece"]) if with_ids else placed
