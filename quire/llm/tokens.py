"""Token ids: encoding with a public tokenizer and a Parquet token store with controlled row groups and page indexes.

Texts are encoded by the ``tokenizers`` library, each distinct unit (what the tokenizer's pattern parts) once a slice of text: units are found by
numpy over the characters of the whole slice, made distinct by Arrow, looked up among those that the worker remembers, and the others go to
the tokenizer together. What a worker remembers and the size of a slice have hard bounds; results don't depend on either.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _common as C

#: Units that a worker remembers, at most (an entry takes some 170 bytes), and their longest in bytes; bytes of text that are encoded together, about.
CACHE_UNITS, CACHE_LENGTH, SLICE_BYTES = 400_000, 64, 4 << 20
#: The kinds of characters that the patterns of the two tokenizer files tell apart: anything else, white space, letters, numbers.
OTHER, SPACE, LETTER, NUMBER = range(4)
#: The pattern of the word-level tokenizer file, and what it parts from an apostrophe; fixed values.
_WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SHORT, _LONG = "stmd", ("re", "ve", "ll")
#: These are white space to Python but not to the tokenizers' patterns.
_NOT_EVERYWHERE_SPACE = re.compile("[\x1c-\x1f]")


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [c if not 0xD800 <= c < 0xE000 else 0 for c in range(0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


@cache
def _lower() -> np.ndarray:
    """The lower-case form of each code point; 0 for those whose text needs the tokenizer's own normalization.

    A text without marks, conjoining Hangul and characters that change on their own is in NFC, and is lowered one character at a time.
    """
    table = np.zeros(0x110000, np.uint32)
    for c in range(1, 0x110000):
        char = chr(c)
        kind = unicodedata.category(char)
        if kind[0] == "M" or kind in ("Cn", "Cs") or 0x1100 <= c < 0x1200:
            continue
        low = char.lower()
        if len(low) == 1 and (c < 0x300 or unicodedata.is_normalized("NFC", char)):
            table[c] = ord(low)
    return table


@cache
def _model_letters() -> np.ndarray:
    """The letter that a byte-level model has for each byte: printable ones stand for themselves, others follow from 256 on; a line end for byte 255."""
    table, more = np.zeros(256, np.uint32), 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[b] = b
        else:
            table[b], more = more, more + 1
    table[255] = 10
    return table


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ``values`` one after another."""
    ends = np.cumsum(lengths)
    return values[np.arange(int(lengths.sum())) + np.repeat(starts - (ends - lengths), lengths)]


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)`` with ``encode_special_tokens`` set: a text that holds the
    name of an added token, such as <|endoftext|>, has it encoded as plain text. The library's default gives the id of the added token there.

    Known by its pre-tokenizer, a tokenizer is either byte-level (a unit carries the space before it) or word-level (white
    space is dropped, letters are lowered); any other is used text by text.
    """

    def __init__(self, path: str, cache_units: int = CACHE_UNITS, slice_bytes: int = SLICE_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = self._kind()
        self.most, self.slice_bytes = cache_units, slice_bytes
        # two generations, each of half the bound at most: a full young one becomes the old one
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if self.kind != "other":
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
            words = {i: w for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
            self.ends = np.array([words.get(i, "").endswith("</w>") for i in range(max(words) + 1)])
            self.widths = np.array([len(words.get(i, "")) for i in range(max(words) + 1)], np.int64)
            self.letters = _model_letters()

    def _kind(self) -> str:
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "byte"
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        norms = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if parts == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>":
            return "word"
        return "other"

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; a null is the empty text."""
        texts = [t or "" for t in texts]
        found, at = [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= self.slice_bytes):
                size += len(texts[to])
                to += 1
            found.append(self._slice(texts[at:to]))
            at = to
        if not found:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate([ids for ids, _ in found]), np.concatenate([n for _, n in found])

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "other":
            return _flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if self.kind == "byte":
            return self._by_units(points, sizes)
        low = _lower()[points]
        odd = _counts(low == 0, sizes) > 0
        if not odd.any():
            return self._by_units(low, sizes)
        plain_ids, plain_n = self._by_units(low[np.repeat(~odd, sizes)], sizes[~odd])
        odd_ids, odd_n = self._by_pieces([t for t, o in zip(texts, odd, strict=True) if o])
        n = np.empty(len(texts), np.int64)
        n[~odd], n[odd] = plain_n, odd_n
        starts = np.empty(len(texts), np.int64)
        starts[~odd], starts[odd] = np.cumsum(plain_n) - plain_n, len(plain_ids) + np.cumsum(odd_n) - odd_n
        return gather(np.concatenate([plain_ids, odd_ids]), starts, n), n

    def _by_units(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given by their code points in a row: their distinct units are encoded, then put in place."""
        if not len(points):
            return np.empty(0, np.uint32), np.zeros(len(sizes), np.int64)
        cut = self._cuts(points, sizes)
        begins = np.flatnonzero(cut)
        raw = points.tobytes().decode("utf-32-le").encode("utf-8")
        offsets = np.append(begins, len(points)).astype(np.int32)
        if len(raw) > len(points):  # bytes before each character
            wide = np.flatnonzero(points >= 0x80)
            more = np.cumsum(1 + (points[wide] >= 0x800) + (points[wide] >= 0x10000))
            offsets += np.concatenate([[0], more]).astype(np.int32)[np.searchsorted(wide, offsets, side="left")]
        units = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = units.dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = coded.indices.to_numpy()
        values, n_of = np.frombuffer(b"".join(ids), np.uint32), lengths[which]
        ends = np.concatenate([[0], np.cumsum(n_of)])
        # the first unit of each text: units begin where texts do
        text_ends = np.searchsorted(begins, np.cumsum(sizes), side="left")
        return gather(values, (np.cumsum(lengths) - lengths)[which], n_of), np.diff(ends[np.concatenate([[0], text_ends])])

    def _cuts(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each character; where there is white space in the word-level case, it is a unit that has no ids."""
        kind = _kinds()[points]
        n = len(points)
        first = np.zeros(n + 1, bool)  # where texts begin, and the end of all
        first[np.concatenate([[0], np.cumsum(sizes)])] = True
        space = kind == SPACE
        cut = np.ones(n, bool)
        cut[1:] = kind[1:] != kind[:-1]
        cut |= first[:-1]
        if self.kind == "word":
            cut |= kind == NUMBER
            glued = np.zeros(n, bool)
        else:
            # of white space before something else the last character is apart, and a space goes with what follows
            last = space & np.append(~space[1:], False) & ~first[1:]
            cut |= last
            glued = np.zeros(n, bool)
            glued[1:] = (last & (points == 32))[:-1]
            cut &= ~glued | first[:-1]
        # an apostrophe on its own that begins a unit takes some letters with it
        quote = np.flatnonzero((points == 39) & cut)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1] & ~glued[quote]]
        after = np.append(points, np.zeros(3, points.dtype))
        one = np.isin(after[quote + 1], [ord(c) for c in _SHORT])
        two = np.zeros(len(quote), bool)
        for a, b in _LONG:
            two |= (after[quote + 1] == ord(a)) & (after[quote + 2] == ord(b))
        two &= ~first[np.minimum(quote + 2, n)]
        for at, letters in ((quote[one], 1), (quote[two], 2)):
            cut[at + 1] = False
            to = at + 1 + letters
            to = to[to < n]
            cut[to] = True
        return cut

    def _ids_of(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units, remembered or encoded."""
        ids = list(map(self.young.get, units))
        unmet = [k for k, x in enumerate(ids) if x is None]
        names = [units[k] for k in unmet]
        found = list(map(self.old.get, names))
        missing = [u for u, x in zip(names, found, strict=True) if x is None]
        encoded = iter(self._encode_units(missing))
        found = [next(encoded) if x is None else x for x in found]
        for k, x in zip(unmet, found, strict=True):
            ids[k] = x
        step = max(1, min(1024, self.most // 2))
        for at in range(0, len(names), step):
            if len(self.young) + step > self.most // 2:
                self.young, self.old = {}, self.young
            self.young.update((u, x) for u, x in zip(names[at : at + step], found[at : at + step], strict=True) if len(u) <= CACHE_LENGTH)
        return ids

    def _encode_units(self, units: list[bytes], together: int = 1024) -> list[bytes]:
        """Units by the tokenizer's model: many as one text, already in the model's letters and parted by line ends, which are none of them."""
        if self.kind == "word":  # white space has no ids
            blank = [_kinds()[ord(u.decode()[0])] == SPACE for u in units]
            if any(blank):
                rest = iter(self._encode_units([u for u, b in zip(units, blank, strict=True) if not b], together))
                return [b"" if b else next(rest) for b in blank]
        out: list[bytes] = []
        for at in range(0, len(units), together):
            part = units[at : at + together]
            # no UTF-8 has the byte 255
            text = self.letters[np.frombuffer(b"\xff".join(part), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            if self.kind == "byte":
                stop = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(u) for u in part])) + 1
            else:
                stop = np.flatnonzero(self.ends[ids]) + 1
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
        return out

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word-level way of texts that may not be in NFC or have letters that are lowered to several: pieces between white space, each normalized by the tokenizer."""
        split = [[t] if _NOT_EVERYWHERE_SPACE.search(t) else t.split() for t in texts]
        distinct = list(set().union(*split))
        ids = {p: np.array(e.ids, np.uint32) for p, e in zip(distinct, self.tokenizer.encode_batch_fast(distinct, add_special_tokens=False), strict=True)}
        return _flat([np.concatenate([ids[p] for p in s]) if s else [] for s in split])


def _counts(mask: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of a mask are set in each run."""
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], np.cumsum(sizes)])])


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate([np.empty(0, np.uint32), *(np.asarray(x, np.uint32) for x in lists)]), n


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, cache_units: int = CACHE_UNITS) -> Encoder:
    """The worker's encoder for a tokenizer file, with all that it remembers."""
    key = (path, cache_units)
    if key not in _ENCODERS:
        _ENCODERS.clear()  # one at a time: what it remembers is large
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def slices_by_bytes(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about so many bytes of a text column, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Arrow lists from ids in a row, without a Python object for each."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view(np.int32)))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with an end id after each."""
    if end_id is None:
        return ids, counts
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


TOKEN_SCHEMA = "doc_id bigint, segment int, local_start bigint, n_tokens int, ids array<int>"


def _encode_segment(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, segment, start = encoder(path).encode, TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                ids, counts = with_end(*encode(batch.column(1).to_pylist()), end_id)
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(counts), segment, np.int32)), pa.array(starts), pa.array(counts.astype(np.int32)), id_lists(ids, counts)],
                    names=["doc_id", "segment", "local_start", "n_tokens", "ids"],
                )

    return run


#: One row group holds about this many bytes, one page this many rows: a read of a few documents touches a few pages.
ROW_GROUP_BYTES, PAGE_ROWS, DICTIONARY_BYTES = 32 << 20, 512, 2 << 20


@dataclass(frozen=True)
class TokenStore:
    """Parquet token files in ascending doc_id order.

    Each file is one segment: rows (doc_id, segment, local_start, n_tokens, ids), doc_id ascending within and across
    segments. ``ids`` is dictionary-encoded (the vocabulary is the dictionary), the integers are small; footers carry
    column and offset indexes, so that a filter on doc_id reads a few pages and a read without ``ids`` reads no ids.
    """

    spark: SparkSession
    path: str

    def raw(self) -> DataFrame:
        return self.spark.read.schema(TOKEN_SCHEMA).parquet(self.path)

    def segment_starts(self) -> DataFrame:
        """segment, base: ids in all segments before it. One row a file, from the metadata columns only."""
        totals = self.raw().groupBy("segment").agg(F.sum("n_tokens").alias("n")).orderBy("segment").collect()
        rows, base = [], 0
        for r in totals:
            rows.append((r.segment, base))
            base += r.n
        return self.spark.createDataFrame(rows, "segment int, base bigint")

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids; select what is needed, the rest is not read."""
        starts = self.segment_starts()
        # one small row for each file, like the file listing that the driver holds anyway
        return self.raw().join(F.broadcast(starts), "segment").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode every whole text and write the ids in ascending order of the id column.

    A null text is the empty text, a null id comes first, rows with equal ids come in the order of their texts. An empty table gives a
    store without rows. The text is range-partitioned before it is encoded (it is smaller than its ids), each task
    encodes and writes one segment: a lost task is run again for its segment alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), C.text_of(text_col).alias("text"))
    rows = rows.repartitionByRange(C.partitions_of(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        rows.mapInArrow(_encode_segment(tokenizer, end_id), TOKEN_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .option("parquet.enable.dictionary", "true")
        .parquet(path)
    )
    return TokenStore(spark, path)


def _crc_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, ends = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B"), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    return store.read().mapInArrow(_crc_of_lists, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
