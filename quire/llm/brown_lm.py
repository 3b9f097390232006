"""A class-based n-gram language model (Brown): exchange clustering, class transitions and word emissions.

Text is words (A-Z in lower case, parted by white space) with one end token a document, which is also what stands before the first word.
A word's probability is P(class | class before) * P(word | class), each smoothed and each summing to one.

Classes come from two exchanges. The first is of units: the CORE most frequent words are units of their own, all others share SHAPES units by their last
letters. Units are exchanged one after another in one task, from the counts of all neighbouring units of the whole training corpus, a table
bounded by the number of units. The second is of words, in parallel: every other word that occurs MIN_COUNT times and more is taken out of the
class of its shape and put where the likelihood of the class bigrams is highest, by the classes of all its own neighbours, on both sides, against
the class bigrams of the first exchange. Rarer and unknown words stay in the class of their shape. So the words that are clustered grow with the corpus.

Words, their counts and classes are a table, the lexicon. The HEAD most frequent words are broadcast with both; occurrences
of other words are joined to the table by shuffling and go back to the places that they have in their documents. HEAD chooses the way, not the result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import _common as C

#: Words with a unit of their own; units of the other words; words that are broadcast, at most; classes (128 at most); passes of the first exchange.
CORE, SHAPES, HEAD, CLASSES, PASSES = 1536, 510, 131_072, 128, 6
#: Occurrences that a word needs for a class by its own neighbours.
MIN_COUNT = 3
#: Words of the head whose neighbours a task counts in a table instead of row by row.
DENSE = 16_384
#: The end token as a word: no word has a line end.
END = b"\n"
#: Entries of a task's counter before it is emptied, and of neighbours before they are put together by word.
COUNTER_ROWS, NEAR_ROWS = 300_000, 1 << 20
#: Pseudo-counts: of words and units, and of a class's history.
ADD, PRIOR = 0.5, 20.0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counter: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["word", "c"])

    counter: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counter.update(C.split_words(text.as_py(), lower=True))
            counter[END] += 1
            if len(counter) > COUNTER_ROWS:
                yield rows(counter)
                counter = Counter()
    yield rows(counter)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, c over all whole texts, the end token included."""
    rows = docs.select(C.text_of(text_col).alias("text"))
    return rows.mapInArrow(_count_words, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def shape_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SHAPES


def _shape_column(column: str):
    from_end = F.greatest(F.octet_length(column) - 2, F.lit(1))
    return F.crc32(F.substring(F.col(column), from_end, F.lit(3))) % SHAPES


@dataclass
class Vocabulary:
    """Head words with their counts, in order of frequency; the first CORE are units 1.., the end token is unit 0, shapes follow."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    shape_tokens: np.ndarray
    shape_words: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        self.core = min(CORE, len(self.words) - 1) if self.words else 0
        self.units = 1 + self.core + SHAPES
        self.unit_tokens = np.concatenate([self.counts[: 1 + self.core], self.shape_tokens]) if self.words else np.zeros(self.units)

    def indexed(self) -> tuple[dict[bytes, int], np.ndarray]:
        """Place of each head word, and its unit."""
        unit = np.arange(len(self.words), dtype=np.int32)
        for k in range(1 + self.core, len(self.words)):
            unit[k] = 1 + self.core + shape_of(self.words[k])
        return {w: k for k, w in enumerate(self.words)}, unit


def vocabulary(counts: DataFrame, head: int | None = None) -> Vocabulary:
    """From a materialized word_counts() table. The head is at most a fixed number of words; totals are over all words.

    The head is all words of at least such a count that they are no more than ``head``. The count is found from how many words there are in
    each sixteenth of an octave, a table of some hundred rows.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words_only = counts.filter(F.col("word") != F.lit(END))
    octaves = words_only.groupBy(F.floor(16 * F.log2("c")).alias("octave")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    least, room = None, HEAD if head is None else head
    for r in sorted(octaves, key=lambda r: -r.octave):
        room -= r.n
        if room < 0:
            break
        least = r.least
    top = words_only.filter(F.col("c") >= least).collect() if least is not None else []
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    ends = counts.filter(F.col("word") == F.lit(END)).collect()
    words = [END, *(bytes(r.word) for r in top)]
    numbers = np.array([ends[0].c if ends else 0, *(r.c for r in top)], np.int64)
    core = counts.sparkSession.createDataFrame([(bytearray(w),) for w in words[: 1 + CORE]], "word binary")
    others = counts.join(F.broadcast(core), "word", "left_anti").groupBy(_shape_column("word").alias("shape")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    tokens, kinds = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in others.collect():  # a row for each shape
        tokens[r.shape], kinds[r.shape] = r.n, r.v
    return Vocabulary(words, numbers, int(total), int(distinct), tokens, kinds)


_INDEXES: dict[str, tuple] = {}


def _index(sent) -> tuple[Vocabulary, dict[bytes, int], np.ndarray]:
    """The worker's index of a broadcast vocabulary."""
    v = sent.value
    if v.key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[v.key] = (v, *v.indexed())
    return _INDEXES[v.key]


def _sequence(texts: list[str], place: dict[bytes, int], unit: np.ndarray, first_shape: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of some texts in a row, each text with its end: words, places in the head (-1 for others), units, ends."""
    words: list[bytes] = []
    ends = []
    for text in texts:
        words += C.split_words(text, lower=True)
        words.append(END)
        ends.append(len(words))
    at = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
    units = unit[at]
    for k in np.flatnonzero(at < 0).tolist():
        units[k] = first_shape + shape_of(words[k])
    return words, at, units, np.array(ends, np.int64)


def _count_pairs(sent, slice_rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, place, unit = _index(sent)
        seen = np.zeros(v.units * v.units, np.int32)
        for whole in batches:
            for a in range(0, whole.num_rows, slice_rows):
                texts = whole.column(0).slice(a, slice_rows).to_pylist()
                units = _sequence(texts, place, unit, 1 + v.core)[2]
                before = np.concatenate([[0], units[:-1]])  # the end token stands before each text
                np.add.at(seen, before.astype(np.int64) * v.units + units, 1)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(seen[there].astype(np.int64))], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit from the matrix of neighbour counts (before, after), by the exchange algorithm.

    Units in order of frequency begin in the classes in turn; each pass takes every unit out of its class and puts it where the likelihood of
    the class bigrams is highest, until no unit moves.
    """
    u = len(pairs)
    classes = min(classes, u)
    seen = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-seen, kind="stable")
    cls = np.empty(u, np.int64)
    cls[order] = np.arange(u) % classes
    member = np.zeros((u, classes))
    member[np.arange(u), cls] = 1.0
    n = member.T @ pairs @ member
    row, col = n.sum(axis=1), n.sum(axis=0)
    for _ in range(passes):
        moved = 0
        for w in order.tolist():
            if not seen[w]:
                continue
            own = pairs[w, w]
            left = np.bincount(cls, weights=pairs[:, w], minlength=classes)
            right = np.bincount(cls, weights=pairs[w], minlength=classes)
            a = cls[w]
            left[a] -= own
            right[a] -= own
            out, into = right.sum() + own, left.sum() + own
            n[:, a] -= left
            n[a] -= right
            n[a, a] -= own
            row[a] -= out
            col[a] -= into
            f = _xlogx(n)
            gain = (_xlogx(n + left[:, None]) - f).sum(axis=0) + (_xlogx(n + right[None, :]) - f).sum(axis=1)
            d = np.arange(classes)
            both = n[d, d]
            gain += _xlogx(both + left + right + own) + f[d, d] - _xlogx(both + left) - _xlogx(both + right)
            gain -= _xlogx(row + out) - _xlogx(row) + _xlogx(col + into) - _xlogx(col)
            c = int(gain.argmax())
            if gain[c] <= gain[a] + 1e-9:
                c = int(a)
            n[:, c] += left
            n[c] += right
            n[c, c] += own
            row[c] += out
            col[c] += into
            moved += c != a
            cls[w] = c
        if not moved:
            break
    return cls


def _cluster(units: int, classes: int, passes: int):
    def run(table: pa.Table) -> pa.Table:
        pairs = np.zeros(units * units)
        pairs[table.column("pair").to_numpy()] = table.column("n").to_numpy()
        pairs = pairs.reshape(units, units)
        cls = exchange(pairs, classes, passes)
        member = np.zeros((units, classes))
        member[np.arange(units), cls] = 1.0
        n = (member.T @ pairs @ member).reshape(-1)
        kinds = np.concatenate([np.zeros(units, np.int32), np.ones(len(n), np.int32)])
        return pa.table({"kind": pa.array(kinds), "at": pa.array(np.concatenate([np.arange(units), np.arange(len(n))])), "value": pa.array(np.concatenate([cls, n.astype(np.int64)]))})

    return run


@dataclass
class Lexicon:
    """What the clustering found: the head with the classes of its words, the class of each shape, and the table of all words (word, c, class; class is null where it is that of the shape)."""

    vocabulary: Vocabulary
    classes: np.ndarray  # of each head word
    shape_classes: np.ndarray
    distinct: np.ndarray  # words of the training corpus in each class
    table: DataFrame


def _neighbours(sent, unit_classes: np.ndarray, most_dense: int, slice_rows: int = 256):
    """Counts of the classes before and after each word that is not in the core: a row for each word and so many occurrences (NEAR_ROWS), with h (XXH64 of the word),
    shape_class, and lists of code and n as bytes.

    A code is both classes, before * 128 + after, or for the most frequent words one of them: 2**14 + side * 128 + class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, place, unit = _index(sent)
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in v.words], np.uint64).view(np.int64)
        first, dense = 1 + v.core, min(most_dense, len(v.words))
        table = np.zeros((max(0, dense - first), 256), np.int32)
        near, far, held = [], [], 0

        def grouped() -> Iterator[pa.RecordBatch]:
            if near:
                key, n = np.unique(np.concatenate(near), return_counts=True)
                at = key >> 14
                yield from _by_word(hashes[at], unit_classes[unit[at]], key & 16383, n)
            if far:
                h, own, code = (np.concatenate(c) for c in zip(*far, strict=True))
                order = np.argsort(h, kind="stable")
                yield from _by_word(h[order], own[order], code[order], np.ones(len(h), np.int64))

        for whole in batches:
            for a in range(0, whole.num_rows, slice_rows):
                texts = whole.column(0).slice(a, slice_rows).to_pylist()
                words, at, units, ends = _sequence(texts, place, unit, first)
                cls = unit_classes[units]
                before = np.concatenate([[cls[-1]], cls[:-1]])  # the end token stands before each text
                after = np.append(cls[1:], 0)
                middle = np.flatnonzero((at >= first) & (at < dense))
                row = (at[middle] - first).astype(np.int64) * 256
                np.add.at(table.reshape(-1), row + before[middle], 1)
                np.add.at(table.reshape(-1), row + 128 + after[middle], 1)
                code = before * 128 + after
                some, others = np.flatnonzero(at >= dense), np.flatnonzero(at < 0)
                near.append((at[some].astype(np.int64) << 14) | code[some])
                far.append((np.array([xxhash.xxh64_intdigest(words[k], 42) for k in others.tolist()], np.uint64).view(np.int64), cls[others], code[others]))
                held += len(some) + len(others)
                if held >= NEAR_ROWS:
                    yield from grouped()
                    near, far, held = [], [], 0
        yield from grouped()
        there = np.flatnonzero(table)
        at = first + there // 256
        yield from _by_word(hashes[at], unit_classes[unit[at]], (1 << 14) + there % 256, table.reshape(-1)[there])

    return run


NEAR_SCHEMA = "h bigint, shape_class smallint, codes binary, counts binary"


def _by_word(h: np.ndarray, own: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each run of equal h: its codes as 16-bit and their counts as 32-bit integers."""
    if len(h):
        begin = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        ends = np.append(begin, len(h)).astype(np.int32)
        lists = [pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]) for x in (code.astype(np.int16), n.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(h[begin]), pa.array(own[begin].astype(np.int16)), *lists], names=["h", "shape_class", "codes", "counts"])


def _entries(batch: pa.RecordBatch) -> list[np.ndarray]:
    """h, shape_class, code and n of each entry of the rows of _by_word()."""
    found = []
    for name, kind in (("codes", np.int16), ("counts", np.int32)):
        column = batch.column(name).cast(pa.binary())
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
        found.append(np.frombuffer(column.buffers()[2], kind)[ends[0] : ends[-1]].astype(np.int64))
    many = np.diff(ends)
    return [np.repeat(batch.column(c).to_numpy().astype(np.int64), many) for c in ("h", "shape_class")] + found


def best_classes(of: np.ndarray, side: np.ndarray, cls: np.ndarray, n: np.ndarray, now: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class of each word by one step of exchange against a table of class bigrams that holds them all.

    Entries (of, side, cls, n), sorted by ``of`` and distinct, say that word ``of`` has n neighbours of class ``cls`` before (side 0) or after it (side 1).
    ``now`` is the class that each word is in. Of classes as good the present one stays, then the first is taken.
    """
    words, k = len(now), len(pairs)
    starts = np.searchsorted(of, np.arange(words))
    own = now[of]
    held = np.where(side == 0, pairs[cls, own], pairs[own, cls])
    stay = np.add.reduceat(_xlogx(held) - _xlogx(np.maximum(held - n, 0)), starts)  # as if it came back to where it is
    gain = np.zeros((words, k), np.float64)
    f, both = _xlogx(pairs), (pairs, np.ascontiguousarray(pairs.T))
    few = 8
    small = [np.stack([_xlogx(x + j) - _xlogx(x) for j in range(few + 1)]) for x in both]  # of counts up to few: looked up
    a = 0
    while a < words:  # some 16384 entries at a time; a word has 256 at most
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + 16_384)))
        lo, hi = int(starts[a]), int(starts[b]) if b < words else len(of)
        s, c, m = side[lo:hi], cls[lo:hi], n[lo:hi]
        more = np.empty((hi - lo, k))
        for which in (0, 1):
            little = np.flatnonzero((s == which) & (m <= few))
            more[little] = small[which][m[little], c[little]]
            lots = np.flatnonzero((s == which) & (m > few))
            more[lots] = _xlogx(both[which][c[lots]] + m[lots, None]) - (f if which == 0 else f.T)[c[lots]]
        gain[a:b] = np.add.reduceat(more, starts[a:b] - lo, axis=0)
        a = b
    for which, total in ((0, pairs.sum(axis=0)), (1, pairs.sum(axis=1))):
        seen = np.add.reduceat(np.where(side == which, n, 0), starts).astype(np.float64)
        gain -= _xlogx(total[None, :] + seen[:, None]) - _xlogx(total)[None, :]
        stay -= _xlogx(total[now]) - _xlogx(np.maximum(total[now] - seen, 0))
    gain[np.arange(words), now] = stay
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(words), best] > stay + 1e-9, best, now)


def _exchange_words(pairs: np.ndarray):
    """Rows of _by_word() in order of h to (h, class) of the words with MIN_COUNT occurrences and more. A word may have many rows, and a code may come again."""

    def settle(h, now, code, n) -> pa.RecordBatch:
        single = code >> 14 == 1
        key = np.concatenate([h, h[~single]])
        side = np.concatenate([np.where(single, (code >> 7) & 1, 0), np.ones(int((~single).sum()), np.int64)])
        cls = np.concatenate([np.where(single, code & 127, code >> 7), code[~single] & 127])
        count = np.concatenate([n, n[~single]])
        names, of = np.unique(key, return_inverse=True)
        seen = np.bincount(of, weights=np.where(side == 0, count, 0))
        kept = seen >= MIN_COUNT
        rank = np.cumsum(kept) - 1
        there = kept[of]
        entry, place = np.unique((rank[of[there]] << 8) | (side[there] << 7) | cls[there], return_inverse=True)
        total = np.bincount(place, weights=count[there]).astype(np.int64)
        first = np.searchsorted(h, names[kept])
        best = best_classes(entry >> 8, (entry >> 7) & 1, entry & 127, total, now[first], pairs) if kept.any() else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[kept]), pa.array(best.astype(np.int16))], names=["h", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _entries(batch)
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1], side="left"))  # the last word may go on in the next batch
            if last > 1 << 16:
                yield settle(*(c[:last] for c in columns))
                held = [c[last:] for c in columns]
            else:
                held = columns
            if len(held[0]) > 1 << 18 and held[0][0] == held[0][-1]:  # one word: no more entries than codes
                codes, which = np.unique(held[2], return_inverse=True)
                held = [held[0][: len(codes)], held[1][: len(codes)], codes, np.bincount(which, weights=held[3]).astype(np.int64)]
        if held is not None:
            yield settle(*held)

    return run


def _class_of_shape(column: str, classes: np.ndarray) -> Column:
    return F.element_at(F.array(*[F.lit(int(c)) for c in classes]), (_shape_column(column) + 1).cast("int"))


def cluster(docs: DataFrame, text_col: str = "text", classes: int = CLASSES, passes: int = PASSES) -> Lexicon:
    """Counts and classes of the words of all whole texts; null texts are empty. An empty table gives a lexicon without words."""
    if not 0 < classes <= 128:
        raise ValueError("there are 128 classes at most")
    spark = docs.sparkSession
    counts = C.materialize(word_counts(docs, text_col), "counts")
    v = vocabulary(counts)
    sent = spark.sparkContext.broadcast(v)
    rows = docs.select(C.text_of(text_col).alias("text"))
    unit_pairs = rows.mapInArrow(_count_pairs(sent), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    k = min(classes, v.units)
    # at most units ** 2 rows, whatever the corpus
    fitted = unit_pairs.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(_cluster(v.units, k, passes), "kind int, at bigint, value bigint").toPandas()
    unit_classes, n = np.zeros(v.units, np.int64), np.zeros(k * k)
    for kind, out in ((0, unit_classes), (1, n)):
        part = fitted[fitted["kind"] == kind]
        out[part["at"].to_numpy()] = part["value"].to_numpy()
    shape_classes = unit_classes[1 + v.core :]
    near = rows.mapInArrow(_neighbours(sent, unit_classes, DENSE), NEAR_SCHEMA)
    moved = near.repartition(C.partitions_of(spark), "h").sortWithinPartitions("h").mapInArrow(_exchange_words(n.reshape(k, k)), "h bigint, class smallint")
    named = counts.select("word", "c", F.xxhash64("word").alias("h"))
    core = spark.createDataFrame([(bytearray(w), int(c)) for w, c in zip(v.words[: 1 + v.core], unit_classes, strict=False)], "word binary, core_class int")
    table = named.join(moved, "h", "left").join(F.broadcast(core), "word", "left").select("word", "c", F.coalesce("core_class", F.col("class").cast("int")).alias("class"))
    table = C.materialize(table, "lexicon")
    own = np.zeros(len(v.words), np.int64)
    if v.words:
        place, unit = v.indexed()
        own[:] = unit_classes[unit]
        least = int(v.counts[1:].min()) if len(v.words) > 1 else 0
        for r in table.filter((F.col("c") >= least) & F.col("class").isNotNull()).select("word", "class").collect():  # the head again: at most HEAD words and the end
            if (at := place.get(bytes(r.word))) is not None:
                own[at] = r["class"]
    distinct = np.zeros(k, np.int64)
    for r in table.groupBy(F.coalesce("class", _class_of_shape("word", shape_classes)).alias("class")).count().collect():  # a row for each class
        distinct[r["class"]] = r["count"]
    return Lexicon(v, own, shape_classes, distinct, table)


PART_SCHEMA = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, mass double, classes binary, word binary, pos int"
SEQUENCE_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, mass double, classes binary"


def _encode(sent, classes: np.ndarray, shape_classes: np.ndarray, slice_rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, place, unit = _index(sent)
        log_of = np.append(np.log10(v.counts + ADD), 0.0)  # 0 for words that are not in the head
        for whole in batches:
            for a in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(a, slice_rows)
                words, at, units, ends = _sequence(batch.column(3).to_pylist(), place, unit, 1 + v.core)
                known = at >= 0
                cls = shape_classes[np.maximum(units - 1 - v.core, 0)]
                cls[known] = classes[at[known]]
                begins = np.concatenate([[0], ends[:-1]])
                far = np.flatnonzero(~known)
                doc = np.searchsorted(ends, far, side="right")
                n, r = len(ends), len(far)
                known_of, mass = np.add.reduceat((known & (v.counts[at] > 0)).astype(np.int64), begins), np.add.reduceat(log_of[at], begins)
                raw = cls.astype(np.uint8).tobytes()
                sequences = [raw[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                row = batch.column(0).to_numpy()
                columns = [pa.concat_arrays([x, pa.nulls(r, x.type)]) for x in (batch.column(1), batch.column(2), pa.array(ends - begins), pa.array(known_of), pa.array(mass), pa.array(sequences, pa.binary()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([row, row[doc]])), *columns, pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([words[k] for k in far.tolist()], pa.binary())]),
                     pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array((far - begins[doc]).astype(np.int32))])],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "mass", "classes", "word", "pos"],
                )

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that were looked up go to their places; ``found`` is a list of pos * 128 + class."""
    for batch in batches:
        filled = []
        for raw, found in zip(batch.column("classes"), batch.column("found"), strict=True):
            if found.is_valid and len(found):
                cls, codes = np.frombuffer(raw.as_py(), np.uint8).copy(), found.values.to_numpy()
                cls[codes >> 7] = codes & 127
                filled.append(cls.tobytes())
            else:
                filled.append(raw.as_py())
        names = [x for x in batch.schema.names if x not in ("classes", "found")]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(filled, pa.binary())], names=[*names, "classes"])


def encode(docs: DataFrame, lexicon: Lexicon, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, mass (sum of log10 of each token's count + ADD), classes (a byte a token) of every whole text, materialized."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon.vocabulary)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), C.text_of(text_col).alias("text"))
    parts = C.materialize(rows.mapInArrow(_encode(sent, lexicon.classes, lexicon.shape_classes), PART_SCHEMA), "parts")
    far = parts.filter("word is not null").select("row", "pos", "word").join(lexicon.table, "word", "left")
    place = F.when(F.col("class").isNotNull(), F.col("pos").cast("bigint") * 128 + F.col("class"))  # nulls are left out of the list
    found = far.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("more"), F.count("c").alias("more_known"), F.collect_list(place).alias("found"))
    joined = parts.filter("word is null").join(found, "row", "left")
    known, mass = F.col("n_known") + F.coalesce("more_known", F.lit(0)), F.col("mass") + F.coalesce("more", F.lit(0.0))
    done = joined.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), mass.alias("mass"), "classes", "found").mapInArrow(_fill, SEQUENCE_SCHEMA)
    return C.materialize(done, "sequences")


def _count_classes(k: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(k * k, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                cls = np.frombuffer(raw.as_py(), np.uint8).astype(np.int64)
                seen += np.bincount(np.concatenate([[end], cls[:-1]]) * k + cls, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(seen)], names=["pair", "n"])

    return run


@dataclass
class Model:
    transition: np.ndarray  # log10 P(class | class before)
    denominator: np.ndarray  # log10 of what a word's count + ADD is divided by in its class
    base: float  # the same for the add-half unigram
    end: int  # class of the end token
    total: int


def estimate(pairs: np.ndarray, lexicon: Lexicon) -> Model:
    """Probabilities from the class bigrams: transitions with a prior of PRIOR tokens spread as the classes are, emissions with ADD for each word and one unknown."""
    v, k = lexicon.vocabulary, len(pairs)
    share = (pairs.sum(axis=0) + ADD) / (pairs.sum() + ADD * k)
    transition = np.log10((pairs + PRIOR * share[None, :]) / (pairs.sum(axis=1, keepdims=True) + PRIOR))
    denominator = np.log10(pairs.sum(axis=0) + ADD * (lexicon.distinct + 1))
    return Model(transition, denominator, math.log10(v.total + ADD * (v.distinct + 1)), int(lexicon.classes[0]) if v.words else 0, v.total)


def train(sequences: DataFrame, lexicon: Lexicon) -> Model:
    """The model from the encoded texts that it may learn from; what comes to the driver is a row for each pair of classes."""
    k = len(lexicon.distinct)
    end = int(lexicon.classes[0]) if lexicon.vocabulary.words else 0
    pairs = np.zeros(k * k)
    for r in sequences.select("classes").mapInArrow(_count_classes(k, end), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    return estimate(pairs.reshape(k, k), lexicon)


def _score(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mass, out = batch.column("mass").to_numpy(), []
            for raw, known in zip(batch.column("classes"), mass.tolist(), strict=True):
                cls = np.frombuffer(raw.as_py(), np.uint8)
                out.append(known + float((m.transition[np.concatenate([[m.end], cls[:-1]]), cls] - m.denominator[cls]).sum()))
            names = ["doc_id", "held_out", "n_tokens", "n_known"]
            base = mass - batch.column("n_tokens").to_numpy() * m.base
            total = pa.array(np.full(batch.num_rows, m.total, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), total, pa.array(base), pa.array(out, pa.float64())], names=[*names, "train_tokens", "base_score", "score"])

    return run


def score(sequences: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every encoded text.

    ``base_score`` is the add-half unigram, ``score`` the class model, both sums of log10 probabilities over all tokens. An empty text is one end
    token. Rows that repeat are each scored; an empty table gives no rows.
    """
    return sequences.mapInArrow(_score(model), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
