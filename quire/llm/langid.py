"""Language identification by cross-parsing entropy.

The labelled sample text of a language goes into a suffix automaton. A text is parsed into phrases, each the longest match with the sample
from where the last phrase ended (one symbol where nothing matches). A phrase costs the logarithm of the sample's length: the language with
the least cost for the text wins. The most frequent letters of the samples are symbols, any other letter is written as five symbols of its own, so no two
letters are one. Automata are dense tables over 64 symbols, and a batch of texts goes through them side by side, one symbol a step. Long texts are
cut into blocks that are parsed side by side too; then each block is parsed from the state that the one before it left until both parses agree, so
the phrases are those of the whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _common as C

#: The labelled sample: documents and symbols of a language, and symbols of all languages, at most. With more than 32 languages each has fewer symbols.
SAMPLE_DOCS, SAMPLE_SYMBOLS, ALL_SYMBOLS = 64, 16_000, 512_000
#: Symbols; those at the end are digits to base 16, five of which write a letter that has no symbol. Symbols that are parsed in one go.
SYMBOLS, DIGITS, BLOCK = 64, 16, 2048
#: Bytes of the texts that samples are taken from first.
SAMPLE_BYTES = (40, 40_000)
UNDETERMINED = "und"
_RARE = 255  # in the table of symbols: a letter that is written with digits; symbol 0 stands for all that is between letters


class Automaton:
    """Dense suffix automaton: ``table[state * SYMBOLS + symbol]`` is the next state, with FAIL set where a new phrase begins."""

    FAIL = 1 << 15

    def __init__(self, sequence: list[int]):
        if 2 * len(sequence) >= self.FAIL:
            raise ValueError("a sample is too long")
        nexts, link, length, last = [{}], [-1], [0], 0
        for symbol in sequence:
            now = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in nexts[at]:
                nexts[at][symbol] = now
                at = link[at]
            if at >= 0:
                target = nexts[at][symbol]
                if length[target] == length[at] + 1:
                    link[now] = target
                else:
                    twin = len(nexts)
                    nexts.append(dict(nexts[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    while at >= 0 and nexts[at].get(symbol) == target:
                        nexts[at][symbol] = twin
                        at = link[at]
                    link[target] = link[now] = twin
            last = now
        table = np.empty((len(nexts), SYMBOLS), np.uint16)
        restart = np.full(SYMBOLS, self.FAIL, np.uint16)
        for symbol, state in nexts[0].items():
            restart[symbol] = state | self.FAIL
        table[:] = restart
        for state, edges in enumerate(nexts):
            if state:  # whatever leaves the root begins a phrase
                for symbol, target in edges.items():
                    table[state, symbol] = target
        self.table = table.reshape(-1)
        self.bits = math.log2(max(2, len(sequence)))


class Model:
    def __init__(self, samples: dict[str, list[str]], most: int | None = None, block: int = BLOCK):
        self.languages, self.block = sorted(samples), block
        if most is None:
            most = symbols_of_each(len(samples))
        # the alphabet: the letters that are most frequent in the languages, each with a symbol of its own
        seen: Counter = Counter()
        for texts in samples.values():
            own = Counter(c for t in texts for c in t.lower() if c.isalpha())
            for c, n in own.items():
                seen[c] += n / own.total()
        self.symbol_of = np.array([_RARE if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint8)
        for k, c in enumerate(sorted(seen, key=lambda c: (-round(seen[c], 12), c))[: SYMBOLS - DIGITS - 1]):
            self.symbol_of[ord(c)] = k + 1
        self.automata = []
        for language in self.languages:
            sequence: list[int] = []
            for text in samples[language]:
                sequence += [0, *self.symbols([text[: 2 * most]])[0].tolist()]
                if len(sequence) >= most:
                    break
            self.automata.append(Automaton(sequence[:most]))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, runs of non-letters as one; where each text ends; letters in each."""
        lower = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, lower), np.int64, len(lower))
        points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.symbol_of[points]
        ends = np.cumsum(sizes)
        keep = np.ones(len(symbol), bool)
        keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0)
        begins = (ends - sizes)[sizes > 0]
        keep[begins] = symbol[begins] != 0  # no gap at a text's start
        counts = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], ends])])
        letters = counts(symbol != 0)
        width = keep + 4 * (symbol == _RARE)
        symbol, lengths = symbol[keep], counts(width)
        rare = np.flatnonzero(symbol == _RARE)
        if len(rare):
            point, each = points[keep][rare].astype(np.int64), np.ones(len(symbol), np.int64)
            each[rare] = 5
            first = (np.cumsum(each) - each)[rare]
            symbol = np.repeat(symbol, each)
            for k in range(5):
                symbol[first + k] = SYMBOLS - DIGITS + ((point >> (4 * (4 - k))) & 15)
        return symbol, np.cumsum(lengths), letters

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) against each language (columns), and its letters."""
        symbol, ends, letters = self.symbols(texts)
        sizes = np.diff(np.concatenate([[0], ends]))
        blocks = -(-sizes // self.block)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (ends - sizes)[owner] + nth * self.block
        length = np.minimum(sizes[owner] - nth * self.block, self.block)
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        if not len(owner):
            return found, letters
        order = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[order], -np.arange(length.max()), side="left")  # blocks that are longer than each step
        states = [np.zeros(len(owner), np.uint16) for _ in self.automata]  # in that order
        fails = [np.zeros(len(owner), np.int64) for _ in self.automata]
        at = begin[order]
        for step in range(len(live)):
            n = live[step]
            now = symbol[at[:n] + step].astype(np.int32)
            for automaton, state, fail in zip(self.automata, states, fails, strict=True):
                to = automaton.table[state[:n].astype(np.int32) * SYMBOLS + now]
                fail[:n] += to >> 15
                state[:n] = to & 0x7FFF
        for k, automaton in enumerate(self.automata):
            end_state, fail = np.empty_like(states[k]), np.empty_like(fails[k])
            end_state[order], fail[order] = states[k], fails[k]
            fail += _mend(automaton.table, symbol, begin, length, nth, end_state)
            found[:, k] = np.bincount(owner, weights=fail, minlength=len(texts)).astype(np.int64)
        return found, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, letters = self.phrases([t or "" for t in texts])
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cost = found * np.array([a.bits for a in self.automata])
        best = cost.argmin(axis=1)  # of equals the first language by name
        likely = 1.0 / np.exp2(np.maximum(cost.min(axis=1, keepdims=True) - cost, -1000.0)).sum(axis=1)
        known = letters > 0
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, likely, 0.0)


def _mend(table: np.ndarray, symbol: np.ndarray, begin: np.ndarray, length: np.ndarray, nth: np.ndarray, end_state: np.ndarray) -> np.ndarray:
    """What the phrases of each block change by if it goes on from the end of the block before it instead of beginning anew; end states are put right.

    Both parses of a block go side by side until they are in one state. A block that ends before they are gives the next one another beginning.
    """
    change, anew = np.zeros(len(begin), np.int64), end_state.copy()
    todo = np.flatnonzero(nth > 0)
    while len(todo):
        fresh, true = np.zeros(len(todo), np.int32), end_state[todo - 1].astype(np.int32)
        more = np.zeros(len(todo), np.int64)
        live, step = np.flatnonzero(true != 0), 0
        late = []  # blocks that ended apart
        while len(live):
            over = step >= length[todo[live]]
            late += live[over].tolist()
            live = live[~over]
            now = symbol[begin[todo[live]] + step].astype(np.int32)
            a, b = table[fresh[live] * SYMBOLS + now], table[true[live] * SYMBOLS + now]
            more[live] += (b >> 15).astype(np.int64) - (a >> 15)
            fresh[live], true[live] = a & 0x7FFF, b & 0x7FFF
            live, step = live[fresh[live] != true[live]], step + 1
        change[todo] = more
        ended = anew[todo]
        ended[late] = true[late]
        moved = todo[end_state[todo] != ended]
        end_state[todo] = ended
        after = moved + 1
        todo = after[after < len(nth)]
        todo = todo[nth[todo] > 0]
    return change


def symbols_of_each(languages: int) -> int:
    return min(SAMPLE_SYMBOLS, max(16, ALL_SYMBOLS // max(1, languages)))


def sample_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 5, most: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Sample texts of each language, by a hash of the id: at most ``most`` documents a language, and symbols_of_each() symbols of them are learned.

    Texts of SAMPLE_BYTES come first; others, the longer ones cut, fill up what a language lacks, so that each language with a text is learned.
    Of the window only the first rows of each language leave a task (a group limit), so a frequent language is no hot key. Texts are cut to twice the symbols
    that are learned, so what comes to the driver is bounded by ALL_SYMBOLS, whatever the number of languages. Of rows that repeat an id and a language one text is taken.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), C.text_of(text_col).alias("text"))
    rows = rows.withColumn("odd", ~F.octet_length("text").between(*SAMPLE_BYTES))
    known = rows.filter("lang is not null and id is not null and text != ''").select("id", "lang", "odd")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("odd", F.xxhash64("id", F.lit(seed)), "id"))
    chosen = known.withColumn("nth", rank).filter(F.col("nth") <= most)
    chosen = C.materialize(chosen.groupBy("lang", "id").agg(F.min("nth").alias("nth")), "sample")
    languages = chosen.select("lang").distinct().count()
    cut = 2 * symbols_of_each(languages)
    sent = F.broadcast(chosen) if languages <= ALL_SYMBOLS // SAMPLE_SYMBOLS else chosen
    texts = rows.filter("text != ''").select("id", "lang", F.left("text", F.lit(cut)).alias("text")).join(sent, ["id", "lang"])
    out: dict[str, list[str]] = {}
    for r in texts.groupBy("lang", "nth").agg(F.min("text").alias("text")).orderBy("lang", "nth").collect():  # bounded by the sample
        out.setdefault(r.lang, []).append(r.text)
    return {k: _until(v, cut) for k, v in out.items()}


def _until(texts: list[str], most: int) -> list[str]:
    """Texts until they have so many characters."""
    out, n = [], 0
    for t in texts:
        if n >= most:
            break
        out.append(t)
        n += len(t)
    return out


_MODELS: dict[int, Model] = {}


def _predict(samples_of, key: int, slice_rows: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(samples_of.value)
        model = _MODELS[key]
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                languages, scores = model.predict(batch.column("q_text").to_pylist())
                kept = [batch.column(c) for c in batch.schema.names if c != "q_text"]
                names = [c for c in batch.schema.names if c != "q_text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(languages, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, samples: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text, also very long ones: ``und`` and 0 if it is null or has no letter (or nothing was learned).

    Of languages that cost the same the first by name wins. Rows that repeat are each predicted; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    rows = docs.select(F.col(id_col).alias("doc_id"), C.text_of(text_col).alias("q_text"))
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double"
    return rows.mapInArrow(_predict(sent, hash(str(sorted((k, tuple(v)) for k, v in samples.items())))), schema)


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents that have a language, all their columns; where the label is null it is filled with the prediction.

    Learns from the labelled documents of the table itself. Texts that are null or have no letter go. The prediction is made in place of
    a join: the columns go through the worker and come back as they were.
    """
    from pyspark.sql import types as T

    samples = sample_texts(docs, id_col, text_col, lang_col)
    if not samples:  # nothing to learn from: what has a letter stays as it is
        return docs.filter(C.text_of(text_col).rlike(r"\p{L}"))
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    inside = C.fresh(docs, "q_row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(inside), C.text_of(text_col).alias("q_text"))
    schema = T.StructType([rows.schema[inside], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    done = rows.mapInArrow(_predict(sent, hash(str(sorted((k, tuple(v)) for k, v in samples.items())))), schema).filter(F.col("lang_pred") != UNDETERMINED)
    columns = [F.col(f"{inside}.`{c}`").alias(c) for c in docs.columns]
    filled = F.coalesce(F.col(f"{inside}.`{lang_col}`"), F.col("lang_pred"))
    return done.select(*[filled.alias(c) if c == lang_col else x for c, x in zip(docs.columns, columns, strict=True)])
