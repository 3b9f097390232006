import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import _common as C
from quire.llm.packing import BestFit, pack, pack_documents, pieces
from quire.llm.queries import tokenizer_path
from quire.llm.tokens import Encoder, slices_by_bytes, token_digests, write_tokens


def plain(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


FUZZ = "aAb \n\t\r  '’sé́İΣß中0१½\u2003\xa0\x1c\x85😀.,!<|endoftext|>\x00~rvelmdt각"


def split_ids(encoded):
    ids, n = encoded
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    r = random.Random(1)
    texts = ["".join(r.choices(FUZZ, k=r.randint(0, 40))) for _ in range(6000)] + ["it's we'll I'D", "a   b ", "x\n y", " \n a", "a\tb c\t \t", "<|endoftext|>", "w" * 500, "'s's 'tis ''s !'s 're'll'verb 'r 'l", ""]
    encoder, encode = Encoder(tokenizer_path(name)), plain(name)
    for _ in range(2):  # met for the first time, and remembered
        assert split_ids(encoder.encode(texts)) == [encode(t) for t in texts]
    assert [len(x) for x in encoder.encode([])] == [0, 0] and encoder.encode([None, ""])[1].tolist() == [0, 0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memory_of_an_encoder_is_bounded(name):
    encoder, encode = Encoder(tokenizer_path(name), cache_units=3000, slice_bytes=5000), plain(name)
    for k in range(3):  # many new words at once, again some of those before, longer ones than are remembered
        texts = [" ".join(f"word{k}x{i}y{j} " + "long" * 30 for i in range(400)) for j in range(10)] + [" ".join(f"word{k - 1}x{i}y0" for i in range(3000))]
        assert split_ids(encoder.encode(texts)) == [encode(t) for t in texts]
        assert len(encoder.young) <= 1500 and len(encoder.old) <= 1500
        assert max(map(len, [*encoder.young, *encoder.old])) <= 64


def test_slices_by_bytes():
    texts = ["a" * n for n in (5, 0, 3, 100, 1, 1, 99)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([*texts, None, "b"])], names=["i", "t"])
    found = [s.column(1).to_pylist() for s in slices_by_bytes(batch, 1, 10)]
    assert sum(found, []) == [*texts, None, "b"]
    assert all(len(s) == 1 or sum(len(t or "") for t in s) <= 10 for s in found)


def test_store_round_trip(spark, docs, corpus):
    store = write_tokens(docs, C.scratch_path(spark, "t"), tokenizer_path("byte_bpe_50k.json"))
    encode = plain("byte_bpe_50k.json")
    order = sorted(corpus, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    expected, start = [], 0
    for row in order:
        ids = [*encode(row[1]), 0]
        expected.append((row[0], start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted(map(tuple, token_digests(store).collect()), key=lambda x: x[1])
    assert got == expected
    one = store.read().filter("doc_id = 203").select("ids").first().ids
    assert one == [*encode(corpus[93][1]), 0]


def test_store_files_have_page_indexes_and_dictionaries(spark, docs):
    import glob

    import pyarrow.parquet as pq

    store = write_tokens(docs, C.scratch_path(spark, "t"), tokenizer_path("byte_bpe_50k.json"))
    for f in glob.glob(store.path.removeprefix("file://") + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        ids = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if "ids" in meta.row_group(0).column(i).path_in_schema)
        assert ids.has_dictionary_page and meta.row_group(0).column(0).has_offset_index


def test_empty_store(spark, empty):
    assert token_digests(write_tokens(empty, C.scratch_path(spark, "t"), tokenizer_path("byte_bpe_50k.json"))).collect() == []


def test_best_fit_places_and_closes():
    r = random.Random(2)
    fit, used = BestFit(100, open_bins=4), {}
    for _ in range(3000):
        n = r.randint(1, 100)
        b, at = fit.place(n)
        assert used.get(b, 0) == at and at + n <= 100
        used[b] = at + n
        assert fit.open <= 4 and fit.open == sum(map(len, fit.by_space))
    fit = BestFit(10, open_bins=2)
    assert [fit.place(n) for n in (6, 8, 2, 3, 9)] == [(0, 0), (1, 0), (1, 8), (0, 6), (2, 0)]
    assert fit.place(9)[0] == 3 and fit.open == 2  # bins 0 (1 free) and 2 (1 free) were open: one of the fullest was closed
    with pytest.raises(ValueError):
        fit.place(11)


def test_packing(spark, docs, corpus):
    got = [r.asDict() for r in pack_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()]
    encode = plain("word_bpe_49k.json")
    expected = []
    for row in corpus:
        ids = [*encode(row[1]), 1]
        expected += [(row[0], k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096)]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted([(g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got], key=key) == sorted(expected, key=key)
    assert all(crc(g["ids"]) == g["ids_crc32"] for g in got)
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(g["length"] for g in got) // 4096)


def test_packing_nothing(empty):
    assert pack_documents(empty, tokenizer_path("word_bpe_49k.json")).collect() == []


def test_many_packers_stay_near_the_bound(spark):
    lengths = spark.range(6000).selectExpr("id as doc_id", "id as row", "0 as piece", "0L as start", "1 + pmod(xxhash64(id), 3000) as length", "0L as ids_crc32", "array(1) as ids")
    cut = C.materialize(lengths, "l")
    got = pack(cut, packer_pieces=1500).toPandas()
    assert len(got) == 6000 and got.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 4096)


def test_pieces_without_ids(docs):
    assert pieces(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False).filter("size(ids) > 0").count() == 0
