import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import _common as C
from quire.llm.exact_dedup import digests, drop_duplicates, exact_dedup, frequent, merge_summary
from quire.llm.warc import base32_of_hex, write_archive


@pytest.mark.parametrize("k", [2, 1000])
def test_groups_and_winners(docs, corpus, k):
    got = exact_dedup(C.materialize(digests(docs), "d"), k).collect()
    groups = defaultdict(list)
    for row in corpus:
        groups[row[1] or ""].append(row[0])
    assert len(got) == len(corpus)
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(bytes(r.digest) for r in got if r.kept) == Counter(dict.fromkeys(by_digest, 1))


def test_drop_duplicates_keeps_columns(docs, corpus):
    got = drop_duplicates(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({r[1] or "" for r in corpus})
    assert {r.doc_id for r in rows if r.text == corpus[5][1]} == {129}


def test_nothing(empty):
    assert exact_dedup(C.materialize(digests(empty), "d")).count() == 0 and drop_duplicates(empty).count() == 0


def test_summary_has_every_frequent_key():
    stream = [b"a"] * 400 + [bytes([k % 250]) * 2 for k in range(500)] + [b"b"] * 300
    counters = {}
    for at in range(0, len(stream), 60):
        counters = merge_summary(counters, Counter(stream[at : at + 60]), 5)
        assert len(counters) <= 5
    assert counters[b"a"] <= 400 and counters[b"b"] <= 300 and {b"a", b"b"} <= set(counters)


def test_frequent_is_bounded(docs):
    assert frequent(digests(docs), 3).count() <= 3


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://a/{k % 7}", "<p>same</p>" if k % 3 == 0 else f"<p>{k}</p>") for k in range(40)]
    rows += [(90, None, None), (91, "http://x y\r\nz", ""), (None, "u", "<p>same</p>"), (None, "u", "only"), (5, "again", "<p>5</p>"), (92, "é", "ü" * 5000)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))


def test_archive_round_trip(spark, pages):
    rows, df = pages
    archive = write_archive(df, C.scratch_path(spark, "w"))
    payloads = [(r[2] or "").encode() for r in rows]
    assert archive.payloads.count() == len(set(payloads))
    records = archive.reconstruct().collect()
    assert sorted((r.page_id if r.page_id is not None else -1, bytes(r.payload)) for r in records) == sorted((r[0] if r[0] is not None else -1, p) for r, p in zip(rows, payloads, strict=True))
    for r in records:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n") and int(fields[b"Content-Length"]) == len(block) - 4
        assert block[:-4] == (b"" if fields[b"WARC-Type"] == b"revisit" else bytes(r.payload))


def test_catalogue(spark, pages):
    import base64

    rows, df = pages
    got = write_archive(df, C.scratch_path(spark, "w")).catalogue().collect()
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[2] or ""] = min(first.get(r[2] or "", r[0]), r[0])
    assert len(got) == len(rows)
    text = {r[0]: r[2] or "" for r in rows if r[0] is not None}
    for g in got:
        if g.page_id is None:
            continue
        t = text[g.page_id]
        assert g.payload_bytes == len(t.encode()) and g.payload_digest == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        assert g.refers_to == (first[t] if g.record_type == "revisit" else None)
        assert g.record_type == "revisit" or first[t] == g.page_id
    assert sum(g.record_type == "response" for g in got) == len({r[2] or "" for r in rows})


def test_small_payloads_are_responses(spark, pages):
    got = write_archive(pages[1], C.scratch_path(spark, "w"), least_bytes=100).catalogue()
    assert got.filter("record_type = 'revisit'").count() == 0


def test_damage_is_found(spark, pages):
    archive = write_archive(pages[1], C.scratch_path(spark, "w"))
    bad = archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))
    broken = type(archive)(spark, C.scratch_path(spark, "w"))
    bad.write.parquet(f"{broken.path}/payloads")
    archive.records.write.parquet(f"{broken.path}/records")
    with pytest.raises(Exception, match="differs from its digest"):
        broken.catalogue().collect()


def test_empty_archive(spark, empty):
    pages = empty.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert write_archive(pages, C.scratch_path(spark, "w")).catalogue().count() == 0


def test_base32(spark):
    import base64

    h = hashlib.sha1(b"x").hexdigest()
    assert spark.range(1).select(base32_of_hex(F.lit(h))).first()[0] == base64.b32encode(bytes.fromhex(h)).decode()
