"""The registered queries of this subpackage, opN_<name>, and their DuckDB equivalents where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _common as C


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.tokens import token_digests, write_tokens

    store = write_tokens(C.documents(spark, sf_dir), C.scratch_path(spark, "tokens"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_digests(store)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import write_archive

    return write_archive(C.documents(spark, sf_dir, "pages"), C.scratch_path(spark, "warc")).catalogue().drop("row")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.exact_dedup import digests, exact_dedup

    settled = exact_dedup(C.materialize(digests(C.documents(spark, sf_dir)), "digests"))
    return settled.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack_documents

    return pack_documents(C.documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).drop("row")


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.media import image_copies, paint

    # no table has a media column: the vectors of ``embeddings`` are painted as images
    found = image_copies(paint(C.documents(spark, sf_dir, "embeddings")))
    return found.select(F.col("image_id").alias("vec_id"), "n_corners", "class_id")


#: Rows with this remainder are held out of training (op6, op10: crc32 modulo 4; op9: modulo 5).
HELD_OUT_4, HELD_OUT_5 = 2, 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import score, train

    docs = C.documents(spark, sf_dir)
    labels = C.documents(spark, sf_dir, "labels").filter(C.remainder("doc_id", 4) != HELD_OUT_4)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (C.remainder("doc_id", 4) == HELD_OUT_4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix_documents

    mixed = mix_documents(C.documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import near_duplicates

    found = near_duplicates(C.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.brown_lm import cluster, encode, score, train

    docs = C.documents(spark, sf_dir)
    held_out = C.remainder("doc_id", 5) == HELD_OUT_5
    lexicon = cluster(docs.filter(~held_out))
    sequences = encode(docs, lexicon, held_out)
    return score(sequences, train(sequences.filter("not held_out"), lexicon))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.langid import predict, sample_texts

    docs = C.documents(spark, sf_dir)
    samples = sample_texts(docs.filter(C.remainder("doc_id", 4) != HELD_OUT_4))
    return predict(docs, samples).select("doc_id", (C.remainder("doc_id", 4) == HELD_OUT_4).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_warc_archive, op3_exact_dedup, op4_best_fit_packing, op5_image_copies, op6_toxicity, op7_source_mix, op8_simhash_near_dedup, op9_brown_lm, op10_language_id)}


#: SHA-1 in base 32 from its hex digits, five at a time.
_BASE32 = (
    "array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "1 + ((('0x' || substr(h, 1 + 5 * g::INT, 5))::BIGINT >> (15 - 5 * b::INT)) & 31)::INT, 1)), '')), '')"
)

ORACLES = {
    "op2_warc_archive": f"""
        with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
        q as (select page_id, strlen(t)::BIGINT as payload_bytes, {_BASE32} as payload_digest, min(page_id) over (partition by t) as first from p)
        select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id = first then null else first end as refers_to from q""",
    "op3_exact_dedup": """
        with g as (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size from documents group by 1)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(g.t) as text_sha256
        from documents d join g on coalesce(d.text, '') = g.t""",
}
