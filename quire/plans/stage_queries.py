"""Registered queries of the stages: which documents they take, messages, ground truth and sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import stages as S
from quire.plans import adapters as A
from quire.plans.registry import query

KNOWN = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
CLASSES = ["de", "en", "es"]


@query("with " + A.DOCUMENT_LOG + " select doc_id from dl where pages = 1 and can_map and doc_id in (select doc_id from labels)")
def stage_handwriting_documents(spark, sf_dir):
    """PRJ2: labelled documents stand for those with character boxes; each is given twice."""
    boxes = A.table(spark, sf_dir, "labels").select("doc_id")
    return S.handwriting_documents(A.document_log(spark, sf_dir), boxes.unionByName(boxes)).select("doc_id")


@query("with " + A.DOCUMENT_LOG + """ select doc_id, case when pages <> 1 then null when (n_handwriting > 0 and coalesce(n_hw_errors = 0, false)) or (n_visual > 0 and coalesce(n_ve_errors = 0, false)) then 'ocr' else 'copy' end as route,
    pages = 1 and ocr_found and coalesce(json_found and json_valid, false) as verified, pages = 1 and ocr_found as words_due, pages = 1 and n_visual > 0 as layout_due from dl""")
def stage_routes(spark, sf_dir):
    """PRJ3, PRJ4, PRJ5."""
    log = A.document_log(spark, sf_dir).withColumn("n_layout", F.col("n_visual"))
    return log.select("doc_id", S.ocr_route().alias("route"), S.verifiable().alias("verified"), S.word_boxes_due().alias("words_due"), S.layout_boxes_due().alias("layout_due"))


@query("with " + A.DOCUMENT_LOG + " select dl.doc_id, count(l.doc_id)::BIGINT as n_toxic from dl left join (select doc_id from labels where toxic = 1) l on l.doc_id = dl.doc_id where pages = 1 group by 1")
def stage_zero_counts(spark, sf_dir):
    """PRJ6: documents without a row of their own are logged with zero."""
    return S.stage_log(A.document_log(spark, sf_dir).filter(S.one_page()), A.table(spark, sf_dir, "labels").filter("toxic = 1"), "n_toxic")


@query("""
    with m as (select page_id, case when page_id % 5 = 0 then 'errored' when page_id % 13 > 0 then 'succeeded' end as kind, page_id % 7 = 0 as refused, case when page_id % 11 > 0 then html else '' end as r from pages),
    n as (select *, coalesce(kind = 'succeeded', false) and not refused as good, len(regexp_extract_all(r, '(?is)<!DOCTYPE html>.*?</html>')) as docs from m)
    select page_id as message_id, kind as result_type, (case when good then 2 else -1 end)::INT as expected, (case when good then docs else -1 end)::INT as found,
    case when good and docs > 0 then array_to_string([page_id || '_' || (i - 1) for i in range(1, docs + 1)], ' ') else '' end as doc_ids from n""")
def stage_message_log(spark, sf_dir):
    """PRJ7: pages as responses; of some the request failed, was refused or brought nothing."""
    at = F.col("page_id")
    messages = A.table(spark, sf_dir, "pages").select(
        at.alias("message_id"), F.when(at % 5 == 0, "errored").when(at % 13 > 0, "succeeded").alias("result_type"),
        F.when(at % 7 == 0, "refusal").when(at % 3 == 0, "").alias("error"), F.when(at % 11 > 0, F.col("html")).alias("response"),
    )
    return S.message_log(messages, 2).withColumn("doc_ids", F.array_join("doc_ids", " "))


@query("with " + A.LAYOUT + " select doc_id, (row_number() over (partition by doc_id order by elem) - 1)::INT as pos, 'LE-TEXT' as label, x0, y0, x2, y2 from bl")
def stage_layout_truth(spark, sf_dir):
    """PRJ9: layout boxes of a document as its ground truth."""
    boxes = A.layout(spark, sf_dir)[0]
    rows = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("elem", "label", "x0", "y0", "x2", "y2"))).alias("boxes"))
    truth = rows.select("doc_id", F.posexplode(S.layout_truth(F.col("boxes"))).alias("pos", "t"))
    return truth.select("doc_id", "pos", "t.label", *[F.col("t.bbox")[i].alias(name) for i, name in enumerate(("x0", "y0", "x2", "y2"))])


@query("""
    with l as (select *, (row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_linestatus) - 1)::INT as question_id from lineitem)
    select l_orderkey as doc_id, question_id, l_returnflag as question, l_linestatus as answer, 5::BIGINT as first, 4 + (l_linenumber % 3)::BIGINT as last from l where l_linenumber % 3 > 0""")
def stage_entity_questions(spark, sf_dir):
    """PRJ9: lines of an order as entities; every third has no box."""
    n = (F.col("l_linenumber") % 3).cast("bigint")
    places = F.when(n > 0, F.sequence(F.lit(5).cast("bigint"), 4 + n)).otherwise(F.array().cast("array<bigint>"))
    lines = A.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("value"), places.alias("bbox_indices")).alias("e"))
    rows = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list("e")).alias("entities"))
    asked = rows.select("doc_id", F.explode(S.entity_questions(F.col("entities"))).alias("q"))
    return asked.select("doc_id", "q.question_id", "q.question", F.col("q.answers")[0].alias("answer"), F.col("q.starts")[0].alias("first"), F.col("q.ends")[0].alias("last"))


@query(f"select c_custkey as doc_id, coalesce(bool_and(o_orderpriority in ({', '.join(map(repr, KNOWN))})), true) as known from customer left join orders on o_custkey = c_custkey group by 1")
def stage_labels_known(spark, sf_dir):
    """PRJ14: priorities of a customer's orders; customers without orders have no labels."""
    labels = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list("o_orderpriority").alias("labels"))
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")).join(labels, "doc_id", "left").select("doc_id", S.all_labels_known(F.col("labels"), KNOWN).alias("known"))


@query("""
    with a as (select doc_id, case doc_id % 5 when 0 then '{}' when 2 then '{"label": "' || coalesce(lang, 'x') || '", "kind": "en"}' when 3 then '{"kind": "en"}' when 4 then '[1' end as j from documents),
    l as (select doc_id, case when doc_id % 5 in (2, 3) then json_extract_string(j, '$.*')[1] end as label from a)
    select doc_id, label, coalesce(label in ('de', 'en', 'es'), false) as passed from l""")
def stage_class_truth(spark, sf_dir):
    """PRJ15: annotations with a class, empty, absent and broken."""
    kind = F.col("doc_id") % 5
    named = F.concat(F.lit('{"label": "'), F.coalesce("lang", F.lit("x")), F.lit('", "kind": "en"}'))
    annotation = F.when(kind == 0, "{}").when(kind == 2, named).when(kind == 3, '{"kind": "en"}').when(kind == 4, "[1")
    return A.table(spark, sf_dir, "documents").select("doc_id", S.class_truth(annotation, CLASSES).alias("t")).select("doc_id", "t.label", "t.passed")


@query("""
    select 'total_tasks' as measure, count(*)::BIGINT as n from part union all select 'words_generated', count(*) from orders where o_orderstatus <> 'F' union all select 'words_reused', count(*) from orders where o_orderstatus = 'F'
    union all select 'extraction_skips', count(*) from lineitem where l_linenumber = 1 union all select 'generation_errors', count(*) from lineitem where l_linenumber = 2 union all select 'sentence_exclusions', count(*) from lineitem where l_linenumber = 3""")
def stage_handwriting_summary(spark, sf_dir):
    """AGG28."""
    results = A.table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("skipped"))
    line = F.col("l_linenumber")
    logs = A.table(spark, sf_dir, "lineitem").select(F.when(line == 1, "extraction_skip").when(line == 2, "generation_error").when(line == 3, "sentence_exclusion").alias("kind"))
    return S.handwriting_summary(A.table(spark, sf_dir, "part"), results, logs)


@query("with " + A.DOCUMENT_LOG + " select count(*) filter (where pages = 1) as successful, count(*) filter (where pages > 1) as multi_page, count(*) filter (where doc_id % 23 = 0) as failed from dl")
def stage_render_summary(spark, sf_dir):
    """AGG29."""
    at = F.col("doc_id")
    return S.render_summary(A.document_log(spark, sf_dir).withColumn("render_error", F.when(at % 23 == 0, "timeout").when(at % 29 == 0, "")))


@query("""
    with s as (select l_linestatus as source, l_linenumber - 2 as cluster, count(*) as n from lineitem group by 1, 2), t as (select source, n, sum(n) over (partition by source) as total from s where cluster >= 0)
    select source, count(*)::BIGINT as n_clusters, round(-sum(n / total * ln(n / total)), 3) as entropy from t group by 1""")
def stage_cluster_overview(spark, sf_dir):
    """AGG30: line numbers as clusters, the first as noise."""
    points = A.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("source"), (F.col("l_linenumber") - 2).alias("cluster"))
    return S.cluster_overview(points, "source", "cluster")


@query("select source, doc_id, row_number() over (partition by source order by doc_id)::INT as place from documents qualify row_number() over (partition by source order by doc_id) <= 12")
def stage_first_of_group(spark, sf_dir):
    """SORT4."""
    return S.first_of_group(A.table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("select l_orderkey as idx, o_orderstatus as sample_id from lineitem join orders on o_orderkey = l_orderkey where l_quantity > 49")
def stage_rows_at(spark, sf_dir):
    """JOIN11: orders of large lines; an order may be drawn more than once."""
    ids = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("sample_id"))
    return S.rows_at(ids, A.table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("idx")))


@query(f"""
    with p as (select doc_id, case when doc_id % 3 = 0 then 'no such class' else lang end as t from documents),
    c as (select doc_id, coalesce(case t when 'de' then 0 when 'en' then 1 when 'es' then 2 end, floor({A.unit_sql('doc_id', salt='class')} * 3))::INT as place from p)
    select doc_id, place, (place = 0)::INT::DOUBLE as logit_0, (place = 1)::INT::DOUBLE as logit_1, (place = 2)::INT::DOUBLE as logit_2 from c""")
def stage_class_from_text(spark, sf_dir):
    """ARR13: languages with white space around them as generated classes; a third of them, and fr, are not among the labels."""
    text = F.when(F.col("doc_id") % 3 == 0, "no such class").otherwise(F.concat(F.lit(" \n"), F.col("lang"), F.lit("\t")))
    rows = A.table(spark, sf_dir, "documents").select("doc_id", S.class_from_text(text, CLASSES, "doc_id").alias("place"))
    hot = S.one_hot(F.col("place"), 3)
    return rows.select("doc_id", "place", *[hot[i].alias(f"logit_{i}") for i in range(3)])
