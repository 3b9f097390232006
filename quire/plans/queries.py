"""Registered queries over the shared tables, and the same in SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import boxes, elements, labels, metrics, order, sampling, stats, summary, vectors, verify
from quire.plans import adapters as A
from quire.plans import stage_queries  # noqa: F401  registers its own
from quire.plans.registry import ORACLES, QUERIES, query, rounded  # noqa: F401  read from here
from quire.sources import records, sinks
from quire.streaming import incremental


# --- HTML and JSON -------------------------------------------------------------------------------------------------------


@query("""
    select page_id, pos::INT as pos, length(doc)::INT as n_chars, md5(doc) as digest, regexp_matches(doc, '(?i)<script') as has_script
    from (select page_id, unnest(d) as doc, unnest(range(len(d))) as pos from (select page_id, regexp_extract_all(html, '(?is)<!DOCTYPE html>.*?</html>') as d from pages))""")
def page_doc_split(spark, sf_dir):
    """SRC1, STR4: one row for each HTML document of a response."""
    df = A.table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.html_documents(F.col("html"))).alias("pos", "doc"))
    return df.select("page_id", "pos", F.length("doc").alias("n_chars"), F.md5("doc").alias("digest"), F.col("doc").rlike("(?i)<script").alias("has_script"))


@query(r"""
    with p as (select page_id, regexp_replace(regexp_replace(html, '@page\s*\{[^}]*\}', '', 'g'), '(?is)^(.*?)</head>', '\1<style>@page{margin:0}</style></head>') as t from pages)
    select page_id, length(t)::INT as n_chars, md5(t) as digest from p""")
def page_prep_rewrite(spark, sf_dir):
    """STR6."""
    df = A.table(spark, sf_dir, "pages").select("page_id", T.print_ready(F.col("html"), "@page{margin:0}").alias("t"))
    return df.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(r"""
    with p as (select page_id, case when page_id % 4 = 0 then html when page_id % 4 = 1 then html || '<script type="application/json" id="GT"> {"q' || page_id || '": "a", "b": "c"} </script>'
        when page_id % 4 = 2 then html || '<SCRIPT id=''GT''>{bad</SCRIPT>' else html || '<script id="GT">' || chr(10) || '{}</script>' end as h from pages),
    g as (select page_id, case when regexp_matches(h, '(?is)<script[^>]*id=["'']GT["''][^>]*>(.*?)</script>') then regexp_replace(regexp_extract(h, '(?is)<script[^>]*id=["'']GT["''][^>]*>(.*?)</script>', 1), '^\s+|\s+$', '', 'g') end as gt from p)
    select page_id, gt is not null as found, coalesce(json_valid(gt), false) as valid, case when json_valid(gt) then len(json_keys(gt)) else 0 end::INT as n_entries from g""")
def page_gt_parse(spark, sf_dir):
    """STR5, JSN1: ground truth from a script: whether it is there, whether it parses, its entries."""
    k, html = F.col("page_id") % 4, F.col("html")
    made = F.when(k == 0, html).when(k == 1, F.concat(html, F.lit('<script type="application/json" id="GT"> {"q'), F.col("page_id").cast("string"), F.lit('": "a", "b": "c"} </script>')))
    made = made.when(k == 2, F.concat(html, F.lit("<SCRIPT id='GT'>{bad</SCRIPT>"))).otherwise(F.concat(html, F.lit('<script id="GT">\n{}</script>')))
    df = A.table(spark, sf_dir, "pages").select("page_id", T.gt_script(made).alias("gt")).withColumn("json", F.try_parse_json("gt"))
    keys = F.size(F.map_keys(F.from_json("gt", "map<string,string>")))
    return df.select("page_id", F.col("gt").isNotNull().alias("found"), F.col("json").isNotNull().alias("valid"), F.when(F.col("json").isNotNull(), keys).otherwise(0).alias("n_entries"))


@query(r"""
    with p as (select page_id, html, len(regexp_extract_all(html, '(?is)<!DOCTYPE html>.*?</html>')) as n from pages),
    q as (select page_id, n, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as t from p),
    e as (select page_id, t, case when n = 0 then 'no_document' when n > 1 then 'is_multipage' when t < 500 then 'no_text' else 'valid' end as error from q)
    select error, count(*) as total, sum(t)::BIGINT as n_chars, min(page_id) as first_page from e group by 1""")
def page_summary(spark, sf_dir):
    """The flagship query: pages to documents to the first check that fails, summed up."""
    html = F.col("html")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "(?is)<script.*?</script>", " "), "<[^>]*>", " "), r"\s+", " "))
    df = A.table(spark, sf_dir, "pages").select("page_id", F.size(T.html_documents(html)).alias("n"), F.length(plain).alias("t"))
    error = F.when(F.col("n") == 0, "no_document").when(F.col("n") > 1, "is_multipage").when(F.col("t") < 500, "no_text").otherwise("valid")
    return df.groupBy(error.alias("error")).agg(F.count("*").alias("total"), F.sum("t").alias("n_chars"), F.min("page_id").alias("first_page"))


_GEO = """'[{"id":"a","tag":"div","classes":"LE-TEXT x","rect":{"x":' || page_id % 90 || ',"y":2,"width":' || page_id % 5 || ',"height":4},"style":"width:' || page_id % 50 || 'mm;height:3.5cm;transform:rotate(-' || page_id % 30 || 'deg)","selectorTypes":["layout_element"]},{"id":"b","tag":"p","classes":"","rect":{"x":1,"y":2,"width":3,"height":0},"style":"width:10px","selectorTypes":["visual_element","layout_element"]}]'"""


@query(rf"""
    with g as (select page_id, unnest(from_json({_GEO}, '[{{"id":"VARCHAR","classes":"VARCHAR","rect":{{"x":"DOUBLE","y":"DOUBLE","width":"DOUBLE","height":"DOUBLE"}},"style":"VARCHAR","selectorTypes":["VARCHAR"]}}]')) as e from pages)
    select page_id, e.id as elem, case when coalesce(e.classes, '') = '' then 'no-class' when e.rect.width = 0 or e.rect.height = 0 then 'invalid-size' end as error,
        case when e.id = 'a' then (page_id % 50)::INT end as width_mm, case when e.id = 'a' then 35 end::INT as height_mm, case when e.id = 'a' then -(page_id % 30)::DOUBLE + 0.0 end as rotation, e.rect.x + e.rect.width as x2 from g""")
def geometry_elements(spark, sf_dir):
    """SRC9, PRJ16, STR10, STR11, GEO5: layout elements of geometry records with their errors and styles."""
    n = lambda k: (F.col("page_id") % k).cast("string")
    geo = F.concat(F.lit('[{"id":"a","tag":"div","classes":"LE-TEXT x","rect":{"x":'), n(90), F.lit(',"y":2,"width":'), n(5), F.lit(',"height":4},"style":"width:'), n(50), F.lit("mm;height:3.5cm;transform:rotate(-"), n(30),
                   F.lit('deg)","selectorTypes":["layout_element"]},{"id":"b","tag":"p","classes":"","rect":{"x":1,"y":2,"width":3,"height":0},"style":"width:10px","selectorTypes":["visual_element","layout_element"]}]'))
    e = A.table(spark, sf_dir, "pages").select("page_id", F.explode(records.elements(geo, "layout_element")).alias("e"))
    return e.select("page_id", F.col("e.id").alias("elem"), boxes.is_visible_error(F.col("e.classes"), F.col("e.rect.width"), F.col("e.rect.height")).alias("error"), T.style_millimetres(F.col("e.style"), "width").alias("width_mm"),
                    T.style_millimetres(F.col("e.style"), "height").alias("height_mm"), (T.rotation_degrees(F.col("e.style")) + 0.0).alias("rotation"), G.rect_box(F.col("e.rect"))["x2"].alias("x2"))


@query("with " + A.WORD_BOXES + """ select doc_id, idx, x0 || ',' || y0 || ',' || x2 || ',' || y2 || ',' || word || ',' || block_no || ',' || line_no || ',' || word_no as line, word as text, line_no from wb""")
def box_file_round_trip(spark, sf_dir):
    """SNK6, SRC7: box lines and the boxes read from them."""
    w = A.word_boxes(spark, sf_dir)
    line = records.box_line(*[F.col(c) for c in ("x0", "y0", "x2", "y2", "word", "block_no", "line_no", "word_no")])
    return w.select("doc_id", "idx", line.alias("line")).withColumn("b", records.parse_box(F.col("line"))).select("doc_id", "idx", "line", "b.text", "b.line_no")


# --- summaries -------------------------------------------------------------------------------------------------------


_CASE = "case " + " ".join(f"when {c} then '{n}'" for n, c in summary.CHECKS) + " end"


@query(f"with {A.DOCUMENT_LOG}, e as (select *, {_CASE} as error from dl) select coalesce(error, 'valid') as error, count(*) as total, sum(n_words)::BIGINT as n_words from e group by 1")
def doc_validity_cascade(spark, sf_dir):
    """PRJ1 to PRJ7, AGG2."""
    df = A.document_log(spark, sf_dir).withColumn("error", F.coalesce(summary.first_error(), F.lit("valid")))
    return df.groupBy("error").agg(F.count("*").alias("total"), F.sum("n_words").alias("n_words"))


@query(f"with {A.DOCUMENT_LOG}, e as (select doc_id, {_CASE} as error from dl) select error, count(*) as total, list_sort(list(doc_id)) as items from e where error is not null group by 1")
def error_groups_sorted(spark, sf_dir):
    """AGG3, SORT5."""
    return summary.groups_with_ids(A.document_log(spark, sf_dir).withColumn("error", summary.first_error()).filter("error is not null"), "error")


@query(f"""with {A.DOCUMENT_LOG}, v as (select * from dl where {_CASE} is null), t as (select case when n_handwriting > 0 then 'handwriting' else 'no_handwriting' end as category from v
    union all select case when n_visual > 0 then 'visual' else 'no_visual' end from v union all select 'both' from v where n_handwriting > 0 and n_visual > 0) select category, count(*) as total from t group by 1""")
def valid_categories(spark, sf_dir):
    """AGG4."""
    return summary.categories(A.document_log(spark, sf_dir).filter(summary.first_error().isNull()))


@query(f"""with {A.DOCUMENT_LOG} select count(*) as n, sum(case when n_words <> -1 then n_words end)::BIGINT as n_words_sum, round(sum(case when n_words <> -1 then n_words end) / count(*), 6) as n_words_mean, min(n_words) as n_words_min,
    greatest(max(n_words), 0) as n_words_max from dl where {_CASE} is null""")
def validity_counters(spark, sf_dir):
    """AGG5, AGG6."""
    return rounded(summary.counters(A.document_log(spark, sf_dir).filter(summary.first_error().isNull()), ["n_words"]), "n_words_mean")


@query(f"""with {A.DOCUMENT_LOG} select doc_id, list_filter([{", ".join(f"case when {c} then '{n}' end" for n, c in summary.CHECKS)}], lambda x: x is not null) as errors from dl""")
def all_errors(spark, sf_dir):
    """AGG2 with every failing check."""
    return A.document_log(spark, sf_dir).select("doc_id", summary.all_errors().alias("errors"))


@query(f"""with {A.MESSAGES} select count(distinct batch_id) as batches, count(*) as messages, sum(tokens_in)::BIGINT as tokens_in, sum(tokens_out)::BIGINT as tokens_out, count(*) filter (result_type = 'succeeded') as succeeded,
    count(*) filter (result_type = 'errored') as errored, sum(expected) filter (result_type = 'succeeded')::BIGINT as expected, sum(found) filter (result_type = 'succeeded')::BIGINT as found from ms""")
def prompting_summary(spark, sf_dir):
    """AGG1."""
    return summary.prompting_totals(A.messages(spark, sf_dir))


_COST = f"((tokens_in - tokens_in // 5 - tokens_in // 4) * {A.PRICE[0]} + tokens_out * {A.PRICE[1]} + (tokens_in // 5) * {A.PRICE[2]} + (tokens_in // 4) * {A.PRICE[3]}) / 1e6"


@query(f"""with {A.MESSAGES}, b as (select batch_id, sum({_COST}) as cost, sum(tokens_in) as tokens_in, sum(tokens_out) as tokens_out, count(*) as messages from ms where result_type = 'succeeded' group by 1)
    select count(*) as batches, sum(messages)::BIGINT as messages, round(sum(cost), 6) as cost, sum(tokens_in)::BIGINT as tokens_in, sum(tokens_out)::BIGINT as tokens_out, round(sum(cost) * 0.5, 6) as discounted, round(sum(cost) * 0.5 / 100, 6) as per_document from b where batch_id % 3 <> 2""")
def cost_rollup(spark, sf_dir):
    """GEO16, AGG7, AGG8."""
    i = F.col("tokens_in")
    cost = G.message_cost(i, F.floor(i / 5), F.floor(i / 4), F.col("tokens_out"), A.PRICE)
    per = summary.batch_costs(A.messages(spark, sf_dir), cost).withColumn("status", F.when(F.col("batch_id") % 3 != 2, "ended").otherwise("in_progress"))
    return rounded(summary.cost_roll_up(per, 100), "cost", "discounted", "per_document")


@query(f"""with {A.MESSAGES}, t as (select count(*) as messages, count(*) filter (result_type = 'succeeded') as succeeded, count(*) filter (result_type is null) as awaited from ms)
    select *, (1000 - (succeeded + awaited) * 3)::BIGINT as documents_left, round((1000 - (succeeded + awaited) * 3) / 3.0::DOUBLE, 6) as messages_left from t""")
def remaining_work(spark, sf_dir):
    """AGG9."""
    return rounded(summary.remaining_work(A.messages(spark, sf_dir), 1000, 3), "messages_left")


@query(f"""with {A.MESSAGES}, bad as (select message_id from ms where result_type is null or error = 'refusal'), s as (select vec_id as seed, row_number() over (order by vec_id) - 1 as i from embeddings where label = 0),
    j as (select s.seed, m.message_id from bad m join s on m.message_id % (select count(*) from s) = s.i) select seed, count(*) as n from j group by 1 order by n desc, seed limit 3""")
def refusal_seeds(spark, sf_dir):
    """JOIN8, JOIN10, AGG23: seeds of messages without an answer; the three most frequent (a report)."""
    ms = A.messages(spark, sf_dir)
    bad = summary.refusals(ms, ms.filter("result_type is not null"))
    seeds = A.table(spark, sf_dir, "embeddings").filter("label = 0").select(F.col("vec_id").alias("seed"))
    seeds = order.numbered(seeds, F.col("seed"), "nth").select("seed", (F.col("nth") - 1).alias("seed_idx"))
    j = summary.cyclic_seeds(bad.withColumn("message_idx", F.col("message_id")), seeds, seeds.count())
    return j.groupBy("seed").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "seed").limit(3)


# --- text and ground truth -------------------------------------------------------------------------------------------------

# a phrase of three words from the middle of each document, with a letter changed in two of three
_PATTERN = "case when len(words) >= 9 then array_to_string(words[len(words) // 2 + 1:len(words) // 2 + 3], ' ') else 'total' end"
_PATTERNS = A.WORD_ARRAYS + f""", pt as (select doc_id, words, lower(case doc_id % 3 when 0 then {_PATTERN} when 1 then replace({_PATTERN}, 'e', 'x') else replace({_PATTERN}, 't', '') end) as pat0 from wa),
    pp as (select doc_id, words, trim(regexp_replace(pat0, '\\s+', ' ', 'g')) as pat, array_to_string(words, ' ') as clean from pt),
    pos as (select doc_id, unnest(range(len(words)))::INT as k, unnest(words) as word from pp), sp as (select doc_id, k, (sum(length(word) + 1) over (partition by doc_id order by k) - length(word) - 1)::INT as s, (sum(length(word) + 1) over (partition by doc_id order by k) - 1)::INT as e from pos)"""


def _patterns(spark, sf_dir) -> DataFrame:
    n = F.size("words")
    mid = F.array_join(F.slice("words", F.floor(n / 2).cast("int") + 1, F.lit(3)), " ")
    base = F.when(n >= 9, mid).otherwise(F.lit("total"))
    k = F.col("doc_id") % 3
    made = F.when(k == 0, base).when(k == 1, F.replace(base, F.lit("e"), F.lit("x"))).otherwise(F.replace(base, F.lit("t"), F.lit("")))
    return A.word_arrays(spark, sf_dir).select("doc_id", F.lit(0).alias("pattern_id"), "words", made.alias("pattern"))


def _fuzzy_sql(extra: str = "", where: str = "") -> str:
    return f"""with {_PATTERNS}{extra}, win as (select doc_id, pat, clean, unnest(range(length(clean) - length(pat) + 1))::INT as i from pp where length(pat) > 0 and length(clean) >= length(pat)),
    d as (select doc_id, i, levenshtein(substr(lower(clean), i + 1, length(pat)), pat) as d from win {where}), b as (select doc_id, min(d) as d, arg_min(i, d * 10000000 + i) as i from d group by 1),
    r as (select pp.doc_id, coalesce(substr(clean, i + 1, length(pat)), '') as span, coalesce(1 - d / length(pat), -1.0) as score, i, length(pat) as m from pp left join b on pp.doc_id = b.doc_id)
    select r.doc_id, 0::INT as pattern_id, span, round(score, 6) as score, score >= 0.75 as found, coalesce((select list_sort(list(k)) from sp where sp.doc_id = r.doc_id and r.score >= 0.75 and not (sp.e < r.i) and not (sp.s > r.i + r.m) {{allowed}}), []) as indices from r"""


@query(_fuzzy_sql().replace("{allowed}", ""))
def fuzzy_span_best(spark, sf_dir):
    """STR1, STR2, WIN3: the best span of a phrase in every whole document."""
    return rounded(verify.fuzzy_spans(_patterns(spark, sf_dir)), "score")


@query(_fuzzy_sql(", al as (select sp.doc_id, min(s) as lo, max(e) as hi from sp join (select doc_id, len(words) as n from pp) using (doc_id) where k between n // 2 - 5 and n // 2 + 5 group by 1)", "join al using (doc_id) where i >= lo and i + length(pat) - 1 <= hi").replace(
    "{allowed}", "and sp.k between (select len(words) // 2 - 5 from pp where pp.doc_id = r.doc_id) and (select len(words) // 2 + 5 from pp where pp.doc_id = r.doc_id)"))
def fuzzy_span_restricted(spark, sf_dir):
    """STR3: the same within the eleven words around the middle."""
    mid = F.floor(F.size("words") / 2).cast("int")
    return rounded(verify.fuzzy_spans(_patterns(spark, sf_dir).withColumn("allowed", F.sequence(mid - 5, mid + 5)), restricted=True), "score")


@query(A.WORD_ARRAYS.join(["with ", """, q as (select doc_id, words, words[len(words) // 2 + 1:len(words) // 2 + 2] as phrase from wa)
    select doc_id, case when len(words) >= 2 then list_min(list_filter(range(len(words) - 1), lambda i: words[i + 1] = phrase[1] and words[i + 2] = phrase[2])) end::INT as at from q"""]))
def phrase_index_span(spark, sf_dir):
    """ARR2: the first place of the two words from the middle of each document."""
    df = A.word_arrays(spark, sf_dir).withColumn("phrase", F.slice("words", F.floor(F.size("words") / 2).cast("int") + 1, F.lit(2)))
    found = verify.phrase_index(F.col("words"), F.col("phrase"))
    return df.select("doc_id", F.when(F.size("phrase") == 2, found).alias("at"))


_TAGS = A.WORDS + """, tg as (select doc_id, idx, word, case when idx % 17 in (3, 4) then (case when idx % 17 = 3 then 'B-' else 'I-' end) || 'NAME' when idx % 17 = 9 then 'I-DATE' when idx % 17 in (11, 12, 13) then (case when idx % 17 = 11 then 'B-' else 'I-' end) || 'TOTAL' else 'O' end as tag from w)"""
_ISLANDS = """, tk as (select *, case when tag <> 'O' then substr(tag, 3) end as kind, tag like 'B-%' as begins from {t}), cut as (select *, case when begins or kind is distinct from lag(kind) over (partition by doc_id order by idx) then 1 else 0 end as c from tk),
    isl as (select *, sum(c) over (partition by doc_id order by idx) as island from cut), led as (select *, first_value(begins) over (partition by doc_id, island order by idx) as lead_b from isl)"""


def _tag(idx):
    k = idx % 17
    return F.when(k == 3, "B-NAME").when(k == 4, "I-NAME").when(k == 9, "I-DATE").when(k == 11, "B-TOTAL").when(k.isin(12, 13), "I-TOTAL").otherwise("O")


def _tags(spark, sf_dir) -> DataFrame:
    return A.words(spark, sf_dir).withColumn("tag", _tag(F.col("idx")))


@query("with " + _TAGS + _ISLANDS.format(t="tg") + """ select doc_id, any_value(kind) as label, min(idx)::INT as first, max(idx)::INT as last, string_agg(word, ' ' order by idx) as text from led where kind is not null and lead_b group by doc_id, island""")
def bio_spans(spark, sf_dir):
    """WIN4, AGG26: entities of tags; an I- without a B- is no entity."""
    return verify.tag_spans(_tags(spark, sf_dir))


@query("with " + A.WORDS + """, en as (select doc_id, 0 as k, 'A' as label, [2, 3, 4] as ix from wa union all select doc_id, 1, 'B', [4, 5] from wa union all select doc_id, 2, 'C', [9] from wa),
    ex as (select doc_id, k, label, unnest(ix) as idx, unnest(range(len(ix))) as pos from en), la as (select doc_id, idx, arg_max((case when pos = 0 then 'B-' else 'I-' end) || label, k * 100 + pos) as tag from ex group by 1, 2)
    select w.doc_id, w.idx, coalesce(la.tag, 'O') as tag from w left join la on w.doc_id = la.doc_id and w.idx = la.idx""")
def qa_bio_tags(spark, sf_dir):
    """ARR5: tags of overlapping entities; the later one wins."""
    docs = A.word_arrays(spark, sf_dir).select("doc_id")
    spans = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key_order"), F.lit(x).alias("label"), F.array(*[F.lit(i) for i in ix]).alias("indices")) for k, x, ix in ((0, "A", [2, 3, 4]), (1, "B", [4, 5]), (2, "C", [9]))])).alias("e"))
    return verify.bio_tags(A.words(spark, sf_dir), spans.select("doc_id", "e.*"))


@query("with " + _TAGS + """, pr as (select doc_id, idx, word, case when idx % 5 = 0 then 'O' when idx % 7 = 0 then replace(tag, 'NAME', 'TOTAL') else tag end as tag from tg)"""
       + _ISLANDS.format(t="tg").replace("tk as", "tk1 as").replace("from tk)", "from tk1)").replace("cut as", "cut1 as").replace("from cut)", "from cut1)").replace("isl as", "isl1 as").replace("from isl)", "from isl1)").replace("led as", "led1 as")
       + _ISLANDS.format(t="pr") + """, g as (select doc_id, any_value(kind) as label, min(idx) as f, max(idx) as l from led1 where kind is not null and lead_b group by doc_id, island),
    p as (select doc_id, any_value(kind) as label, min(idx) as f, max(idx) as l from led where kind is not null and lead_b group by doc_id, island),
    u as (select coalesce(g.label, p.label) as label, (g.label is not null)::INT as g, (p.label is not null)::INT as p from g full join p on g.doc_id = p.doc_id and g.label = p.label and g.f = p.f and g.l = p.l),
    a as (select label, g, p from u union all select 'micro', g, p from u), s as (select label, sum(g)::BIGINT as support, sum(p)::BIGINT as predicted, sum(g * p)::BIGINT as tp from a group by 1)
    select label, support, predicted, tp, round(case when predicted > 0 then tp / predicted else 0 end, 6) as precision, round(case when support > 0 then tp / support else 0 end, 6) as recall, round(case when tp > 0 then 2 * (tp / predicted) * (tp / support) / (tp / predicted + tp / support) else 0 end, 6) as f1 from s""")
def entity_f1(spark, sf_dir):
    """STAT13."""
    gold = _tags(spark, sf_dir)
    i = F.col("idx")
    pred = gold.withColumn("tag", F.when(i % 5 == 0, "O").when(i % 7 == 0, F.replace("tag", F.lit("NAME"), F.lit("TOTAL"))).otherwise(F.col("tag")))
    return rounded(metrics.entity_scores(gold.drop("word"), pred.drop("word")), "precision", "recall", "f1")


# --- boxes -------------------------------------------------------------------------------------------------------


@query("with " + A.WORD_BOXES + """ select doc_id, block_no, line_no, arg_min(x0, idx) as x0, arg_min(y0, idx) as y0, arg_max(x2, idx) as x2, arg_max(y2, idx) as y2, string_agg(word, ' ' order by idx) as text, arg_min(word_no, idx) as word_no from wb group by 1, 2, 3""")
def line_group_first_last(spark, sf_dir):
    """AGG10."""
    return boxes.lines_first_last(A.word_boxes(spark, sf_dir))


@query("with " + A.WORD_BOXES + """ select doc_id, block_no, line_no, min(x0) as x0, min(y0) as y0, max(x2) as x2, max(y2) as y2, string_agg(word, ' ' order by idx) as text from wb group by 1, 2, 3""")
def line_group_minmax(spark, sf_dir):
    """AGG11."""
    return boxes.lines_envelope(A.word_boxes(spark, sf_dir))


@query("with " + A.WORDS + """ select doc_id, idx, (sum(length(word) + 1) over (partition by doc_id order by idx) - length(word) - 1)::BIGINT as start, (sum(length(word) + 1) over (partition by doc_id order by idx) - 1)::BIGINT as end from w""")
def char_offsets(spark, sf_dir):
    """WIN3."""
    return boxes.char_offsets(A.words(spark, sf_dir)).select("doc_id", "idx", "start", "end")


@query("with " + A.WORD_BOXES + """, l as (select doc_id, line_no, string_agg(case when doc_id % 9 = 0 and idx % 50 = 7 then replace(word, 'e', 'i') else word end, ' ' order by idx) as t from wb group by 1, 2),
    g as (select doc_id, line_no, unnest(string_split(t, ' ')) as spelled, unnest(range(len(string_split(t, ' ')))) as word_no from l)
    select g.doc_id, bool_and(coalesce(wb.word = g.spelled, false)) as matches, count(*) as n_groups from g left join wb on g.doc_id = wb.doc_id and g.line_no = wb.line_no and g.word_no = wb.word_no group by 1""")
def char_word_consistency(spark, sf_dir):
    """WIN9, JOIN3: characters numbered into words and held against the words."""
    w = A.word_boxes(spark, sf_dir)
    said = F.when((F.col("doc_id") % 9 == 0) & (F.col("idx") % 50 == 7), F.replace("word", F.lit("e"), F.lit("i"))).otherwise(F.col("word"))
    lines = w.groupBy("doc_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", said.alias("s")))), lambda x: x["s"]), " ").alias("t"))
    chars = lines.select("doc_id", "line_no", F.posexplode(F.split("t", "")).alias("pos", "ch"))
    return boxes.chars_match_words(boxes.number_words(chars), w)


@query("with " + A.WORD_BOXES + f""", sg as (select doc_id, block_no as seg_idx, min(x0) + 30 as x0, min(y0) + 6 as y0, max(x2) - 80 as x2, max(y2) + 6 as y2 from wb group by 1, 2),
    pr as (select a.doc_id, a.idx, b.seg_idx, {A.INTER} as i, {A.AREA_A} + {A.AREA_B} - {A.INTER} as u from wb a join sg b on a.doc_id = b.doc_id), s as (select doc_id, idx, seg_idx, case when i > 0 then i / u else 0 end as iou from pr),
    m as (select doc_id, idx, max(iou) as iou, arg_max(seg_idx, iou * 1000000 - seg_idx * 1e-7) as seg from s group by 1, 2)
    select m.doc_id, m.idx, round(m.iou, 6) + 0.0 as iou, case when m.iou > 0 then seg end as seg_idx, case when m.iou > 0 then sg.x0 else wb.x0 end as x0 from m join wb on m.doc_id = wb.doc_id and m.idx = wb.idx join sg on sg.doc_id = m.doc_id and sg.seg_idx = m.seg""")
def word_segment_iou_remap(spark, sf_dir):
    """GEO1, JOIN2: each word and its best segment."""
    w = A.word_boxes(spark, sf_dir)
    s = w.groupBy("doc_id", F.col("block_no").alias("seg_idx")).agg((F.min("x0") + 30).alias("x0"), (F.min("y0") + 6).alias("y0"), (F.max("x2") - 80).alias("x2"), (F.max("y2") + 6).alias("y2"))
    return rounded(boxes.best_segment(w, s).select("doc_id", "idx", "iou", "seg_idx", F.col("box.x0").alias("x0")), "iou")


@query("with " + A.LAYOUT + f""", h as (select distinct a.doc_id, a.elem from ve a join bl b on a.doc_id = b.doc_id where case when least({A.AREA_A}, {A.AREA_B}) > 0 then {A.INTER} / least({A.AREA_A}, {A.AREA_B}) else 0 end > 0.8)
    select doc_id, x0, y0, x2, y2, 'LE-TEXT' as label from bl union all select doc_id, x0, y0, x2, y2, 'LE-FIGURE' from ve where not exists (select 1 from h where h.doc_id = ve.doc_id and h.elem = ve.elem)""")
def layout_overlap_merge(spark, sf_dir):
    """GEO2, JOIN5."""
    return boxes.add_figures(*A.layout(spark, sf_dir))


@query("with " + A.LAYOUT + f""", al as (select doc_id, elem * 2 as elem, x0, y0, x2, y2 from bl union all select doc_id, elem * 2 + 1, x0, y0, x2, y2 from ve),
    p as (select a.doc_id, (a.x0 <= b.x0 and a.y0 <= b.y0 and a.x2 >= b.x2 and a.y2 >= b.y2) or (b.x0 <= a.x0 and b.y0 <= a.y0 and b.x2 >= a.x2 and b.y2 >= a.y2) or case when least({A.AREA_A}, {A.AREA_B}) > 0 then {A.INTER} / least({A.AREA_A}, {A.AREA_B}) else 0 end > 0.5 as hit
        from al a join al b on a.doc_id = b.doc_id and a.elem < b.elem) select d.doc_id, coalesce(bool_or(hit), false) as conflict from (select distinct doc_id from al) d left join p on d.doc_id = p.doc_id group by 1""")
def layout_pairs(spark, sf_dir):
    """GEO3, JOIN6."""
    b, v = A.layout(spark, sf_dir)
    cols = ["doc_id", "elem", "x0", "y0", "x2", "y2"]
    every = b.withColumn("elem", F.col("elem") * 2).select(*cols).unionByName(v.withColumn("elem", F.col("elem") * 2 + 1).select(*cols))
    return boxes.overlapping(every, 0.5)


@query("with " + A.WORD_BOXES + """, r as (select distinct doc_id, line_no as rect_id from wb where line_no % 4 = 1) select r.doc_id, r.rect_id, list_sort(list(idx)) as indices from r join wb on r.doc_id = wb.doc_id
    where x0 >= 100 - 25 and y0 >= rect_id * 14.0 - 25 and x2 <= 100 + 200 + 25 and y2 <= rect_id * 14.0 + 20 + 25 group by 1, 2""")
def words_in_rect(spark, sf_dir):
    """GEO4, JOIN4, ARR3."""
    w = A.word_boxes(spark, sf_dir)
    rect = F.struct(F.lit(100.0).alias("x"), (F.col("line_no") * 14.0).alias("y"), F.lit(200.0).alias("width"), F.lit(20.0).alias("height"))
    rects = w.filter("line_no % 4 = 1").select("doc_id", "line_no").distinct().select("doc_id", F.col("line_no").alias("rect_id"), rect.alias("rect"))
    return boxes.boxes_in_rect(w, rects)


@query("with " + A.WORD_BOXES + """, n as (select *, greatest(least(x0, 499.0), 0) as cx0, greatest(least(y2, 699.0), 0) as cy2 from wb) select doc_id, idx, round(x0 / 500, 6) as nx0, round(y2 / 700, 6) as ny2, cx0, cy2,
    (x0 >= 0 and y0 >= 0 and x2 <= 500 and y2 <= 700 and x2 > x0 and y2 > y0) or (x2 - x0 > 1 and y2 - y0 > 1) as detectable, (x2 - x0) / 500 between 0 and 1 and (y2 - y0) / 700 between 0 and 1 and x0 / 500 between 0 and 1 and x2 / 500 between 0 and 1 and y0 / 700 between 0 and 1 and y2 / 700 between 0 and 1 as normalised from n""")
def box_normalise_clip(spark, sf_dir):
    """GEO6, GEO9, PRJ12, PRJ13."""
    w, h = F.lit(500.0), F.lit(700.0)
    b = A.word_boxes(spark, sf_dir).withColumn("b", G.box("x0", "y0", "x2", "y2"))
    n, c = G.normalised(F.col("b"), w, h), G.clipped(F.col("b"), w, h)
    return rounded(b.select("doc_id", "idx", n["x0"].alias("nx0"), n["y2"].alias("ny2"), c["x0"].alias("cx0"), c["y2"].alias("cy2"), G.is_detectable(F.col("b"), w, h).alias("detectable"), G.is_normalised(n).alias("normalised")), "nx0", "ny2")


# --- splitting and token labels -------------------------------------------------------------------------------------------------


@query(r"with " + A.WORDS + r""", u as (select distinct word from w), r as (select word, regexp_extract_all(word, '\d+|\D+') as runs from u),
    s as (select word, flatten(list_transform(runs, lambda t: case when regexp_matches(t, '^\d') then list_transform(range((length(t) - 1) // 2 + 1), lambda i: substr(t, i * 2 + 1, 2))
        when length(t) <= 6 then [t] else list_transform(range((length(t) + 5) // 6), lambda i: substr(t, i * (length(t) // ((length(t) + 5) // 6)) + least(i, length(t) % ((length(t) + 5) // 6)) + 1, (length(t) // ((length(t) + 5) // 6)) + case when i < length(t) % ((length(t) + 5) // 6) then 1 else 0 end)) end)) as parts from r) select word, parts from s""")
def word_split_digits(spark, sf_dir):
    """STR13, STR14."""
    return A.words(spark, sf_dir).select("word").distinct().select("word", T.digit_aware_parts(F.col("word"), 6, 2).alias("parts"))


@query("with " + A.WORDS + """, t as (select doc_id, idx as pos, (idx // 12)::INT % 7 // 2 as box, idx % 40 = 0 as special from w), r0 as (select *, case when box is distinct from lag(box) over (partition by doc_id order by pos) then 1 else 0 end as c from t),
    r as (select doc_id, pos, case when special then 0 else sum(c) over (partition by doc_id order by pos) end::BIGINT as rank from r0), c2 as (select *, case when rank <> lag(rank) over (partition by doc_id order by pos) then 1 when lag(rank) over (partition by doc_id order by pos) is null then 1 else 0 end as c from r),
    k as (select *, sum(c) over (partition by doc_id order by pos) as run from c2), n as (select *, row_number() over (partition by doc_id, run order by pos) as nth, count(*) over (partition by doc_id, run) as n, max(run) over (partition by doc_id) as last from k)
    select doc_id, pos, rank, case when nth = 1 then 1 when run = last then 0 when nth = n then 3 else 2 end::INT as place from n""")
def segment_ranks(spark, sf_dir):
    """WIN5, WIN6."""
    t = A.words(spark, sf_dir).select("doc_id", F.col("idx").alias("pos"), F.floor(F.floor(F.col("idx") / 12) % 7 / 2).alias("box"), (F.col("idx") % 40 == 0).alias("special"))
    return labels.run_positions(labels.segment_ranks(t)).select("doc_id", "pos", "rank", "place")


@query("with " + A.WORDS + """, t as (select doc_id, idx as pos, (idx // 12)::INT % 7 // 2 as box, idx % 40 = 0 as special from w), r0 as (select *, case when box is distinct from lag(box) over (partition by doc_id order by pos) then 1 else 0 end as c from t),
    r as (select doc_id, pos, case when special then 0 else sum(c) over (partition by doc_id order by pos) end::BIGINT as rank from r0), b as (select *, case when rank <> lag(rank) over (partition by doc_id order by pos) and rank <> 0 then pos end as f from r),
    f as (select doc_id, coalesce(list_sort(list(f) filter (f is not null)), []) as fs from b group by 1) select doc_id, fs[1:150] || list_transform(range(greatest(150 - len(fs), 0)), lambda i: 0) as firsts, least(len(fs), 150)::INT as n_firsts from f""")
def first_tokens(spark, sf_dir):
    """WIN7."""
    t = A.words(spark, sf_dir).select("doc_id", F.col("idx").alias("pos"), F.floor(F.floor(F.col("idx") / 12) % 7 / 2).alias("box"), (F.col("idx") % 40 == 0).alias("special"))
    return labels.first_tokens(labels.segment_ranks(t))


_PIECES = A.WORD_ARRAYS + """, pc as (select doc_id, words, flatten(list_transform(range(len(words)), lambda i: list_transform(range((length(words[i + 1]) + 3) // 4), lambda j: i::INT))) as ids, list_transform(range(len(words)), lambda i: (i % 5)::INT) as lab from wa)"""


def _pieces(spark, sf_dir) -> DataFrame:
    """Word ids of pieces of four letters, and a label of each word."""
    df = A.word_arrays(spark, sf_dir)
    ids = F.flatten(F.transform("words", lambda w, i: F.array_repeat(i, F.ceil(F.length(w) / 4).cast("int"))))
    return df.select("doc_id", "words", ids.alias("ids"), F.transform("words", lambda w, i: i % 5).alias("lab"))


@query("with " + _PIECES + """ select doc_id, list_transform(range(len(ids)), lambda i: case when i > 0 and ids[i + 1] = ids[i] then -100 else lab[ids[i + 1] + 1] end::INT) as masked, list_transform(ids, lambda k: length(words[k + 1])::INT) as gathered from pc""")
def subword_masking(spark, sf_dir):
    """WIN8, ARR6."""
    p = _pieces(spark, sf_dir)
    return p.select("doc_id", labels.first_piece_labels(F.col("ids"), F.col("lab")).alias("masked"), labels.gather(F.col("ids"), F.transform("words", F.length), F.lit(0)).alias("gathered"))


@query("with " + _PIECES + """, s as (select doc_id, ids, unnest(range(0, greatest(len(ids) - 16 - 1, 0) + 1, 48)) as st from pc), w as (select doc_id, (st // 48)::INT as nth, ids[st + 1:st + 64] as items from s),
    p as (select *, coalesce(max(list_max(items)) over (partition by doc_id order by nth rows between unbounded preceding and 1 preceding), -1) as seen from w) select doc_id, nth as "window", len(items)::INT as n, list_filter(items, lambda x: x > seen) as fresh from p""")
def overflow_windows(spark, sf_dir):
    """WIN10, WIN11."""
    w = labels.overflow_windows(_pieces(spark, sf_dir).select("doc_id", "ids"), "ids", 64, 16)
    return labels.new_items(w).select("doc_id", "window", F.size("items").alias("n"), "fresh")


@query("""
    with l as (select vec_id as id, unnest(range(32))::INT as k, unnest(embedding[1:32])::DOUBLE as s, unnest(embedding[33:64])::DOUBLE as e from embeddings),
    a as (select id, k, s, row_number() over (partition by id order by s desc, k) as n from l), b as (select id, k, e, row_number() over (partition by id order by e desc, k) as n from l),
    p as (select a.id, a.k as start, b.k as end, a.s + b.e as score, row_number() over (partition by a.id order by a.s + b.e desc, a.k, b.k) - 1 as nth from a join b on a.id = b.id and a.n <= 20 and b.n <= 20 and b.k >= a.k and b.k - a.k < 100),
    t as (select *, max(score) over (partition by id) as m from p where nth < 20) select id, nth::INT as nth, start, "end", round(score, 6) as score, round(exp(score - m) / sum(exp(score - m)) over (partition by id), 6) as probability from t""")
def qa_nbest(spark, sf_dir):
    """SORT2, ARR12."""
    return rounded(labels.n_best_spans(A.logits(spark, sf_dir)), "score", "probability")


@query("""with c as (select item_id, unnest(string_split(text, '')) as ch from benchmark), v as (select ch, row_number() over (order by ch) + 3 as code from (select distinct ch from c)),
    x as (select item_id, unnest(string_split(text, ''))as ch, unnest(range(length(text))) as pos from benchmark) select item_id, list_concat([2], list(v.code order by pos), [3]) as codes from x join v on x.ch = v.ch group by 1""")
def char_tokenize(spark, sf_dir):
    """STR26: a vocabulary of characters after four special ones, and texts as codes between start (2) and end (3)."""
    from pyspark.sql import Window

    b = A.table(spark, sf_dir, "benchmark")
    chars = b.select("item_id", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    vocabulary = chars.select("ch").distinct().withColumn("code", F.row_number().over(Window.orderBy("ch")) + 3)
    codes = chars.join(vocabulary, "ch").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("c"))
    return codes.select("item_id", F.concat(F.array(F.lit(2)), "c", F.array(F.lit(3))).cast("array<bigint>").alias("codes"))


# --- metrics -------------------------------------------------------------------------------------------------------

_REPORT = """with p as (select l.quality as g, case when d.n_chars > 1200 then 1 else 0 end as p from labels l join documents d on l.doc_id = d.doc_id), c as (select unnest([0, 1]) as label),
    s as (select label, count(*) filter (g = label) as support, count(*) filter (p = label) as predicted, count(*) filter (g = label and p = label) as tp from c, p group by 1),
    r as (select label, support, case when predicted > 0 then tp / predicted else 0 end as precision, case when support > 0 then tp / support else 0 end as recall from s), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from r)"""


def _predictions(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return A.table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("g"), (F.col("n_chars") > 1200).cast("int").alias("p"))


@query(_REPORT + " select label::INT as label, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f")
def classification_report(spark, sf_dir):
    """STAT12."""
    return rounded(metrics.classification_report(_predictions(spark, sf_dir), "g", "p"), "precision", "recall", "f1")


@query(_REPORT + " select (select round(avg((g = p)::INT), 6) from p) as accuracy, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from f")
def classification_summary(spark, sf_dir):
    """STAT12."""
    return rounded(metrics.classification_summary(_predictions(spark, sf_dir), "g", "p"), "accuracy", "precision", "recall", "f1")


@query("""with p as (select l.quality as gold, case when d.n_chars > 1200 then 1 else 0 end::INT as pred from labels l join documents d on l.doc_id = d.doc_id), c as (select gold, pred, count(*) as n from p group by 1, 2) select gold, pred, n, round(n / sum(n) over (partition by gold), 6) as share from c""")
def confusion_matrix(spark, sf_dir):
    """STAT12."""
    return rounded(metrics.confusion(_predictions(spark, sf_dir), "g", "p"), "share")


_ASCII = "regexp_replace(text, '[^ -~]+', '', 'g')"


@query(f"""with a as (select conv_id as doc_id, turn as question, {_ASCII} as g from conversations where role = 'assistant'), p as (select doc_id, question, case when question % 3 = 1 then replace(g, 'e', 'a') when question % 5 = 0 then '' else lower(g) end as a from a where doc_id % 4 <> 3 and question % 7 <> 6),
    r as (select a.doc_id, a.question, a.g, coalesce(p.a, '') as a from a left join p on a.doc_id = p.doc_id and a.question = p.question where a.doc_id in (select doc_id from p)),
    d as (select *, greatest(length(lower(a)), length(lower(g))) as m, levenshtein(lower(a), lower(g)) as l from r) select doc_id, question, round(case when m = 0 then 0 when l / m < 0.5 then 1 - l / m else 0 end, 6) as anls from d""")
def anls(spark, sf_dir):
    """JOIN7, STAT11."""
    g = A.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("question"), F.regexp_replace("text", "[^ -~]+", "").alias("g"))
    q = F.col("question")
    answer = F.when(q % 3 == 1, F.replace("g", F.lit("e"), F.lit("a"))).when(q % 5 == 0, "").otherwise(F.lower("g"))
    preds = g.filter("doc_id % 4 <> 3 and question % 7 <> 6").select("doc_id", "question", F.lit(0).alias("pos"), answer.alias("answer"))
    return rounded(metrics.answers_scored(g.select("doc_id", "question", F.array("g").alias("golds")), preds), "anls")


@query("with " + A.WORDS + """, p as (select doc_id % 10 as writer, word as gold, case when idx % 4 = 0 then replace(word, 'e', 'c') when idx % 9 = 0 then word || 'x' else word end as pred from w)
    select writer, round(avg((gold <> pred)::INT), 6) as wer, round(avg(levenshtein(gold, pred) / greatest(length(gold), 1)), 6) as cer, count(*) as n from p group by 1""")
def wer_cer(spark, sf_dir):
    """STAT17, AGG24."""
    i = F.col("idx")
    pred = F.when(i % 4 == 0, F.replace("word", F.lit("e"), F.lit("c"))).when(i % 9 == 0, F.concat("word", F.lit("x"))).otherwise(F.col("word"))
    return rounded(metrics.recognition_errors(A.words(spark, sf_dir).select((F.col("doc_id") % 10).alias("writer"), F.col("word").alias("gold"), pred.alias("pred")), "writer"), "wer", "cer")


def _detections(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b, _ = A.layout(spark, sf_dir)
    gold = b.select(F.col("doc_id").alias("image_id"), F.concat(F.lit("c"), (F.col("elem") % 2).cast("string")).alias("label"), F.col("elem").alias("gold_no"), "x0", "y0", "x2", "y2")
    k = F.col("elem") % 4
    pred = b.filter("elem % 5 <> 4").select(F.col("doc_id").alias("image_id"), F.concat(F.lit("c"), (F.col("elem") % 2).cast("string")).alias("label"), F.col("elem").alias("det"), (F.col("x0") + k * 20).alias("x0"), (F.col("y0") + k * 3).alias("y0"),
                                            (F.col("x2") + k * 20).alias("x2"), (F.col("y2") + k * 3).alias("y2"), ((F.col("doc_id") * 7 + F.col("elem") * 13) % 97 / 97.0 + 0.01).alias("score"))
    return gold, pred


@query("with " + A.LAYOUT + f""", p as (select doc_id, elem as det, elem % 2 as c, x0 + elem % 4 * 20 as x0, y0 + elem % 4 * 3 as y0, x2 + elem % 4 * 20 as x2, y2 + elem % 4 * 3 as y2 from bl where elem % 5 <> 4),
    j as (select a.doc_id as image_id, 'c' || b.c as label, a.elem as gold_no, b.det, {A.INTER} as i, {A.AREA_A} + {A.AREA_B} - {A.INTER} as u from bl a join p b on a.doc_id = b.doc_id and a.elem % 2 = b.c) select image_id, label, gold_no, det, round(i / u, 6) as iou from j where i / u >= 0.5""")
def detection_iou(spark, sf_dir):
    """STAT15: pairs of boxes by IoU."""
    gold, pred = _detections(spark, sf_dir)
    return rounded(metrics.iou_pairs(gold, pred), "iou")


@query()
def detection_ap(spark, sf_dir):
    """STAT15: precision and recall of detections; tests hold it against a plain version."""
    gold, pred = _detections(spark, sf_dir)
    return metrics.detection_scores(gold.drop("gold_no"), pred)


# --- vectors -------------------------------------------------------------------------------------------------------

_X = "x as (select vec_id, label, unnest(range(len(embedding)))::INT as dim, unnest(embedding)::DOUBLE as x from embeddings)"


@query(f"with {_X}, n as (select vec_id, sqrt(sum(x * x)) as n from x group by 1) select x.vec_id, list(round(x / n, 6) + 0.0 order by dim) as v from x join n on x.vec_id = n.vec_id group by 1")
def emb_normalise(spark, sf_dir):
    """VEC1."""
    return A.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(vectors.normalised(F.col("embedding")), lambda x: F.round(x, 6) + 0.0).alias("v"))


@query(f"with {_X}, s as (select dim, avg(x) as m, stddev_pop(x) as s from x group by 1), z as (select vec_id, dim, (x - m) / case when s = 0 then 1 else s end as z from x join s using (dim)) select vec_id, round(sum(z * (dim + 1)), 4) + 0.0 as weighted, round(max(z), 5) as largest, (count(*) * 2) as n from z group by 1")
def emb_zscore_concat(spark, sf_dir):
    """VEC2, JOIN13."""
    z = vectors.standardised(A.table(spark, sf_dir, "embeddings"))
    both = vectors.stacked(z, z)
    half = F.slice("z", 1, (F.size("z") / 2).cast("int"))
    weighted = F.aggregate(F.transform(half, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    out = both.select("vec_id", (F.round(weighted, 4) + 0.0).alias("weighted"), F.round(F.array_max("z"), 5).alias("largest"), F.size("z").cast("bigint").alias("n"))
    return out


@query(f"""with {_X}, s as (select label, dim, sum(x / n) as s, count(*) as c from x join (select vec_id, sqrt(sum(x * x)) as n from x group by 1) using (vec_id) group by 1, 2), q as (select label, max(c) as size, sum(s * s) as q from s group by 1)
    select label, size, round(case when size > 1 then 1 - (q - size) / (size * (size - 1)) end, 6) as mean_distance from q""")
def cluster_stats(spark, sf_dir):
    """AGG18, AGG19, STAT4."""
    return rounded(vectors.cluster_cosine(A.table(spark, sf_dir, "embeddings")), "mean_distance")


@query("""with s as (select label, count(*) as size from embeddings group by 1), o as (select size, size / sum(size) over () as p, row_number() over (order by size, label) as i, count(*) over () as k, sum(size) over () as t from s)
    select round(-sum(p * ln(p)) / ln(count(*)), 6) as entropy, round(stddev_pop(size) / avg(size), 6) as cv, round(min(size) / max(size), 6) as ratio, round(2 * sum(i * size) / (max(k) * max(t)) - (max(k) + 1) / max(k), 6) as gini from o""")
def cluster_balance(spark, sf_dir):
    """STAT3."""
    return rounded(vectors.balance(A.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("size"))), "entropy", "cv", "ratio", "gini")


_DIST = """e as (select vec_id, label, embedding::DOUBLE[] as v from embeddings), d as (select a.vec_id as q, a.label as own, b.vec_id as id, b.label as label, list_distance(a.v, b.v) as d from e a join e b on a.vec_id <> b.vec_id)"""


@query(f"""with {_DIST}, n as (select *, row_number() over (partition by q order by d, id) as nth from d) select round(coalesce(avg((own <> label)::INT), 0), 6) as connectivity from n where nth <= (select count(*) // 100 from embeddings)""")
def connectivity(spark, sf_dir):
    """STAT2: every row against all rows, in blocks."""
    return rounded(vectors.connectivity(A.table(spark, sf_dir, "embeddings")), "connectivity")


@query(f"""with {_DIST.replace("label, embedding", "case when vec_id % 10 = 0 then -1 else label end as label, embedding")}, n as (select q, label, row_number() over (partition by q order by d, id) as nth from d where own = -1 and label <> -1),
    v as (select q, label, count(*) as n from n where nth <= 5 group by 1, 2), m as (select q, arg_min(label, -n * 1000 + label) as label from v group by 1) select e.vec_id, coalesce(m.label, e.label)::INT as label, e.label = -1 as was_noise from e left join m on e.vec_id = m.q""")
def knn_relabel(spark, sf_dir):
    """VEC6: noise, a stated tenth of the rows, against all others, in blocks."""
    e = A.table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("label")))
    return vectors.relabel_noise(e)


@query(f"""with {_DIST}, m as (select q, own, label, sum(d) as d, count(*) as n from d group by 1, 2, 3), s as (select q, own, max(case when own = label then d / n end) as a, min(case when own <> label then d / n end) as b from m group by 1, 2)
    select q as vec_id, own as label, round(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end, 6) + 0.0 as silhouette from s""")
def silhouette(spark, sf_dir):
    """STAT1."""
    return rounded(vectors.silhouette(A.table(spark, sf_dir, "embeddings")), "silhouette")


@query(f"""with {_X}, c as (select label, dim, avg(x) as mu, count(*) as n from x group by 1, 2), g as (select dim, avg(x) as m from x group by 1), q as (select vec_id, x.label, sum((x - mu) ** 2) as q from x join c on x.label = c.label and x.dim = c.dim group by 1, 2), p as (select label, sum(q) as w, avg(sqrt(q)) as s, count(*) as n from q group by 1),
    b as (select sum(n * (mu - m) ** 2) as b from c join g using (dim)), r as (select a.label as a, b.label as b, sqrt(sum((a.mu - b.mu) ** 2)) as d from c a join c b on a.dim = b.dim and a.label <> b.label group by 1, 2), m as (select r.a, max((pa.s + pb.s) / d) as r from r join p pa on pa.label = r.a join p pb on pb.label = r.b group by 1)
    select round((select b from b) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 6) as calinski_harabasz, (select round(avg(r), 6) from m) as davies_bouldin from p""")
def cluster_scores(spark, sf_dir):
    """STAT1."""
    return rounded(vectors.cluster_scores(A.table(spark, sf_dir, "embeddings")), "calinski_harabasz", "davies_bouldin")


@query(f"with {_X} select a.dim as i, b.dim as j, round(covar_samp(a.x, b.x), 8) + 0.0 as cov from x a join x b on a.vec_id = b.vec_id group by 1, 2")
def covariance(spark, sf_dir):
    """STAT8."""
    return rounded(vectors.covariance(A.table(spark, sf_dir, "embeddings")), "cov", digits=8)


@query()
def frechet_distance(spark, sf_dir):
    """STAT9: even against odd vectors; tests hold it against a closed form."""
    e = A.table(spark, sf_dir, "embeddings")
    return spark.createDataFrame([(round(vectors.frechet(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")), 6),)], "frechet double")


@query()
def principal_components(spark, sf_dir):
    """VEC3."""
    return vectors.principal_components(A.table(spark, sf_dir, "embeddings"), 5)


@query()
def k_means(spark, sf_dir):
    """VEC5."""
    return vectors.k_means(A.table(spark, sf_dir, "embeddings"), 10)


# --- distributions -------------------------------------------------------------------------------------------------------


@query("""with r as (select event_type, count(*) as r from events where user_id % 2 = 0 group by 1), s as (select event_type, count(*) as s from events where user_id % 2 = 1 group by 1), c as (select coalesce(r, 0) as r, coalesce(s, 0) as s from r full join s using (event_type)),
    p as (select r / sum(r) over () as p, s / sum(s) over () as q from c), m as (select p, q, (p + q) / 2 as m from p) select round(sqrt((sum(case when p > 0 then p * ln(p / m) else 0 end) + sum(case when q > 0 then q * ln(q / m) else 0 end)) / 2), 6) as js, round(sum(p * ln(p / q)), 6) as kl from m""")
def js_kl_divergence(spark, sf_dir):
    """JOIN14, STAT5."""
    e = A.table(spark, sf_dir, "events")
    return rounded(stats.divergences(stats.joined_counts(e.filter("user_id % 2 = 0"), e.filter("user_id % 2 = 1"), "event_type")), "js", "kl")


_SPACE = "select {k} as kind, avg((x0 + x2) / 2) as cx, avg((y0 + y2) / 2) as cy, stddev_pop((x0 + x2) / 2) as sx, stddev_pop((y0 + y2) / 2) as sy from wb where {w} group by 1"


@query("with " + A.WORD_BOXES + f""", a as ({_SPACE.format(k="length(word)::INT", w="doc_id % 2 = 0")}), b as ({_SPACE.format(k="length(word)::INT", w="doc_id % 2 = 1")})
    select kind, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 5) as centroid_distance, round(abs(a.sx - b.sx), 5) as spread_x, round(abs(a.sy - b.sy), 5) as spread_y from a join b using (kind)""")
def spatial_diff(spark, sf_dir):
    """STAT6, JOIN15."""
    w = A.word_boxes(spark, sf_dir).withColumn("kind", F.length("word"))
    return rounded(stats.spatial_difference(w.filter("doc_id % 2 = 0"), w.filter("doc_id % 2 = 1"), "kind"), "centroid_distance", "spread_x", "spread_y", digits=5)


@query("""with d as (select distinct user_id, event_type as k from events), p as (select a.k as a, b.k as b, count(*) as n from d a join d b on a.user_id = b.user_id and a.k <> b.k group by 1, 2) select a, b, n, round(n / sum(n) over (), 6) as share from p""")
def cooccurrence(spark, sf_dir):
    """AGG21."""
    return rounded(stats.co_occurrence(A.table(spark, sf_dir, "events"), "user_id", "event_type"), "share")


@query("""with c as (select o_totalprice as v, count(*) as n from orders where o_totalprice is not null group by 1) select v, n, round(sum(n) over (order by v) / (select sum(n) from c), 6) as share from c""")
def ecdf(spark, sf_dir):
    """STAT7."""
    return rounded(stats.empirical_distribution(A.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v")), "v"), "share")


@query("with c as (select lang, count(*) as n from documents group by 1) select lang, n, round(n / sum(n) over (), 6) as share from c")
def label_histogram(spark, sf_dir):
    """AGG14, AGG16."""
    return rounded(stats.histogram(A.table(spark, sf_dir, "documents"), "lang"), "share")


_CONFIGS = "m as (select p_brand as by_, p_type as config, avg(p_retailprice) / 2000 as up, avg(p_size) / 50 as down from part group by 1, 2)"


def _configs(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("by_"), F.col("p_type").alias("config")).agg((F.avg("p_retailprice") / 2000).alias("up"), (F.avg("p_size") / 50).alias("down"))


@query(f"with {_CONFIGS}, s as (select *, (up + 1 - down) / 2 as score from m), n as (select *, row_number() over (partition by by_ order by round(score, 9) desc, config) as nth from s) select by_, config, round(score, 12) as final_score, nth::INT as nth from n where nth <= 3")
def best_config_topn(spark, sf_dir):
    """WIN2: the three best configurations of each group (a report), raw."""
    return rounded(stats.best_configs(_configs(spark, sf_dir), "by_", "config", ["up"], ["down"], 3, scaled=False).select("by_", "config", "final_score", "nth"), "final_score", digits=12)


@query(f"""with {_CONFIGS}, w as (select *, min(up) over (partition by by_) as l, max(up) over (partition by by_) as h, min(down) over (partition by by_) as dl, max(down) over (partition by by_) as dh from m), s as (select by_, config, (case when h = l then 0 else (up - l) / (h - l) end + 1 - case when dh = dl then 0 else (down - dl) / (dh - dl) end) / 2 as score from w),
    n as (select *, row_number() over (partition by by_ order by round(score, 9) desc, config) as nth from s) select by_, config, round(score, 6) as final_score, nth::INT as nth from n where nth <= 1""")
def minmax_best(spark, sf_dir):
    """STAT18, SORT1: the best of each group by scaled measures (a report)."""
    return rounded(stats.best_configs(_configs(spark, sf_dir), "by_", "config", ["up"], ["down"], 1, scaled=True).select("by_", "config", "final_score", "nth"), "final_score")


@query(f"with {_CONFIGS}, n as (select config, 10 - (row_number() over (partition by by_ order by up desc, config) - 1) as p from m), s as (select config, sum(p)::BIGINT as points from n where p > 0 group by 1) select config, points, row_number() over (order by points desc, config)::INT as rank from s")
def rank_points(spark, sf_dir):
    """WIN1, AGG20."""
    return stats.rank_points(_configs(spark, sf_dir), "by_", "config", "up", 10).withColumn("points", F.col("points").cast("bigint"))


# --- sampling -------------------------------------------------------------------------------------------------------

_CL = "cl as (select vec_id as doc_id, label as cluster from embeddings)"


def _clusters(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))


@query(f"""with {_CL}, u as (select *, {A.unit_sql("doc_id", salt="member")} as u1, {A.unit_sql("doc_id", salt="pool")} as u2, count(*) over (partition by cluster) as size from cl), s as (select *, row_number() over (partition by cluster order by u1, doc_id) as nth from u),
    r as (select doc_id, cluster, row_number() over (order by -ln(1 - u2) / size, doc_id) as nth from s where nth > 1) select doc_id, cluster from s where nth = 1 union all select doc_id, cluster from r where nth <= 100 - (select count(distinct cluster) from cl)""")
def alpha_pool(spark, sf_dir):
    """SAMP1: a pool of a hundred (a sample by definition)."""
    return sampling.cluster_pool(_clusters(spark, sf_dir), 100)


_ODDS = """sz as (select cluster, count(*) as size, pow(count(*)::DOUBLE, 0.5) as w from cl group by 1), od as (select *, sum(w) over (order by cluster) / sum(w) over () as hi0, row_number() over (order by cluster desc) as b from sz), oi as (select cluster, size, coalesce(lag(hi0) over (order by cluster), 0) as lo, case when b = 1 then 2 else hi0 end as hi from od),
    gr as (select r::INT as run, s::INT as slot from range(200) t(r), range(6) v(s)), mb as (select cluster, doc_id, row_number() over (partition by cluster order by doc_id) - 1 as nth from cl)"""


@query(f"""with {_CL}, {_ODDS}, dr as (select *, {A.unit_sql("run", "slot", salt="cluster")} as u, {A.unit_sql("run", "slot", salt="member")} as v from gr), ch as (select run, slot, cluster, floor(v * size)::BIGINT as nth from dr join oi on u >= lo and u < hi) select run, slot, doc_id, cluster from ch join mb using (cluster, nth)""")
def alpha_seeds_v1(spark, sf_dir):
    """SAMP2, SAMP4."""
    return sampling.seed_table(_clusters(spark, sf_dir), 200, 6, 0.5)


@query(f"""with {_CL}, {_ODDS}, dr as (select *, {A.unit_sql("run", salt="cluster")} as u, {A.unit_sql("run", "slot", salt="member")} as v from gr), ch as (select run, slot, cluster, floor(v * size)::BIGINT as nth from dr join oi on u >= lo and u < hi) select run, slot, doc_id, cluster from ch join mb using (cluster, nth)""")
def alpha_seeds_v2(spark, sf_dir):
    """SAMP3."""
    return sampling.seed_table(_clusters(spark, sf_dir), 200, 6, 0.5, one_cluster_a_run=True)


@query(f"with o as (select doc_id, row_number() over (order by {A.unit_sql('doc_id', salt='subset')}, doc_id) as n from documents) select doc_id from o where n <= 300")
def random_subset(spark, sf_dir):
    """SAMP6: three hundred documents (a sample by definition)."""
    return sampling.random_subset(A.table(spark, sf_dir, "documents").select("doc_id"), 300, "doc_id")


@query(f"with o as (select doc_id, row_number() over (order by {A.unit_sql('doc_id', salt='split')}, doc_id) as n, count(*) over () as t from documents) select doc_id, case when n <= t - ceil(t * 0.05 - 1e-9) then 'train' else 'validation' end as split from o")
def random_split(spark, sf_dir):
    """SAMP8."""
    return sampling.split(A.table(spark, sf_dir, "documents").select("doc_id"), 0.95, "doc_id")


@query("with o as (select doc_id, row_number() over (order by doc_id) as n, count(*) over () as t from documents) select doc_id, case when n <= t - ceil(t * 0.2 - 1e-9) then 'train' else 'validation' end as split from o")
def sequential_split(spark, sf_dir):
    """SAMP9, with disjoint parts."""
    return sampling.split(A.table(spark, sf_dir, "documents").select("doc_id"), 0.8, "doc_id", shuffled=False)


@query(f"select conv_id, turn, ['s0', 's1', 's2', 's3', 's4'][floor({A.unit_sql('conv_id', 'role', salt='style')} * 5)::INT + 1] as style from conversations")
def writer_style(spark, sf_dir):
    """SAMP11: one style for a writer of a conversation."""
    options = F.array(*[F.lit(f"s{k}") for k in range(5)])
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", sampling.pick(options, "conv_id", "role", salt="style").alias("style"))


# --- elements and words ---


@query("with " + A.WORDS + """, g as (select doc_id, idx, word, row_number() over (partition by doc_id, word order by idx) as nth from w) select doc_id, word, count(*) as n, min(idx) as first from g group by 1, 2""")
def entities_per_document(spark, sf_dir):
    """AGG22 over words as labels."""
    w = A.words(spark, sf_dir)
    return elements.entity_counts(w.withColumn("label", F.col("word"))).withColumnRenamed("label", "word").join(w.groupBy("doc_id", "word").agg(F.min("idx").alias("first")), ["doc_id", "word"])


@query("with " + A.WORD_BOXES + """, c as (select *, greatest((length(word) + 5) // 6, 1) as n from wb), p as (select *, unnest(range(n)) as piece from c), e as (select *, piece * 6 as a, least(piece * 6 + 6, length(word)) - 1 as z from p)
    select doc_id, idx, piece::INT as piece, substr(word, a + 1, 6) as word, case when n = 1 then x0 else x0 + 4 * a + a % 4 end as x0, case when n = 1 then y0 else y0 + a % 4 end as y0, case when n = 1 then x2 else x0 + 4 * z + 3 end as x2, case when n = 1 then y2 else y2 - z % 4 end as y2 from e""")
def word_pieces(spark, sf_dir):
    """ARR1."""
    char = lambda i: F.struct((F.col("x0") + 4 * i + i % 4).alias("x0"), (F.col("y0") + i % 4).alias("y0"), (F.col("x0") + 4 * i + 3).alias("x2"), (F.col("y2") - i % 4).alias("y2"))
    w = A.word_boxes(spark, sf_dir).withColumn("chars", F.transform(F.sequence(F.lit(0), F.length("word") - 1), char))
    return elements.word_pieces(w, 6).select("doc_id", "idx", "piece", "word", "x0", "y0", "x2", "y2")


@query("""select round(avg(coalesce(case when n_chars > 0 then 1 + n_chars // 20000 end, 1)), 6) as mean_pages, bool_or(text is not null) as has_words, count(*) as n from documents""")
def dataset_info(spark, sf_dir):
    """AGG17."""
    d = A.table(spark, sf_dir, "documents").select((1 + F.floor(F.col("n_chars") / 20000)).alias("pages"), F.col("text").alias("words"))
    return rounded(elements.dataset_info(d), "mean_pages")


@query("""select doc_id, case doc_id % 5 when 0 then 'stamp' when 1 then null when 2 then 'figure' when 3 then 'photo' else 'barcode' end as kind, case when doc_id % 5 = 1 then 'unknown-type' when doc_id % 3 = 0 then 'invalid-size' end as error,
    case when doc_id % 4 = 0 then 'author' || doc_id % 7 end as author, case when doc_id % 4 <> 0 then 'no-authorid' when doc_id % 6 = 0 then 'no-text' when doc_id % 10 <> 0 then 'not-found' end as hw_error from documents""")
def element_errors(spark, sf_dir):
    """PRJ18, PRJ19, PRJ20."""
    i = F.col("doc_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("seal", "Chart", "infographic", "photo", "barcode")]), (i % 5 + 1).cast("int"))
    classes = F.when(i % 4 == 0, F.concat(F.lit("handwritten author"), (i % 7).cast("string"), F.lit(" signature"))).otherwise("handwritten")
    who = elements.author(classes)
    return A.table(spark, sf_dir, "documents").select("doc_id", elements.visual_type(name).alias("kind"), elements.visual_error(name, i % 3, F.lit(1)).alias("error"), who.alias("author"),
                                                       elements.handwriting_error(who, F.when(i % 6 != 0, "x").when(i % 12 == 0, " \t\n"), i % 10 == 0).alias("hw_error"))


# --- expressions ---


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) as collapsed, 'Question: ' || source || ' Answer: ' || lang as qa,
    case when doc_id % 2 = 0 then 'd' || doc_id else 'e' || doc_id end as base, replace(replace('{a} of {b} in {c}', '{a}', lang), '{b}', source) as prompt from documents""")
def text_functions(spark, sf_dir):
    """STR1, STR24, STR25, PRJ24."""
    i = F.col("doc_id").cast("string")
    sample = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), i, F.lit("_page_7"))).otherwise(F.concat(F.lit("e"), i, F.lit("_subsample_2")))
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.collapse_spaces(F.col("text"))).alias("collapsed"), T.qa_text(F.col("source"), F.col("lang")).alias("qa"), T.base_id(sample).alias("base"), T.filled(F.lit("{a} of {b} in {c}"), {"a": F.col("lang"), "b": F.col("source")}).alias("prompt"))


@query("with " + _TAGS + """, l as (select doc_id, string_agg(word || ' ' || tag, ' ' order by idx) as t, count(*) as n, count(*) filter (tag <> 'O') as tagged from tg where regexp_matches(word, '^[A-Za-z]+$') group by 1) select doc_id, md5(t) as digest, n, tagged from l""")
def labelled_text_round_trip(spark, sf_dir):
    """STR20, STR21: words and labels as one text, and read from it again."""
    tagged = F.transform("words", lambda w, i: F.struct(i.alias("idx"), w.alias("word"), _tag(i).alias("tag")))
    per = A.word_arrays(spark, sf_dir).select("doc_id", F.filter(tagged, lambda e: e["word"].rlike("^[A-Za-z]+$")).alias("x"))
    if not per.groupBy("doc_id").count().filter("count > 1").isEmpty():  # rows of one id are one text; else no word is moved
        per = per.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("x"))
    t = per.select("doc_id", T.labelled_text(F.transform("x", lambda e: e["word"]), F.transform("x", lambda e: e["tag"])).alias("t"))
    pairs = t.select("doc_id", F.md5("t").alias("digest"), T.labelled_words(F.col("t"), ["NAME", "DATE", "TOTAL"]).alias("p"))
    n, labelled = F.size("p").cast("bigint"), F.size(F.filter("p", lambda p: p["label"] != "O")).cast("bigint")
    return pairs.select("doc_id", "digest", n.alias("n"), labelled.alias("tagged")).filter("n > 0")


@query("with " + A.WORD_BOXES + """ select doc_id, idx, x0::INT as x, y0::INT as y, (x2 - x0)::INT + 1 as width, (y2 - y0)::INT + 1 as height, x0::INT + (x2 - x0)::INT + 1 as right_edge from wb""")
def ocr_geometry(spark, sf_dir):
    """SRC12, PRJ25: boxes of OCR polygons, ends included."""
    w = A.word_boxes(spark, sf_dir)
    polygon = F.array("x0", "y0", "x2", "y0", "x2", "y2", "x0", "y2")
    g = w.select("doc_id", "idx", records.polygon_box(polygon).alias("g"))
    return g.select("doc_id", "idx", F.col("g")[0].alias("x"), F.col("g")[1].alias("y"), F.col("g")[2].alias("width"), F.col("g")[3].alias("height"), (F.col("g")[0] + F.col("g")[2]).alias("right_edge"))


@query("""with j as (select conv_id, turn, {'total_1': role, 'b': case when turn % 2 = 0 then ' ' else 'x' end, 'n': null} as o from conversations), e as (select conv_id, turn, unnest(['total_1', 'b']) as key, unnest([o.total_1, o.b]) as value from j)
    select conv_id, turn, key as id, null::VARCHAR as "group", key, value, case when trim(value) = '' then 'missing-value' end as error from e""")
def ground_truth_items(spark, sf_dir):
    """PRJ22."""
    c = A.table(spark, sf_dir, "conversations")
    raw = F.to_json(F.struct(F.col("role").alias("total_1"), F.when(F.col("turn") % 2 == 0, " ").otherwise("x").alias("b")))
    return c.select("conv_id", "turn", F.explode(elements.ground_truth_items(raw)).alias("i")).select("conv_id", "turn", "i.id", "i.group", "i.key", "i.value", "i.error")


@query("""select conv_id, turn, unnest(['a', 'b<<%?c', 'b<<%?d']) as key, unnest([role, turn::VARCHAR, 'x']) as value from conversations""")
def flat_answers(spark, sf_dir):
    """ARR4: nested answers, one level flattened."""
    c = A.table(spark, sf_dir, "conversations")
    raw = F.to_json(F.struct(F.col("role").alias("a"), F.struct(F.col("turn").cast("string").alias("c"), F.lit("x").alias("d")).alias("b")))
    return c.select("conv_id", "turn", F.explode(elements.flat_answers(raw)).alias("e")).select("conv_id", "turn", "e.key", "e.value")


@query("""select vec_id, round((vec_id % 500) * 72.0 / 96, 6) as points, round((vec_id % 500) * (72 / 25.4), 6) as mm_points, round((vec_id % 500) * (200 / 72), 6) as pixels,
    (((vec_id % 500) + 1) * least(100.0 / ((vec_id % 500) + 1), 80.0 / ((vec_id % 300) + 1)))::DOUBLE as w0, round(case when vec_id < 100 then 0.5 * vec_id / 100 else greatest(0.5 - 0.45 * (vec_id - 100) / 900, 0.05) end, 6)::DOUBLE as rate from embeddings""")
def unit_conversions(spark, sf_dir):
    """GEO10, GEO14 (before truncation), GEO17."""
    v = F.col("vec_id") % 500
    scale = F.least(F.lit(100.0) / (v + 1), F.lit(80.0) / (F.col("vec_id") % 300 + 1))
    df = A.table(spark, sf_dir, "embeddings").select("vec_id", G.pixels_to_points(v).alias("points"), G.millimetres_to_points(v).alias("mm_points"), G.points_to_pixels(v).alias("pixels"), ((v + 1) * scale).alias("w0"), G.learning_rate(F.col("vec_id"), 1000, 0.1, 0.5, 0.05).alias("rate"))
    return rounded(df, "points", "mm_points", "pixels", "rate")


@query("with " + A.WORDS + """, h as (select doc_id as id, length(word)::INT as bin, count(*) as n from w group by 1, 2), r as (select id, bin, sum(n) over (partition by id order by bin) as w0, sum(n * bin) over (partition by id order by bin) as s0, sum(n) over (partition by id) as t, sum(n * bin) over (partition by id) as s from h),
    v as (select id, bin, case when t > w0 then w0 * (t - w0) * (s0 / w0 - (s - s0) / (t - w0)) * (s0 / w0 - (s - s0) / (t - w0)) end as v from r), n as (select *, row_number() over (partition by id order by round(v, 6) desc nulls last, bin) as nth from v) select id, bin as threshold from n where nth = 1 and v is not null""")
def otsu_threshold(spark, sf_dir):
    """GEO18 on lengths of words."""
    h = A.words(spark, sf_dir).groupBy(F.col("doc_id").alias("id"), F.length("word").alias("bin")).agg(F.count("*").alias("n"))
    return stats.otsu(h).filter("threshold is not null")


@query("with " + A.WORD_BOXES + """, i as (select doc_id as id, min(x0) as l, min(y0) as t, max(x0) as r, max(y0) as b from wb group by 1) select d.doc_id as id, case when l is null then 0 else greatest(l - 2, 0) end as x0, case when l is null then 0 else greatest(t - 2, 0) end as y0,
    case when l is null then 1 else least(r + 2, 551) + 1 end as x2, case when l is null then 1 else least(b + 2, 999) + 1 end as y2 from documents d left join i on d.doc_id = i.id""")
def ink_boxes(spark, sf_dir):
    """GEO20 on corners of words."""
    images = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(552).alias("width"), F.lit(1000).alias("height"))
    return elements.ink_box(A.word_boxes(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y")), images, 2)


@query("with " + A.WORD_BOXES + """, l as (select doc_id, x0, max(y0) as y from wb group by 1, 2) select doc_id as id, floor(quantile_cont(y, 0.3))::INT as baseline from l group by 1""")
def baselines(spark, sf_dir):
    """GEO19 on corners of words."""
    return elements.baseline(A.word_boxes(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y")), 0.3)


@query("with " + A.WORD_BOXES + """, e as (select doc_id, min(x0) as l, max(x2) as r, max(y2) as b from wb group by 1) select doc_id, ceil(case when (r - l) / 650.0 < 0.7 then r - l + 2 * greatest(l, 0) else 650.0 end + 5)::BIGINT as width, ceil(greatest(b, 400.0) + 5)::BIGINT as height from e""")
def page_extents(spark, sf_dir):
    """GEO15."""
    w = A.word_boxes(spark, sf_dir).select("doc_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x2") - F.col("x0")).alias("width"), (F.col("y2") - F.col("y0")).alias("height"), F.lit(650.0).alias("body_width"), F.lit(400.0).alias("body_height"))
    return elements.page_extent(w)


@query("""select source, arg_max(doc_id, n_chars * 10000000 + doc_id) as doc_id from documents group by 1""")
def latest_checkpoint(spark, sf_dir):
    """SORT3: the row with the largest number of each group."""
    d = A.table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") * 10_000_000 + F.col("doc_id")).alias("step"))
    return elements.latest(d, "source", "step").select("source", "doc_id")


@query("""with a as (select vec_id, row_number() over (order by vec_id) as pos from embeddings), b as (select vec_id, row_number() over (order by case when vec_id < 10 then -vec_id else vec_id end) as pos from embeddings) select count(*) filter (a.vec_id is distinct from b.vec_id) as differences from a full join b on a.pos = b.pos""")
def id_alignment(spark, sf_dir):
    """JOIN12: lists of ids that should be in the same order."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id")
    a = order.numbered(e, F.col("vec_id"), "pos")
    b = order.numbered(e, F.when(F.col("vec_id") < 10, -F.col("vec_id")).otherwise(F.col("vec_id")), "pos")
    return elements.same_ids(a, b, "vec_id")


@query(f"""with {_CL}, {_ODDS}, dr as (select *, {A.unit_sql("run", "slot", salt="cluster")} as u, {A.unit_sql("run", "slot", salt="member")} as v from gr), ch as (select run, slot, cluster, floor(v * size)::BIGINT as nth from dr join oi on u >= lo and u < hi), l as (select run, slot, doc_id from ch join mb using (cluster, nth))
    select run, max(case when slot = 0 then doc_id end) as seed_0, max(case when slot = 1 then doc_id end) as seed_1, max(case when slot = 2 then doc_id end) as seed_2, max(case when slot = 3 then doc_id end) as seed_3, max(case when slot = 4 then doc_id end) as seed_4, max(case when slot = 5 then doc_id end) as seed_5 from l group by 1""")
def seeds_wide(spark, sf_dir):
    """SAMP4: the wide table of seeds."""
    long = sampling.seed_table(_clusters(spark, sf_dir), 200, 6, 0.5)
    wide = long.groupBy("run").pivot("slot", list(range(6))).agg(F.max("doc_id"))
    return wide.select("run", *[F.col(str(k)).alias(f"seed_{k}") for k in range(6)])


@query("select event_type, count(*) as n from events group by 1")
def stream_resume(spark, sf_dir):
    """STM1, STM3: events ingested by a stream that takes what is there and stops; a second call adds nothing."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # a local session alone may do without a shared folder
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
    base = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
    events = A.table(spark, sf_dir, "events").select("event_id", "event_type")
    events.write.parquet(f"{base}/source")
    for _ in range(2):
        incremental.ingest_new(spark, f"{base}/source", events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), f"{base}/sink", f"{base}/state")
    return spark.read.parquet(f"{base}/sink").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""select conv_id, list_transform(list_filter(list_sort(list({'t': turn, 'r': role, 'c': text})), lambda x: x.r = 'assistant'), lambda x: x.t) as turns from conversations group by 1""")
def confirmed_turns(spark, sf_dir):
    """PRJ8, ARR: entries kept with their original positions."""
    c = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("ts"))
    entries = F.transform("ts", lambda t: F.struct(t["role"].alias("answer"), F.when(t["role"] == "assistant", F.array(t["turn"])).otherwise(F.array().cast("array<bigint>")).alias("indices")))
    return c.select("conv_id", F.transform(elements.confirmed(entries), lambda x: x["start"]).alias("turns"))


# --- sets, sinks, streams -------------------------------------------------------------------------------------------------


@query("select doc_id as id, text, 'real' as origin, lang from documents union all select conv_id, text, 'synthetic', null from conversations")
def mixed_concat(spark, sf_dir):
    """SET1."""
    real = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("real").alias("origin"), "lang")
    return real.unionByName(A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text", F.lit("synthetic").alias("origin")), allowMissingColumns=True)


@query("""with n as (select o_orderkey as k, o_totalprice * 2 as price from orders where o_orderkey % 3 = 0), o as (select o_orderkey as k, o_totalprice as price from orders where o_orderkey % 2 = 0) select k, price from n union all select k, price from o where k not in (select k from n)""")
def metrics_upsert(spark, sf_dir):
    """SNK9."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return sinks.upserted(o.filter("k % 2 = 0"), o.filter("k % 3 = 0").withColumn("price", F.col("price") * 2), "k")


@query("""with o as (select o_orderkey as doc_id, o_totalprice as price, o_orderstatus as status from orders where o_orderkey % 2 = 0), n as (select o_orderkey as doc_id, case when o_orderkey % 5 = 0 then null else o_totalprice + 1 end as price, o_custkey as cust from orders where o_orderkey % 3 = 0)
    select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.price, o.price) as price, status, cust from o full join n on o.doc_id = n.doc_id""")
def log_merge(spark, sf_dir):
    """SNK4."""
    t = A.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "doc_id")
    old = t.filter("doc_id % 2 = 0").select("doc_id", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    new = t.filter("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("o_totalprice") + 1).alias("price"), F.col("o_custkey").alias("cust"))
    return sinks.merged_log(old, new)


@query("select conv_id from (select distinct conv_id from conversations) where conv_id not in (select conv_id from conversations where role = 'system')")
def resume_not_done(spark, sf_dir):
    """STM3, SET2."""
    c = A.table(spark, sf_dir, "conversations")
    return incremental.not_done(c.select("conv_id").distinct(), c.filter("role = 'system'").select("conv_id").distinct(), "conv_id")


@query("""select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2""")
def event_windows(spark, sf_dir):
    """Tumbling windows over events (an extension)."""
    e = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("with " + A.WORD_BOXES + """ select doc_id, idx, 'hw' || doc_id % 7 || '_b' || coalesce(case when idx % 3 > 0 then block_no end::VARCHAR, 'X') || '_l' || coalesce(case when idx % 4 > 0 then line_no end::VARCHAR, 'X') || '_w' || word_no || '.png' as file,
    case idx % 6 when 0 then 'layoutlm' when 1 then 'clip' when 2 then 'sentence' when 3 then 'pooled' when 4 then 'combined' end as encoder, case when idx % 2 = 0 then 0 else 2 end::INT as n_words from wb""")
def word_names(spark, sf_dir):
    """STR18, STR27, STR29."""
    w, i = A.word_boxes(spark, sf_dir), F.col("idx")
    name = F.element_at(F.array(*[F.lit(x) for x in ("layout", "image", "text", "paper_kernel=4", "combined", "other")]), (i % 6 + 1).cast("int"))
    file = T.word_image_name(F.concat(F.lit("hw"), (F.col("doc_id") % 7).cast("string")), F.when(i % 3 > 0, F.col("block_no")), F.when(i % 4 > 0, F.col("line_no")), F.col("word_no"))
    text = F.when(i % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("word"), F.lit("\t x ")))
    return w.select("doc_id", "idx", file.alias("file"), T.display_name(name).alias("encoder"), F.size(T.as_words(text)).alias("n_words"))


@query("with " + A.WORD_BOXES + """ select doc_id, idx, round(x0 / 612, 6) as x0, round(y0 / 792, 6) as y0, round((x0 + 30) / 612, 6) as x2, round((y0 + 10) / 792, 6) as y2, case when doc_id % 2 = 0 then 1700 else 612 end::INT as width from wb""")
def page_shares(spark, sf_dir):
    """GEO7, GEO11, GEO13."""
    w = A.word_boxes(spark, sf_dir)
    b = G.position_box(F.struct(F.col("x0").alias("x_points"), F.col("y0").alias("y_points"), F.lit(30.0).alias("width_points"), F.lit(10.0).alias("height_points")))
    size = G.size_for_boxes(F.when(F.col("doc_id") % 2 == 0, True), F.lit(1700), F.lit(612))
    out = w.select("doc_id", "idx", G.page_share(b, F.lit(612.0), F.lit(792.0)).alias("b"), size.alias("width"))
    return rounded(out.select("doc_id", "idx", "b.x0", "b.y0", "b.x2", "b.y2", "width"), "x0", "y0", "x2", "y2")
