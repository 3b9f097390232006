import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import boxes, handwriting, labels, metrics, sampling, stats, summary, vectors, verify
from quire.sources import records, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


WORDS = ["Invoice", "No.", "4711", "Total", "19.90", "EUR"]


@pytest.mark.parametrize(
    "pattern, allowed, expected",
    [
        ("total 19.90", None, ("Total 19.90", 1.0, True, [3, 4])),
        ("Totel 19,90", None, ("Total 19.90", 0.818182, True, [3, 4])),
        ("Invoice N", None, ("Invoice N", 1.0, True, [0, 1])),
        ("", None, ("", -1.0, False, [])),
        ("x" * 60, None, ("", -1.0, False, [])),
        (None, None, ("", -1.0, False, [])),
        ("zzzz", None, ("Invo", 0.0, False, [])),
        ("total 19.90", [0, 1], ("nvoice No. ", 0.181818, False, [])),
        ("total 19.90", [3, 4, 5], ("Total 19.90", 1.0, True, [3, 4])),
    ],
)
def test_fuzzy_spans(spark, pattern, allowed, expected):
    df = spark.createDataFrame([(1, 0, WORDS, pattern, allowed)], "doc_id int, pattern_id int, words array<string>, pattern string, allowed array<int>")
    r = verify.fuzzy_spans(df, restricted=True).first()
    assert (r.span, round(r.score, 6), r.found, r.indices) == expected


def test_fuzzy_ties_and_empty_texts(spark):
    rows = [(1, 0, ["a", "b", "a", "b"], "a b"), (2, 0, [], "x"), (3, 0, ["Ä", "ö"], "ä ö")]
    got = {r.doc_id: r for r in verify.fuzzy_spans(spark.createDataFrame(rows, "doc_id int, pattern_id int, words array<string>, pattern string")).collect()}
    assert got[1].indices == [0, 1] and got[2].score == -1.0 and got[3].found


def test_window_distances():
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    text, pat = "the quick brown fox jumps over the lazy dog " * 3, "brwn foxx"
    assert verify.window_distances(text, pat).tolist() == [lev(text[k : k + len(pat)], pat) for k in range(len(text) - len(pat) + 1)]


@pytest.mark.parametrize(
    "word, parts",
    [("handwriting", ["handwr", "iting"]), ("abcdefghijklm", ["abcde", "fghi", "jklm"]), ("INV2024-07", ["INV", "20", "24", "-", "07"]), ("Quittungsnummer12345", ["Quitt", "ungsn", "ummer", "12", "34", "5"]), ("", [""])],
)
def test_word_parts(spark, word, parts):
    assert value(spark, T.digit_aware_parts(F.lit(word), 6, 2)) == parts


def test_text(spark):
    assert value(spark, T.collapse_spaces(F.lit(" \n a\t b  c\n"))) == "a b c"
    docs = value(spark, T.html_documents(F.lit("x <!DOCTYPE html><p>1</html> y <!doctype HTML>\n2</HTML>")))
    assert docs == ["<!DOCTYPE html><p>1</html>", "<!doctype HTML>\n2</HTML>"]
    html = '<script type="application/json" id="GT"> {"q":"a"}\n</script><p>'
    assert value(spark, T.gt_script(F.lit(html))) == '{"q":"a"}' and value(spark, T.gt_script(F.lit("<p>"))) is None
    assert value(spark, T.without_gt_script(F.lit(html))) == "<p>"
    assert value(spark, T.print_ready(F.lit("<head>@page { a }</head></head>"), "s")) == "<head><style>s</style></head></head>"
    style = F.lit("width:35mm;height:3.5cm")
    assert (value(spark, T.style_millimetres(style, "width")), value(spark, T.style_millimetres(style, "height"))) == (35, 35)
    assert value(spark, T.style_millimetres(F.lit("width:10px"), "width")) is None
    assert value(spark, T.rotation_degrees(F.lit("transform:rotate(-15deg)"))) == -15.0 and value(spark, T.rotation_degrees(F.lit(""))) is None
    assert value(spark, T.is_right_to_left(F.lit("אב"))) and not value(spark, T.is_right_to_left(F.lit("ab")))
    assert [tuple(x) for x in value(spark, T.spaced_parts(F.lit("a  b")))] == [("a", False), ("b", True)]
    assert value(spark, T.padded(F.array(F.lit("a"), F.lit("abc")))) == ["a  ", "abc"]
    assert [tuple(x) for x in value(spark, T.entity_items(F.lit("a=1|b|c=2=3|d=")))] == [("a", "1"), ("d", "")]
    pairs = value(spark, T.labelled_words(F.lit("Bob B-NAME saw O Ann B-XX"), ["NAME"]))
    assert [tuple(x) for x in pairs] == [("Bob", "B-NAME"), ("saw", "O")]
    assert value(spark, T.labelled_text(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("O"), F.lit("B-X")))) == "a O b B-X"
    assert value(spark, T.base_id(F.lit("d_page_3"))) == "d" and value(spark, T.base_id(F.lit("d_subsample_1"))) == "d"
    assert value(spark, T.filled(F.lit("{a} and {b}"), {"a": F.lit("1"), "b": F.lit("2")})) == "1 and 2"
    assert value(spark, T.element_text(F.lit("input"), F.lit(" v "), F.lit("t"))) == "v"


def lit_box(*v):
    return G.box(*[F.lit(float(x)) for x in v])


def test_geometry(spark):
    a, b = lit_box(0, 0, 10, 10), lit_box(5, 5, 15, 15)
    assert round(value(spark, G.iou(a, b)), 6) == 0.142857 and value(spark, G.iou(a, lit_box(10, 0, 20, 10))) == 0.0
    assert value(spark, G.overlap_ratio(a, lit_box(5, 5, 7, 7))) == 1.0 and value(spark, G.overlap_ratio(a, b)) == 0.25
    assert value(spark, G.overlap_ratio(a, lit_box(1, 1, 1, 5))) == 0.0
    assert value(spark, G.contains(a, lit_box(0, 0, 10, 10))) and not value(spark, G.contains(a, b))
    assert tuple(value(spark, G.clipped(lit_box(-5, 2, 50, 90), F.lit(20.0), F.lit(30.0)))) == (0.0, 2.0, 19.0, 29.0)
    assert value(spark, G.is_detectable(lit_box(-5, 0, 50, 90), F.lit(20.0), F.lit(30.0)))
    assert round(value(spark, G.message_cost(F.lit(10000), F.lit(2000), F.lit(3000), F.lit(4000), (3.0, 15.0, 3.75, 0.3))), 6) == 0.0834
    assert tuple(value(spark, G.fitted_size(F.lit(400), F.lit(200), 100, 100))) == (100, 50)
    rates = [value(spark, G.learning_rate(F.lit(k), 100, 0.1, 1.0, 0.1)) for k in (0, 5, 10, 55, 100, 200)]
    assert [round(x, 9) for x in rates] == [0.0, 0.5, 1.0, 0.55, 0.1, 0.1]


def test_run_features(spark):
    ranks = [0, 0, 0, 1, 1, 2, 2, 2, 2, 0, 0]
    df = spark.createDataFrame([(1, k, r) for k, r in enumerate(ranks)], "doc_id int, pos int, rank int")
    assert [r.place for r in labels.run_positions(df).orderBy("pos").collect()] == [1, 2, 3, 1, 3, 1, 2, 2, 3, 1, 0]
    r = labels.first_tokens(df, 5).first()
    assert r.firsts == [3, 5, 0, 0, 0] and r.n_firsts == 2


def test_token_labels(spark):
    ids = F.array(*[F.lit(x).cast("int") for x in (None, 0, 0, 1, None)])
    assert value(spark, labels.first_piece_labels(ids, F.array(F.lit(7), F.lit(8)))) == [-100, 7, -100, 8, -100]
    assert value(spark, labels.gather(ids, F.array(F.lit(7), F.lit(8)), F.lit(0))) == [0, 7, 7, 8, 0]
    seq = F.array(*[F.lit(x).cast("int") for x in (None, 0, 0, 1, 1)])
    assert value(spark, labels.masked_word_ids(ids, seq)) == [-100, -100, -100, 1, -100]
    span = lambda a, b: tuple(value(spark, labels.answer_tokens(ids, F.lit(a), F.lit(b), F.lit(1), F.lit(5))))
    assert span(0, 1) == (1, 3) and span(0, 9) == (1, 4) and span(9, 1) == (-1, -1)
    assert value(spark, labels.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert sum(value(spark, labels.softmax(F.array(F.lit(1.0), F.lit(3.0))))) == pytest.approx(1)
    assert value(spark, labels.label_index(["a", "b"], F.lit("b"))) == 1
    with pytest.raises(Exception, match="unknown label"):
        value(spark, labels.label_index(["a"], F.lit("z")))


def test_tags(spark):
    df = spark.createDataFrame([(1, k, w, t) for k, (w, t) in enumerate(zip("ABCD", ["B-X", "I-X", "I-Y", "B-Y"], strict=True))], "doc_id int, idx int, word string, tag string")
    assert sorted((r.text, r.label) for r in verify.tag_spans(df).collect()) == [("A B", "X"), ("D", "Y")]
    same = metrics.entity_scores(df.drop("word"), df.drop("word")).filter("label = 'micro'").first()
    assert (same.support, same.f1) == (2, 1.0)


def test_cascade(spark):
    schema = "doc_id int, json_found boolean, json_valid boolean, annotation_found boolean, pages int, can_map boolean, n_ve_errors int, n_hw_errors int, n_missing_images int, ocr_found boolean, gt_passed boolean, n_words int"
    rows = [(1, True, True, None, 2, True, 0, 0, 0, False, True, 5), (2, *[None] * 11), (3, None, None, True, 1, True, 0, 0, 0, True, True, None), (4, True, True, None, 1, True, 0, 0, 0, True, True, 0)]
    df = spark.createDataFrame(rows, schema)
    assert [r.e for r in df.orderBy("doc_id").select(summary.first_error().alias("e")).collect()] == ["is_multipage", "invalid_raw_gt", None, "no_text"]
    assert df.filter("doc_id = 1").select(summary.all_errors().alias("e")).first().e == ["is_multipage", "missing_ocr"]
    empty = summary.counters(df.filter("doc_id < 0"), ["n_words"]).first()
    assert (empty.n_words_min, empty.n_words_max, empty.n_words_mean) == (99999, 0, None)


def test_statistics(spark):
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([2, 3, 5, 10])], "label int, size int")
    r = vectors.balance(sizes).first()
    assert [round(x, 6) for x in (r.entropy, r.cv, r.ratio, r.gini)] == [0.871369, 0.616441, 0.2, 0.325]
    counts = lambda rs: spark.createDataFrame([(k, *p) for k, p in enumerate(rs)], "k int, r int, s int")
    r = stats.divergences(counts([(10, 20), (20, 20), (30, 20)])).first()
    assert (round(r.js, 6), round(r.kl, 6)) == (0.150160, 0.087208)
    r = stats.divergences(counts([(10, 30), (20, 0)])).first()
    assert round(r.js, 6) == 0.564143 and math.isinf(r.kl)
    got = [value(spark, metrics.anls(F.lit(a), F.lit(b))) for a, b in (("Paris", "paris"), ("Pariss", "Paris"), ("ab", "xy"), ("", ""))]
    assert [round(x, 6) for x in got] == [1.0, 0.833333, 0.0, 0.0]
    d = stats.empirical_distribution(spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int"), "v").collect()
    assert sorted((r.v, round(r.share, 4)) for r in d) == [(1, 0.6667), (2, 1.0)]
    h = spark.createDataFrame([(1, b, n) for b, n in ((0, 50), (1, 0), (200, 30), (255, 20))], "id int, bin int, n int")
    assert stats.otsu(h).first().threshold == 0
    tied = spark.createDataFrame([(1, b, n) for b, n in ((2, 1), (4, 2), (5, 2), (6, 2), (8, 1))], "id int, bin int, n int")
    assert stats.otsu(tied).first().threshold == 4  # as great at 5, but for the last bits of a double


def test_vectors(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (60, 4)), r.normal(3, 2, (60, 4))])
    df = spark.createDataFrame([(k, v.tolist(), int(k >= 60)) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    c = np.zeros((4, 4))
    for row in vectors.covariance(df).collect():
        c[row.i, row.j] = row.cov
    assert np.allclose(c, np.cov(x.T))
    assert vectors.frechet(df, df) == pytest.approx(0, abs=1e-6)
    shifted = df.withColumn("embedding", F.transform("embedding", lambda v: v + 2))
    assert vectors.frechet(df, shifted) == pytest.approx(16, abs=1e-6)
    near = vectors.neighbours(df.filter("vec_id % 40 = 0"), df, 3).collect()
    for q in (0, 40, 80):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [n.id for n in sorted((n for n in near if n.query == q), key=lambda n: n.nth)] == np.argsort(d, kind="stable")[:3].tolist()
    p = np.array([row.reduced for row in vectors.principal_components(df, 2).orderBy("vec_id").collect()])
    assert np.allclose(np.cov(p.T), np.diag(np.linalg.eigvalsh(np.cov(x.T))[::-1][:2]), atol=1e-8)
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.normalised(F.col("v")).alias("n")).first().n
    assert all(math.isnan(v) for v in zero)


def test_sampling(spark):
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4, 0).when(F.col("id") < 20, 1).otherwise(2).alias("cluster"))
    odds = {r.cluster: round(r.p, 6) for r in sampling.cluster_odds(docs, 0.5).collect()}
    assert odds == {0: 0.125, 1: 0.25, 2: 0.625}
    seeds = sampling.seed_table(docs, 300, 5, 0.5, one_cluster_a_run=True)
    assert seeds.count() == 1500 and seeds.groupBy("run").agg(F.countDistinct("cluster").alias("n")).filter("n > 1").isEmpty()
    assert sampling.cluster_pool(docs, 3).count() == 3 and sampling.cluster_pool(docs, 50).count() == 50 and sampling.cluster_pool(docs, -1).count() == 120
    for shuffled in (True, False):
        parts = {r.split: r["count"] for r in sampling.split(docs, 0.95, "doc_id", shuffled).groupBy("split").count().collect()}
        assert parts == {"train": 114, "validation": 6}
    a, b = sampling.equal_sizes(docs, docs.limit(10), "doc_id")
    assert a.count() == b.count() == 10 and sampling.runs_needed(10, 3) == 4


def test_detection(spark):
    gold = spark.createDataFrame([(1, "a", 0.0, 0.0, 50.0, 50.0), (1, "a", 100.0, 0.0, 150.0, 50.0), (2, "a", 0.0, 0.0, 50.0, 50.0)], "image_id int, label string, x0 double, y0 double, x2 double, y2 double")
    perfect = gold.withColumn("score", F.lit(0.9)).withColumn("det", F.monotonically_increasing_id())
    r = metrics.detection_scores(gold, perfect).filter("area = 'all' and most = 100").first()
    assert (round(r.ap, 6), round(r.ar, 6)) == (1.0, 1.0)
    # one of three found first, then a miss, then another: precision 1 up to recall 1/3, 2/3 up to 2/3
    rows = [(1, "a", 0.0, 0.0, 50.0, 50.0, 0.9, 0), (1, "a", 300.0, 0.0, 350.0, 50.0, 0.8, 1), (2, "a", 0.0, 0.0, 50.0, 50.0, 0.7, 2)]
    pred = spark.createDataFrame(rows, "image_id int, label string, x0 double, y0 double, x2 double, y2 double, score double, det int")
    r = metrics.detection_scores(gold, pred).filter("area = 'all' and most = 100").first()
    assert r.ap == pytest.approx((34 * 1 + 33 * 2 / 3) / 101) and r.ar == pytest.approx(2 / 3)


def test_boxes(spark):
    schema = "doc_id int, idx int, word string, x0 double, y0 double, x2 double, y2 double, block_no int, line_no int, word_no int"
    w = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 9.0, 12.0, 0, 0, 0), (1, 1, "b", 10.0, 1.0, 15.0, 9.0, 0, 0, 1)], schema)
    first, every = boxes.lines_first_last(w).first(), boxes.lines_envelope(w).first()
    assert (first.y2, every.y2, first.text) == (9.0, 12.0, "a b")
    seg = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 12.0), (1, 1, 0.0, 0.0, 9.0, 12.0)], "doc_id int, seg_idx int, x0 double, y0 double, x2 double, y2 double")
    got = {r.idx: r for r in boxes.best_segment(w, seg).collect()}
    assert got[0].seg_idx == 0 and got[0].iou == 1.0 and got[1].seg_idx is None and got[1].box.x0 == 10.0


def test_sources_and_sinks(spark, tmp_path):
    b = value(spark, records.parse_box(F.lit("1.0,2.0,3.0,4.0,a,b,c,0,1,2")))
    assert (b.text, b.block_no, b.line_no, b.word_no) == ("a,b,c", 0, 1, 2)
    assert value(spark, records.parse_box(F.lit("1,2,3"))) is None
    geo = value(spark, records.polygon_box(F.array(*[F.lit(float(v)) for v in (1.5, 2, 10, 2, 10, 8, 1.5, 8)])))
    assert geo == [2, 2, 9, 7] and value(spark, records.box_polygon(F.array(*[F.lit(v) for v in geo]))) == [2, 2, 10, 2, 10, 8, 2, 8]
    df = spark.createDataFrame([("a.1", "train", 1), ("b", "validation", 2)], "sample_id string, split string, x int")
    path = str(tmp_path / "d")
    sinks.write_records(df, path)
    sinks.write_records(df.limit(0), path)  # what is there stays
    config = records.find_config([records.DatasetConfig("d", path, "qa")], "d", False)
    assert records.load_dataset(spark, config).count() == 2 and records.load_dataset(spark, config, "train").count() == 1
    assert records.find_record(df, "a_1").first().x == 1
    with pytest.raises(ValueError, match="there are"):
        records.find_config([config], "e", False)
    twice = sinks.upserted(sinks.upserted(df.select("sample_id", "x"), spark.createDataFrame([("b", 5)], "sample_id string, x int"), "sample_id"), spark.createDataFrame([("b", 5)], "sample_id string, x int"), "sample_id")
    assert sorted(map(tuple, twice.collect())) == [("a.1", 1), ("b", 5)]
    assert sinks.parameter_hash({"b": 1, "a": 2}) == sinks.parameter_hash({"a": 2, "b": 1})
    with pytest.raises(ValueError, match="repeat"):
        sinks.write_embeddings(spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "sample_id string, embedding array<double>"), str(tmp_path / "e"))


def test_ingest(spark, tmp_path):
    from quire.streaming.incremental import ingest_new

    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).write.mode("append").parquet(src)
        ingest_new(spark, src, "id bigint", out, chk)
        ingest_new(spark, src, "id bigint", out, chk)  # nothing new: nothing twice
        assert spark.read.parquet(out).count() == 10 * (part + 1)


def test_elements(spark):
    from quire.operators import elements as E

    assert value(spark, E.visual_type(F.lit("seal"))) == "stamp" and value(spark, E.visual_error(F.lit("hologram"), F.lit(0), F.lit(1))) == "unknown-type"
    assert [value(spark, E.visual_type(F.lit(x))) for x in ("Seal", "plot", "qr", "logo")] == [None, "figure", None, "logo"]
    assert value(spark, E.visual_error(F.lit("logo"), F.lit(0), F.lit(1))) == "invalid-size" and value(spark, E.visual_error(F.lit("logo"), F.lit(-1), F.lit(1))) is None
    assert [value(spark, E.is_placeholder(F.lit(x))) for x in ("&?ve12", "ve1", "&?ve", "&?vex", "x&?ve1")] == [True, False, False, False, False]
    assert [value(spark, E.handwriting_error(F.lit("a"), F.lit(x), F.lit(True))) for x in (" \t\n", "\u2003", "x")] == ["no-text", "no-text", None]
    word = spark.createDataFrame([("abcdefgh", 0.0, 0.0, 80.0, 9.0, [(10.0 * k, float(k), 10.0 * k + 5, 9.0 - k) for k in range(8)])], "word string, x0 double, y0 double, x2 double, y2 double, chars array<struct<x0:double,y0:double,x2:double,y2:double>>")
    assert [tuple(r) for r in E.word_pieces(word, 5).orderBy("piece").select("word", "x0", "y0", "x2", "y2").collect()] == [("abcde", 0.0, 0.0, 45.0, 5.0), ("fgh", 50.0, 5.0, 75.0, 2.0)]
    assert [tuple(r) for r in E.word_pieces(word, 9).select("word", "x2").collect()] == [("abcdefgh", 80.0)]
    assert value(spark, E.author(F.lit("handwritten author2 signature"))) == "author2" and value(spark, E.is_signature(F.lit("a signature")))
    assert value(spark, E.key_value_error(F.lit("a b"), F.lit("x"), ["a", "b"])) == "multiple-labels" and value(spark, E.first_label(F.lit("x b"), ["a", "b"])) == "b"
    items = value(spark, E.ground_truth_items(F.lit('{"total_1": "5", "b": " "}')))
    assert [(i.key, i.group, i.error) for i in items] == [("total_1", None, None), ("b", None, "missing-value")] and [i.id for i in items] == ["total_1", "b"]
    flat = value(spark, E.flat_answers(F.lit('{"a": "1", "b": {"c": "2"}}')))
    assert [tuple(x) for x in flat] == [("a", "1"), ("b<<%?c", "2")]
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    assert value(spark, E.in_order_matches(arr("a", "b", "a", "c"), arr("a", "a", "b", "c"))) == [0, 2, -1, 3]
    df = spark.createDataFrame([(1, ["total", "sum"], ["totl", "summ", "total"])], "doc_id int, gold array<string>, pred array<string>")
    assert [tuple(p) for p in E.greedy_matches(df).first().pairs] == [(0, 2), (1, 1)]
    assert value(spark, E.line_width(F.array(*[F.struct(F.lit(w).alias("width"), F.lit(s).alias("space_before")) for w, s in ((5, False), (7, True), (3, False))]), 10, 2)) == 27
    assert tuple(value(spark, E.grid_place(F.lit(7), 3))) == (2, 1)
    ink = spark.createDataFrame([(1, 0, 3), (1, 0, 5), (1, 1, 7)], "id int, x int, y int")
    assert E.baseline(ink, 0.5).first().baseline == 6
    for p, box in ((0, (0, 3, 2, 8)), (2, (0, 1, 4, 8))):
        assert [tuple(r) for r in E.ink_box(ink, spark.createDataFrame([(1, 9, 8), (2, 5, 5)], "id int, width int, height int"), p).orderBy("id").collect()] == [(1, *box), (2, 0, 0, 1, 1)]
    entry = lambda a, *ix: F.struct(F.lit(a).alias("answer"), F.array(*[F.lit(i) for i in ix]).cast("array<int>").alias("indices"))
    assert [tuple(x) for x in value(spark, E.confirmed(F.array(entry("x"), entry("y", 3, 4))))] == [(1, "y", 3, 4)]


def test_handwriting_tasks_lines_and_entries(spark):
    rows = [("a", 0, "h1", "author1", "x", ["1,2,3,4,Hello, you,0,1,2", "1,2,3,4,generation,0,1,1"]), ("a", 1, "h2", None, " two　words ", None), ("a", 2, "h2", None, "more", []), ("a", 3, "h3", None, " ", None)]
    found = spark.createDataFrame(rows, "source_json string, pos int, hw_id string, author_id string, text string, bboxes array<string>")
    tasks, logs = handwriting.handwriting_tasks(found, 5, 2)
    got = {(r.hw_id, r.block_no, r.line_no, r.word_no): r for r in tasks.collect()}
    assert set(got) == {("h1", 0, 1, 2), ("h1", 0, 1, 1), *(("h2", -1, -1, 100000 + k) for k in range(3))}
    assert [tuple(s) for s in got["h1", 0, 1, 2].segments] == [("Hel", 0, False), ("lo,", 1, False), ("you", 2, True)]
    assert [s.token for s in got["h1", 0, 1, 1].segments] == ["gener", "ation"] and got["h1", 0, 1, 1].bbox == [1, 2, 3, 4]
    assert got["h2", -1, -1, 100002].segments[0].token == "more" and not got["h2", -1, -1, 100002].include_in_sentence
    assert sorted((r.pos, r.reason, r.num_words) for r in logs.collect()) == [(1, "missing_bbox_generated", 2), (2, "missing_bbox_generated", 1), (3, "missing_bbox_no_text", None)]
    words = [(0, "a", "h", 0, 1, 10, "b", "A1", False, True, "i"), (1, "a", "h", 0, 1, 2, "a", "A2", False, None, "j"), (2, "a", "h", 0, 1, 3, "c", "A2", True, True, "k"), (3, "a", "h", 0, 0, 9, "d", "A2", False, False, "l")]
    df = spark.createDataFrame(words, "pos int, source_json string, hw_id string, block_no int, line_no int, word_no int, text string, author_id string, skipped boolean, include_in_sentence boolean, image string")
    assert [tuple(r) for r in handwriting.sentence_lines(df).collect()] == [("a", "h", 0, 1, "a b", 2)]
    entry = handwriting.entries(df, ("image",)).first()
    assert entry.author_id == "A1" and [w.image for w in entry.words] == ["l", "j", "k", "i"]


def test_message_seeds(spark):
    logs = [(0, "b0", ["m1"], {"m1": '["old"]'}), (1, "b1", ["m1", "m2"], {"m1": '[["s1"], ["s2", "s3"]]', "m2": '[["s1"], ["s2", "s3"]]'}), (2, "b2", ["m3", "m4"], {"m3": '["s4"]', "m4": "[]"})]
    got = {r.message_id: (r.batch_id, r.seeds) for r in handwriting.message_seeds(spark.createDataFrame(logs, "pos int, batch_id string, message_ids array<string>, seeds map<string,string>")).collect()}
    assert got == {"m1": ("b1", ["s1"]), "m2": ("b1", ["s2", "s3"]), "m3": ("b2", ["s4"]), "m4": ("b2", [])}


def test_answered_windows_gathered_labels_layout_target(spark):
    df = spark.createDataFrame([(1, [-1, 3, 4], [-1, 5, -1], [[1], [2], [3]], None), (2, [-1], [-1], [[1]], None), (3, [], [], [], None)], "id int, s array<int>, e array<int>, x array<array<int>>, y array<int>")
    assert [tuple(r) for r in labels.answered_windows(df, "s", "e", ["x", "y"]).collect()] == [(1, [3], [5], [[2]], None)]
    one = spark.range(1).select(F.expr("array(-100, 1, 0)").alias("t"), F.expr("array(array(9d, 1d), array(1d, 1d), array(0d, 2d))").alias("l"), F.expr("array('O', 'B')").alias("n"))
    got = one.select(labels.gathered_labels(F.col("t"), F.col("l"), F.col("n")).alias("g")).first().g
    assert (got.targets, got.predictions) == (["B", "O"], ["O", "B"])
    assert value(spark, labels.layout_target(F.expr("array('T', 'F')"), F.expr("array(array(0.1d, 0.2009d, 0.9999d, 1d), array(0d, 0d, 0.5d, 0.5d))"))) == "<100><200><999><1000><T>,<0><0><500><500><F>"


def test_answer_coverage(spark):
    rows = [("train", ["a", "Big", "cat"], [1, -1], [2, -1], ["big cat"]), ("train", ["a"], [-1], [-1], ["a"]), ("train", ["abcd"], [0], [9], ["zz", "abcx"]), ("test", [], None, None, ["q"])]
    got = {r.split: r for r in metrics.answer_coverage(spark.createDataFrame(rows, "split string, words array<string>, starts array<int>, ends array<int>, golds array<string>"), "split").collect()}
    assert (got["train"].n_questions, got["train"].n_found, got["train"].anls) == (3, 2, pytest.approx(1.75 / 3))
    assert (got["test"].n_questions, got["test"].n_found, got["test"].anls) == (1, 0, 0)


def test_position_script(spark):
    page = value(spark, T.with_position_script(F.lit("<body>x</body>"), ("a", "b")))
    assert page.startswith("<body>x<script>") and page.endswith("</body>") and '["a", "b"]' in page
    assert value(spark, T.with_position_script(F.lit("x"))).startswith("x<script>")
    dump = '<div id="__positions_data__" style="display: none;">{"a": [{"index": 0, "className": "a", "text": "t", "x": 96, "y": 48.0, "width": 4, "height": 8}], "b": []}</div>'
    got = value(spark, T.dumped_positions(F.lit(dump), F.lit(0)))
    assert tuple(got["a"][0]) == (0, "t", 72, 36, 3, 6, 96, 48, 4, 8) and got["b"] == []
    assert value(spark, T.dumped_positions(F.lit(dump), F.lit(1))) == {} and value(spark, T.dumped_positions(F.lit("<p>"), F.lit(0))) == {}


def test_boxes_in_rects_of_any_height(spark):
    import random

    draw = random.Random(5)
    words = [(d, i, float(x), float(y), x + 20.0, y + 10.0) for d in range(3) for i in range(60) for x, y in [(draw.randrange(400), draw.randrange(-200, 900))]]
    rects = [(d, k, (float(draw.randrange(300)), float(draw.randrange(-100, 800)), 120.0, float(h))) for d in range(4) for k, h in enumerate([0, 1, 59, 60, 61, 700, 5000, -40, -300])]
    inside = lambda w, r: w[2] >= r[0] - 25 and w[3] >= r[1] - 25 and w[4] <= r[0] + r[2] + 25 and w[5] <= r[1] + r[3] + 25
    expected = {(d, k): [w[1] for w in words if w[0] == d and inside(w, r)] for d, k, r in rects}
    df = spark.createDataFrame(rects, "doc_id int, rect_id int, rect struct<x:double,y:double,width:double,height:double>")
    got = boxes.boxes_in_rect(spark.createDataFrame(words, "doc_id int, idx int, x0 double, y0 double, x2 double, y2 double"), df).collect()
    assert {(r.doc_id, r.rect_id): r.indices for r in got} == {k: v for k, v in expected.items() if v}


def test_detections_are_counted_as_they_are_matched(spark):
    r = np.random.default_rng(5)
    boxes = lambda n: [(x, y, x + w, y + h) for x, y, w, h in zip(*(r.integers(lo, hi, n).astype(float).tolist() for lo, hi in ((0, 40), (0, 40), (10, 130), (10, 130))))]
    gold, pred = [], []
    for image in [None, *range(25)]:
        for label in "ab":
            gold += [(image, label, *b) for b in boxes(r.integers(0, 9))]
            pred += [(image, label, k, *b, float(r.integers(1, 5)) / 4) for k, b in enumerate(boxes(r.choice([0, 3, 12, 130])))]
    gold = spark.createDataFrame(gold, "image_id int, label string, x0 double, y0 double, x2 double, y2 double")
    pred = spark.createDataFrame(pred, "image_id int, label string, det int, x0 double, y0 double, x2 double, y2 double, score double")
    way = ["label", "area", "most", "threshold"]
    plain = metrics.detection_matches(gold, pred)
    n = {(*r[:4], None): (r.n, r.n) for r in plain.groupBy(*way).agg(F.sum("n_gold").alias("n")).collect()}
    of = plain.filter("score > 0").groupBy(*way, "score").agg(F.count_if("hit").alias("h"), F.count_if(~F.col("hit")).alias("f"))
    want = {**n, **{tuple(r[:5]): (r.h, r.f) for r in of.collect()}}
    got = metrics.detection_counts(gold, pred).groupBy(*way, "score").agg(F.sum("h").alias("h"), F.sum("f").alias("f")).filter("score is null or h + f > 0")
    assert {tuple(r[:5]): (r.h, r.f) for r in got.collect()} == want and len(want) > 500


@pytest.mark.parametrize("kind", ["odd", "ties", "copies", "one id"])
def test_connectivity_as_sql(spark, tmp_path, kind):
    """Several blocks, with ties at the border, null and NaN vectors, null labels and ids, ids that repeat, and copies with other labels."""
    import duckdb

    import __spark_entry__

    rng = np.random.default_rng(5)
    n = {"odd": 1300, "ties": 1100, "copies": 700, "one id": 300}[kind]
    x = rng.integers(0, 3, (n, 6)).astype(float) if kind == "ties" else np.ones((n, 6)) if kind == "copies" else rng.standard_normal((n, 6)) + 1000 * (rng.random((n, 1)) < 0.01)
    rows = [(i, int(rng.integers(0, 4)), x[i].tolist()) for i in rng.permutation(n).tolist()]
    if kind == "odd":
        rows = [(None if i % 97 == 0 else i // 2 if i % 53 == 0 else i, None if i % 31 == 0 else lab, None if i % 41 == 0 else [math.nan, *v[1:]] if i % 43 == 0 else [math.inf, *v[1:]] if i % 47 == 0 else v) for i, lab, v in rows]
    if kind == "one id":
        rows = [(7, lab, v) for _, lab, v in rows]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = __spark_entry__.queries()["connectivity"](spark, str(tmp_path)).first()[0]
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == con.sql(__spark_entry__.oracle_sql()["connectivity"]).fetchall()[0][0]
