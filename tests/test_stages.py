import json

import pytest
from pyspark.sql import functions as F

from quire.operators import stages as S

LOG = "doc_id bigint, pages int, can_map boolean, ocr_found boolean, json_found boolean, json_valid boolean, annotation_found boolean, n_handwriting int, n_hw_errors int, n_visual int, n_ve_errors int, n_layout int"


def test_documents_of_stages(spark):
    rows = [
        (1, 1, True, True, True, True, None, 2, 0, 0, None, 3),  # handwriting without errors
        (2, 1, None, True, True, False, True, 2, 1, 1, 0, 0),  # annotations alone; visual elements
        (3, 1, True, None, True, True, True, 0, 0, 0, 0, None),  # no OCR, no elements
        (4, 2, True, True, True, True, True, 1, 0, 1, 0, 1),  # two pages
        (5, None, True, True, None, None, None, None, None, None, None, None),
        (6, 1, True, True, None, True, None, 1, None, 0, 0, 1),  # errors not known
    ]
    log = spark.createDataFrame(rows, LOG)
    got = {r[0]: tuple(r)[1:] for r in log.select("doc_id", S.ocr_route(), S.verifiable(), S.word_boxes_due(), S.layout_boxes_due()).collect()}
    assert got == {
        1: ("ocr", True, True, True), 2: ("ocr", True, True, False), 3: ("copy", False, False, False), 4: (None, False, False, False), 5: (None, False, False, False), 6: ("copy", False, True, True),
    }
    boxes = spark.createDataFrame([(1,), (1,), (2,), (4,), (None,)], "doc_id bigint")
    assert [r.doc_id for r in S.handwriting_documents(log, boxes).collect()] == [1]
    made = spark.createDataFrame([(1,), (1,), (9,)], "doc_id bigint")
    assert {tuple(r) for r in S.stage_log(log.filter(S.one_page()), made, "n").collect()} == {(1, 2), (2, 0), (3, 0), (6, 0)}
    assert S.stage_log(log.limit(0), made, "n").collect() == []


def test_message_log(spark):
    two = "<!DOCTYPE html><html>a</html> and <!doctype HTML><p></html>"
    rows = [("a", "succeeded", None, two), ("b", "succeeded", "refused", two), ("c", "errored", None, None), ("d", None, None, two), ("e", "succeeded", "", None)]
    got = {r.message_id: (r.expected, r.found, r.doc_ids) for r in S.message_log(spark.createDataFrame(rows, "message_id string, result_type string, error string, response string"), 3).collect()}
    assert got == {"a": (3, 2, ["a_0", "a_1"]), "b": (-1, -1, []), "c": (-1, -1, []), "d": (-1, -1, []), "e": (3, 0, [])}


def test_truth(spark):
    one = spark.range(1)
    entities = F.from_json(F.lit('[{"key":"k","value":"v","bbox_indices":[]},{"key":"l","value":"w","bbox_indices":[4,5,7]}]'), "array<struct<key:string,value:string,bbox_indices:array<int>>>")
    assert one.select(S.entity_questions(entities)).first()[0] == [(1, "l", ["w"], [4], [7])]
    known = lambda a: one.select(S.all_labels_known(F.lit(a).cast("array<string>") if a is None else F.array(*map(F.lit, a)).cast("array<string>"), ["x", "y"])).first()[0]
    assert [known(a) for a in (["x", "y", "x"], ["x", "z"], ["x", None], [], None)] == [True, False, False, True, True]
    texts = ['{"label": "x", "b": "y"}', '{"label": "q"}', "{}", "[1", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(S.class_truth(F.col("t"), ["x", "y"]).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [("x", True), ("q", False), (None, False), (None, False), (None, False)]


def test_summaries(spark):
    log = spark.createDataFrame([(1, None), (3, ""), (None, "timeout"), (1, "late")], "pages int, render_error string")
    assert tuple(S.render_summary(log).first()) == (2, 1, 2)
    assert tuple(S.render_summary(log.limit(0)).first()) == (0, 0, 0)
    points = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("a", 1), ("a", -1), ("b", -1), ("c", 5)], "source string, cluster int")
    assert {tuple(r) for r in S.cluster_overview(points, "source", "cluster").collect()} == {("a", 2, 0.693), ("b", 0, None), ("c", 1, 0.0)}


def test_classes_from_text(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["  y\n", " x", "other", None] + ["?"] * 300)], "id int, t string")
    got = [r[0] for r in df.orderBy("id").select(S.class_from_text(F.col("t"), ["x", "y"], "id")).collect()]
    assert got[:2] == [1, 0] and set(got[2:4]) <= {0, 1} and 100 < sum(got[4:]) < 200
    assert spark.range(1).select(S.one_hot(F.lit(1), 3)).first()[0] == [0.0, 1.0, 0.0]


def test_sizes_of_arrays(spark):
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit("x"))
    assert spark.range(1).select(S.same_sizes(F.lit(7), a, a)).first()[0] == 7
    with pytest.raises(Exception, match="arrays differ in size: 2, 1"):
        spark.range(1).select(S.same_sizes(F.lit(7), a, b)).collect()


def test_prompts(spark):
    assert system_ends(S.system_message("sequence_classification", ["FORM", "é"]), '["FORM", "\\u00e9"].')
    with pytest.raises(NotImplementedError):
        S.system_message("layout_analysis")
    sample = spark.range(1).select(F.to_json(S.chat_sample("be short", F.lit("i.png"), F.lit("q"), F.lit("a")))).first()[0]
    said = json.loads(sample)["messages"]
    assert [m["role"] for m in said] == ["system", "user", "assistant"] and said[1]["content"] == [{"type": "image", "image": "i.png"}, {"type": "text", "text": "q"}]
    assert S.reference_path("/d/{split}/x.jsonl", "validation") == "/d/dev/x.jsonl" and S.reference_path("/d/{split}", "test") == "/d/test"


def system_ends(text: str, end: str) -> bool:
    return text.endswith(end)
