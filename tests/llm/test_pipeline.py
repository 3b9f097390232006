import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    from quire.llm import _common as C

    docs = C.documents(spark, SF)
    n = {"documents": docs.count()}
    for name, stage in p.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        n[name] = docs.count()
    assert n["documents"] >= n["language"] > n["exact_dedup"] >= n["near_dedup"] > 0 and n["mixing"] > 0
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == n["mixing"]


def test_chain_with_nulls_repeats_and_clashing_names(spark, docs, empty, corpus):
    import corpus_pipeline as p

    from quire.llm import _common as C

    names = docs.columns
    stages = dict(p.STAGES)
    now = C.materialize(stages["language"](spark, docs, ""), "language")
    lettered = [r for r in corpus if any(c.isalpha() for c in r[1] or "")]
    assert now.columns == names and now.count() == len(lettered) and now.filter("lang is null").count() == 0
    now = C.materialize(stages["exact_dedup"](spark, now, ""), "exact")
    best = {}
    for r in lettered:
        best[r[1]] = max(best.get(r[1], -1), -1 if r[0] is None else r[0])
    assert now.columns == names
    assert sorted(((r.text, -1 if r.doc_id is None else r.doc_id) for r in now.collect())) == sorted(best.items())
    now = C.materialize(stages["near_dedup"](spark, now, ""), "near")
    ids = {r.doc_id for r in now.collect()}
    assert now.columns == names and 205 not in ids and None in ids  # 205 is a near copy of another
    taken = C.materialize(stages["mixing"](spark, now, ""), "mixing")
    assert taken.columns == names and {r.doc_id for r in taken.collect()} <= ids
    packed = stages["packing"](spark, taken, "")
    assert packed.filter("piece = 0").count() == taken.count()
    nothing = empty
    for name, stage in p.STAGES:
        nothing = stage(spark, nothing, "")
        assert nothing.count() == 0, name
