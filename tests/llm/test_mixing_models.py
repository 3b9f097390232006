import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import _common as C
from quire.llm import brown_lm, langid, toxicity
from quire.llm.mixing import mix_documents, pivotal, take, targets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, most=3.0):
    """Targets by repeated reshared excess."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in capped)
        w = sum(x for k, x in enumerate(weights) if k not in capped)
        t = [most * s if k in capped else left * x / w for k, (s, x) in enumerate(zip(sizes, weights, strict=True))]
        over = {k for k in range(len(sizes)) if k not in capped and t[k] > most * sizes[k]}
        if not over:
            return t
        capped |= over


def test_targets(spark):
    sizes = [1000, 10, 0, 500, 90, 2000, 3]
    rows = [(k, f"s{k}" if k < 6 else None, n) for k, n in enumerate(sizes)]
    got = {r.source: r.target for r in targets(spark.createDataFrame(rows, "row int, source string, size bigint")).collect()}
    expected = water(sizes, [1, 2, 3, 1, 2, 3, 1])
    assert [got[f"s{k}" if k < 6 else None] for k in range(7)] == pytest.approx(expected)


def test_mix(docs, corpus):
    got = mix_documents(docs).collect()
    assert len(got) == len(corpus)
    per = defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert 0 <= r.copies <= 3
        p = per[r.source]
        p[0] += r.copies * r.size
        p[1] = r.target
        p[2] = max(p[2], r.size)
    for taken, target, longest in per.values():
        assert abs(taken - target) <= longest + 1
    assert Counter(r.size for r in got) == Counter(len(WORDS.findall(r[1] or "")) for r in corpus)
    assert sorted(map(tuple, mix_documents(docs).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mix_does_not_depend_on_partitions(docs):
    twice = docs.unionByName(docs.limit(20))
    found = [sorted(((r.doc_id, r.source, r.size, r.copies) for r in mix_documents(d).collect()), key=str) for d in (twice, twice.repartition(7), twice.coalesce(1), twice.repartition(3, "source"))]
    assert found[1:] == found[:1] * 3
    taken = [sorted(map(str, take(d).collect())) for d in (twice, twice.repartition(5))]
    assert taken[0] == taken[1]


def test_groups_leave_no_more_than_one_document(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.mixing.LEAF", 50)
    monkeypatch.setattr("quire.llm.mixing.FAN", 4)
    r = random.Random(3)
    rows = [(k, "w " * r.randint(1, 90), f"s{k % 2}" if k < 900 else None) for k in range(1200)]
    per = defaultdict(list)
    for x in mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect():
        per[x.source].append(x)
    assert len(per) == 3
    for xs in per.values():
        assert abs(sum(x.copies * x.size for x in xs) - xs[0].target) <= 90


def test_take(docs, empty):
    mixed, copies = take(docs), mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == copies.agg(F.sum("copies")).first()[0]
    assert take(empty).count() == 0 and mix_documents(empty).count() == 0


@pytest.mark.parametrize("longest", [30, 2000])
def test_pivotal_keeps_mass_and_expectation(longest):
    r = np.random.default_rng(1)
    over, sums, mass = 0, np.zeros(30), np.array([longest, *range(29, 0, -1)])
    p0 = np.linspace(0.05, 0.95, 30)
    for _ in range(3000):
        p = p0.tolist()
        left = pivotal(p, mass.tolist(), r.random(30).tolist())
        assert np.dot(p, mass) == pytest.approx(np.dot(p0, mass))
        assert all(x in (0.0, 1.0) for k, x in enumerate(p) if k != left)
        over += mass[left] if left >= 0 else 0
        sums += p
    assert np.abs(sums / 3000 - p0).max() < 0.04
    assert longest == 2000 or over / 3000 < 15.5 / 2  # half of the mean document


def test_pivotal_of_whole_probabilities():
    assert pivotal([], [], []) == -1
    p = [0.0, 1.0, 0.5]
    assert pivotal(p, [3, 2, 1], [0.1] * 3) == 2 and p == [0.0, 1.0, 0.5]


def test_language(docs, empty, corpus):
    samples = langid.sample_texts(docs)
    assert sorted(samples) == ["de", "en"]
    got = langid.predict(docs, samples).collect()
    assert len(got) == len(corpus)
    lang = {r[0]: (r[1], r[2]) for r in corpus if r[0] is not None}
    for r in got:
        if r.doc_id is None:
            continue
        text, label = lang[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(text) > 100:
            assert r.lang_pred == label and 0 <= r.score <= 1
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in corpus)
    assert langid.with_language(empty).count() == 0 and langid.predict(docs, {}).filter("lang_pred != 'und'").count() == 0


def test_languages_of_short_or_long_texts_alone_are_learned(spark):
    rows = [(k, f"ja nein {k}", "de") for k in range(5)] + [(10 + k, "the house " * 5000, "en") for k in range(2)] + [(20 + k, "une maison blanche et un jardin vert ici", "fr") for k in range(70)]
    rows += [(100, "oui", "fr"), (101, "", "es"), (102, None, "it")]
    samples = langid.sample_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert sorted(samples) == ["de", "en", "fr"] and len(samples["de"]) == 5
    assert max(map(len, samples["en"])) == 32_000 and "oui" not in samples["fr"]
    got = langid.predict(spark.createDataFrame([(1, "ja ja nein"), (2, "the house")], "doc_id bigint, text string"), samples).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "de", 2: "en"}


def brute_phrases(text, sample):
    """Greedy longest matches of a list of symbols with a sample; one symbol where nothing matches."""
    sample, at, n = " " + " ".join(map(str, sample)) + " ", 0, 0
    while at < len(text):
        to = at + 1
        while to < len(text) and " " + " ".join(map(str, text[at : to + 1])) + " " in sample:
            to += 1
        n, at = n + 1, to
    return n


def test_phrases_by_brute_force():
    r = random.Random(5)
    letters = "abcdeéжы漢字 "
    for k in range(12):
        samples = {x: ["".join(r.choices(letters[: 3 + 2 * i] + "жz"[: k % 2], k=120)) for _ in range(2)] for i, x in enumerate("uvwx")}
        m = langid.Model(samples, most=150, block=(7, 40, 2048)[k % 3])
        texts = ["".join(r.choices(letters + "q漢", k=r.randint(0, 300))) for _ in range(6)] + ["", "12 !", samples["u"][0][:100] * 2, "aaaa" * 30, "漢" * 50, samples["w"][1]]
        found, _ = m.phrases(texts)
        for j, language in enumerate(m.languages):
            sample = []
            for t in samples[language]:
                sample += [0, *m.symbols([t])[0].tolist()]
            for i, t in enumerate(texts):
                assert found[i, j] == brute_phrases(m.symbols([t])[0].tolist(), sample[:150])


def test_every_letter_is_told_apart():
    m = langid.Model({"a": ["abc " * 50], "b": ["".join(chr(0x4E00 + 7 * k) for k in range(300))]})
    letters = [chr(c) for c in (*range(97, 123), *range(0x3B1, 0x3C9), *range(0x4E00, 0x4E80), 0x20000)]
    codes = [tuple(m.symbols([c])[0].tolist()) for c in letters]
    assert len(set(codes)) == len(letters) and {len(c) for c in codes} == {1, 5}


def test_many_languages_stay_within_the_sample(spark):
    rows = [(1000 * k + j, f"lang{k} says word{k}x{j} " * 30, f"l{k}") for k in range(150) for j in range(2)]
    samples = langid.sample_texts(spark.createDataFrame(rows + rows[:100], "doc_id bigint, text string, lang string"))
    assert len(samples) == 150 and sum(len(t) for x in samples.values() for t in x) <= 4 * langid.ALL_SYMBOLS
    assert sum(len(a.table) for a in langid.Model({k: [t * 40 for t in x] for k, x in samples.items()}).automata) <= 2 * langid.SYMBOLS * (langid.ALL_SYMBOLS + 150)


def test_phrases_of_batches_match_single_texts():
    m = langid.Model({"a": ["abc abd abe " * 20], "b": ["xyz xyw " * 30]})
    texts = ["abc abd", "", "xyz 12 xyw", "q", "abc " * 2000]
    together = m.phrases(texts)[0]
    assert all((m.phrases([t])[0][0] == together[k]).all() for k, t in enumerate(texts))


def test_toxicity(spark, docs, empty):
    clean = ["the house and tree stand here", "we read some books today", "rain falls on green hills"]
    rows = [(k, f"{clean[k % 3]} number{k}" + (" you moron" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = df.select("doc_id", "toxic").filter("doc_id < 300").unionByName(spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))
    w = toxicity.train(df.drop("toxic"), labels)
    got = toxicity.score(df, w).join(df, "doc_id").collect()
    assert all((r.score >= 0.3) == bool(r.toxic) for r in got)
    assert len(w) < 5000
    assert toxicity.score(docs, w).filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.train(empty.drop("lang"), labels) == [] and toxicity.score(empty, []).count() == 0
    assert {r.score for r in toxicity.score(docs, []).collect()} == {0.5}


def fit(docs, held=None):
    held = F.lit(False) if held is None else held
    lexicon = brown_lm.cluster(docs.filter(~held))
    sequences = brown_lm.encode(docs, lexicon, held)
    return lexicon, sequences, brown_lm.train(sequences.filter("not held_out"), lexicon)


def lm_tokens(text):
    return C.split_words(text or "", True) + [b"\n"]


def test_language_model(docs, corpus, monkeypatch):
    monkeypatch.setattr(brown_lm, "CORE", 20)
    held = C.remainder("doc_id", 5) == 1
    lexicon, sequences, model = fit(docs, held)
    is_held = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1
    train = [r for r in corpus if not is_held(r)]
    c = Counter(w for r in train for w in lm_tokens(r[1]))
    n, v = sum(c.values()), len(c)
    table = {bytes(r.word): (r.c, r["class"]) for r in lexicon.table.collect()}
    assert {w: x[0] for w, x in table.items()} == dict(c)
    # every word of the core and every other with enough occurrences has a class of its own neighbours
    core = set(lexicon.vocabulary.words[:21])
    assert all((k is not None) == (w in core or x >= brown_lm.MIN_COUNT) for w, (x, k) in table.items())
    # the model by brute force from the classes
    shape = lambda w: int(lexicon.shape_classes[brown_lm.shape_of(w)])
    assert any(k not in (None, shape(w)) for w, (x, k) in table.items() if w not in core)
    cls = lambda w: shape(w) if table.get(w, (0, None))[1] is None else table[w][1]
    k = len(lexicon.distinct)
    pairs, distinct = np.zeros((k, k)), Counter(cls(w) for w in c)
    for r in train:
        s = [cls(w) for w in lm_tokens(r[1])]
        for a, b in zip([cls(b"\n"), *s[:-1]], s, strict=True):
            pairs[a, b] += 1
    share = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * k)

    def score(text):
        total, before = 0.0, cls(b"\n")
        for w in lm_tokens(text):
            now = cls(w)
            total += np.log10((pairs[before, now] + 20 * share[now]) / (pairs[before].sum() + 20))
            total += np.log10((c[w] + 0.5) / (pairs[:, now].sum() + 0.5 * (distinct[now] + 1)))
            before = now
        return total

    got = brown_lm.score(sequences, model).collect()
    assert len(got) == len(corpus)
    texts = {r[0]: r[1] for r in corpus}
    for r in got:
        if r.doc_id is None:
            assert not r.held_out
            continue
        t = lm_tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score == pytest.approx(score(texts[r.doc_id]))


def test_the_head_chooses_the_way_only(docs, monkeypatch):
    monkeypatch.setattr(brown_lm, "CORE", 6)
    found = []
    for head, dense in ((131_072, 16_384), (131_072, 40), (60, 16_384), (12, 10)):
        monkeypatch.setattr(brown_lm, "HEAD", head)
        monkeypatch.setattr(brown_lm, "DENSE", dense)
        lexicon, sequences, model = fit(docs)
        assert lexicon.vocabulary.core == 6
        got = brown_lm.score(sequences, model).select("n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6)).collect()
        found.append(sorted(map(tuple, got)))
    assert found[1:] == found[:1] * 3


def test_language_model_probabilities_sum_to_one(docs):
    lexicon, _, model = fit(docs)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    total = np.zeros(len(lexicon.distinct))
    for r in lexicon.table.collect():
        own = r["class"] if r["class"] is not None else lexicon.shape_classes[brown_lm.shape_of(bytes(r.word))]
        total[own] += r.c + 0.5
    there = lexicon.distinct > 0
    assert np.allclose(((total + 0.5) / 10**model.denominator)[there], 1)


@pytest.mark.parametrize("near_rows", [1 << 20, 40])
def test_neighbours_are_a_row_a_word(near_rows, monkeypatch):
    """A task gives a row for each word and so many occurrences, not one for each occurrence; what comes of the rows is the same however they are cut."""
    from types import SimpleNamespace

    import pyarrow as pa
    import xxhash

    monkeypatch.setattr(brown_lm, "CORE", 3)
    monkeypatch.setattr(brown_lm, "NEAR_ROWS", near_rows)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.geometric(0.1, 60)) for _ in range(20)]
    seen = Counter(w for t in texts for w in t.encode().split())
    words = [brown_lm.END, *sorted(seen, key=lambda w: (-seen[w], w))[:12]]
    v = brown_lm.Vocabulary(words, np.array([20, *(seen[w] for w in words[1:])]), sum(seen.values()) + 20, len(seen) + 1, np.zeros(brown_lm.SHAPES, np.int64), np.zeros(brown_lm.SHAPES, np.int64))
    classes = rng.integers(0, 5, v.units)
    rows = list(brown_lm._neighbours(SimpleNamespace(value=v), classes, 8, slice_rows=4)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    outside = {w for w in seen if w not in words[: 1 + v.core]}
    assert near_rows == 40 or sum(b.num_rows for b in rows) == len(outside)
    place, unit = v.indexed()
    class_of = lambda w: classes[unit[place[w]] if w in place else 1 + v.core + brown_lm.shape_of(w)]
    expected, got = Counter(), Counter()
    for t in texts:
        line = [brown_lm.END, *t.encode().split(), brown_lm.END]
        for x, w, y in zip(line, line[1:-1], line[2:], strict=False):
            if w in outside:
                h = xxhash.xxh64(w, 42).intdigest()
                expected[h, 0, class_of(x)] += 1
                expected[h, 1, class_of(y)] += 1
    for b in rows:
        for h, _, code, n in zip(*brown_lm._entries(b), strict=True):
            for side, c in [((code >> 7) & 1, code & 127)] if code >> 14 else [(0, code >> 7), (1, code & 127)]:
                got[int(h) % (1 << 64), int(side), int(c)] += int(n)
    assert got == expected
    pairs = rng.integers(0, 50, (5, 5)) + 2.0 * sum(seen.values())
    table = pa.Table.from_batches(rows).sort_by("h")
    settle = lambda batches: {h: k for b in brown_lm._exchange_words(pairs)(batches) for h, k in zip(*b.to_pydict().values(), strict=True)}
    once = settle(table.combine_chunks().to_batches())
    assert once == settle(table.to_batches(max_chunksize=3)) and len(once) == sum(seen[w] >= brown_lm.MIN_COUNT for w in outside)


def test_best_classes_by_brute_force():
    r = np.random.default_rng(3)
    k, words = 7, 40
    pairs = r.integers(0, 30, (k, k)).astype(float)
    f = lambda x: 0.0 if x <= 0 else x * math.log(max(x, 1))
    now, entries, left, right = r.integers(0, k, words), [], [], []
    for w in range(words):
        lr = r.integers(0, 4, (2, k)) * (r.random((2, k)) < 0.6)
        lr[0, 0] += 1 + 12 * (w % 5 == 0)
        lr[1, 1] += lr[0].sum() - lr[1].sum() if lr[0].sum() > lr[1].sum() else 0
        left.append(lr[0])
        right.append(lr[1])
        pairs[:, now[w]] += lr[0]
        pairs[now[w]] += lr[1]
        entries += [(w, s, c, lr[s, c]) for s in (0, 1) for c in range(k) if lr[s, c]]
    of, side, cls, n = map(np.array, zip(*entries, strict=True))
    got = brown_lm.best_classes(of, side, cls, n, now, pairs)
    for w in range(words):
        gains = []
        for c in range(k):
            sign = -1 if c == now[w] else 1  # where it is: what it would lose by leaving
            g = sum(f(pairs[a, c] + sign * x) - f(pairs[a, c]) for a, x in enumerate(left[w])) + sum(f(pairs[c, b] + sign * x) - f(pairs[c, b]) for b, x in enumerate(right[w]))
            g -= f(pairs[:, c].sum() + sign * left[w].sum()) - f(pairs[:, c].sum()) + f(pairs[c].sum() + sign * right[w].sum()) - f(pairs[c].sum())
            gains.append(sign * g)
        best = max(gains)
        assert gains[got[w]] == pytest.approx(best)


def test_exchange_finds_blocks():
    r = np.random.default_rng(0)
    pairs = r.integers(0, 3, (20, 20)).astype(float)
    pairs[:10, 10:] += 100
    pairs[10:, :10] += 100
    cls = brown_lm.exchange(pairs, classes=2)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:])) == 1 and cls[0] != cls[10]


def test_language_model_of_nothing(empty):
    _, sequences, model = fit(empty)
    assert brown_lm.score(sequences, model).count() == 0
    _, sequences, model = fit(empty.sparkSession.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id bigint, text string"), F.col("doc_id").isNotNull())
    got = brown_lm.score(sequences, model).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 1, 1), (3, 1, 1), (3, 1, 1)] and all(r.score < 0 for r in got)
