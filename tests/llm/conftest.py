import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, digest string, size int, row string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, ties, repeated rows and columns whose names the operators use inside."""
    r = random.Random(4)
    vocab = {"en": ["the", "of", "and", "tion", "ing", "was", "that"], "de": ["der", "und", "schein", "keit", "über", "ein"]}

    def text(lang, n):
        return " ".join("".join(r.choices(vocab[lang], k=r.randint(1, 3))) for _ in range(n)).capitalize() + ".\nDone, now."

    rows = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        rows.append((k, text(lang, r.randint(1, 60)), lang, f"s{k % 3}" if k % 10 else None, "x", k, "r"))
    rows += [(100 + k, rows[5][1], "en", "s0", None, None, None) for k in range(30)]  # a hot text
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "s1", None, 1, ""), (202, "  \n\t ", "en", "s1", None, 1, "")]
    rows += [(203, text("en", 9000), "en", "s2", "y", 2, "z"), (204, "Ünïcödé ſtraße 12 %%  x\x1cy <|endoftext|>", None, "é", "y", 2, "z")]
    rows += [(5, rows[5][1], "en", "s0", "x", 5, "r"), (None, "no id", "en", "s0", "x", 5, "r"), (None, None, None, None, None, None, None)]
    near = rows[93][1].split(" ")
    near[10] = "changed"
    rows.append((205, " ".join(near), "en", "s2", "y", 2, "z"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
