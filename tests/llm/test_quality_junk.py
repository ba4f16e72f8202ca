"""Moderate junk goes and a group may hold much of it."""

import numpy as np

from stromlage.llm import quality


def docs(spark, clean, junk):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(900)]
    text = lambda: [str(w) for w in rng.choice(vocabulary, rng.integers(60, 300))]
    rows = [(i, " ".join(text()), "en", "a") for i in range(clean)]
    for i in range(clean, clean + junk):
        words = text()
        words[::6] = ["#" + w for w in words[::6]]  # some 17 symbols in 100 words
        rows.append((i, " ".join(words), "en", "a"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def kept(spark, clean, junk):
    return {r.doc_id for r in quality.judge(docs(spark, clean, junk)).where("kept").collect()}


def test_moderate_junk_goes(spark):
    assert kept(spark, 300, 15) == set(range(300))


def test_two_fifths_of_a_group_are_junk(spark):
    assert kept(spark, 300, 200) == set(range(300))
