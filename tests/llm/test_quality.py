import re
from collections import Counter

import numpy as np
import pytest

from stromlage.llm import quality
from stromlage.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i] and re.search(r"[^\x20\x09-\x0D]", x))
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " ", "a", "a\n\n\na\n \n \nb", "x y z u v x y z u v", "a a a a a a a a a a a a", "é\u00a0ü #*$ <|>",
         "w " * 20000]


@pytest.mark.parametrize("text", TEXTS)
def test_stats(text):
    assert quality.text_stats(text) == brute(text)


def test_base_columns_of_the_small_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_quality"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        stats = brute(texts[r.doc_id])
        assert tuple(r)[1:6] == stats
        assert r.base_failed == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])
        assert not (r.base_failed and r.kept)


def planted(n=400, junk=12):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(900)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(20, 300))), "en", "a" if i % 3 else f"s{i}") for i in range(n)]
    rows += [(n + i, " | ".join(rng.choice(vocabulary, 80)) + " ### $$$ ***" * 9, "en", "a") for i in range(junk)]
    return rows


def test_outliers_go_and_clean_documents_stay(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept == set(range(400))
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept


def test_estimate_agrees_with_a_direct_one(spark):
    """Final centre and scatter as from concentration over the same bins in numpy."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, 4)) * [0.3, 2, 2, 0.4]
    x[:60] += [3, 30, 30, 3]
    rows = spark.createDataFrame([((2, "en", "a"), *map(float, v)) for v in x],
                                 "grp struct<level:int,lang:string,source:string>, x0 double, x1 double, x2 double, x3 double")
    got = quality.estimate(rows).collect()[0]
    centre = np.array([got[f"c_x{i}"] for i in range(4)])
    assert np.all(np.abs(centre) < [0.05, 0.3, 0.3, 0.06])
    inverse = np.zeros((4, 4))
    for i, j in quality.PAIRS:
        inverse[i, j] = inverse[j, i] = got[f"i_{i}_{j}"]
    d = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
    assert (d[:60] > quality.CUTOFF).all() and (d[60:] < quality.CUTOFF).all()


def test_odd_rows(spark):
    rows = [(i, t, None if i % 2 else "en", None) for i, t in enumerate(TEXTS)] + [(0, None, "en", None)] * 2
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n int")
    found = quality.judge(docs).collect()
    assert len(found) == len(rows)
    assert all(r.kept != r.base_failed for r in found)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.n for r in kept.collect()} <= {7}
    empty = docs.where("doc_id < 0")
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
