import math
import re
from collections import Counter

import pytest

from stromlage.llm import backoff
from stromlage.llm.backoff import backoff_scores


def brute(rows, order):
    """doc_id -> (n_words, n_unseen, n_alone, log_score) for unique ids."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}

    def counts(ws):
        padded = [None] * (order - 1) + ws
        grams, contexts = Counter(), Counter()
        for i in range(len(ws)):
            for k in range(1, order + 1):
                gram = tuple(padded[i + order - k : i + order])
                grams[gram] += 1
                contexts[k, gram[:-1]] += 1
        return grams, contexts

    own = {k: counts(ws) for k, ws in words.items()}
    grams, contexts = (sum((o[i] for o in own.values()), Counter()) for i in range(2))
    total, out = sum(map(len, words.values())), {}
    for key, ws in words.items():
        mine, before = own[key]
        padded, unseen, alone, score = [None] * (order - 1) + ws, 0, 0, 0.0
        for i in range(len(ws)):
            for k in range(order, 0, -1):
                gram = tuple(padded[i + order - k : i + order])
                c = grams[gram] - mine[gram]
                if k == 1:
                    score += math.log(max(c, 1) / max(total - len(ws), 1))
                    alone += 1
                elif c > 0:
                    score += math.log(c / (contexts[k, gram[:-1]] - before[k, gram[:-1]]))
                if k == 1 or c > 0:
                    break
                score += math.log(0.4)
            unseen += k < order
        out[key] = (len(ws), unseen, alone, score)
    return out


def check(spark, rows, order=3):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    want, got = brute(rows, order), backoff_scores(docs, order).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.n_unseen, r.n_alone) == want[r.doc_id][:3]
        assert r.log_score == pytest.approx(want[r.doc_id][3], abs=1e-6, rel=1e-9)


def test_small_table_same_as_brute_force(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


@pytest.mark.parametrize("order", [2, 3, 5])
def test_odd_rows_in_several_orders(spark, order):
    check(spark, [
        (1, None), (2, ""), (3, " \n"), (4, "a"), (5, "a"), (6, "b c b c b"), (7, "x " * 40000), (None, "b c q"),
        (8, "a b"), (9, "q b c b c b a b"),
    ], order)


def test_one_document_has_nothing_to_compare_with(spark):
    check(spark, [(1, "a b a b")])
    assert backoff_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_many_blocks_and_parts_same_as_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(backoff, "BLOCK_WORDS", 12)
    monkeypatch.setattr(backoff, "PART_WORDS", 9)
    rows = [(i, " ".join("abcd"[(i * j * j + j // 3) % 4] for j in range(i % 17))) for i in range(60)]
    check(spark, rows, order)


def test_rows_that_share_an_id_are_counted_row_by_row(spark):
    got = backoff_scores(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_unseen) for r in got) == [(1, 4, 0), (2, 1, 1)]


def test_a_block_sends_each_ngram_once_and_hears_of_those_that_others_hold(spark):
    text = " ".join(f"w{i % 50}" for i in range(5000))
    docs = spark.createDataFrame([(i, text + (" own" if i == 0 else "")) for i in range(8)], "doc_id long, text string")
    blocks = backoff.word_blocks(docs.repartition(4, "doc_id"))
    for k in (1, 2, 3):
        asked = backoff.asked_counts(blocks, 3, k, 2)
        sent = asked.selectExpr("sum(length(keys) div 8) AS n").head().n
        # 53 n-grams of an order at most, and the start sign, for each block; there are 40,000 words.
        assert sent <= blocks.count() * 54
        answers = backoff.answered_counts(asked, k).collect()
        assert len(answers) == asked.count()
        told = sum(len(r.grams) // 8 for r in answers)
        assert 0 < told < sent if blocks.count() > 1 else told == 0
