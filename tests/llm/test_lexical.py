import math
import re
from collections import Counter

from stromlage.llm import lexical
from stromlage.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=50):
    """Sorted (item_id, rank, doc_id, score), every document beside every item."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    df = Counter(t for _, c in counted for t in c)
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, c in counted:
            if d is None or not c:
                continue
            m = 100 - 50 + 50 * c.total() * n_docs // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in ts if t in c
            )
            scored += [(-s, d)] * (s > 0)
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def both(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, terms int")
    got = sorted(tuple(r) for r in lexical.best_documents(d, i, **options).collect())
    assert got == brute(docs, items, **options)
    return got


def test_given_tables_same_as_brute_force(spark):
    read = lambda t: [tuple(r)[:2] for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_lexical_search"](spark, SF).collect())
    assert got == brute(read("documents"), read("benchmark"))


def test_odd_texts_ties_and_repeated_rows(spark):
    docs = [
        (5, "a b a"), (4, "A-B_a"), (3, None), (2, ""), (1, " .\n"), (None, "a c"), (9, "aa ab ba"), (8, "é x É x"),
        (8, "é x É x"), (7, "x " * 30000), (6, "a\x00b\x7fc"), (10, "日本 日本"), (11, "c" * 20000), (12, "b"), (13, "z"),
    ]
    items = [
        (1, "A a b!"), (2, None), (3, ""), (4, "..."), (None, "a"), (5, "é x x"), (6, "日本"), (7, "C" * 20000),
        (8, "b"), (8, "c"), (9, "not there"), (10, "a b c x z"),
    ]
    got = both(spark, docs, items)
    assert {r[0] for r in got} == {1, 5, 6, 7, 8, 10}
    both(spark, docs, items, k=2)


def test_item_groups_and_score_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_BYTES", 12)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 5 + 1))) for i in range(60)]
    both(spark, docs, [(i, f"w{i} w{i + 1} w{i % 3}") for i in range(7)], k=5)


def test_empty_tables(spark):
    assert both(spark, [], [(1, "a")]) == []
    assert both(spark, [(1, "a")], []) == []
    assert both(spark, [], []) == []
