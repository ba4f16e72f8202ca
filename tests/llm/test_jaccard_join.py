import random

import pytest

from stromlage.llm.jaccard_join import linked_documents
from tests.llm.brute import groups


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row, sorted."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = (text or "").translate(lower).encode().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    links = [
        (i, j) for j in range(len(rows)) for i in range(j)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    of = groups(range(len(rows)), links)
    ids = {}
    for i, root in of.items():
        ids.setdefault(root, []).append(rows[i][0])
    return sorted((r[0], len(sets[i]), min(ids[of[i]])) for i, r in enumerate(rows))


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sig int")
    assert sorted(tuple(r) for r in linked_documents(docs).collect()) == brute(rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"W{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies_same_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for g in range(12):
        base = [f"b{g}x{rng.randrange(5000)}" for _ in range(rng.choice([4, 9, 40, 120]))]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, 5))) for k in range(rng.choice([2, 5, 40]))]
    rows += [(len(rows) + k, " ".join(passage + [f"u{rng.randrange(10**9)}" for _ in range(rng.choice([2, 5, 60]))])) for k in range(40)]
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [
        (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "One\ttwo three "), (8, "ÄB c d e"),
        (9, "äb c d e"), (10, "a b c d"), (10, "a b c d"), (11, "x y z u v"), (11, "q r s t u"), (12, "w " * 30000),
        (13, "W " * 9), (14, " ".join(f"k{i}" for i in range(20000))), (15, " ".join(f"k{i}" for i in range(19000))),
    ])


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "A b c d e"), (None, "z")], "doc_id long, text string")
    found = sorted(map(str, (tuple(r) for r in linked_documents(docs).collect())))
    assert found == ["(3, 2, 3)", "(None, 1, None)", "(None, 2, 3)"]


def test_empty_table(spark):
    assert linked_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
