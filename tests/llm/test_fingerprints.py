import hashlib

import numpy as np
import pytest

from stromlage.llm import fingerprints as fp
from stromlage.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """doc_id -> (n_chars, sha, fingerprint, edited fingerprint, likeness, likeness) of (doc_id, text)."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = {}
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = (set(map(int, fp.sketch(t))) for t in (text, new, after))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        out.setdefault(key, []).append((
            len(text), hashlib.sha256(new.encode()).hexdigest(), fp.as_text(fp.sketch(text)),
            fp.as_text(fp.sketch(new)), like(a, b), like(a, c),
        ))
    return {k: sorted(v) for k, v in out.items()}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:7])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("task_bytes", [24_000_000, 4_000])
def test_same_as_brute_force(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(fp, "TASK_BYTES", task_bytes)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(QUERIES["op7_fingerprints"](spark, SF)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (5, "a b c d e f g"), (9, "a b c d e f g"), (70, "é ü " * 9000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, slice string")
    assert found(fp.compare_with_next(docs)) == brute(rows)


def test_single_and_no_row(spark):
    one = spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")
    row = fp.compare_with_next(one).collect()[0]
    assert row.near_next == 1.0
    assert fp.compare_with_next(one.where("doc_id < 0")).count() == 0


def test_null_id(spark):
    docs = spark.createDataFrame([(4, "a b c d e f"), (None, "q r")], "doc_id long, text string")
    assert {r.doc_id for r in fp.compare_with_next(docs).collect()} == {4, None}


def test_sketches_merge_and_estimate():
    words = [f"w{i * i % 9973}" for i in range(6000)]
    a, b = " ".join(words[:3000]), " ".join(words[2000:])
    both = fp.merge([fp.sketch(a), fp.sketch(b)])
    exact = np.union1d(fp.shingle_hashes(a.split()), fp.shingle_hashes(b.split()))
    assert np.array_equal(both, exact[exact < (1 << 64) // fp.SCALE])
    part = " ".join(words[100:400])
    assert fp.containment(fp.sketch(part), fp.sketch(a)) == 1.0
    assert abs(fp.likeness(fp.sketch(a), fp.sketch(b)) - 1000 / 6000) < 0.06
    assert np.array_equal(fp.from_text(fp.as_text(both)), both)


def test_fingerprints_of_a_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "a b c d e f")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(docs).collect()}
    assert got[1] == got[3] != "" and got[2] == ""
