import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stromlage.llm import packing as pk
from stromlage.llm.queries import BYTE_BPE, BYTE_BPE_RANKS, QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a b<|endoftext|> c", "東京 ٣ \u2028 x", "long " * 30000, "x" * 9000, "Äöü\n\n  don't", "same", "same"]


def check(rows, texts):
    """Every id in one piece, sequences gapless and within capacity."""
    t = Tokenizer.from_file(BYTE_BPE)
    docs = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for key, pieces in docs.items():
        ids = np.array([*t.encode(texts[key] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= pk.CAPACITY and all(r.sequence_length == at for r in pieces)
    return len(sequences) * pk.CAPACITY / sum(r.length for r in rows) - 1


def test_small_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check(QUERIES["op3_packing"](spark, SF).collect(), texts) < 0.015


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string")
    for ranks in (BYTE_BPE_RANKS, None):
        rows = pk.pack(docs, BYTE_BPE, ranks, public_tokenizers.PATTERN, with_ids=True).collect()
        check(rows, dict(enumerate(TEXTS)))
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert pk.pack(docs.where("doc_id < 0"), BYTE_BPE).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (7, "q"), (7, "q")], "doc_id long, text string")
    rows = pk.pack(docs, BYTE_BPE).collect()
    assert sorted((str(r.doc_id), r.start, r.length) for r in rows) == [("7", 0, 2), ("7", 0, 2), ("None", 0, 4)]


@pytest.mark.parametrize("seed", range(20))
def test_differencing_near_the_best_partition(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(1, 60) for _ in range(8)])
    windows = rng.choice([2, 3])
    at = pk.difference(lengths, windows)
    spread = lambda a: np.ptp(np.bincount(a, weights=lengths, minlength=windows))
    best = min(spread(np.array(a)) for a in product(range(windows), repeat=8))
    assert best <= spread(at) <= best + 25


def test_windows_rise_until_all_fit():
    at, windows = pk.pack_block(np.array([1100, 1100, 1100, 700]))
    assert windows == 3
    at, windows = pk.pack_block(np.array([2048, 2048, 1, 2047]))
    assert windows == 3 and np.bincount(at, weights=[2048, 2048, 1, 2047]).tolist() == [2048] * 3


def test_blocks_are_full_to_the_token():
    packer = pk.Packer(0, False)
    rng = random.Random(2)
    rows = []
    for i in range(700):
        rows += packer.add(i, np.zeros(rng.randint(1, 3000), np.uint32))
    rows += packer.close()
    used = len({r[5] for r in rows}) * pk.CAPACITY
    assert used / sum(r[2] for r in rows) < 1.02
