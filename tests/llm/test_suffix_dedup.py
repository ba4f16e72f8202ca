import hashlib
import random
from collections import Counter

import pytest

from stromlage.llm import suffix_dedup as sd
from stromlage.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row, sorted."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((key, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, anchor string")
    assert sorted((tuple(r)[:5] for r in sd.remove_repeats(docs).collect()), key=str) == brute(rows)


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()), key=str) == brute(rows)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows = [(i, text(rng.randint(0, 60)) + passage[rng.randrange(40) :][: rng.randint(150, 400)] + text(rng.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(9)]
    rows += [(200 + i, "".join(c if rng.random() > 0.004 else "#" for c in passage * 3)) for i in range(25)]
    return rows


@pytest.mark.parametrize("collection", [1024, 5])
def test_planted_passages(spark, monkeypatch, collection):
    monkeypatch.setattr(sd, "COLLECTION", collection)
    monkeypatch.setattr(sd, "LARGEST", 4 * collection)
    check(spark, planted(3))


def test_odd_rows(spark):
    check(spark, [
        (1, None), (2, ""), (3, "a" * 199), (4, "a" * 200), (5, "ab" * 110), (6, "xyz" * 500), (7, "q" * 200), (7, "q" * 200),
        (None, "no id " * 3), (8, "é" * 150), (9, "\x00" * 250), (10, "東京" * 60 + "end"), (10, "other text"),
    ])
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_transform_finds_what_counting_finds():
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcdef ") for _ in range(400))
    strings = []
    for _ in range(300):
        b = bytearray(base[rng.randrange(100) :][: rng.randint(200, 300)])
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = rng.randrange(120)
        strings.append(bytes(b))
    count = Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
    for s, places in zip(strings, sd.repeats(strings), strict=True):
        assert list(places) == [i for i in range(len(s) - 199) if count[s[i : i + 200]] > 1]


def test_units_cover_each_span_once():
    rng = random.Random(2)
    for data in (bytes(rng.choice(b"ab") for _ in range(3000)), b"a" * 700, b"abc" * 200, b"x" * 200, b"y" * 199):
        _, start, spans = sd.units(data)
        covered = sorted(i for a, n in zip(start, spans, strict=True) for i in range(a, a + n))
        assert covered == list(range(max(0, len(data) - 199))) and (not len(spans) or spans.max() <= sd.WIDTH)


def test_units_that_share_only_their_anchor_are_not_taken():
    rng = random.Random(5)
    some = lambda k: bytes(rng.choice(b"abcdefghij ") for _ in range(k))
    anchor, other, left, right = some(64), some(64), some(70), some(70)
    strings = [
        some(70) + anchor + right, some(70) + anchor + some(70), some(66) + anchor + right[:64] + some(20), left + anchor + some(80),
        some(100) + left + anchor + some(40), left[1:] + other + right, some(70) + other + some(70), some(130) + anchor + right[:63] + b"#" + some(9),
    ]
    of = sd._hashes(anchor + other).view("int64")
    keys = of[[0, 0, 0, 0, 0, 64, 64, 0]]
    assert sd.sharing(keys, strings).tolist() == [True, False, True, True, True, False, False, False]


def test_units_with_a_repeat_are_taken():
    found = []
    for _, text in planted(7):
        data = (text or "").encode()
        for anchor, a, n in zip(*sd.units(data), strict=True):
            found.append((anchor, data[a : a + n + sd.SPAN - 1]))
    found = sorted(set(found))
    strings = [x for _, x in found]
    taken = sd.sharing(sd.np.array([a for a, _ in found]), strings)
    repeated = [len(x) > 0 for x in sd.repeats(strings)]
    assert any(repeated) and all(t or not r for t, r in zip(taken, repeated, strict=True)) and not all(taken)


def test_units_are_cut_to_where_they_may_repeat():
    rng = random.Random(6)
    some = lambda k: bytes(rng.choice(b"abcdefghij ") for _ in range(k))
    shared = some(230)
    of = sd._hashes(shared)[100]
    strings = [some(36) + shared + some(70), some(20) + shared + some(50), some(30) + shared[40:180] + some(120), shared[:231]]
    low, high = sd.stretches(sd.np.array([of] * 4).view("int64"), strings)
    for a, b, x in zip(low.tolist(), high.tolist(), (36, 20, 0, 0), strict=True):
        assert (a, b) == (0, 0) if x == 0 and b == 0 else x - 8 < a <= x and x + 230 <= b < x + 238 or (x, a, b) == (0, 0, 230)
    assert high[2] == 0 and high[3] == 230
    cut = [x[a:b] for x, a, b in zip(strings, low, high, strict=True)]
    whole = [places.tolist() for places in sd.repeats(strings)]
    kept = [i for i, x in enumerate(cut) if x]
    assert [(sd.repeats([cut[i] for i in kept])[n] + low[i]).tolist() for n, i in enumerate(kept)] == [whole[i] for i in kept]
    assert not any(whole[i] for i in range(4) if i not in kept) and all(whole[i] for i in kept)


def test_cut_units_lose_no_span():
    found = []
    for _, text in planted(8):
        data = (text or "").encode()
        found += [(a, data[b : b + n + sd.SPAN - 1]) for a, b, n in zip(*sd.units(data), strict=True)]
    found = sorted(set(found))
    strings = [x for _, x in found]
    low, high = sd.stretches(sd.np.array([a for a, _ in found]), strings)
    places = sd.repeats(strings)
    assert all(not len(p) or a <= p[0] and p[-1] + sd.SPAN <= b for p, a, b in zip(places, low, high, strict=True))
    assert sum(high - low) < sum(map(len, strings))
