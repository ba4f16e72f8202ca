import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from stromlage.llm.pieces import Vocabulary, decode, encode
from stromlage.llm.queries import PIECES, QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "hello world", " a  b\n\nc ", "ä東\x00 ½ﬁ", "\t\xa0 x", "don't stop stopping stopped", "x" * 3000,
         "     indented\n        more", "🙂🙂 emoji", "w " * 20000, "hello world", "ſ ̈"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PIECES)


def ids(vocabulary, text):
    words = vocabulary.words(text)
    known = vocabulary.encode_words(words)
    return np.frombuffer(b"".join(known[w] for w in words), "<u4").tolist()


def brute(vocabulary, text):
    """Best sum of scores over all segmentations of the whole marked text."""
    marked = vocabulary.model.normalize(text)
    best = [0.0]
    for end in range(1, len(marked) + 1):
        found = [best[end - 1] + vocabulary.scores.get(marked[end - 1], vocabulary.unknown)]
        found += [best[s] + vocabulary.scores[marked[s:end]] for s in range(max(0, end - 16), end) if marked[s:end] in vocabulary.scores]
        best.append(max(found))
    return best[-1]


def score(vocabulary, text):
    """Sum of scores of the segmentation that was found: bytes of one character are one unknown."""
    total, rest = 0.0, vocabulary.model.normalize(text)
    found = iter(ids(vocabulary, text))
    while rest:
        piece = vocabulary.model.id_to_piece(next(found))
        if piece in vocabulary.scores and rest.startswith(piece):
            total, rest = total + vocabulary.scores[piece], rest[len(piece):]
        else:
            for _ in rest[0].encode()[1:]:
                next(found)
            total, rest = total + vocabulary.unknown, rest[1:]
    assert next(found, None) is None
    return total


@pytest.mark.parametrize("text", [t for t in TEXTS if t and len(t) < 4000])
def test_best_segmentation(vocabulary, text):
    assert score(vocabulary, text) == pytest.approx(brute(vocabulary, text))


def test_best_segmentation_of_random_texts(vocabulary):
    rng = random.Random(4)
    words = ["stop", "stopping", "the", "theatre", "Straße", "naïve", "x", "qqzx", "123", "4567", "東京", "🙂", "don't", "end."]
    for _ in range(100):
        text = " ".join(rng.choice(words) + rng.choice(["", "s", "ing", ","]) for _ in range(12))
        assert score(vocabulary, text) == pytest.approx(brute(vocabulary, text), abs=1e-6)
        assert vocabulary.model.decode(ids(vocabulary, text)) == text


def test_words_share_prefixes_without_mixing(vocabulary):
    """One walk over all words gives what each word gives by itself."""
    rng = random.Random(5)
    words = ["▁" + "".join(rng.choice("aehlnorst") for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    together = vocabulary.encode_words(words)
    assert all(together[w] == vocabulary.encode_words([w])[w] for w in words[::7])


def test_round_trip_and_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    encoded = encode(docs, PIECES)
    found = {r.doc_id: r for r in decode(encoded, PIECES).collect()}
    raw = {r.doc_id: r.ids for r in encoded.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, t in enumerate(TEXTS):
        assert found[i].text == (t or "") == library.decode(raw[i])
        assert found[i].n_ids == len(raw[i]) and found[i].ids_crc32 == zlib.crc32(np.array(raw[i], "<u4").tobytes())
    assert encode(docs.where("doc_id < 0"), PIECES).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r.n_ids, r.text) for r in decode(nulls, PIECES).collect()] == [(0, "")] * 2


def test_small_table_round_trip(spark, vocabulary):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    for i in list(texts)[::10]:
        assert rows[i].n_ids == len(ids(vocabulary, texts[i]))


def test_search_looks_no_further_than_pieces_end():
    """Strings that end no piece are looked up once, and nothing longer than they is."""

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return dict.get(self, key, default)

    rng, vocabulary = random.Random(6), Vocabulary(PIECES)
    words = ["▁" + "".join(rng.choice("qxzjkvw") for _ in range(40)) for _ in range(50)]
    want = vocabulary.encode_words(words)
    for table in {"scores", "ends"} & set(vars(vocabulary)):
        setattr(vocabulary, table, Counted(getattr(vocabulary, table)))
    assert vocabulary.encode_words(words) == want
    assert Counted.asked < 5 * sum(map(len, words))
