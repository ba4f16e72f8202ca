import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stromlage.llm.token_counts import pieces, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "  ", "a", " a b", "a  b   c", "a\n\n b \n c\t d", "Don't 't 's they'll", "x<|endoftext|> y",
    " <|endoftext|>  <|endoftext|>", "Zürich straße – 東京   1234 ½ ٣ \x1c z", "a b" * 5000, "trail ", "﻿ q",
    "a b c", "don 't", "1 2 3", "!! ?? ..", "a b", "a b",
]


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_pieces_join_to_the_text(text):
    first, *rest = pieces(text)
    assert "".join([first, *[" " + p for p in rest]]) == text


def test_counts_equal_the_library(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, BPE).collect()}
    t = Tokenizer.from_file(BPE)
    assert found == {
        i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in enumerate(TEXTS)
    }


def test_counts_of_a_sentencepiece_model(spark):
    import sentencepiece

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts(docs, PIECE).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert found == {i: len(sp.encode(x or "")) for i, x in enumerate(TEXTS)}


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_all_documents_of_the_small_table(spark):
    from stromlage.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in QUERIES["op8_token_counts"](spark, sf).collect()}
    t = Tokenizer.from_file(BPE)
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        n = len(t.encode(r.text or "", add_special_tokens=False))
        assert found[r.doc_id].n_tokens == n and found[r.doc_id].over_limit == (n > 512)
