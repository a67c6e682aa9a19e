import random

import public_tokenizers
import pytest
import sentencepiece
from conftest_rows import ODD

from placegrid.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def ours():
    return pieces.Pieces(pieces.load_blob(PATH))


def test_ids_and_texts_as_the_library(library, ours):
    rnd = random.Random(3)
    alphabet = list("abcdeht THE inging  \n\t.,1234▁éßñü中文😀\x00　​<0x41></s>")
    for _ in range(4000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        ids = library.encode(text)
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_the_library(library, ours):
    rnd = random.Random(5)
    for _ in range(4000):
        ids = [rnd.randrange(rnd.choice([3, 300, 32000])) for _ in range(rnd.randint(0, 8))]
        assert ours.decode(ids) == library.decode(ids), ids


def test_whole_documents(library, ours, docs):
    for r in docs.select("text").collect():
        assert ours.encode(r.text) == library.encode(r.text)


def test_a_long_word_takes_linear_work(library, ours):
    text = "abcab" * 30000
    assert ours.encode(text) == library.encode(text)


def test_memo_turns_over(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 3)
    model = pieces.Pieces(pieces.load_blob(PATH))
    text = "a few words that come back, a few words more: a few"
    assert [model.encode(text) for _ in range(3)] == [library.encode(text)] * 3
    assert len(model.memo) <= 3 and len(model.memo.aged) <= 3


def test_odd_rows(library, odd, none):
    blob = pieces.load_blob(PATH)
    out = pieces.tokenized(odd.withColumnsRenamed({"n_chars": "Ids"}), blob)
    assert out.columns == ["doc_id", "text", "lang", "source", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert pieces.tokenized(none, blob).count() == 0
    assert pieces.token_digests(odd, blob).columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"]
