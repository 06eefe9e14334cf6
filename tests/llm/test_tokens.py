import json
from pathlib import Path

import pytest

from pricelattice.llm.tokens import BYTE_BPE_50K, LETTERS, ByteBpe, encode_corpus, spell, unspell

HARD = ["", " ", "\n\n  x", "don't I'LL we've", "<|endoftext|> <unk>", "Ñandú – ½ L 1.234,56", "\x00\x01\t", "🙂👩‍👩‍👧", "हिन्दी Цена 价格 ٣Ⅷ", "a" * 3000, " " * 999 + "b", "é́", "x￾", "0xDEADBEEF" * 50]


@pytest.fixture(scope="module")
def encoder():
    return ByteBpe(Path(BYTE_BPE_50K).read_bytes())


def test_against_tokenizers(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(str(Path(BYTE_BPE_50K).with_suffix(".json")))
    other.encode_special_tokens = True
    assert encoder.encode_batch(HARD) == [e.ids for e in other.encode_batch(HARD, add_special_tokens=False)]


def test_round_trip(encoder):
    assert [encoder.decode(ids) for ids in encoder.encode_batch(HARD)] == HARD
    assert len(set(LETTERS)) == 256 and unspell(spell(bytes(range(256)))) == bytes(range(256))


def test_vocabulary_is_whole(encoder):
    assert len(encoder.pieces) == 50_256 and encoder.model.get_piece_size() == 50_257
    assert max(json.loads(json.dumps(encoder.encode_batch(["abc def"])[0]))) < 50_256


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hola mundo", "x"), (3, "Hola mundo", "x"), (None, "a", "x"), (4, "z " * 200_000, "x")]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert len(got) == 6 and got[0].ids == [] and got[1].ids == [] and got[2].ids == got[3].ids != [] and got[4].doc_id is None and len(got[5].ids) == 200_001 + 0 * 1
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
