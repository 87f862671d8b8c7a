"""The piece encoder against the plain tokenizer on texts of odd signs, with a memory that is too small."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pricemill.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [" ", " ", " ", "\n", "\t", "a", "b", "the", "ing", "é", "日", "🙂", ".", ",", "'s", "1", "23", "!?", "<|endoftext|>", "\xa0", "　", "_", "-"]
SIGNS += ["\r\n", "\x1c", "\x85", "...", "\x00", "word", "Ⅷ", "½", "***", "$$$", "ß", "Жы", "ªº", "Ǆ", "Ελ", "don't", ".\nThe", "\x7f", "\xad"]


@pytest.mark.parametrize("cache_pieces", [0, 500, 400_000])
def test_encoder_equals_the_plain_tokenizer(cache_pieces):
    plain, encoder = Tokenizer.from_file(PATH), PieceEncoder(PATH, cache_pieces)
    draw = random.Random(cache_pieces)
    for _ in range(30):
        texts = ["".join(draw.choices(SIGNS, k=draw.randrange(30))) for _ in range(300)] + ["", " ", "a", "a  b", "a " * 5000]
        for text, ids in zip(texts, encoder(texts)):
            assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0], repr(text)
    assert encoder([]) == []


def test_other_tokenizers_are_refused():
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        encoder(["some words stand here"])
