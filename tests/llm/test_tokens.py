import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lithogrid.llm import tokens
from lithogrid.llm.tokens import Encoder, tokenizer_path


class Watched:
    """Counts the texts that the library gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def made_up(rng):
    return "".join(rng.choice(["an", "ß", "e", "tion", "ñt", "öe", "zq", "x", "ÿ"]) for _ in range(rng.randrange(1, 9)))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("blind", [False, True])
def test_words_joined_give_the_ids_of_whole_texts(name, blind):
    rng, whole, own = random.Random(3), Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name), literal=False)
    if blind and own.ends is not None:
        own.ends[:] = False  # as if no id ended a word: every piece goes alone
    texts = [" ".join(made_up(rng) for _ in range(rng.randrange(400))) for _ in range(20)]
    texts += ["", " \n ", "İstanbul été ªº µm don't we'll 'tis", "12 a1b2 -- !!x <|endoftext|> y", "ﬁ ǅ  x y", None]
    for text, ids in zip(texts, own.encode(texts, 1)):
        assert np.frombuffer(ids, own.kind).tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def test_the_library_gets_few_texts():
    rng, own = random.Random(5), Encoder(tokenizer_path("word_bpe_49k.json"), literal=False)
    own.tokenizer = Watched(own.tokenizer)
    list(own.encode([" ".join(made_up(rng) for _ in range(20_000))], 1))
    assert len(own) > 5000 and own.tokenizer.texts < 100


def test_pieces_cut_in_bytes_are_those_of_the_pattern():
    rng = random.Random(7)
    signs = [chr(b) for b in tokens._PLAIN] + list("''''''sstmdrevel''  09") * 8
    texts = ["", "'", "''s", "'stuff 're 'r 'v' 'l 'll'l x'", *("".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000))]
    data = "".join(t.lower() + "\0" for t in texts).encode()
    assert "".join(t + "\0" for t in texts).encode().translate(tokens._LOWER) == data
    at = tokens.unspaced_offsets(data).tolist()
    got = [p for p in (data[a:b].decode() for a, b in zip(at, at[1:])) if p == "\0" or not p.isspace()]
    assert got == [p for t in texts for p in [*tokens.unspaced_pieces(t), "\0"]]


def test_joined_words_skip_the_word_search_and_a_full_cache_keeps_what_is_used(monkeypatch):
    own, plain = Encoder(tokenizer_path("word_bpe_49k.json"), literal=False), Encoder(tokenizer_path("word_bpe_49k.json"))
    own.tokenizer, own.words = Watched(own.tokenizer), Watched(own.words)
    monkeypatch.setattr(tokens, "MAX_PIECES", 6)
    texts = ["one two three four", "two three five six seven", "one 2 - seven"]
    for text in texts:
        [ids] = own.encode([text], 1)
        assert np.frombuffer(ids, own.kind).tolist() == [*plain.tokenizer.encode(text, add_special_tokens=False).ids, 1]
        if text == texts[1]:
            assert sorted(own) == [" ", "five", "seven", "six", "three", "two"]
            assert own.words.texts == 2 and own.tokenizer.texts == 1  # the space; no word went through the search
