import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lithogrid.llm.packing import first_fit_decreasing, pack_documents, with_digest
from lithogrid.llm.tokens import Encoder, encoder, tokenizer_path

ODD = ["", None, " ", "a", "it's  a\n\n test\t of   spaces ", "don't we'll I'M", "Ünïcode çà et là, été.", "日本語 テスト",
       "a b  c", "x\x1cy z\x85w", "naïve é ́a", "<|endoftext|> <|startoftext|>", "½ ² ³ªº µ", "a\0b c",
       "İstanbul ǅ ΑΣ", "1234 5,678.90 $$$ %%% end.", "tail\n", "\nhead", " two  ", "word's 's 'S", "👍🏽 ok", "w " * 9000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name):
    whole = Tokenizer.from_file(tokenizer_path(name))
    whole.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = "ab Éé'st \n\t\r.,!0 ́\x1cß日İ½ "
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    encoder = Encoder(tokenizer_path(name))
    for text, got in zip(texts, encoder.encode(texts, 7)):
        assert np.frombuffer(got, encoder.kind).tolist() == [
            *whole.encode(text or "", add_special_tokens=False).ids, 7], repr(text)


def test_first_fit_decreasing_matches_a_plain_scan():
    rng = np.random.default_rng(4)
    for count in (0, 1, 2, 7, 300):
        sizes = rng.integers(1, 101, count)
        bins, offsets = first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for at in np.argsort(-sizes, kind="stable"):
            spot = next((b for b, r in enumerate(room) if r >= sizes[at]), len(room))
            if spot == len(room):
                room.append(100)
            want[at] = (spot, 100 - room[spot])
            room[spot] -= sizes[at]
        assert {i: (bins[i], offsets[i]) for i in range(count)} == want


def test_every_id_lies_in_one_piece(docs_of):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "of", "erthing", "naïve", "12,"], k=rng.choice([0, 3, 90, 700, 4000])))
             for _ in range(150)]
    rows = [*enumerate(texts), (3, texts[3]), (None, None), (None, "x")]
    pieces = with_digest(pack_documents(docs_of(rows), tokenizer_path("byte_bpe_50k.json"), group_docs=40)).collect()
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = sorted([*whole.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows)
    sequences, documents = {}, {}
    for p in pieces:
        assert p.length * 4 == len(p.ids) and p.ids_crc32 == zlib.crc32(p.ids)
        sequences.setdefault(p.sequence_id, []).append(p)
        documents.setdefault(p.doc_id, []).append(p)
    for some in sequences.values():
        some.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in some]).tolist()
        assert [p.offset for p in some] == [0, *ends[:-1]] and ends[-1] <= 1024
        assert all(p.padded_length == (ends[-1] if ends[-1].bit_count() == 1 else 1024) for p in some)
    got = []
    for i, some in documents.items():
        if i in (3, None):  # rows that share an id
            continue
        some.sort(key=lambda p: p.start)
        ids = b"".join(p.ids for p in some)
        assert [p.start for p in some] == [0, *np.cumsum([p.length for p in some]).tolist()[:-1]]
        assert {p.doc_tokens for p in some} == {len(ids) // 4}
        got.append(np.frombuffer(ids, "<u4").tolist())
    shared = [whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows if i in (3, None)]
    assert sorted(got + shared) == want
    assert sum(p.length for p in documents[3]) + sum(p.length for p in documents[None]) == sum(map(len, shared))
    assert pack_documents(docs_of([]), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_little_padding(spark):
    from lithogrid.llm.common import table

    pieces = pack_documents(table(spark, "/root/testdata/sf0.01", "documents"), tokenizer_path("byte_bpe_50k.json"))
    by = pieces.groupBy("sequence_id").agg({"length": "sum", "padded_length": "max"}).toPandas()
    assert 1 - by["sum(length)"].sum() / by["max(padded_length)"].sum() < 0.01


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_queries_encode_like_an_unmodified_tokenizer(name):
    whole = Tokenizer.from_file(tokenizer_path(name))
    texts = [*ODD, "a <|endoftext|> b", "a<|endoftext|><|startoftext|>b", "<|ENDOFTEXT|> x", "<|endoftext|", " <|endoftext|>"]
    made = encoder(tokenizer_path(name))
    for text, got in zip(texts, made.encode(texts, 7)):
        assert np.frombuffer(got, made.kind).tolist() == [
            *whole.encode(text or "", add_special_tokens=False).ids, 7], repr(text)
