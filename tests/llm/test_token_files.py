import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lithogrid.llm import range_coder as R
from lithogrid.llm.token_files import read_token_files, write_token_files
from lithogrid.llm.tokens import tokenizer_path


@pytest.mark.parametrize("count", [0, 1, 2, 63, 64, 65, 200, 1000])
@pytest.mark.parametrize("kind", ["zipf", "same", "uniform", "cycle"])
def test_blocks_round_trip(count, kind):
    rng = np.random.default_rng(count)
    ids = {"zipf": np.minimum(rng.zipf(1.2, count), R.MAX_ID), "same": np.full(count, 49407),
           "uniform": rng.integers(0, R.MAX_ID + 1, count), "cycle": np.arange(count) % 5}[kind].astype(np.int64)
    coded = R.encode_blocks(ids, 64)
    assert len(coded) == -(-count // 64)
    assert np.array_equal(R.decode_blocks(coded, count, 64), ids)
    for n, one in enumerate(coded):  # a block needs no other
        part = ids[64 * n:64 * n + 64]
        assert np.array_equal(R.decode_blocks([one], len(part), 64), part)


def test_long_runs_cross_the_intervals_edges():
    ids = np.random.default_rng(9).choice([7, 8], 400_000, p=[.999, .001]).astype(np.int64)
    coded = R.encode_blocks(ids)
    assert np.array_equal(R.decode_blocks(coded, len(ids)), ids)
    assert sum(len(x) + len(y) for x, y in coded) < len(ids) / 10


def test_damage_is_found():
    ids = np.arange(5000) % 300
    data = R.write_file([1, None], np.array([4000, 1000]), ids)
    names, lengths, back = R.read_file(data)
    assert names == [1, None] and lengths.tolist() == [4000, 1000] and np.array_equal(back, ids)
    for at in (2, 30, len(data) - 40, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            R.read_file(bytes(broken))
    with pytest.raises(ValueError):
        R.encode_blocks(np.array([R.MAX_ID + 1]))


@pytest.mark.parametrize("file_ids", [1 << 23, 300])
def test_documents_come_back_in_order(docs_of, file_ids):
    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(i * 7 % 101, f"Text {i} naïve the of " * (i % 13)) for i in range(101)]
    rows += [(5000, None), (-3, ""), (6000, "long words " * 9000), (None, "x"), (None, "y")]
    got = {r.doc_id: r for r in read_token_files(
        write_token_files(docs_of(rows), tokenizer_path("word_bpe_49k.json"), file_ids=file_ids)).collect()}
    start = 4  # of the two without an id
    for i, text in sorted(r for r in rows if r[0] is not None):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got[None].start in (0, 2)
    assert read_token_files(write_token_files(docs_of([]), tokenizer_path("word_bpe_49k.json"))).count() == 0
