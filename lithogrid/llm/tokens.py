"""Token ids of whole texts through the tokenizers library, by pieces that encode alike alone.

A text is cut where the tokenizer itself always cuts, each distinct piece is
encoded once by the library, and the pieces' ids are joined. The ids equal
those of the whole text; tests hold both against each other. The cache of
pieces is emptied when it is full, so its memory has a bound.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from lithogrid.llm.common import per_worker

MAX_PIECES = 400_000
#: Characters of the texts that are encoded together.
TOGETHER = 1 << 21
#: The same where the pieces are told apart without a Python string each.
UNSPACED_TOGETHER = 1 << 22

# Texts of these characters only are cut by the pattern that the tokenizers apply, where no version of Unicode differs.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = bytes([9, 10, 11, 12, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = re.compile(rf"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_UNSPACED = re.compile(rf"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
# Others are cut at white space. White space beside white space stays where it is; Python knows more of it than the tokenizers.
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
_ASCII_SPACE = re.compile("[ \t\n\r\f\v]+")
# One word to any tokenizer that cuts out runs of letters, whatever its normalizer does to it.
_WORD = re.compile("[a-zß-öø-ÿ]+")
# The unspaced cut over bytes of UTF-8, where every byte of a plain text from 128 on belongs to a letter À to ÿ: what
# becomes of each byte in lower case, and its kind. Each even kind is a piece alone.
_SPACE, _DIGIT, _LETTER, _MARK, _OTHER = 1, 2, 3, 4, 5
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
_KINDS = bytes(_MARK if not b else _LETTER if b >= 128 or chr(b).isalpha() else _DIGIT if chr(b).isdigit()
               else _SPACE if chr(b).isspace() else _OTHER for b in range(256))
#: Words that the library gets as one text.
_JOINED = 500


def _plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


def spaced_pieces(text: str) -> list[str]:
    """Pieces of a byte-level tokenizer that puts a single space before the next word."""
    if _plain(text):
        return _SPACED.findall(text)
    first, *rest = _BETWEEN_WORDS.split(text)
    return [first, *(" " + piece for piece in rest)]


def unspaced_pieces(text: str) -> list[str]:
    """Pieces of a lower-casing tokenizer that drops white space."""
    return _UNSPACED.findall(text.lower()) if _plain(text) else _ASCII_SPACE.split(text)


def unspaced_offsets(data: bytes) -> np.ndarray:
    """Where the pieces of lower-case plain texts start, and the end. ``data``: UTF-8, a zero byte after each text.

    Cuts as ``unspaced_pieces`` does; runs of white space and the zero bytes are pieces too.
    """
    raw, kinds = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KINDS), np.uint8)
    new = np.ones(len(raw) + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=new[1:-1])
    new[:-1] |= kinds & 1 == 0
    at = np.flatnonzero(raw == ord("'"))
    at = at[new[at] & (kinds[at + 1] == _LETTER)]
    first, second = raw[at + 1], raw[at + 2]
    short = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    long = np.isin(first, np.frombuffer(b"rv", np.uint8)) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    some = short | long
    new[at[some] + 1] = False
    new[at[some] + 2 + long[some]] = True
    return np.flatnonzero(new).astype(np.int32)


def packer_of(kind: np.dtype):
    """Ids as bytes; ``array`` packs a short list faster than numpy does."""
    code = "H" if kind.itemsize == 2 else "I"
    if sys.byteorder == "little" and array(code).itemsize == kind.itemsize:
        return lambda ids: array(code, ids).tobytes()
    return lambda ids: np.array(ids, kind).tobytes()


class Encoder(dict):
    """Pieces to the bytes of their ids, little-endian unsigned numbers of type ``kind``.

    ``literal``: added tokens' content in a text is encoded like other text. Otherwise, as the
    library does by default, it becomes their ids; such texts are encoded whole.
    """

    def __init__(self, path: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        added = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a normalizer may make an added token of other letters
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.pack = packer_of(self.kind)
        self.cut = unspaced_pieces if self.tokenizer.normalizer is not None else spaced_pieces
        ending = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: By id, whether it ends a word; None where no id tells.
        self.ends = None
        #: What plain words joined by spaces go to: the same model without the search for words in them.
        self.words = self.tokenizer
        if ending and self.cut is unspaced_pieces:
            how = self.tokenizer.pre_tokenizer
            how = list(how) if isinstance(how, pre_tokenizers.Sequence) else []
            if len(how) == 2 and isinstance(how[1], pre_tokenizers.ByteLevel):
                self.words = Tokenizer(self.tokenizer.model)
                self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), how[1]])
            self.ends = np.zeros(size, bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(ending)]] = True

    def _learn(self, new: list[str]) -> None:
        """Encode pieces; plain words many to a text, where the ids that end a word part them."""
        alone = new
        if self.ends is not None:
            words, alone = [], []
            for piece in new:
                (words if _WORD.fullmatch(piece) else alone).append(piece)
            some = [words[at:at + _JOINED] for at in range(0, len(words), _JOINED)]
            for own, found in zip(some, self.words.encode_batch_fast([" ".join(own) for own in some], add_special_tokens=False)):
                ids = np.array(found.ids, self.kind)
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(own):  # a word has one such id at most, so one of these has none
                    alone += own
                    continue
                data, stops = ids.tobytes(), (stops * self.kind.itemsize).tolist()
                self.update(zip(own, map(data.__getitem__, map(slice, [0, *stops], stops))))
        for piece, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self[piece] = self.pack(found.ids)

    def _plain_ids(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids of plain texts that are cut unspaced: Arrow tells the pieces apart, numpy joins their ids."""
        if not texts:
            return []
        data = ("\0".join(texts) + "\0").encode().translate(_LOWER)
        offsets = unspaced_offsets(data)
        cut = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which, pieces = cut.indices.to_numpy(), cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        mark = pieces.index("\0")
        own = list(map(self.get, pieces))
        own[mark] = end
        new = [p for p, ids in zip(pieces, own) if ids is None]
        if new:
            if len(self) + len(new) > MAX_PIECES:  # what these texts have again is kept
                known = {p: ids for p, ids in zip(pieces, own) if ids is not None and p != "\0"}
                self.clear()
                self.update(known)
            self._learn(new)
            own = list(map(self.get, pieces))
            own[mark] = end
        sizes = np.fromiter(map(len, own), np.int32, len(own)) // self.kind.itemsize
        counts = sizes[which]
        stops = np.cumsum(counts, dtype=np.int32)
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes)[which] - (stops - counts)
        ids = np.frombuffer(b"".join(own), self.kind)[np.repeat(shift, counts) + np.arange(stops[-1], dtype=np.int32)].tobytes()
        ends = (stops[which == mark] * self.kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _together(self, texts: list[str], end: bytes) -> Iterator[bytes]:
        whole = [self.added is not None and self.added.search(t) is not None for t in texts]
        plain = [self.cut is unspaced_pieces and not w and _plain(t) for t, w in zip(texts, whole)]
        done = iter(self._plain_ids([t for t, p in zip(texts, plain) if p], end))
        cut = [[] if w or p else self.cut(t) for t, w, p in zip(texts, whole, plain)]
        new = list(set().union(*cut).difference(self))
        if len(self) + len(new) > MAX_PIECES:
            self.clear()
            new = list(set().union(*cut))
        self._learn(new)
        for text, pieces, w, p in zip(texts, cut, whole, plain):
            if p:
                yield next(done)
            elif w:
                yield self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids) + end
            else:
                yield b"".join(map(self.__getitem__, pieces)) + end

    def encode(self, texts: Iterable[str | None], end: int) -> Iterator[bytes]:
        """Each text's ids and then the id ``end``; a null text counts as empty."""
        mark, held, size = np.array([end], self.kind).tobytes(), [], 0
        most = UNSPACED_TOGETHER if self.cut is unspaced_pieces else TOGETHER
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= most:
                yield from self._together(held, mark)
                held, size = [], 0
        yield from self._together(held, mark)


def encoder(path: str) -> Encoder:
    return per_worker("encoder", path, lambda: Encoder(path, literal=False))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
