"""Token-id files: an adaptive context-mixing range coder over independent blocks.

A file holds the ids of consecutive documents, cut into blocks of BLOCK ids.
Every block starts from an empty model and has a checksum, so blocks decode
alone; the blocks of a file are coded side by side, one numpy lane each.

An id is one symbol of the range coder, and bits within a class beside it. Order 2 and order 1 (the ids after the
last two ids, and after the last one, in hashed tables with a confidence)
each predict an id; the shares of "order 2 is right" and "order 1 is right"
are the mean of two adaptive distributions, chosen by the confidence of either
order. The rest of the interval belongs to order 0, which codes the id by its place in a list of
the block's ids that moves ids forward as they recur, or by its number of
bits, with an adaptive distribution over these classes. The bits that tell
ids of a class apart go to a bit string of the block as they are.

File layout, little-endian: header (magic, counts), documents (id, has-id
flag, ids in the document), blocks (bytes, bytes of them that are
range-coded words, checksum), checksum of all
that, then the blocks: words, then bit string. A document never spans two files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LTC1"
BLOCK = 1024
MAX_ID = (1 << 16) - 1

_TOTAL = 14                       # bits of a distribution
_T = 1 << _TOTAL
_SCALE = 16                       # bits of a symbol's share: four times finer than a distribution
_WHOLE = 1 << _SCALE
_KEEP = 16                        # least share of a symbol
_CLASSES = 16
_LIST = 128
_W1, _W2 = 8, 9                   # bits of the order-1 and order-2 tables
_SEEN = 9                         # bits of the encoder's table of places in the list
_TOP = 32                         # a 48-bit interval sheds its top 16 bits below 2**_TOP
_MASK = (1 << _TOP) - 1
_SMALL = 1 << 28                  # an interval cut this short by a word's edge sheds again
#: Lanes whose bit strings are made together.
_TOGETHER = 64
_HEADER = "<4sIIIQ"
_HEADER_SIZE = struct.calcsize(_HEADER)
#: Raw bits by class: places in the list by powers of two, then ids by their number of bits.
_RAW = np.array([0, 0, 1, 2, 3, 4, 5, 6, 9, 9, 10, 11, 12, 13, 14, 15, 0], np.int32)   # none of the last, "not coded"
_BASE = np.array([0, 1, 2, 4, 8, 16, 32, 64, 0, 512, 1024, 2048, 4096, 8192, 16384, 32768], np.int32)
_LENGTH = np.array([n.bit_length() for n in range(1 << 16)], np.int8)
#: Classes of places in the list, then those of ids.
_CLASS = np.concatenate([_LENGTH[:_LIST], np.maximum(_LENGTH, 9) - 1]).astype(np.int16)
_STEP = np.arange(1, _CLASSES, dtype=np.int16)[:, None]


def _at(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    """held[places]; numpy is twice as fast at it where it need not raise."""
    return held.take(places, mode="clip")


class _Model:
    """The lanes' predictions; encoder and decoder feed it the same ids."""

    def __init__(self, lanes: int):
        self.lanes = np.arange(lanes)
        # order 1, then order 2, in one array each, so that one numpy call does both: their tables of id << 2 | confidence,
        # and the distributions chosen by these
        self.places = np.stack([self.lanes << _W1, (lanes << _W1) + (self.lanes << _W2)])
        self.table = np.full((lanes << _W1) + (lanes << _W2), -4, np.int32)
        self.by = np.full((18 + 9) * lanes, np.int32(_T // 3 | (2 * _T // 3) << 16))
        #: Where each class starts, and the end.
        self.classes = np.repeat((np.arange(_CLASSES + 1) * (_T // _CLASSES)).astype(np.int16)[:, None], lanes, axis=1)
        self.starts = self.classes.ravel()
        self.goal = np.empty((_CLASSES - 1, lanes), np.int16)
        self.list = np.full(_LIST * lanes, -1, np.int32)
        self.fresh = np.zeros(lanes, np.int32)
        self.last = np.zeros(lanes, np.uint32)
        self.before = np.zeros(lanes, np.uint32)
        self.right = np.zeros(lanes, np.int32)
        self.stride = lanes

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds c1 and c2 of "order 2 is right" and "order 1 is right" for the first n lanes."""
        last = self.last[:n] * 40503
        self.at = self.places[:, :n].copy()
        self.at[0] += last >> 4 & (1 << _W1) - 1
        self.at[1] += (last ^ self.before[:n] * 60493) >> 3 & (1 << _W2) - 1
        self.e = e = _at(self.table, self.at)
        self.p1, self.p2 = self.p = e >> 2
        empty = e >> 31
        by = ((e & 3) << 1 | (self.p1 == self.p2)) & ~empty | empty & 8
        by[0] <<= 1
        by[0] += self.right[:n]
        by[1] += 18
        self.within = by * self.stride + self.lanes[:n]
        d = _at(self.by, self.within)
        self.c1, self.c2 = d & 0xFFFF, d >> 16
        return self.c1[0] + self.c1[1] << 1, self.c2[0] + self.c2[1] << 1

    def learn(self, n: int, first: np.ndarray, neither: np.ndarray, ids: np.ndarray) -> None:
        """first: order 2 was right; neither: it was not, nor was order 1."""
        to1 = first.astype(np.int32) * (_T - 3 * _KEEP) + _KEEP
        to2 = (_T - _KEEP) - neither.astype(np.int32) * (_T - 3 * _KEEP)
        self.by[self.within] = self.c1 + (to1 - self.c1 >> 4) | self.c2 + (to2 - self.c2 >> 4) << 16
        e = self.e
        now = e - 1
        np.copyto(now, ids << 2, where=e & 3 == 0)
        np.copyto(now, np.minimum(e + 1, e | 3), where=self.p == ids)
        self.table[self.at] = now
        np.logical_not(neither, out=self.right[:n], casting="unsafe")
        self.before[:n] = self.last[:n]
        self.last[:n] = ids

    def learn_class(self, n: int, cls: np.ndarray) -> None:
        """cls: the class that order 0 coded, _CLASSES where it coded none."""
        bounds, goal = self.classes[1:-1, :n], self.goal[:, :n]
        np.subtract(cls, _STEP, out=goal)
        goal >>= 15                                # all bits where the class is below
        goal &= _T - _CLASSES * _KEEP
        goal += _STEP * np.int16(_KEEP)
        goal -= bounds
        goal >>= 5
        goal &= -(cls < _CLASSES).astype(np.int16)
        bounds += goal

    def class_bounds(self, some: np.ndarray, k: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where class k starts and stops; every class has a share."""
        at = k * self.stride + some
        room, c2 = _WHOLE - _CLASSES - c2, c2 + k
        return c2 + (room * _at(self.starts, at) >> _TOTAL), c2 + 1 + (room * _at(self.starts, at + self.stride) >> _TOTAL)

    def class_at(self, some: np.ndarray, rest: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """The class whose share holds c2 + rest."""
        room, at = _WHOLE - _CLASSES - c2, some.copy()
        k = np.zeros(len(some), np.int32)
        for half in (8, 4, 2, 1):
            above = (room * _at(self.starts, at + half * self.stride) >> _TOTAL) + k + half <= rest
            k += above * np.int32(half)
            at += above * (half * self.stride)
        return k


class _Interval:
    """48-bit range coding without carries: an interval across a word's edge gives up its smaller side."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, (1 << 48) - 1, np.int64)

    def shed(self, low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lanes that shed a word, the word, their low, their range)."""
        some = np.flatnonzero(rng <= _MASK)
        lo, r = low[some], rng[some]
        edge = (lo | _MASK) + 1
        left = edge - lo
        right = r - left
        over, upper = right > 0, right > left
        lo = np.where(upper, edge, lo)
        r = np.where(upper, right, np.where(over, left, r))
        return some, lo >> _TOP, (lo & _MASK) << 16, r << 16


class _Writer(_Interval):
    def __init__(self, lanes: int, ids: int):
        super().__init__(lanes)
        self.words = np.zeros(lanes * (2 * ids + 3), np.uint16)
        self.first = np.arange(lanes) * (2 * ids + 3)
        self.next = self.first.copy()
        self.deep = np.zeros((ids, lanes), np.uint16)
        self.classes = np.full((ids, lanes), _CLASSES, np.uint8)

    def put(self, n: int, start: np.ndarray, stop: np.ndarray) -> None:
        unit = self.range[:n] >> _SCALE
        low, rng = self.low[:n], self.range[:n]
        low += start * unit
        np.multiply(unit, stop - start, out=rng)
        again = True
        while again:
            some, word, lo, r = self.shed(low, rng)
            low[some], rng[some] = lo, r
            at = self.next[some]
            self.words[at] = word
            self.next[some] = at + 1
            again = bool((r < _SMALL).any())

    def finish(self) -> list[tuple[bytes, bytes]]:
        """(words, bit string) of each lane."""
        for shift in (32, 16, 0):
            self.words[self.next] = self.low >> shift & 0xFFFF
            self.next += 1
        words, out = self.words.astype("<u2", copy=False), []
        for at in range(0, len(self.next), _TOGETHER):
            size = _at(_RAW, np.ascontiguousarray(self.classes[:, at:at + _TOGETHER].T))
            value = np.ascontiguousarray(self.deep[:, at:at + _TOGETHER].T)
            ends = size.cumsum(1, dtype=np.int32)
            total = ends[:, -1]
            # each lane's bits start with a 16-bit word of their own; a value reaches into the next word at most
            starts = np.concatenate([[0], np.cumsum(total + 15 >> 4)]).astype(np.int32)
            place = (ends - size + (starts[:-1, None] << 4)).ravel().astype(np.int32)
            own = place >> 4
            new = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            pair = np.add.reduceat(value.ravel().astype(np.uint32) << (32 - (place & 15) - size.ravel()).view(np.uint32), new)
            bits = np.zeros(int(starts[-1]) + 2, np.uint16)
            bits[own[new]] = pair >> 16
            bits[own[new] + 1] |= (pair & 0xFFFF).astype(np.uint16)
            data = bits.astype(">u2").tobytes()
            for lane, (start, n) in enumerate(zip((2 * starts).tolist(), (total + 7 >> 3).tolist()), at):
                out.append((words[self.first[lane]:self.next[lane]].tobytes(), data[start:start + n]))
        return out


class _Reader(_Interval):
    def __init__(self, coded: list[tuple[bytes, bytes]]):
        super().__init__(len(coded))
        self.words = np.frombuffer(b"".join(x for x, _ in coded) + bytes(6), "<u2")
        ends = np.cumsum([len(x) // 2 for x, _ in coded])
        self.next = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        raw = b"".join(x for _, x in coded)
        raw = np.frombuffer(raw + bytes(4 + len(raw) % 2), ">u2").astype(np.uint32)
        #: Two 16-bit words from every one on.
        self.raw = raw[:-1] << 16 | raw[1:]
        sizes = [len(x) for _, x in coded]
        self.bit = 8 * (np.cumsum(sizes) - sizes).astype(np.int64)
        self.code = np.zeros(len(coded), np.int64)
        for _ in range(3):
            self.code = self.code << 16 | _at(self.words, self.next)
            self.next += 1

    def target(self, n: int) -> np.ndarray:
        self.unit = self.range[:n] >> _SCALE
        # exact in floats: no number is over 48 bits, no quotient over 17
        return np.minimum((self.code[:n] - self.low[:n]) / self.unit, _WHOLE - 1).astype(np.int32)

    def take(self, n: int, start: np.ndarray, stop: np.ndarray) -> None:
        low, rng = self.low[:n], self.range[:n]
        low += start * self.unit
        np.multiply(self.unit, stop - start, out=rng)
        again = True
        while again:
            some, word, lo, r = self.shed(low, rng)
            low[some], rng[some] = lo, r
            at = self.next[some]
            self.code[some] = (self.code[some] - (word << _TOP)) << 16 | _at(self.words, at)
            self.next[some] = at + 1
            again = bool((r < _SMALL).any())

    def deep(self, some: np.ndarray, size: np.ndarray) -> np.ndarray:
        bit = self.bit[some]
        self.bit[some] = bit + size
        pair = _at(self.raw, bit >> 4).astype(np.int64)
        return (pair >> (32 - (bit & 15) - size)).astype(np.int32) & (1 << size) - 1


def _rows(ids: np.ndarray, block: int) -> tuple[np.ndarray, int]:
    """Ids by step and lane, and the length of the last lane."""
    lanes = -(-len(ids) // block)
    wide = np.zeros(lanes * block, np.int32)
    wide[:len(ids)] = ids
    return np.ascontiguousarray(wide.reshape(lanes, block).T), len(ids) - (lanes - 1) * block


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[tuple[bytes, bytes]]:
    """(range-coded words, bit string) of each block."""
    if not len(ids):
        return []
    if ids.max() > MAX_ID:
        raise ValueError(f"ids above {MAX_ID} do not fit this format")
    rows, short = _rows(ids, block)
    lanes = rows.shape[1]
    model, out = _Model(lanes), _Writer(lanes, block)
    seen = np.zeros(lanes << _SEEN, np.int16)
    for t in range(short if lanes == 1 else block):
        n = lanes if t < short else lanes - 1
        now = rows[t, :n]
        c1, c2 = model.predict(n)
        first, second = now == model.p2, now == model.p1
        neither = ~(first | second)
        start, stop = c1 * (second & ~first), c2.copy()
        np.copyto(stop, c1, where=first)
        some = np.flatnonzero(neither)
        classes = np.full(n, _CLASSES, np.int16)
        if len(some):
            x = _at(now, some)
            spot = (some << _SEEN) + _slot(x)
            place = _at(seen, spot).astype(np.int32)
            listed = _at(model.list, place * model.stride + some) == x
            value = np.where(listed, place, x)
            cls = _at(_CLASS, np.where(listed, place, x + _LIST))
            c2_some = _at(c2, some)
            start[some], stop[some] = model.class_bounds(some, cls.astype(np.int32), c2_some)
            classes[some] = cls
            out.classes[t, :n] = classes
            out.deep[t][some] = value - _at(_BASE, cls)
            to = _move(model, some, x, np.where(listed, place, -1), seen)
            seen[spot] = to
        out.put(n, start, stop)
        model.learn_class(n, classes)
        model.learn(n, first, neither, now)
    return out.finish()


def _slot(ids: np.ndarray) -> np.ndarray:
    """Where the encoder's table of places in the list has these ids."""
    return ids.astype(np.uint32) * 40503 >> 4 & (1 << _SEEN) - 1


def _move(model: _Model, some: np.ndarray, x: np.ndarray, place: np.ndarray, seen: np.ndarray | None) -> np.ndarray:
    """Move listed ids to half their place; new ids replace the lower half in turn. Returns their places."""
    new = place < 0
    fresh = _at(model.fresh, some)
    to = np.where(new, _LIST // 2 + (fresh & _LIST // 2 - 1), place >> 1)
    model.fresh[some] = fresh + new
    goal = to * model.stride + some
    other = _at(model.list, goal)
    model.list[goal] = x
    back = np.flatnonzero(~new)
    place, lanes, other = _at(place, back), _at(some, back), _at(other, back)
    model.list[place * model.stride + lanes] = other
    if seen is not None:
        lost = np.flatnonzero(other >= 0)
        seen[(_at(lanes, lost) << _SEEN) + _slot(_at(other, lost))] = _at(place, lost)
    return to


def decode_blocks(coded: list[tuple[bytes, bytes]], count: int, block: int = BLOCK) -> np.ndarray:
    lanes = len(coded)
    if not lanes:
        return np.empty(0, np.int64)
    short = count - (lanes - 1) * block
    rows = np.zeros((block, lanes), np.int32)
    model, read = _Model(lanes), _Reader(coded)
    for t in range(short if lanes == 1 else block):
        n = lanes if t < short else lanes - 1
        c1, c2 = model.predict(n)
        target = read.target(n)
        first, second = target < c1, target < c2
        start, stop = c1 * ~first, c2.copy()
        np.copyto(stop, c1, where=first)
        now = np.where(first, model.p2, model.p1)
        neither = ~second
        some = np.flatnonzero(neither)
        classes = np.full(n, _CLASSES, np.int16)
        if len(some):
            c2_some = _at(c2, some)
            cls = model.class_at(some, _at(target, some) - c2_some, c2_some)
            start[some], stop[some] = model.class_bounds(some, cls, c2_some)
            classes[some] = cls
            value = _at(_BASE, cls) + read.deep(some, _at(_RAW, cls))
            listed = cls < 8
            place = np.where(listed, value, 0)
            x = np.where(listed, _at(model.list, place * model.stride + some), value)
            _move(model, some, x, np.where(listed, place, -1), None)
            now[some] = x
        read.take(n, start, stop)
        rows[t, :n] = now
        model.learn_class(n, classes)
        model.learn(n, first, neither, now)
    return np.ascontiguousarray(rows.T).ravel()[:count].astype(np.int64)


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    coded = encode_blocks(ids, block)
    head = struct.pack(_HEADER, MAGIC, block, len(coded), len(doc_ids), len(ids))
    head += np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    head += np.array([i is not None for i in doc_ids], "u1").tobytes()
    head += np.asarray(lengths, "<u8").tobytes()
    head += np.array([[len(x) + len(y), len(x), zlib.crc32(x + y)] for x, y in coded], "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(x + y for x, y in coded)


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids in each document, all ids); a damaged file raises ValueError."""
    magic, block, blocks, docs, count = struct.unpack_from(_HEADER, data)
    at = _HEADER_SIZE + 17 * docs + 12 * blocks
    if magic != MAGIC or struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise ValueError("not a token-id file, or its header is damaged")
    numbers = np.frombuffer(data, "<i8", docs, _HEADER_SIZE).tolist()
    known = np.frombuffer(data, "u1", docs, _HEADER_SIZE + 8 * docs).tolist()
    lengths = np.frombuffer(data, "<u8", docs, _HEADER_SIZE + 9 * docs).astype(np.int64)
    index = np.frombuffer(data, "<u4", 3 * blocks, _HEADER_SIZE + 17 * docs).reshape(-1, 3).tolist()
    coded, at = [], at + 4
    for size, words, checksum in index:
        part = data[at:at + size]
        at += size
        if len(part) < size or zlib.crc32(part) != checksum:
            raise ValueError(f"block {len(coded)} is damaged")
        coded.append((part[:words], part[words:]))
    ids = decode_blocks(coded, count, block)
    return [i if k else None for i, k in zip(numbers, known)], lengths, ids
