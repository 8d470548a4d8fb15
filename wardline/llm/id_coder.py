"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks that are coded independently, each from a fresh model, with a checksum of its ids. The probability of the next
id is a mix of three predictions: order 2 and order 1 each predict the id that followed their context last, order 0 is an adaptive
distribution over the ids seen so far, which are kept in ``SLOTS`` hashed slots, and an escape, after which the id's bits follow
evenly. The weights of orders 2 and 1 adapt after each id, apart for each state of the predictions (which are there, whether they
agree); contexts learn after each id; order 0 learns at the ends of chunks, short ones first. An id takes one part of the range:
order 2's if that is right, else order 1's, else its part of order 0. A carry-less 64-bit range coder puts out 32-bit words.

The blocks of a group are coded together: a numpy step codes the next id of every block, and what of the encoder doesn't depend on
the weights is computed for a chunk of all blocks at once. All arithmetic is of integers: files are the same everywhere.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block at most, and at least if there are as many; blocks that are coded together.
BLOCK = 4096
LEAST = 2048
LANES = 1024
#: Slots of a block's tables of predictions, by order. The last of order 0 is the escape.
SLOTS = 512
SLOTS_1 = 256
SLOTS_2 = 1024
ESCAPE = SLOTS - 1
#: Bits of order 0's frequencies, and of the mix's weights.
F0 = 12
MIX = 15
#: States of the predictions: whether order 2 has one, and whether order 1 has the same.
STATES = 4
#: A weight loses 1/16 and gains the first number at each id, and the second if its prediction was right: it never comes to 0, and
#: orders 1 and 2 together never to more than about three quarters.
LEAST_GAIN, GAIN = 4, 1536
#: Where chunks end, and the length of those that follow.
CHUNKS = (32, 160, 512, 1280)
CHUNK = 1408
#: Steps of a chunk that the encoder prepares at once.
AHEAD = 64
MAGIC = b"TIDC\x02"
_LOW, _FIELD = np.uint64(0xFFFFFFFF), np.uint64(0xFFFF)
_32, _16 = np.uint64(32), np.uint64(16)
#: Two weights lie in one number, order 2's in the upper half.
_BOTH = 1 << 32 | 1
_LOSS = (1 << 28) - 1 << 32 | (1 << 28) - 1
_GAINS = np.array([LEAST_GAIN * _BOTH, LEAST_GAIN * _BOTH + GAIN, LEAST_GAIN * _BOTH + (GAIN << 32)], np.uint64)


def _chunks(block: int) -> list[tuple[int, int]]:
    ends = [c for c in CHUNKS if c < block] + list(range(CHUNKS[-1] + CHUNK, block, CHUNK)) + [block]
    return list(zip([0, *ends], ends, strict=False))


class Order0:
    """Each lane's distribution over slots: of every chunk, from the ids before it."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.base = np.arange(lanes) * SLOTS
        self.ids = np.full(lanes * SLOTS, (1 << 31) - 1, np.int64)
        self.ids.reshape(lanes, SLOTS)[:, ESCAPE] += 1
        #: Counts and, in the 11 bits below, whether there is one.
        self.counts = np.zeros((lanes, SLOTS), np.int32)
        self.counts[:, ESCAPE] = 1 << 11 | 1
        self.seen = 0
        self._freeze()

    def _freeze(self) -> None:
        """What a slot has: its id, where its frequencies start, and how many they are; 32, 16 and 16 bits. The frequencies' sum
        is 2 ** F0, and a slot in use has one at least."""
        sums = np.cumsum(self.counts, 1, dtype=np.int32)
        used = sums & 2047
        sums >>= 11
        sums *= ((1 << F0) - used[:, -1:] << 18) // sums[:, -1:]
        sums >>= 18
        sums += used
        sums[:, -1] = 1 << F0
        sizes = sums.copy()
        sizes[:, 1:] -= sums[:, :-1]
        sums -= sizes
        sums <<= 16
        sums |= sizes
        self.slot = self.ids << 32
        self.slot |= sums.reshape(-1)
        self.slot = self.slot.view(np.uint64)
        self.sizes = sizes.reshape(-1)

    def lookup(self) -> np.ndarray:
        """The slot of each frequency of each lane."""
        return np.repeat(np.tile(np.arange(SLOTS, dtype=np.uint16), self.lanes), self.sizes)

    def places(self, ids: np.ndarray) -> np.ndarray:
        return ids % np.int32(ESCAPE) + self.base

    def learn(self, ids: np.ndarray, escapes: np.ndarray) -> None:
        """From a chunk of ids (rows are steps), and how many of each lane's were escapes."""
        at = self.places(ids).reshape(-1)
        self.ids[at] = ids.reshape(-1)  # of a slot's ids the last one stays
        found = np.bincount(at, minlength=self.lanes * SLOTS).astype(np.int32).reshape(self.lanes, SLOTS)
        found <<= 11
        self.counts += found
        self.counts |= found > 0
        self.seen += len(ids)
        # As many escapes as in the last chunk; a 48th at least, so that an escape leaves the range wide enough for the id's bits.
        self.counts[:, ESCAPE] = np.maximum(escapes * self.seen // len(ids), self.seen // 48 + 1) << 11 | 1
        self._freeze()


class Contexts:
    """What followed each context of orders 1 and 2 last, and the weights of the two."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.base_1, self.base_2, self.base_state = lane * SLOTS_1, lane * SLOTS_2, lane * STATES
        self.one, self.two = np.full(lanes * SLOTS_1, -1, np.int32), np.full(lanes * SLOTS_2, -1, np.int32)
        self.weights = np.full(lanes * STATES, _BOTH << MIX - 5, np.uint64)

    def places(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = last.astype(np.uint32) * np.uint32(0x9E3779B1)
        b = before.astype(np.uint32) * np.uint32(0x85EBCA6B)
        b += a
        a >>= np.uint32(24)
        b >>= np.uint32(22)
        return self.base_1 + a, self.base_2 + b

    def state(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Where the weights are."""
        return self.base_state + ((two >= 0).view(np.uint8) * np.uint8(2) + (one == two))


class Constants:
    """Of each number that steps work with, an array: quicker than a scalar."""

    def __init__(self, lanes: int):
        def of(n):
            return np.full(lanes, n, np.uint64)

        self.mix, self.all, self.f0, self.full, self.four, self.sixteen = of(MIX), of(1 << MIX), of(F0), of((1 << F0) - 1), of(4), of(16)
        self.half, self.low, self.field, self.loss, self.least = of(32), of(_LOW), of(_FIELD), of(_LOSS), of(_GAINS[0])


class Range:
    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))

    def narrow(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Take a part of the range; the lanes that have a word to move, which is in ``word``."""
        self.low += start
        self.range = size
        hit = (size <= _LOW).nonzero()[0]
        if len(hit):
            low, part = self.low.take(hit), size.take(hit)
            self.word = top = low >> _32
            astride = ((low + part >> _32) != top).nonzero()[0]
            if len(astride):
                part[astride] = (np.uint64(0) - low[astride]) & _LOW
            low <<= _32
            part <<= _32
            self.low[hit], size[hit] = low, part
        return hit


def encode_blocks(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The words of each block; ``ids`` are blocks by rows, of which each id has at most ``bits`` bits."""
    lanes, block = ids.shape
    steps = np.ascontiguousarray(ids.T, np.int32)
    zero, contexts, coder, n = Order0(lanes), Contexts(lanes), Range(lanes), Constants(lanes)
    out, at = np.zeros(lanes * (block + 4), np.uint32), np.arange(lanes) * (block + 4)
    last = np.vstack([np.zeros((2, lanes), np.int32), steps])
    bits = np.uint64(bits)
    for a, b in _chunks(block):
        escapes = np.zeros(lanes, np.int64)
        edge = zero.slot[zero.base + ESCAPE]
        for c in range(a, b, AHEAD):
            d = min(c + AHEAD, b)
            now = steps[c:d]
            slot = zero.slot.take(zero.places(now))
            escape = slot >> _32 != now.astype(np.uint64)
            slot = np.where(escape, edge, slot)
            start, size = slot >> _16 & _FIELD, slot & _FIELD
            at_1, at_2 = contexts.places(last[c + 1 : d + 1], last[c:d])
            one, two = np.empty_like(now), np.empty_like(now)
            for t in range(d - c):
                contexts.one.take(at_1[t], out=one[t], mode="clip")
                contexts.two.take(at_2[t], out=two[t], mode="clip")
                contexts.one[at_1[t]] = contexts.two[at_2[t]] = now[t]
            state = contexts.state(one, two)
            right_2 = two == now
            right = (one == now) | right_2
            escape &= ~right
            escapes += escape.sum(0)
            gain = _GAINS.take(right.view(np.uint8) + right_2)
            for t in range(d - c):
                place = state[t]
                weights = contexts.weights.take(place)
                w_2 = weights >> n.half
                both = weights & n.low
                both += w_2
                step = coder.range >> n.mix
                begin = step * both
                part = n.all - both
                part *= step
                part >>= n.f0
                begin += part * start[t]
                part *= size[t]
                k = right[t].nonzero()[0]
                if len(k):
                    some = step[k]
                    two_ends = some * w_2[k]
                    is_2 = right_2[t, k]
                    part[k] = np.where(is_2, two_ends, some * both[k] - two_ends)
                    two_ends[is_2] = 0
                    begin[k] = two_ends
                k = escape[t].nonzero()[0]
                if len(k):
                    fine = part.take(k) >> bits
                    begin[k] += fine * now[t].take(k).astype(np.uint64)
                    part[k] = fine
                hit = coder.narrow(begin, part)
                if len(hit):
                    to = at.take(hit)
                    out[to] = coder.word
                    at[hit] = to + 1
                loss = weights >> n.four
                loss &= n.loss
                weights -= loss
                weights += gain[t]
                contexts.weights[place] = weights
        if b < block:
            zero.learn(steps[a:b], escapes)
    out[at], out[at + 1] = coder.low >> _32, coder.low & _LOW
    return [out[k * (block + 4) : at[k] + 2] for k in range(lanes)]


def decode_blocks(words: list[np.ndarray], block: int, bits: int) -> np.ndarray:
    """The ids of blocks (by rows)."""
    lanes = len(words)
    zero, contexts, coder, n = Order0(lanes), Contexts(lanes), Range(lanes), Constants(lanes)
    width = max(map(len, words)) + 2
    source = np.zeros((lanes, width), np.uint32)
    for k, w in enumerate(words):
        source[k, : len(w)] = w
    source = source.reshape(-1)
    code = source[::width].astype(np.uint64) << _32 | source[1::width]
    at = np.arange(lanes) * width + 2
    steps = np.zeros((block, lanes), np.int32)
    last = before = np.zeros(lanes, np.int32)
    base = np.arange(lanes) << F0
    most, bits = np.uint64((1 << bits) - 1), np.uint64(bits)
    for a, b in _chunks(block):
        lookup, escapes = zero.lookup(), np.zeros(lanes, np.int64)
        for t in range(a, b):
            at_1, at_2 = contexts.places(last, before)
            one, two = contexts.one.take(at_1), contexts.two.take(at_2)
            place = contexts.state(one, two)
            weights = contexts.weights.take(place)
            w_2 = weights >> n.half
            both = weights & n.low
            both += w_2
            step = coder.range >> n.mix
            begin = step * both
            part = n.all - both
            part *= step
            part >>= n.f0
            value = code - coder.low
            right = value < begin
            inner = value - begin  # far too large where it is below, and cut then
            inner //= part
            np.minimum(inner, n.full, out=inner)
            inner = inner.view(np.int64)
            inner += base
            inner = lookup.take(inner)
            slot = zero.slot.take(zero.base + inner)
            size = slot >> n.sixteen
            size &= n.field
            begin += part * size
            part *= slot & n.field
            slot >>= n.half
            now = slot.astype(np.int32)
            escape = now < 0
            gain = n.least.copy()
            k = right.nonzero()[0]
            if len(k):
                escape[k] = False
                some = step[k]
                two_ends = some * w_2[k]
                is_2 = value.take(k) < two_ends
                part[k] = np.where(is_2, two_ends, some * both[k] - two_ends)
                two_ends[is_2] = 0
                begin[k] = two_ends
                now[k] = np.where(is_2, two.take(k), one.take(k))
                gain[k] = np.where(is_2, _GAINS[2], _GAINS[1])
            escapes += escape
            k = escape.nonzero()[0]
            if len(k):
                fine, first = part.take(k) >> bits, begin.take(k)
                raw = np.minimum((value.take(k) - first) // fine, most)
                begin[k] = first + fine * raw
                part[k] = fine
                now[k] = raw
            hit = coder.narrow(begin, part)
            if len(hit):
                where = at.take(hit)
                code[hit] = code.take(hit) << _32 | source.take(where, mode="clip")
                at[hit] = where + 1
            loss = weights >> n.four
            loss &= n.loss
            weights -= loss
            weights += gain
            contexts.weights[place] = weights
            contexts.one[at_1] = contexts.two[at_2] = now
            steps[t] = now
            before, last = last, now
        if b < block:
            zero.learn(steps[a:b], escapes)
    return np.ascontiguousarray(steps.T)


def encode(ids: np.ndarray) -> bytes:
    """A segment: header, each block's words and checksum, then the words of all blocks. The last block is filled up with 0."""
    n = len(ids)
    block = max(LEAST, -(-n // (LANES * max(1, -(-n // (LANES * BLOCK))))))
    blocks = -(-n // block)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    if n and (int(ids.min()) < 0 or bits > 20):
        raise ValueError("ids are of 0 to 20 bits")
    padded = np.zeros(blocks * block, np.int32)
    padded[:n] = ids
    rows = padded.reshape(blocks, block)
    words = [w for a in range(0, blocks, LANES) for w in encode_blocks(rows[a : a + LANES], bits)]
    heads = [struct.pack("<II", len(w), zlib.crc32(r.astype("<u4").tobytes())) for w, r in zip(words, rows, strict=True)]
    return MAGIC + struct.pack("<QII", n, block, bits) + b"".join(heads) + b"".join(w.astype("<u4").tobytes() for w in words)


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if it is damaged."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("no segment of token ids")
    n, block, bits = struct.unpack_from("<QII", data, len(MAGIC))
    at, blocks = len(MAGIC) + 16, -(-n // block) if block else 0
    heads = np.frombuffer(data, "<u4", 2 * blocks, at).reshape(blocks, 2)
    ends = np.cumsum(heads[:, 0].astype(np.int64))
    words = np.frombuffer(data, "<u4", int(ends[-1]) if blocks else 0, at + 8 * blocks)
    parts = np.split(words, ends[:-1]) if blocks else []
    out = np.zeros((blocks, block), np.int32)
    for a in range(0, blocks, LANES):
        out[a : a + LANES] = decode_blocks(parts[a : a + LANES], block, bits)
    for row, crc in zip(out, heads[:, 1].tolist(), strict=True):
        if zlib.crc32(row.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
    return out.reshape(-1)[:n]
