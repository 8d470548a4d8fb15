"""Lossless WebP (VP8L) pictures as a column: writing 8-bit samples and reading any lossless file back into pixels.

The reader follows the public bitstream description: prefix codes (simple and normal, with groups chosen by an entropy
image), back-references with the two-dimensional distance codes, the colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. The writer stores samples in the green channel with one optimal prefix code a
picture, and with back-references, a palette or the predictor of the row above where those make the picture shorter. Other channels
are constant, so that cross-colour and subtract-green could change nothing, and a cached colour would cost what its sample costs;
the tests' writer in ``tests/llm`` uses these.

Pictures of prefix codes alone are read many at a time: one numpy step takes the next symbol of every picture. Others go through
the general reader one by one.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

WIDTH = 64
#: Rows of a picture at most; a longer payload is a series of pictures. It bounds the steps of reading many at a time.
ROWS = 128
LONGEST = 11
#: Repeats are found where they have SAME bytes from a place that is one of 2 ** ANCHORS by hash; pictures are tried with them if they
#: cover a REPEATED th, and with the predictor if this share of the samples equals those above.
SAME = 16
ANCHORS = 3
REPEATED = 24
EQUAL = 0.3
#: The longest back-reference.
COPY = 4096
#: Fixed values of the format: the order in which the lengths of the code for code lengths are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Fixed values of the format: the columns and rows that the 120 short distance codes go back.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
#: Fixed value of the format: the multiplier of the colour cache's hash.
CACHE_MULTIPLIER = 0x1E35A7BD


class Bad(ValueError):
    """The file is no lossless WebP picture, or it is damaged."""


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are flattened until none is longer than ``longest``."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        # two queues: leaves by weight, and what is joined, whose weights only grow
        order = sorted(range(len(weights)), key=weights.__getitem__)
        leaf, joined, n = len(weights), [], len(weights)
        parent, at, below = [0] * (2 * leaf - 1), 0, 0
        while n < 2 * leaf - 1:
            total = 0
            for _ in range(2):
                if below == len(joined) or (at < leaf and weights[order[at]] <= joined[below]):
                    total, k, at = total + weights[order[at]], order[at], at + 1
                else:
                    total, k, below = total + joined[below], leaf + below, below + 1
                parent[k] = n
            joined.append(total)
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(found := depth[:leaf]) <= longest:
            lengths[used] = found
            return lengths
        weights = [w // 2 + 1 for w in weights]


#: The longest code that the format has.
LEFT = 15


@functools.cache
def backwards(n: int) -> np.ndarray:
    """Of each number of ``n`` bits the one with its bits in the other order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that have codes, in the order of their codes, and the codes' lengths."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    return order, lengths[order]


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    order, size = canonical(lengths)
    codes[order] = backwards(LEFT)[(np.cumsum(1 << LEFT - size) - (1 << LEFT - size)) & (1 << LEFT) - 1]
    return codes


class Bits:
    """A bit string that grows; the first bit is the lowest."""

    def __init__(self):
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


#: The flat code for code lengths.
FLAT = {s: int(f"{k:04b}"[::-1], 2) for k, s in enumerate([*range(13), 16, 17, 18])}


def put_code(bits: Bits, lengths: np.ndarray) -> None:
    """A prefix code's description: simple for one or two symbols below 256, else run lengths under a flat 4-bit code."""
    used = np.flatnonzero(lengths).tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        bits.put(1, 1)
        bits.put(len(used) - 1, 1)
        bits.put(1, 1)
        for s in used:
            bits.put(s, 8)
        return
    own = Bits()
    own.put(0, 1)
    own.put(12, 4)
    own.put(sum(4 << 3 * k for k in range(16)), 48)
    own.put(0, 1)
    at, all_ = 0, lengths.tolist()
    for s in [*np.flatnonzero(lengths).tolist(), len(all_)]:
        while at < s:
            run = min(s - at, 138)
            if run >= 11:
                own.put(FLAT[18] | run - 11 << 4, 11)
            elif run >= 3:
                own.put(FLAT[17] | run - 3 << 4, 7)
            else:
                own.put(0, 4 * run)
            at += run
        if s < len(all_):
            own.put(FLAT[all_[s]], 4)
            at += 1
    bits.put(own.value, own.size)


def put_single(bits: Bits, symbol: int) -> None:
    """The description of a code of one symbol below 256."""
    bits.put(5 | symbol << 3, 11)


def riff(data: bytes) -> bytes:
    data += b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def repeats(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """Places of ``flat`` that repeat what is ``back`` before them: place, back, length, in order and apart from each other."""
    n = len(flat) - SAME + 1
    if n < 2:
        return []
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, 8)).view(np.uint64).ravel()
    hashes = (eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[SAME - 8 : SAME - 8 + n]) * np.uint64(0xD6E8FEB86659FD93)
    anchors = np.flatnonzero(hashes >> np.uint64(64 - ANCHORS) == 0)
    order = np.argsort(hashes[anchors], kind="stable")
    same = np.flatnonzero(np.diff(hashes[anchors[order]]) == 0)
    here, earlier = anchors[order[same + 1]], anchors[order[same]]
    by_place, out, end, data = np.argsort(here), [], 0, flat.tobytes()
    for at, back in zip(here[by_place].tolist(), (here - earlier)[by_place].tolist(), strict=True):
        if at < end:
            continue
        other = np.flatnonzero(flat[at:] != flat[at - back : len(flat) - back])
        stop = at + (int(other[0]) if len(other) else len(flat) - at)
        while at > end and at > back and data[at - 1] == data[at - 1 - back]:
            at -= 1
        if stop - at >= SAME // 2:
            out += [(a, back, min(COPY, stop - a)) for a in range(at, stop, COPY)]
            end = stop
    return out


def prefixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers from 1 as a prefix symbol, the bits after it, and how many these are."""
    x = x - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    n = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> np.maximum(n, 0) & 1)), x & (1 << n) - 1, n


@functools.lru_cache
def near_codes(width: int) -> dict[int, int]:
    """The short distance code of each distance that has one."""
    out: dict[int, int] = {}
    for k, (dx, dy) in enumerate(NEAR):
        out.setdefault(max(1, dx + dy * width), k + 1)
    return out


def put_image(bits: Bits, flat: np.ndarray, width: int, alpha: int, found: list[tuple[int, int, int]]) -> bytes:
    """The picture's data: ``bits``, then the main image's codes and pixels, with back-references where ``found`` says so."""
    bits.put(0, 2)  # no cache, no groups
    symbol = flat.astype(np.int64)
    if found:
        at, back, size = np.array(found, np.int64).T
        copied = np.zeros(len(flat) + 1, np.int64)
        np.add.at(copied, at, 1)
        np.add.at(copied, at + size, -1)
        start = np.zeros(len(flat), bool)
        start[at] = True
        token = np.flatnonzero((np.cumsum(copied)[:-1] == 0) | start)
        copy = np.flatnonzero(start[token])
        symbol = symbol[token]
        length, more, n_more = prefixed(size)
        symbol[copy] = 256 + length
        codes = near_codes(width)
        far, rest, n_rest = prefixed(np.array([codes.get(d, d + 120) for d in back.tolist()], np.int64))
        of_far = code_lengths(np.bincount(far, minlength=40))
    lengths = code_lengths(np.bincount(symbol, minlength=280))
    put_code(bits, lengths)
    for single in (0, 0, alpha):
        put_single(bits, single)
    if found:
        put_code(bits, of_far)
    else:
        put_single(bits, 0)
    fields = 4 if found else 1
    n, value = np.zeros((2, len(symbol), fields), np.int64)
    if np.count_nonzero(lengths) > 1:
        n[:, 0], value[:, 0] = lengths[symbol], reversed_codes(lengths)[symbol]
    if found:
        n[copy, 1], value[copy, 1], n[copy, 3], value[copy, 3] = n_more, more, n_rest, rest
        if np.count_nonzero(of_far) > 1:
            n[copy, 2], value[copy, 2] = of_far[far], reversed_codes(of_far)[far]
    n, value = n.ravel(), value.ravel()
    ends = bits.size + np.cumsum(n)
    total = int(ends[-1])
    head = np.frombuffer(bits.value.to_bytes((total + 95) // 32 * 4, "little"), np.uint32).astype(np.uint64)
    if total > bits.size:
        at = ends - n
        value = value.astype(np.uint64) << (at & 31).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        head[word[first]] += np.add.reduceat(value & 0xFFFFFFFF, first)
        head[word[first] + 1] += np.add.reduceat(value >> np.uint64(32), first)
    return head.astype("<u4").tobytes()[: (total + 7) // 8]


def begun(width: int, rows: int) -> Bits:
    bits = Bits()
    for value, n in ((0x2F, 8), (width - 1, 14), (rows - 1, 14), (0, 4)):  # no alpha, version 0
        bits.put(value, n)
    return bits


def with_palette(samples: np.ndarray) -> bytes:
    """The picture by a palette of at most 16 entries, which share pixels."""
    rows, width = samples.shape
    colours = np.unique(samples)
    bits = begun(width, rows)
    bits.put(1 | 3 << 1, 3)
    bits.put(len(colours) - 1, 8)
    bits.put(0, 1)  # no cache; the palette's own image: differences from entry to entry, in green
    steps = np.diff(colours.astype(np.int64), prepend=0) & 255
    lengths = code_lengths(np.bincount(steps, minlength=280))
    put_code(bits, lengths)
    for used in ([0], [0], [0, 255] if len(colours) > 1 else [255], [0]):
        put_code(bits, np.isin(np.arange(256), used).astype(np.int64))
    codes = reversed_codes(lengths)
    for k, step in enumerate(steps.tolist()):
        bits.put(int(codes[step]), int(lengths[step]) if np.count_nonzero(lengths) > 1 else 0)
        bits.put(int(k == 0), len(colours) > 1)  # alpha: 255, then no difference
    bits.put(0, 1)
    per = packed(len(colours))
    index = np.searchsorted(colours, samples).astype(np.int64)
    narrow = -(-width >> per)
    index = np.pad(index, ((0, 0), (0, (narrow << per) - width))).reshape(rows, narrow, 1 << per)
    flat = (index << np.arange(1 << per) * (8 >> per)).sum(2).astype(np.uint8).ravel()
    return put_image(bits, flat, narrow, 255, repeats(flat))


def with_predictor(samples: np.ndarray) -> bytes:
    """The picture as differences from the row above."""
    rows, width = samples.shape
    bits = begun(width, rows)
    bits.put(1, 3)
    bits.put(7, 3)
    bits.put(0, 1)  # no cache; the modes' image: all are the row above, which takes no bits
    for single in (2, 0, 0, 255, 0):
        put_single(bits, single)
    bits.put(0, 1)
    rest = samples.copy()
    rest[1:] -= samples[:-1]
    rest[0, 1:] -= samples[0, :-1]
    return put_image(bits, rest.ravel(), width, 0, repeats(rest.ravel()))


def write_gray(samples: np.ndarray) -> bytes:
    """A picture whose green channel holds ``samples`` (rows of bytes); red and blue are 0, alpha is 255. The shortest of what is tried."""
    rows, width = samples.shape
    flat = samples.ravel()

    def plain(found):
        bits = begun(width, rows)
        bits.put(0, 1)
        return put_image(bits, flat, width, 255, found)

    tried = [plain([])]
    found = repeats(flat)
    if sum(n for _, _, n in found) * REPEATED >= len(flat):
        tried.append(plain(found))
    if np.count_nonzero(np.bincount(flat, minlength=256)) <= 16:
        tried.append(with_palette(samples))
    if rows > 1 and np.count_nonzero(samples[1:] == samples[:-1]) > EQUAL * len(flat):
        tried.append(with_predictor(samples))
    return riff(min(tried, key=len))


def write_payload(payload: bytes) -> bytes:
    """``payload`` (a positive multiple of 64 bytes) as one picture, or as a series of pictures of ``ROWS`` rows."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(write_gray(samples[a : a + ROWS]) for a in range(0, len(samples), ROWS))


class Reader:
    def __init__(self, data: bytes):
        self.data, self.left, self.at = data, len(data) * 8, 0

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.left:
            raise Bad("it ends too early")
        return value

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 5], "little") >> (self.at & 7) & ((1 << n) - 1)


class Code:
    """A prefix code: ``one`` is its only symbol, or ``found`` maps (length, code) to a symbol."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.lengths, self.used, self.one = lengths, used, used[0] if len(used) == 1 else 0 if not used else None
        if self.one is None and sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
            raise Bad("a prefix code is not complete")

    @functools.cached_property
    def found(self) -> dict[tuple[int, int], int]:
        codes = reversed_codes(np.array(self.lengths))
        return {(self.lengths[s], int(codes[s])): s for s in self.used}

    def take(self, bits: Reader) -> int:
        if self.one is not None:
            return self.one
        window = bits.peek(15)
        for n in range(1, 16):
            if (s := self.found.get((n, window & ((1 << n) - 1)))) is not None:
                bits.take(n)
                return s
        raise Bad("no such code")

    def table(self, bits: int = LONGEST) -> np.ndarray | None:
        """symbol * 16 + length for each window of ``bits`` bits, or None if a code is longer."""
        if self.one is not None:
            return np.full(1 << bits, self.one * 16, np.int32)
        if max(self.lengths) > bits:
            return None
        order, size = canonical(np.array(self.lengths))
        return np.repeat((order * 16 + size).astype(np.int32), 1 << bits - size)[backwards(bits)]


@functools.lru_cache
def single(symbol: int, size: int) -> Code:
    return Code([int(s == symbol) for s in range(size)])


@functools.lru_cache
def of_lengths(order: tuple[int, ...]) -> list[int]:
    """The table, for windows of 7 bits, of a code for code lengths."""
    return Code(list(order)).table(7).tolist()


def take_code(bits: Reader, size: int) -> Code:
    if bits.peek(3) == 5 and bits.peek(11) >> 3 < size:
        return single(bits.take(11) >> 3, size)
    lengths = [0] * size
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        for s in [bits.take(8 if wide else 1), *([bits.take(8)] if two else [])]:
            lengths[s] = 1
        return Code(lengths)
    order = [0] * 19
    for k in range(bits.take(4) + 4):
        order[LENGTH_ORDER[k]] = bits.take(3)
    table = of_lengths(tuple(order))
    most = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, last = 0, 8
    while at < size and most:
        most -= 1
        found = table[bits.peek(7)]
        bits.take(found & 15)
        s = found >> 4
        if s < 16:
            lengths[at] = s
            last, at = s or last, at + 1
            continue
        value, run = (last, 3 + bits.take(2)) if s == 16 else (0, 3 + bits.take(3) if s == 17 else 11 + bits.take(7))
        if at + run > size:
            raise Bad("code lengths run over")
        lengths[at : at + run] = [value] * run
        at += run
    return Code(lengths)


def take_number(bits: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def one_channel(bits: Reader, codes: list[Code], width: int, total: int) -> np.ndarray | None:
    """The words of an image of which only green varies, or None if others do or codes are too long."""
    green, far = codes[0].table(), codes[4].table()
    if green is None or far is None or any(c.one is None for c in codes[1:4]):
        return None
    green, far, out, at, most = green.tolist(), far.tolist(), bytearray(), bits.at, (1 << LONGEST) - 1
    data = bits.data + b"\0" * 8

    def number(prefix):
        nonlocal at
        if prefix < 4:
            return prefix + 1
        n = prefix - 2 >> 1
        value = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & (1 << n) - 1
        at += n
        return (2 + (prefix & 1) << n) + value + 1

    while len(out) < total:
        found = green[int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & most]
        at += found & 15
        if found < 4096:
            out.append(found >> 4)
            continue
        n = number((found >> 4) - 256)
        found = far[int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & most]
        at += found & 15
        back = distance(number(found >> 4), width)
        if back > len(out) or len(out) + n > total:
            raise Bad("a back-reference leaves the picture")
        out += (out[-back:] * (n // back + 1))[:n] if back < n else out[len(out) - back : len(out) - back + n]
        if at > bits.left:
            break
    if at > bits.left:
        raise Bad("it ends too early")
    bits.at = at
    return np.frombuffer(out, np.uint8).astype(np.uint32) << 8 | np.uint32(codes[1].one << 16 | codes[2].one | codes[3].one << 24)


def take_image(bits: Reader, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image as ARGB words."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise Bad("the colour cache is too large")
    block, groups = 0, np.zeros((1, 1), np.int64)
    if main and bits.take(1):
        block = bits.take(3) + 2
        groups = take_image(bits, -(-width >> block), -(-height >> block)).astype(np.int64) >> 8 & 0xFFFF
    codes = [[take_code(bits, n) for n in (280 + (cache_bits and 1 << cache_bits), 256, 256, 256, 40)] for _ in range(int(groups.max()) + 1)]
    total, rows = width * height, groups.tolist()
    if not cache_bits and not block and (quick := one_channel(bits, codes[0], width, total)) is not None:
        return quick.reshape(height, width)
    out, cache = [], [0] * (1 << cache_bits)
    while len(out) < total:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, far = codes[rows[y >> block][x >> block] if block else 0]
        s = green.take(bits)
        if s < 256:
            new = [red.take(bits) << 16 | s << 8 | blue.take(bits) | alpha.take(bits) << 24]
        elif s < 280:
            n = take_number(bits, s - 256)
            back = distance(take_number(bits, far.take(bits)), width)
            if back > len(out) or len(out) + n > total:
                raise Bad("a back-reference leaves the picture")
            new = (out[-back:] * (n // back + 1))[:n] if back < n else out[len(out) - back : len(out) - back + n]
        else:
            new = [cache[s - 280]]
        out += new
        if cache_bits:
            for p in new:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32).reshape(height, width)


def channels(words: np.ndarray) -> np.ndarray:
    return np.stack([words >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def words(argb: np.ndarray) -> np.ndarray:
    a = argb.astype(np.uint32) & 255
    return a[..., 0] << 24 | a[..., 1] << 16 | a[..., 2] << 8 | a[..., 3]


def predict(mode: int, left, top, right_top, left_top):
    """One pixel (four channels each) from its neighbours."""
    def mean(a, b):
        return (a + b) >> 1

    if mode == 11:
        near_left = np.abs(top - left_top).sum()
        near_top = np.abs(left - left_top).sum()
        return left if near_left < near_top else top
    if mode == 12:
        return np.clip(left + top - left_top, 0, 255)
    if mode == 13:
        half = mean(left, top)
        return np.clip(half + np.trunc((half - left_top) / 2).astype(np.int64), 0, 255)
    return [
        lambda: np.array([255, 0, 0, 0]), lambda: left, lambda: top, lambda: right_top, lambda: left_top,
        lambda: mean(mean(left, right_top), top), lambda: mean(left, left_top), lambda: mean(left, top), lambda: mean(left_top, top),
        lambda: mean(top, right_top), lambda: mean(mean(left, left_top), mean(top, right_top)),
    ][mode if mode < 11 else 0]()


def neighbours(image: np.ndarray, y: int, x: int) -> tuple:
    """Left, top, top right and top left; the pixel above right of the last column is the row's own first one."""
    width = image.shape[1]
    beyond = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
    return image[y, x - 1], image[y - 1, x], beyond, image[y - 1, x - 1]


def mode_at(modes: np.ndarray, block: int, y: int, x: int) -> int:
    """The predictor of a pixel: black for the first one, left in the first row, top in the first column."""
    if not y:
        return 1 if x else 0
    return int(modes[y >> block, x >> block]) if x else 2


def undo_predictor(image: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    if (modes == 2).all():  # the row above, everywhere: sums
        image[0, 0, 0] += 255
        image[0] = np.cumsum(image[0], 0)
        return np.cumsum(image, 0) & 255
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            mode = mode_at(modes, block, y, x)
            image[y, x] = (image[y, x] + predict(mode, *neighbours(image, y, x))) & 255
    return image


def signed(x: np.ndarray) -> np.ndarray:
    return (x ^ 128) - 128


def colour_deltas(table: np.ndarray, block: int, shape: tuple) -> tuple:
    """green to red, green to blue and red to blue multipliers of every pixel."""
    y, x = np.arange(shape[0]) >> block, np.arange(shape[1]) >> block
    each = signed(table)[y[:, None], x[None, :]]
    return each[..., 3], each[..., 2], each[..., 1]


def undo_cross_colour(image: np.ndarray, table: np.ndarray, block: int) -> np.ndarray:
    to_red, to_blue, red_blue = colour_deltas(table, block, image.shape[:2])
    green = signed(image[..., 2])
    image[..., 1] = (image[..., 1] + (to_red * green >> 5)) & 255
    image[..., 3] = (image[..., 3] + (to_blue * green >> 5) + (red_blue * signed(image[..., 1]) >> 5)) & 255
    return image


def undo_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    per = packed(len(palette))
    index = image[..., 2]
    bits = 8 >> per
    index = (index[:, :, None] >> (np.arange(1 << per) * bits) & ((1 << bits) - 1)).reshape(len(image), -1)[:, :width]
    known = np.concatenate([palette, np.zeros((256 - len(palette), 4), np.int64)])
    return known[index]


def packed(colours: int) -> int:
    """A power of two: so many palette entries share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def body(file: bytes) -> tuple[bytes, int]:
    """The VP8L data of the first picture in ``file``, and where the picture ends."""
    if len(file) < 20 or file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise Bad("no lossless WebP file")
    end = 8 + struct.unpack_from("<I", file, 4)[0]
    size = struct.unpack_from("<I", file, 16)[0]
    if end > len(file) or 20 + size > end:
        raise Bad("it ends too early")
    return file[20 : 20 + size], end


def head(bits: Reader) -> tuple[int, int]:
    if bits.take(8) != 0x2F:
        raise Bad("no lossless WebP picture")
    width, height, _, version = bits.take(14) + 1, bits.take(14) + 1, bits.take(1), bits.take(3)
    if version:
        raise Bad("unknown version")
    return width, height


def read_pixels(data: bytes) -> np.ndarray:
    """Alpha, red, green and blue (last axis) of a picture's VP8L data."""
    bits = Reader(data)
    width, height = head(bits)
    undo, narrow, seen = [], width, set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise Bad("a transform is there twice")
        seen.add(kind)
        if kind < 2:
            block = bits.take(3) + 2
            table = channels(take_image(bits, -(-narrow >> block), -(-height >> block)))
            undo.append((lambda p, t=table, b=block: undo_predictor(p, t[..., 2] & 15, b)) if kind == 0 else (lambda p, t=table, b=block: undo_cross_colour(p, t, b)))
        elif kind == 2:
            undo.append(lambda p: np.stack([p[..., 0], (p[..., 1] + p[..., 2]) & 255, p[..., 2], (p[..., 3] + p[..., 2]) & 255], -1))
        else:
            palette = np.cumsum(channels(take_image(bits, bits.take(8) + 1, 1))[0], 0) & 255
            undo.append(lambda p, t=palette, w=narrow: undo_palette(p, t, w))
            narrow = -(-narrow >> packed(len(palette)))
    image = channels(take_image(bits, narrow, height, main=True))
    for f in reversed(undo):
        image = f(image)
    return image


def plain_code(bits: Reader) -> np.ndarray | None:
    """The green code's table if the picture has no transform, cache, groups or back-references and only green varies; else None."""
    if bits.take(3):
        return None
    codes = [take_code(bits, n) for n in (280, 256, 256, 256, 40)]
    if [c.one for c in codes[1:4]] != [0, 0, 255] or any(codes[0].lengths[256:]):
        return None
    return codes[0].table()


def read_gray(datas: list[bytes], plainly: list[bool] | None = None) -> list[np.ndarray]:
    """The samples (rows) of many pictures' green channels. ``plainly`` is told of each whether it was read as prefix codes alone."""
    out: list = [None] * len(datas)
    plain = []
    for k, data in enumerate(datas):
        bits = Reader(data)
        width, height = head(bits)
        table = plain_code(bits)
        if plainly is not None:
            plainly.append(table is not None)
        if table is None:
            out[k] = read_pixels(data)[..., 2].astype(np.uint8)
        else:
            plain.append((width * height, k, width, table, bits.at))
    plain.sort(key=lambda x: -x[0])
    if not plain:
        return out
    counts = np.array([x[0] for x in plain])
    tables = np.concatenate([x[3] for x in plain])
    sizes = [len(datas[x[1]]) + 8 for x in plain]
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    joined = np.frombuffer(b"".join(datas[x[1]] + b"\0" * 8 for x in plain), np.uint8).astype(np.uint32)
    window = joined[:-2] | joined[1:-1] << 8 | joined[2:] << 16
    at = base * 8 + np.array([x[4] for x in plain])
    last = base * 8 + np.array(sizes) * 8 - 32
    lane = np.arange(len(plain)) << LONGEST
    rows = np.empty((int(counts[0]), len(plain)), np.int16) if len(plain) else None
    live, most = len(plain), (1 << LONGEST) - 1
    ends = len(plain) - np.searchsorted(counts[::-1], np.arange(int(counts[0])), "right")
    for step in range(int(counts[0])):
        live = ends[step]
        a = np.minimum(at[:live], last[:live])
        found = tables[lane[:live] | (window[a >> 3] >> (a & 7) & most)]
        rows[step, :live] = found >> 4
        at[:live] += found & 15
    columns = rows.T
    for i, (n, k, width, _, _) in enumerate(plain):
        got = columns[i, :n]
        if at[i] > (base[i] + len(datas[k])) * 8:
            raise Bad("it ends too early")
        out[k] = got.astype(np.uint8).reshape(-1, width)
    return out


def special(data: bytes) -> bool:
    """Whether a picture has transforms, a cache, groups or back-references."""
    bits = Reader(data)
    head(bits)
    return bits.take(3) != 0 or any(take_code(bits, 280).lengths[256:])


def pictures(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        data, end = body(media[at:])
        out.append(data)
        at += end
    return out
