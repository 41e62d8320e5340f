"""Operator 3, media columns: texts stored as lossless WebP images and read back inside Spark tasks.

``decode`` reads plain lossless WebP (VP8L) files, not the extended container: prefix codes, meta prefix codes, back-references, colour cache, and the
predictor, cross-colour, subtract-green and palette transforms. ``encode_samples`` stores 8-bit samples, one in the
green channel of each pixel, with prefix codes and back-references, or through a palette where few values occur.

Defined results: a null text is the empty text; the payload is never empty (at least 64 zero bytes); equal texts give
equal rows; payloads over ``STRIP`` bytes become several images, one after the other, so a text of any length needs the
memory of one strip; repeated rows stay; an empty table gives no rows; other columns, of whatever name, are left aside by
``store`` and kept by ``pixels``.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import Spans, in_batches

# Fixed values of the lossless WebP bitstream: order of the code length codes, and the (x, y) offsets of the 120 short
# distance codes.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE, MAX_LENGTH, MAX_BITS = 1 << 14, 4096, 15
#: Payload bytes of one image at most: as many rows of 64 as an image holds.
STRIP = 64 * MAX_SIDE


# --------------------------------------------------------------------------------------------------------- prefix codes
def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of a prefix code for symbols with these counts, none over 15 bits."""
    symbols = sorted(counts)
    if len(symbols) == 1:
        return {symbols[0]: 0}
    weights = [counts[s] for s in symbols]
    while True:
        n = len(symbols)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            w, a = heapq.heappop(heap)
            v, b = heap[0]
            parent[a] = parent[b] = node
            heapq.heapreplace(heap, (w + v, node))
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= MAX_BITS:
            return dict(zip(symbols, depth))
        weights = [(w >> 1) + 1 for w in weights]


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, length)."""
    out, code, last = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        if length:
            code <<= length - last
            out[symbol] = (int(f"{code:0{length}b}"[::-1], 2), length)
            code, last = code + 1, length
        else:
            out[symbol] = (0, 0)
    return out


class Code:
    """A decoding table: the symbol and the bits used, by the next ``bits`` bits of the stream."""

    __slots__ = ("bits", "symbol", "used")

    def __init__(self, lengths: dict[int, int]):
        self.bits = max(lengths.values(), default=0)
        self.symbol = np.zeros(1 << self.bits, np.int64)
        self.used = np.zeros(1 << self.bits, np.int64)
        total = sum(1 << (self.bits - n) for n in lengths.values())
        if total != 1 << self.bits:
            raise ValueError("prefix code is not complete")
        for symbol, (code, length) in canonical(lengths).items():
            self.symbol[code :: 1 << length] = symbol
            self.used[code :: 1 << length] = length


# ------------------------------------------------------------------------------------------------------------ bit reader
class Bits:
    """Bits of a stream, first bit lowest."""

    def __init__(self, data: bytes):
        self.data = data + bytes(8)
        self.at = 0
        self.end = 8 * len(data)

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return value

    def symbol(self, code: Code) -> int:
        k = self.peek(code.bits)
        self.at += int(code.used[k])
        return int(code.symbol[k])


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if two and (second := bits.read(8)) != first:
            return Code({first: 1, second: 1})
        return Code({first: 0})
    meta = {}
    for k in range(4 + bits.read(4)):
        if n := bits.read(3):
            meta[CODE_LENGTH_ORDER[k]] = n
    inner = Code(meta if len(meta) > 1 else dict.fromkeys(meta, 0))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, at, before = {}, 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = bits.symbol(inner)
        if s < 16:
            if s:
                lengths[at] = before = s
            at += 1
        elif s == 16:
            for _ in range(3 + bits.read(2)):
                lengths[at] = before
                at += 1
        else:
            at += 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
    if at > alphabet:
        raise ValueError("too many code lengths")
    return Code(lengths if len(lengths) > 1 else dict.fromkeys(lengths, 0))


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(bits: Bits, code: Code, width: int) -> int:
    d = _extended(bits, bits.symbol(code))
    if d > len(NEAR):
        return d - len(NEAR)
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


# --------------------------------------------------------------------------------------------------------------- pixels
_EIGHT = np.arange(8)


def _green_only(bits: Bits, codes: list[Code], size: int, width: int, rest: int) -> np.ndarray:
    """Pixels where only green (and distances) take bits: every bit position is decoded at once, then the chain of code
    starts is followed in strides of 16 and filled in."""
    green, dist = codes[0], codes[4]
    out = np.empty(size, np.uint32)
    if green.bits == 0:
        out[:] = rest | int(green.symbol[0]) << 8
        return out
    base = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8)[base:].astype(np.int64)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    window = ((wide[:, None] >> _EIGHT) & ((1 << green.bits) - 1)).ravel()
    following = green.used[window]
    following += np.arange(len(window))
    np.minimum(following[-MAX_BITS - 1 :], len(window) - 1, out=following[-MAX_BITS - 1 :])
    copying = bool((green.symbol >= 256).any())
    if copying:
        stopped = np.flatnonzero(green.symbol[window] >= 256)
        following[stopped] = stopped
    jumps = [following]
    for _ in range(4):
        jumps.append(jumps[-1].take(jumps[-1]))
    far = jumps[-1].item
    at, done = bits.at - 8 * base, 0
    while done < size:
        need = size - done
        heads, p = [at], at
        for _ in range(need >> 4):
            q = far(p)
            if q == p:
                break
            heads.append(p := q)
        chain = np.array(heads)
        for jump in reversed(jumps[:-1]):
            chain = np.stack((chain, jump.take(chain)), 1).ravel()
        chain = chain[:need]
        symbols = green.symbol.take(window.take(chain))
        run = len(chain)
        if copying and (halt := symbols >= 256).any():
            run = int(np.argmax(halt))
        out[done : done + run] = symbols[:run] << 8 | rest
        done += run
        if run < len(chain):
            at = int(chain[run])
            bits.at = 8 * base + at + int(green.used[window[at]])
            length = _extended(bits, int(symbols[run]) - 256)
            _copy(out, done, length, _distance(bits, dist, width))
            done += length
            at = bits.at - 8 * base
        else:
            at = int(chain[-1] + green.used[window[chain[-1]]])
    bits.at = 8 * base + at
    return out


def _copy(out: np.ndarray, at: int, length: int, back: int) -> None:
    if back > at or at + length > len(out):
        raise ValueError("a back-reference leaves the image")
    if back >= length:
        out[at : at + length] = out[at - back : at - back + length]
    else:
        out[at : at + length] = np.resize(out[at - back : at], length)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: ARGB values, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    block, groups_of = 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        groups_of = (read_pixels(bits, across, -(-height >> block), False) >> 8) & 0xFFFF
    count = int(groups_of.max()) + 1 if groups_of is not None else 1
    groups = [[read_code(bits, n) for n in (280 + (cache_bits and 1 << cache_bits), 256, 256, 256, 40)] for _ in range(count)]
    size = width * height
    g = groups[0]
    if groups_of is None and not cache_bits and not (g[1].bits or g[2].bits or g[3].bits):
        return _green_only(bits, g, size, width, int(g[3].symbol[0]) << 24 | int(g[1].symbol[0]) << 16 | int(g[2].symbol[0]))
    out = np.zeros(size, np.uint32)
    cache, shift, cached, at = [0] * (1 << cache_bits), 32 - cache_bits, 0, 0
    while at < size:
        if groups_of is not None:
            g = groups[groups_of[(at // width >> block) * across + (at % width >> block)]]
        s = bits.symbol(g[0])
        if s < 256:
            red, blue, alpha = bits.symbol(g[1]), bits.symbol(g[2]), bits.symbol(g[3])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _extended(bits, s - 256)
            _copy(out, at, length, _distance(bits, g[4], width))
            at += length
        else:
            while cached < at:
                cache[(CACHE_FACTOR * int(out[cached]) & 0xFFFFFFFF) >> shift] = int(out[cached])
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return out


# ----------------------------------------------------------------------------------------------------------- transforms
def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _packed(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predicted(mode: int, left, top, topleft, topright):
    """The predictor's guess, channel by channel (arrays of four)."""
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode < 5:
        return (left, top, topright, topleft)[mode - 1]
    if mode == 5:
        return ((left + topright) // 2 + top) // 2
    if mode < 10:
        a, b = ((left, topleft), (left, top), (topleft, top), (top, topright))[mode - 6]
        return (a + b) // 2
    if mode == 10:
        return ((left + topleft) // 2 + (top + topright) // 2) // 2
    if mode == 11:
        return left if np.abs(top - topleft).sum() < np.abs(left - topleft).sum() else top
    if mode == 12:
        return np.clip(left + top - topleft, 0, 255)
    if mode == 13:
        mean = (left + top) // 2
        return np.clip(mean + np.fix((mean - topleft) / 2).astype(int), 0, 255)
    return np.array([255, 0, 0, 0])


def invert_predictor(argb: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    c = _channels(argb).reshape(height, width, 4)
    across = -(-width >> block)
    modes = ((modes >> 8) & 15).reshape(-1, across)
    flat = c.reshape(-1, 4)
    flat[0] = (flat[0] + (255, 0, 0, 0)) & 255
    c[0, 1:] += c[0, 0]
    c[0, 1:] = (c[0, 0] + np.cumsum(c[0, 1:] - c[0, 0], 0)) & 255
    for y in range(1, height):
        flat[y * width] = (flat[y * width] + flat[(y - 1) * width]) & 255
        for x in range(1, width):
            i = y * width + x
            guess = predicted(int(modes[y >> block, x >> block]), flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
            flat[i] = (flat[i] + guess) & 255
    return _packed(flat)


def _delta(factor: np.ndarray, value: np.ndarray) -> np.ndarray:
    signed = lambda v: ((v & 255) ^ 128) - 128
    return signed(factor) * signed(value) >> 5


def invert_cross_colour(argb: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    c = _channels(argb)
    y, x = np.divmod(np.arange(width * height), width)
    f = _channels(factors)[(y >> block) * -(-width >> block) + (x >> block)]
    red = (c[:, 1] + _delta(f[:, 3], c[:, 2])) & 255
    c[:, 3] += _delta(f[:, 2], c[:, 2]) + _delta(f[:, 1], red)
    c[:, 1] = red
    return _packed(c)


def invert_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb)
    c[:, 1] += c[:, 2]
    c[:, 3] += c[:, 2]
    return _packed(c)


def palette_bundle(colours: int) -> int:
    """log2 of how many indexes share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def invert_palette(argb: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    bundle = palette_bundle(len(palette))
    each = 8 >> bundle
    index = ((argb >> 8) & 255).reshape(height, -1)
    index = ((index[:, :, None] >> (np.arange(1 << bundle, dtype=np.uint32) * np.uint32(each))) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    known = np.zeros(256, np.uint32)
    known[: len(palette)] = palette
    return known[index.ravel()]


def decode(file: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB values row by row) of a lossless WebP file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or file[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(file[21 : 20 + int.from_bytes(file[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            data = read_pixels(bits, -(-now >> block), -(-height >> block), False)
            undo.append((invert_predictor if kind == PREDICTOR else invert_cross_colour, (now, height, block, data)))
        elif kind == SUBTRACT_GREEN:
            undo.append((invert_subtract_green, ()))
        else:
            n = bits.read(8) + 1
            palette = _packed(np.cumsum(_channels(read_pixels(bits, n, 1, False)), 0))
            undo.append((invert_palette, (now, height, palette)))
            now = -(-now >> palette_bundle(n))
    argb = read_pixels(bits, now, height, True)
    for f, given in reversed(undo):
        argb = f(argb, *given)
    return width, height, argb


# ------------------------------------------------------------------------------------------------------------- encoding
class Writer:
    """Bits in order; ``many`` appends whole arrays of codes."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.value: list[int] = []
        self.length: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.value.append(value)
        self.length.append(n)

    def many(self, values: np.ndarray, lengths: np.ndarray) -> None:
        if self.value:
            self.parts.append((np.array(self.value, np.int64), np.array(self.length, np.int64)))
            self.value, self.length = [], []
        self.parts.append((values, lengths))

    def bytes(self) -> bytes:
        self.many(np.zeros(0, np.int64), np.zeros(0, np.int64))
        values = np.concatenate([v for v, _ in self.parts])
        lengths = np.concatenate([n for _, n in self.parts])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1]) if len(ends) else 0
        # Codes have at most 24 bits and bits of their own: a float64 sum of those that start in a 16-bit unit is exact.
        units = np.bincount(starts >> 4, values << (starts & 15), (total >> 4) + 4).astype(np.int64)
        out = units & 0xFFFF
        out[1:] += (units[:-1] >> 16) & 0xFFFF
        out[2:] += units[:-2] >> 32
        return out.astype("<u2").tobytes()[: total + 7 >> 3]


def write_code(w: Writer, lengths: dict[int, int]) -> None:
    """The description of a prefix code (a symbol over 255 or more than two symbols take the general form)."""
    symbols = sorted(lengths)
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(int(symbols[0] > 1), 1)
        w.put(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
        return
    items, at = [], 0
    for s in symbols:
        gap = s - at
        while gap >= 3:
            n = min(gap, 138)
            items.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            gap -= n
        items += [(0, 0, 0)] * gap
        items.append((max(1, lengths[s]), 0, 0))
        at = s + 1
    counts: dict[int, int] = {}
    for k, _, _ in items:
        counts[k] = counts.get(k, 0) + 1
    while True:
        inner = code_lengths(counts)
        if max(inner.values()) <= 7:
            break
        counts = {k: (v >> 1) + 1 for k, v in counts.items()}
    w.put(0, 1)
    order = [inner.get(k, 0) or int(k in inner) for k in CODE_LENGTH_ORDER]
    used = max(4, 1 + max(i for i, n in enumerate(order) if n))
    w.put(used - 4, 4)
    for n in order[:used]:
        w.put(n, 3)
    limit = len(items) - 2  # how many items follow
    n = max(2, (limit.bit_length() + 1) & ~1)
    w.put(1, 1)
    w.put((n - 2) >> 1, 3)
    w.put(limit, n)
    codes = canonical(inner)
    for k, extra, size in items:
        w.put(*codes[k])
        if size:
            w.put(extra, size)


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, how many) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    extra = value.bit_length() - 2
    return 2 * extra + 2 + ((value >> extra) & 1), value & ((1 << extra) - 1), extra


#: Bytes that must repeat for a back-reference; positions with a hash of this remainder anchor the search.
REPEAT, ANCHOR = 24, 8
#: Farthest repeat that the distance alphabet of 40 symbols names.
FARTHEST = (1 << 20) - len(NEAR)


def repeats(data: np.ndarray) -> list[tuple[int, int, int]]:
    """Non-overlapping (start, length, distance) of repeated spans, found from content-defined anchors."""
    if len(data) < 2 * REPEAT:
        return []
    start = np.arange(len(data) - REPEAT)
    hashes = Spans(data).hash(start, start + REPEAT)
    at = start[hashes % ANCHOR == 0]
    h = hashes[at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return []
    found = sorted(zip(at[order][1:][same].tolist(), at[order][:-1][same].tolist()))
    raw, out, done = data.tobytes(), [], 0
    for p, q in found:
        if p < done or p - q > FARTHEST or raw[p : p + REPEAT] != raw[q : q + REPEAT]:
            continue
        while p > done and q and raw[p - 1] == raw[q - 1]:
            p, q = p - 1, q - 1
        a, b = data[p:], data[q : q + len(data) - p]
        n = 0
        while n < len(a):
            differ = np.flatnonzero(a[n : n + 256] != b[n : n + 256])
            if len(differ):
                n += int(differ[0])
                break
            n += len(a[n : n + 256])
        out.append((p, n, p - q))
        done = p + n
    return out


def encode_image(samples: np.ndarray, width: int) -> bytes:
    """8-bit samples (a multiple of ``width``) as the green channel of one image."""
    height = len(samples) // width
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    present = np.flatnonzero(np.bincount(samples, minlength=256))
    data, across = samples, width
    if len(present) <= 16:
        bundle = palette_bundle(len(present))
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(present) - 1, 8)
        steps_ = np.diff(present, prepend=0)
        w.put(0, 1)
        greens = {int(s): int(n) for s, n in zip(*np.unique(steps_, return_counts=True))}
        lengths = code_lengths(greens)
        alpha = {255: 1, 0: 1} if len(present) > 1 else {255: 0}
        for code in (lengths, {0: 0}, {0: 0}, alpha, {0: 0}):
            write_code(w, code)
        green, opaque = canonical(lengths), canonical(alpha)
        for k, s in enumerate(steps_.tolist()):
            w.put(*green[s])
            w.put(*opaque[0 if k else 255])
        index = np.searchsorted(present, samples).astype(np.uint8).reshape(height, width)
        each, per = 8 >> bundle, 1 << bundle
        across = -(-width // per)
        index = np.pad(index, ((0, 0), (0, across * per - width))).reshape(height, across, per)
        data = (index << (np.arange(per, dtype=np.uint8) * each)).sum(2).astype(np.uint8).ravel()
    w.put(0, 1)  # no further transform
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one group of prefix codes
    spans = repeats(data)
    copies: dict[int, list[tuple[int, int, int, int]]] = {}
    literal = np.ones(len(data), bool)
    extra_counts: dict[int, int] = {}
    far: dict[int, int] = {}
    for p, n, back in spans:
        literal[p : p + n] = False
        parts = []
        while n:
            m = min(n, MAX_LENGTH)
            a, b = prefix_of(m), prefix_of(back + len(NEAR))
            parts.append((a, b))
            extra_counts[256 + a[0]] = extra_counts.get(256 + a[0], 0) + 1
            far[b[0]] = far.get(b[0], 0) + 1
            n -= m
        copies[p] = parts
    counted = np.bincount(data[literal], minlength=256)
    counts = {int(s): int(counted[s]) for s in np.flatnonzero(counted)} | extra_counts
    green = code_lengths(counts)
    distance = code_lengths(far) if far else {0: 0}
    alpha = {0: 0} if len(present) <= 16 else {255: 0}
    for code in (green, {0: 0}, {0: 0}, alpha, distance):
        write_code(w, code)
    codes, far_codes = canonical(green), canonical(distance)
    value, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (v, n) in codes.items():
        if s < 256:
            value[s], length[s] = v, n
    done = 0
    for p, n, _ in spans:
        w.many(value[data[done:p]], length[data[done:p]])
        for a, b in copies[p]:
            w.put(*codes[256 + a[0]])
            w.put(a[1], a[2])
            w.put(*far_codes[b[0]])
            w.put(b[1], b[2])
        done = p + n
    w.many(value[data[done:]], length[data[done:]])
    body = w.bytes()
    pad = len(body) & 1
    return b"RIFF" + (12 + len(body) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + bytes(pad)


def encode_samples(payload: bytes) -> bytes:
    """Images for a payload whose length is a positive multiple of 64, one after the other."""
    out = []
    for at in range(0, len(payload), STRIP):
        strip = np.frombuffer(payload[at : at + STRIP], np.uint8)
        out.append(encode_image(strip, 64))
    return b"".join(out)


def images(stored: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(stored):
        size = 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        yield stored[at : at + size]
        at += size


def decode_images(stored: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(width, height, ARGB values row by row) of each image of a stored value."""
    return map(decode, images(stored))


def decode_samples(stored: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """(the samples, the sizes of the images) of what ``encode_samples`` stored."""
    data, sizes = [], []
    for width, height, argb in decode_images(stored):
        data.append(((argb >> 8) & 255).astype(np.uint8).tobytes())
        sizes.append((width, height))
    return b"".join(data), sizes


def feature(data: bytes, sizes: list[tuple[int, int]]) -> str:
    """Size, mean, variance, distinct values and mean horizontal step of the samples, as text."""
    a = np.frombuffer(data, np.uint8)
    counts = np.bincount(a, minlength=256)
    levels = np.arange(256)
    n, total, squares = len(a), int(counts @ levels), int(counts @ levels**2)
    mean = total / n
    step = np.abs(np.diff(a.astype(np.int16))).sum() / max(1, n - 1)
    shape = "+".join(f"{w}x{h}" for w, h in sizes)
    return f"{shape};mean={mean:.6f};var={squares / n - mean * mean:.6f};distinct={int((counts > 0).sum())};step={step:.6f}"


# ---------------------------------------------------------------------------------------------------------- Spark layer
IMAGES = ArrayType(StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("argb", ArrayType(IntegerType()))]))
MEDIA = "{id} long, n_bytes long, payload_bytes long, media binary"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as stored media: id, n_bytes, payload_bytes, media (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(k, 256), batch.column(1).slice(k, 256)
                rows = []
                for t in texts:
                    raw = (t.as_py() or "").encode()
                    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
                    rows.append((len(raw), len(payload), encode_samples(payload)))
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["id", "n_bytes", "payload_bytes", "media"])

    return in_batches(docs).select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, MEDIA.format(id="id"))


#: Pixels that one batch of the decode operator holds before it is handed on.
BATCH_PIXELS = 1 << 20


def pixels(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with a column ``images``: of each lossless WebP file that ``media_col`` holds (one or several, one after
    the other; none if null), its width, its height and its ARGB values row by row."""
    image = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.list_(pa.int32()))])
    names = [*media.columns, "images"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, ends, found = 0, [0], []
            for i, stored in enumerate(batch[media_col]):
                found += decode_images(stored.as_py() or b"")
                ends.append(len(found))
                if sum(len(a) for _, _, a in found) >= BATCH_PIXELS or i + 1 == batch.num_rows:
                    at = np.cumsum([0, *(len(a) for _, _, a in found)]).astype(np.int32)
                    flat = np.concatenate([np.zeros(0, np.uint32), *(a.astype(np.uint32) for _, _, a in found)]).view(np.int32)
                    argb = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
                    size = [pa.array([x[k] for x in found], pa.int32()) for k in (0, 1)]
                    column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*size, argb], fields=list(image)))
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, i + 1 - first).columns, column], names=names)
                    first, ends, found = i + 1, [0], []

    return media.mapInArrow(run, StructType([*media.schema.fields, StructField("images", IMAGES)]))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Read the stored media back: digests of the payload and of the stored form, and features of the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, n, stored in zip(batch["id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"]):
                stored = stored.as_py()
                data, sizes = decode_samples(stored)
                rows.append((ident, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data, sizes)))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=[f.split()[0] for f in DIGEST.split(", ")])

    return media.mapInArrow(run, DIGEST)
