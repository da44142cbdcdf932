"""Lossless WebP (VP8L): a decoder for the whole format and an encoder that can use all of it.

The decoder reads prefix codes by tables, back-references as runs, the colour cache and grouped codes, and inverts the
predictor (row segments at once), cross-colour, subtract-green and palette transforms. The encoder takes its matches from
zlib and writes all codes of an image at once.

Both are generators that ask for the tokens of a stream of bits and are sent them, or ask for an image in green alone to be written;
``together`` runs many of them, so that streams of like lengths are read side by side and such images are written together.

Pixels are arrays of shape (height, width, 4): red, green, blue, alpha.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Generator, Iterable
from functools import cached_property, lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np

PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: Fixed value: the order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PLACE_OF_LENGTH = {s: i for i, s in enumerate(LENGTH_ORDER)}
LIMIT = 16384  # pixels of a side
#: Short distance codes: the 120 nearest pixels before, by distance, then by column.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


#: Numbers of 15 bits, read from the other end.
REVERSED = np.packbits(np.unpackbits(np.arange(1 << 15, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, :0:-1], axis=1, bitorder="big").view(">u2")[:, 0].astype(int) >> 1


@lru_cache(maxsize=16)
def reversal(bits: int) -> np.ndarray:
    """All numbers of so many bits, read from the other end."""
    return REVERSED[: 1 << bits] >> (15 - bits)


def table_of(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of the longest length's bits the symbol times 16 and the length of its code; symbols are in the order of their codes.
    Where codes are missing, zeros."""
    most = int(lengths[-1])
    table = np.zeros(1 << most, np.int32)
    runs = np.repeat((symbols << 4 | lengths).astype(np.int32), 1 << (most - lengths))
    if len(runs) > len(table):
        raise ValueError("too many codes")
    table[: len(runs)] = runs
    return table[reversal(most)]


def size_of(order: Order) -> int:
    return 1 << order[1][-1] if order[1] else 1


def tables_of(orders: list[Order]) -> np.ndarray:
    """The tables of many codes one after the other, as ``table_of`` makes them; a code without symbols has one zero."""
    counts = np.array([len(symbols) for symbols, _ in orders])
    wide = np.array([size_of(o) for o in orders])
    symbols, lengths = (np.fromiter(chain.from_iterable(o[j] for o in orders), np.int32, counts.sum()) for j in range(2))
    repeats = np.repeat(wide, counts) >> lengths
    upto = np.concatenate([[0], np.cumsum(repeats)])
    ends = np.cumsum(counts)
    left = wide - (upto[ends] - upto[ends - counts])
    if (left < 0).any():
        raise ValueError("too many codes")
    table = np.repeat(np.insert(symbols << 4 | lengths, ends, 0), np.insert(repeats, ends, left))
    first = np.cumsum(wide) - wide
    for n in np.unique(wide).tolist():
        rows = first[wide == n, None] + np.arange(n)
        table[rows] = table[rows[:, reversal(n.bit_length() - 1)]]
    return table


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self) -> int:
        """The next bits, 57 at least; zeros after the end."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)

    def bits(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends too early")
        return value


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n


#: Numbers of 7 bits, read from the other end.
REVERSED_7 = reversal(7).tolist()
Order = tuple[list[int], list[int]]


class Code:
    """A canonical prefix code: ``order``, the symbols in the order of their codes, and the codes' lengths; the reversed ``bits`` of codes in that
    order; ``table`` gives for each run of ``most`` bits the symbol times 16 and the length of its code. A code of one symbol takes no bits."""

    def __init__(self, lengths: dict[int, int]):
        symbols = sorted(sorted(lengths), key=lengths.__getitem__)
        sizes = [lengths[s] for s in symbols]
        self.only = -1
        if len(symbols) == 1:
            self.only, sizes = symbols[0], [0]
        self.most = most = sizes[-1]
        self.order: Order = symbols, sizes
        used = sum([1 << (most - n) for n in sizes])
        if used != 1 << most:
            raise ValueError("too many codes" if used > 1 << most else "not all codes are used")

    @cached_property
    def symbols(self) -> np.ndarray:
        return np.array(self.order[0])

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array(self.order[1])

    @cached_property
    def bits(self) -> np.ndarray:
        wide = 1 << (self.most - self.lengths)
        return REVERSED[(np.cumsum(wide) - wide) >> (self.most - self.lengths)] >> (15 - self.lengths)

    @cached_property
    def entries(self) -> np.ndarray:
        return table_of(self.symbols, self.lengths)

    @cached_property
    def table(self) -> list[int]:
        if self.most > 7:
            return self.entries.tolist()
        table = [0] * (1 << self.most)
        for (s, n), bits in zip(zip(*self.order, strict=True), self.short_bits(), strict=True):
            table[bits :: 1 << n] = [s << 4 | n] * (1 << (self.most - n))
        return table

    def short_bits(self) -> list[int]:
        """``bits`` of a code whose lengths are 7 at most."""
        out, code = [], 0
        for n in self.order[1]:
            out.append(REVERSED_7[code])
            code += 128 >> n
        return out

    def read(self, r: Reader) -> int:
        found = self.table[r.peek() & ((1 << self.most) - 1)]
        r.bits(found & 15)
        return found >> 4


@lru_cache(maxsize=512)
def only(symbol: int) -> Code:
    return Code({symbol: 1})


def read_code(r: Reader, size: int) -> Code:
    if r.bits(1):
        two = r.bits(1)
        symbol = r.bits(8 if r.bits(1) else 1)
        return Code(dict.fromkeys((symbol, r.bits(8)), 1)) if two else only(symbol)
    lengths = {LENGTH_ORDER[i]: n for i in range(4 + r.bits(4)) if (n := r.bits(3))}
    if not lengths:
        raise ValueError("bad code lengths")
    of_lengths = Code(lengths)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else size
    found: dict[int, int] = {}
    table, mask = of_lengths.table, (1 << of_lengths.most) - 1
    word, have = 0, 0
    at, before = 0, 8
    while at < size and left:
        left -= 1
        if have < 14:
            word, have = r.peek(), 56
        s = table[word & mask]
        n = s & 15
        s >>= 4
        word >>= n
        if s < 16:
            if s:
                found[at] = before = s
            at += 1
        else:
            extra = (2, 3, 7)[s - 16]
            run = (3, 3, 11)[s - 16] + (word & ((1 << extra) - 1))
            word >>= extra
            n += extra
            if s == 16:
                found.update(dict.fromkeys(range(at, at + run), before))
            at += run
        have -= n
        r.at += n
    r.bits(0)
    if at > size or not found:
        raise ValueError("bad code lengths")
    return Code(found)


class Stream(NamedTuple):
    """A stream of bits from bit ``at`` on, its codes' symbols and lengths in the order of the codes, and the values of the symbols."""

    data: bytes
    at: int
    green: Order
    places: Order
    sizes: tuple[np.ndarray, np.ndarray]
    fars: tuple[np.ndarray, np.ndarray]
    total: int | None


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, int]


class Greens(NamedTuple):
    """An image whose pixels differ in green alone, to be written with zlib's matches: the green values, the width, and the numbers that all
    pixels have in red, blue and alpha."""

    writer: Writer
    values: np.ndarray
    width: int
    main: bool
    others: tuple[int, int, int]


Asking = Generator["Stream | Greens", "Tokens | None"]


#: Of the prefix symbols of lengths and distances: the least value, and the number of extra bits that are added to it.
PREFIXES = [(s + 1, 0) if s < 4 else (((2 + (s & 1)) << ((s - 2) >> 1)) + 1, (s - 2) >> 1) for s in range(40)]


def slot(argb: int, bits: int) -> int:
    return (0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - bits)


def read_pixels(r: Reader, width: int, height: int, main: bool) -> Asking:
    """ARGB numbers of an entropy-coded image."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_bits, across, groups = 0, 0, None
    if main and r.bits(1):
        group_bits = r.bits(3) + 2
        across = -(-width >> group_bits)
        groups = ((yield from read_pixels(r, across, -(-height >> group_bits), False)) >> np.uint32(8)) & np.uint32(0xFFFF)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(r, n) for n in sizes] for _ in range(int(groups.max()) + 1 if groups is not None else 1)]
    total = width * height
    # Of each group: the table and mask of green, the pixel that a green symbol makes where the other channels have one symbol each,
    # and the codes of the others.
    plain = [[c[3].only << 24 | c[1].only << 16 | s << 8 | c[2].only for s in range(256)] if min(x.only for x in c[1:4]) >= 0 else None for c in codes]
    ready = [(c[0].table, (1 << c[0].most) - 1, p, c) for c, p in zip(codes, plain, strict=True)]
    if groups is None and not cache_bits and plain[0]:
        base = codes[0][3].only << 24 | codes[0][1].only << 16 | codes[0][2].only
        return (yield from read_greens(r, total, width, codes[0])).astype(np.uint32) << np.uint32(8) | np.uint32(base)
    table = groups.tolist() if groups is not None else None
    green, mask, made, group = ready[0]
    data, byte = r.data, r.at + 7 >> 3
    have = 8 * byte - r.at  # bits in ``word``
    word = r.peek() & ((1 << have) - 1)
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    at = cached = 0  # pixels that are out, and in the cache
    while at < total:
        if have < 64:  # a literal takes up to 60 bits, a back-reference 59
            word |= int.from_bytes(data[byte : byte + 16], "little") << have
            byte += 16
            have += 128
        if table:
            green, mask, made, group = ready[table[(at // width >> group_bits) * across + (at % width >> group_bits)]]
        s = green[word & mask]
        n = s & 15
        word >>= n
        have -= n
        s >>= 4
        if s < 256:
            if made:
                out.append(made[s])
            else:
                argb = s << 8
                for code, shift in zip(group[1:4], (16, 0, 24), strict=True):
                    found = code.table[word & ((1 << code.most) - 1)]
                    word >>= found & 15
                    have -= found & 15
                    argb |= found >> 4 << shift
                out.append(argb)
            at += 1
        elif s < 280:
            base, extra = PREFIXES[s - 256]
            n = base + (word & ((1 << extra) - 1))
            word >>= extra
            found = group[4].table[word & ((1 << group[4].most) - 1)]
            word >>= found & 15
            base, more = PREFIXES[found >> 4]
            far = base + (word & ((1 << more) - 1))
            word >>= more
            have -= extra + (found & 15) + more
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            run = out[at - far : at - far + n]
            while len(run) < n:
                run += run[: n - len(run)]
            out += run
            at += n
        else:
            while cached < at:
                cache[slot(out[cached], cache_bits)] = out[cached]
                cached += 1
            out.append(cache[s - 280])
            at += 1
    r.at = 8 * byte - have
    if r.at > 8 * len(data):
        raise ValueError("the image ends too early")
    return np.array(out, np.uint32)


SEGMENT = 1 << 15  # bits whose tokens are read at once


def by_symbol(first: int, values: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Least values and numbers of extra bits by symbol; those before ``first`` are literals, one pixel each."""
    both = np.array([(1, 0)] * first + values, np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


SIZES, FARS = by_symbol(256, PREFIXES[:24]), by_symbol(0, PREFIXES)
SHIFTS = np.arange(8, dtype=np.uint64)


def read_tokens(data: bytes, at: int, green: Order, places: Order, sizes: tuple[np.ndarray, np.ndarray], fars: tuple[np.ndarray, np.ndarray], total: int | None) -> Tokens:
    """Literals and back-references from bit ``at`` on: symbols, pixels, distances (0 for literals), and the bit after them.

    They end with ``total`` pixels or, without it, before symbol 256. In a segment the token that would begin at each bit is looked up, and
    how many bits it takes; those that do begin are found by going from each to the next.
    """
    one = np.uint64(1)
    green, places = tables_of([green]), tables_of([places])
    mask, far_mask = np.uint64(len(green) - 1), np.uint64(len(places) - 1)
    is_match = (green >= 4096).astype(np.uint64)
    head = (green & 15).astype(np.uint64) + sizes[1][green >> 4]
    tail = (places & 15).astype(np.uint64) + fars[1][places >> 4]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    done = 0
    while True:
        byte = at >> 3
        count = min(SEGMENT >> 3, len(data) - byte, SEGMENT if total is None else 8 * (total - done) + 1)  # a token takes up to 59 bits
        if count <= 0:
            raise ValueError("the image ends too early")
        words = np.ndarray(count + 8, "<u8", data[byte : byte + count + 16].ljust(count + 16, b"\0"), strides=(1,))
        word = (words[:count, None] >> SHIFTS).ravel()
        index = (word & mask).astype(np.intp)
        skip = head[index]
        after = tail[(word >> skip & far_mask).astype(np.intp)]
        after *= is_match[index]
        after += skip
        after += np.arange(8 * count, dtype=np.uint64)
        after = after.astype(np.intp)
        to = np.concatenate([after, np.arange(8 * count, 8 * count + 64)])  # what begins after the segment stays there
        far = to[to]
        far = far[far]
        jump, p, end = memoryview(far), at - 8 * byte, 8 * count
        begins: list[int] = []
        begin = begins.append
        while p < end:  # four tokens at once
            begin(p)
            p = jump[p]
        begun = np.empty((len(begins), 4), np.intp)
        begun[:, 0] = begins
        for j in range(3):
            begun[:, j + 1] = to[begun[:, j]]
        begun = begun.ravel()
        begun = begun[begun < end]
        entry = green[index[begun]]
        symbol = entry >> 4
        size = sizes[0][symbol] + (word[begun] >> (entry & 15).astype(np.uint64) & ((one << sizes[1][symbol]) - one))
        size = size.astype(np.int64)
        last = -1
        if total is None:
            stop = np.flatnonzero(symbol == 256)
            if len(stop):
                last = int(stop[0])
                p = int(begun[last] + (entry[last] & 15))
        else:
            upto = np.cumsum(size)
            if upto[-1] >= total - done:
                last = int(np.searchsorted(upto, total - done))
                if upto[last] > total - done:
                    raise ValueError("a back-reference leaves the image")
                p = int(after[begun[last]])
                last += 1
            else:
                done += int(upto[-1])
        if last >= 0:
            begun, symbol, size = begun[:last], symbol[:last], size[:last]
        far = np.zeros(len(symbol), np.int64)
        match = np.flatnonzero(symbol > 255)
        place = begun[match] + skip[begun[match]].astype(np.int64)
        word = words[place >> 3] >> (place & 7).astype(np.uint64)
        entry = places[(word & far_mask).astype(np.intp)]
        far[match] = fars[0][entry >> 4] + (word >> (entry & 15).astype(np.uint64) & ((one << fars[1][entry >> 4]) - one))
        found.append((symbol, size, far))
        at = 8 * byte + p
        if last >= 0:
            return *(np.concatenate(x) for x in zip(*found, strict=True)), at


SIDE_BY_SIDE = 48  # streams, that are worth it
BLOCK = 64  # steps, after which streams that have ended are left out
ENTRIES = 1 << 22  # of the tables of streams that are read side by side


def side_by_side(streams: list[Stream]) -> list[Tokens]:
    """What ``read_tokens`` gives of each stream. All have the same values of symbols; a step goes on by a token in each. The last few
    streams are read to their ends one by one."""
    sizes, fars, whole = streams[0].sizes, streams[0].fars, streams[0].total is not None
    base = np.cumsum([0] + [len(s.data) for s in streams])
    data = b"".join(s.data for s in streams) + bytes(8 * BLOCK + 16)  # a token takes less than 64 bits
    words = np.ndarray(len(data) - 8, "<i8", data, strides=(1,))
    codes = [s.green for s in streams], [s.places for s in streams]
    green, places = map(tables_of, codes)
    mask, far_mask = (np.array([size_of(o) - 1 for o in orders]) for orders in codes)
    first_green, first_place = np.cumsum(mask + 1) - mask - 1, np.cumsum(far_mask + 1) - far_mask - 1
    symbol = green >> 4
    step = (green & 15) + sizes[1][symbol].astype(np.int32)
    match = symbol > 255
    if not whole:  # the end's symbol stays where it is
        step[symbol == 256] = 0
        match &= symbol != 256
    step |= match.astype(np.int32) << 7
    tail = (places & 15) + fars[1][places >> 4].astype(np.int32)
    at = np.array([s.at for s in streams]) + 8 * base[:-1]
    end = 8 * base[1:]
    live = np.arange(len(streams))
    steps: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    while len(live) >= SIDE_BY_SIDE:
        a, g, p, m, n = at[live], first_green[live], first_place[live], mask[live], far_mask[live]
        some = np.empty((BLOCK, len(live)), np.int64)
        for j in range(BLOCK):
            some[j] = a
            word = words[a >> 3]
            word >>= a & 7
            index = word & m
            index += g
            head = step[index]
            size = head & 127
            a += size
            word >>= size
            word &= n
            word += p
            head >>= 7
            head *= tail[word]
            a += head
        steps.append(some.ravel())
        owners.append(np.tile(live, BLOCK))
        at[live] = a
        live = live[(a < end[live]) if whole else (a != some[-1])]
    owner = np.concatenate(owners)
    order = np.argsort(owner.astype(np.uint16), kind="stable")
    owner, begun = owner[order], np.concatenate(steps)[order]
    edges = np.searchsorted(owner, np.arange(len(streams) + 1))
    word = words[begun >> 3] >> (begun & 7)
    entry = green[(word & mask[owner]) + first_green[owner]]
    symbol = entry >> 4
    extra = sizes[1][symbol].astype(np.int64)
    size = sizes[0][symbol].astype(np.int64) + (word >> (entry & 15) & (1 << extra) - 1)
    after = begun + (entry & 15) + extra
    match = np.flatnonzero(symbol > (255 if whole else 256))
    word = words[after[match] >> 3] >> (after[match] & 7)
    entry = places[(word & far_mask[owner[match]]) + first_place[owner[match]]]
    extra = fars[1][entry >> 4].astype(np.int64)
    far = np.zeros(len(begun), np.int64)
    far[match] = fars[0][entry >> 4].astype(np.int64) + (word >> (entry & 15) & (1 << extra) - 1)
    after[match] += (entry & 15) + extra
    # Each stream's tokens up to its last one.
    upto = np.concatenate([[0], np.cumsum(size)])
    done = upto[edges[1:]] - upto[edges[:-1]]
    last = edges[1:].copy()
    ended = np.ones(len(streams), bool)
    ended[live] = False
    if whole:
        totals = np.array([s.total for s in streams])
        if (ended & (done < totals)).any():
            raise ValueError("the image ends too early")
        ended |= done >= totals
        want = upto[edges[:-1]][ended] + totals[ended]
        last[ended] = np.searchsorted(upto, want)
        if (upto[last[ended]] != want).any():
            raise ValueError("a back-reference leaves the image")
        at[ended] = after[last[ended] - 1]
    else:
        stops = np.flatnonzero(symbol == 256)
        last[ended] = stops[np.searchsorted(stops, edges[:-1][ended])]
        at[ended] = after[last[ended]]
    at -= 8 * base[:-1]
    out = []
    for s, a, b, e, whole_stream, n in zip(streams, edges[:-1].tolist(), last.tolist(), at.tolist(), ended.tolist(), done.tolist(), strict=True):
        found = symbol[a:b], size[a:b], far[a:b]
        if not whole_stream:
            *rest, e = read_tokens(s.data, e, *s[2:6], None if s.total is None else s.total - n)
            found = (np.concatenate(x) for x in zip(found, rest, strict=True))
        out.append((*found, e))
    return out


def read_many(streams: list[Stream]) -> list[Tokens]:
    """The tokens of many streams: side by side where there are enough of them, one by one otherwise."""
    out: list[Tokens | None] = [None] * len(streams)
    for kind in (True, False):
        some = [i for i, s in enumerate(streams) if (s.total is None) == kind]
        while some:
            upto = np.cumsum([size_of(streams[i].green) + size_of(streams[i].places) for i in some])
            n = max(1, int(np.searchsorted(upto, ENTRIES, "right")))
            part, some = some[:n], some[n:]
            found = side_by_side([streams[i] for i in part]) if n >= SIDE_BY_SIDE else [read_tokens(*streams[i]) for i in part]
            for i, tokens in zip(part, found, strict=True):
                out[i] = tokens
    return out


def together(jobs: Iterable[Asking]) -> list:
    """What generators that ask for tokens, or for images to be written, return."""
    jobs = [*jobs]
    out: list = [None] * len(jobs)
    answers: dict[int, Tokens | None] = dict.fromkeys(range(len(jobs)))
    while answers:
        asked: dict[int, Stream | Greens] = {}
        for i, tokens in answers.items():
            try:
                asked[i] = jobs[i].send(tokens)
            except StopIteration as end:
                out[i] = end.value
        images = {i: x for i, x in asked.items() if isinstance(x, Greens)}
        streams = {i: x for i, x in asked.items() if i not in images}
        if images:
            write_greens([*images.values()])
        answers = dict.fromkeys(images) | dict(zip(streams, read_many([*streams.values()]), strict=True))
    return out


@lru_cache(maxsize=64)
def near_distances(width: int) -> np.ndarray:
    """The distances of short codes, in the codes' order from 1 on."""
    return np.array([0] + [max(1, x + y * width) for x, y in NEAR])


def read_greens(r: Reader, total: int, width: int, group: list[Code]) -> Asking:
    """The green values of an image in which no other channel takes bits: one group, no cache."""
    if group[0].only >= 256:
        raise ValueError("a back-reference leaves the image")
    if group[0].only >= 0:
        return np.full(total, group[0].only, np.uint8)
    symbol, size, far, at = yield Stream(r.data, r.at, group[0].order, group[4].order, SIZES, FARS, total)
    if at > 8 * len(r.data):
        raise ValueError("the image ends too early")
    r.at = at
    match = np.flatnonzero(symbol > 255)
    pixels = symbol.astype(np.uint8)
    if not len(match):
        return pixels
    start = (np.cumsum(size) - size)[match]
    far, n = far[match], size[match]
    far = np.where(far > 120, far - 120, near_distances(width)[np.minimum(far, 120)])
    if (far > start).any():
        raise ValueError("a back-reference leaves the image")
    out = bytearray(np.repeat(pixels, size))
    for p, n, far in zip(start.tolist(), n.tolist(), far.tolist(), strict=True):
        if far >= n:
            out[p : p + n] = out[p - far : p - far + n]
        else:
            out[p : p + n] = (out[p - far : p] * (n // far + 1))[:n]
    return np.frombuffer(out, np.uint8)


def channels(argb: np.ndarray) -> np.ndarray:
    """(…, 4) bytes in the order red, green, blue, alpha."""
    return argb.astype("<u4")[..., None].view(np.uint8)[..., [2, 1, 0, 3]]


def numbers(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels[..., [2, 1, 0, 3]]).view("<u4")[..., 0]


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, left, top, corner, after) -> np.ndarray:
    """The prediction from four neighbours, arrays of 32-bit channels."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255], np.int32), top.shape)
    if mode < 5:
        return (left, top, after, corner)[mode - 1]
    if mode < 10:
        return average(*((average(left, after), top), (left, corner), (left, top), (corner, top), (top, after))[mode - 5])
    if mode == 10:
        return average(average(left, corner), average(top, after))
    if mode == 11:
        by_left, by_top = np.abs(top - corner).sum(-1), np.abs(left - corner).sum(-1)
        return np.where((by_left < by_top)[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean, gap = average(left, top), average(left, top) - corner
    return np.clip(mean + np.sign(gap) * (np.abs(gap) >> 1), 0, 255)


ABOVE = {0, 2, 3, 4, 8, 9}  # modes that read the row above alone


def neighbours(full: np.ndarray, y: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Above, above left and above right of columns a to b - 1 in row y; right of a row's end is the row's own first pixel."""
    after = full[y - 1, a + 1 : b + 1]
    if len(after) < b - a:
        after = np.concatenate([after, full[y, :1]])
    return full[y - 1, a:b], full[y - 1, a - 1 : b - 1], after


def predictor(pixels: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Adds the predictions to residuals, or takes them from pixels (``forward``), a segment of a row at a time."""
    height, width = pixels.shape[:2]
    given = pixels.astype(np.int32)
    out = np.zeros_like(given)
    full = given if forward else out
    sign = -1 if forward else 1
    black = np.array([0, 0, 0, 255], np.int32)
    first = np.concatenate([black[None], given[0, :-1]]) if forward else None
    out[0] = (given[0] - first) & 255 if forward else (np.cumsum(given[0], 0) + black) & 255
    sides = [max(1, x << bits) for x in range(modes.shape[1])] + [width]
    for y in range(1, height):
        out[y, 0] = (given[y, 0] + sign * full[y - 1, 0]) & 255
        for tile, a, b in zip(modes[y >> bits].tolist(), sides[:-1], sides[1:], strict=True):
            if a >= b:
                continue
            if forward or tile in ABOVE or tile > 13:
                top, corner, after = neighbours(full, y, a, b)
                left = full[y, a - 1 : b - 1]
                out[y, a:b] = (given[y, a:b] + sign * predicted(tile, left, top, corner, after)) & 255
            elif tile == 1:
                out[y, a:b] = (np.cumsum(given[y, a:b], 0) + out[y, a - 1]) & 255
            else:
                for x in range(a, b):
                    out[y, x] = (given[y, x] + predicted(tile, out[y, x - 1], *(v[0] for v in neighbours(out, y, x, x + 1)))) & 255
    return out.astype(np.uint8)


def cross(pixels: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Cross-colour: red and blue are told from green, blue from red as well."""
    height, width = pixels.shape[:2]
    spread = np.repeat(np.repeat(elements, 1 << bits, 0), 1 << bits, 1)[:height, :width].view(np.int8).astype(np.int32)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    red, green, blue = (pixels[..., j].astype(np.int32) for j in range(3))
    sign = -1 if forward else 1
    new_red = (red + sign * ((spread[..., 2] * signed(green)) >> 5)) & 255
    true_red = red if forward else new_red
    new_blue = (blue + sign * (((spread[..., 1] * signed(green)) >> 5) + ((spread[..., 0] * signed(true_red)) >> 5))) & 255
    return np.stack([new_red, green, new_blue, pixels[..., 3]], -1).astype(np.uint8)


def subtract_green(pixels: np.ndarray, forward: bool) -> np.ndarray:
    out = pixels.copy()
    for j in (0, 2):
        out[..., j] = out[..., j] - out[..., 1] if forward else out[..., j] + out[..., 1]
    return out


def bundle(colours: int) -> int:
    """log2 of the palette indices that share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decoding(data: bytes) -> Asking:
    """The pixels of a WebP file with a lossless image."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    r = Reader(data[20 : 20 + size])
    if r.bits(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    steps: list[tuple] = []
    across = width
    while r.bits(1):
        kind = r.bits(2)
        if kind in [s[0] for s in steps]:
            raise ValueError("a transform is repeated")
        if kind == PALETTE:
            n = r.bits(8) + 1
            deltas = channels((yield from read_pixels(r, n, 1, False)))
            steps.append((kind, np.cumsum(deltas, axis=0, dtype=np.uint8), across))
            across = -(-across >> bundle(n))
        elif kind == GREEN:
            steps.append((kind,))
        else:
            bits = r.bits(3) + 2
            shape = -(-height >> bits), -(-across >> bits)
            steps.append((kind, channels((yield from read_pixels(r, shape[1], shape[0], False))).reshape(*shape, 4), bits))
    pixels = channels((yield from read_pixels(r, across, height, True))).reshape(height, across, 4)
    for kind, *more in reversed(steps):
        if kind == PREDICTOR:
            pixels = predictor(pixels, more[0][..., 1], more[1], False)
        elif kind == CROSS:
            pixels = cross(pixels, more[0], more[1], False)
        elif kind == GREEN:
            pixels = subtract_green(pixels, False)
        else:
            colours, wide = more
            packed = bundle(len(colours))
            n = 8 >> packed
            shifts = np.arange(0, 8, n) if packed else np.zeros(1, int)
            index = (pixels[..., 1][..., None] >> shifts & ((1 << n) - 1)).reshape(height, -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)
            table[: len(colours)] = colours
            pixels = table[index]
    return pixels


def decode(data: bytes) -> np.ndarray:
    return together([decoding(data)])[0]


# Encoding

NEVER = 1 << 62  # more than all counts


def depths(counts: list[int], most: int) -> list[int]:
    """Huffman code lengths of ascending counts; rare symbols count as more where a length would be above ``most``."""
    leaves = len(counts)
    if leaves == 1:
        return [1]
    floor = 1
    while True:
        # Sums come in ascending order, so the two least are at the head of the symbols or of the sums.
        weights = [max(n, floor) for n in counts] if floor > 1 else [*counts]
        weights.append(NEVER)
        sums = [NEVER] * leaves
        parent = [0] * (2 * leaves - 1)
        leaf = inner = 0
        for new in range(leaves - 1):
            if weights[leaf] <= sums[inner]:
                total = weights[leaf]
                parent[leaf] = leaves + new
                leaf += 1
            else:
                total = sums[inner]
                parent[leaves + inner] = leaves + new
                inner += 1
            if weights[leaf] <= sums[inner]:
                total += weights[leaf]
                parent[leaf] = leaves + new
                leaf += 1
            else:
                total += sums[inner]
                parent[leaves + inner] = leaves + new
                inner += 1
            sums[new] = total
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        del depth[leaves:]
        if max(depth) <= most:
            return depth
        floor *= 2


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Huffman code lengths of symbols."""
    symbols = sorted(counts, key=counts.__getitem__)
    return dict(zip(symbols, depths([counts[s] for s in symbols], most), strict=True))


def write_code(w: Writer, lengths: dict[int, int], size: int) -> Code:
    symbols = sorted(lengths)
    code = only(symbols[0]) if len(symbols) == 1 else Code(lengths)
    if len(symbols) <= 2 and symbols[-1] < 256 and set(lengths.values()) == {1}:
        w.bits(1, 1)
        w.bits(len(symbols) - 1, 1)
        w.bits(int(symbols[0] > 1), 1)
        w.bits(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            w.bits(symbols[1], 8)
        return code
    runs: list[list[int]] = []  # a length, and how many symbols in a row have it
    at, before = 0, -1
    for s in symbols:
        if s > at:
            runs.append([0, s - at])
            before = 0
        n = lengths[s]
        if n == before:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
            before = n
        at = s + 1
    if at < size:
        runs.append([0, size - at])
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    for n, run in runs:
        if n:
            tokens.append((n, 0, 0))
            run -= 1
        while run:
            if n and run >= 3:
                step = min(run, 6)
                tokens.append((16, step - 3, 2))
            elif not n and run >= 11:
                step = min(run, 138)
                tokens.append((18, step - 11, 7))
            elif not n and run >= 3:
                step = min(run, 10)
                tokens.append((17, step - 3, 3))
            else:
                step = 1
                tokens.append((n, 0, 0))
            run -= step
    counts: dict[int, int] = {}
    for s, _, _ in tokens:
        counts[s] = counts.get(s, 0) + 1
    own = code_lengths(counts, 7)
    w.bits(0, 1)
    n = max(4, 1 + max([PLACE_OF_LENGTH[s] for s in own]))
    w.bits(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        w.bits(own.get(s, 0), 3)
    w.bits(0, 1)
    own_code = Code(own)
    codes = dict(zip(own_code.order[0], zip(own_code.short_bits(), own_code.order[1], strict=True), strict=True))
    value = at = 0
    for s, extra, bits in tokens:
        own_bits, n = codes[s]
        value |= (own_bits | extra << n) << at
        at += n + bits
    w.bits(value, at)
    return code


def find_prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = values.astype(np.int64) - 1
    high = np.maximum(np.frexp(v.astype(float))[1] - 1, 1)
    few = v < 4
    symbol = np.where(few, v, 2 * high + (v >> (high - 1) & 1))
    return symbol, np.where(few, 0, v & ((1 << (high - 1)) - 1)), np.where(few, 0, high - 1)


FOUND = find_prefixes(np.maximum(np.arange(1 << 16), 1))


def prefixes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix symbols, extra bits and their numbers of lengths or distances."""
    if len(values) and values.max() >= len(FOUND[0]):
        return find_prefixes(values)
    return tuple(x[values] for x in FOUND)


def short_order(lengths: dict[int, int]) -> Order:
    """The symbols and lengths of a deflate code, in the order of the codes. Unlike here, a code of one symbol takes a bit there."""
    symbols = sorted(sorted(lengths), key=lengths.__getitem__)
    return symbols, [lengths[s] for s in symbols]


def short_table(order: Order) -> list[int]:
    """The table of a deflate code whose lengths are 7 at most."""
    most = order[1][-1]
    table, code = [0] * (1 << most), 0
    for s, n in zip(*order, strict=True):
        table[REVERSED_7[code] :: 1 << n] = [s << 4 | n] * (1 << (most - n))
        code += 128 >> n
    return table


#: Fixed values of the deflate format: the order of its code lengths' lengths, and the codes of its fixed blocks.
DEFLATE_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
FIXED_LENGTHS = {s: 8 if s < 144 else 9 if s < 256 else 7 if s < 280 else 8 for s in range(288)}, dict.fromkeys(range(30), 5)
#: Least values and extra bits of its lengths (of symbols from 257 on) and distances.
LENGTHS = [(s + 3, 0) if s < 8 else (((4 + (s & 3)) << ((s - 4) >> 2)) + 3, (s - 4) >> 2) for s in range(28)] + [(258, 0)]
FIXED = tuple(short_order(lengths) for lengths in FIXED_LENGTHS)
DEFLATE_SIZES, DEFLATE_FARS = by_symbol(257, LENGTHS + [(0, 0)] * 2), by_symbol(0, PREFIXES)


def parsing(raw: bytes) -> Generator[Stream, Tokens]:
    """The tokens that zlib makes of a sequence of bytes, read from its output: symbols, pixels and distances of its blocks."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15, 9)
    r = Reader(packer.compress(raw) + packer.flush())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = last = 0
    while not last:
        last, kind = r.bits(1), r.bits(2)
        if kind == 0:
            r.at = -(-r.at // 8) * 8
            n = r.bits(16)
            r.bits(16)
            r.at += 8 * n
            found.append((np.frombuffer(raw[at : at + n], np.uint8).astype(np.int32), np.ones(n, np.int64), np.zeros(n, np.int64)))
            at += n
            continue
        orders = FIXED
        if kind == 2:
            n_long, n_far, n_own = r.bits(5) + 257, r.bits(5) + 1, r.bits(4) + 4
            word = r.peek()
            table = short_table(short_order({DEFLATE_ORDER[i]: n for i in range(n_own) if (n := word >> 3 * i & 7)}))
            r.at += 3 * n_own
            mask = len(table) - 1
            both: list[int] = []
            word = have = 0
            while len(both) < n_long + n_far:
                if have < 14:
                    word, have = r.peek(), 56
                s = table[word & mask]
                n = s & 15
                s >>= 4
                if s < 16:
                    both.append(s)
                else:
                    extra = (2, 3, 7)[s - 16]
                    both += [both[-1] if s == 16 else 0] * ((3, 3, 11)[s - 16] + (word >> n & ((1 << extra) - 1)))
                    n += extra
                word >>= n
                have -= n
                r.at += n
            orders = tuple(short_order({s: n for s, n in enumerate(part) if n}) for part in (both[:n_long], both[n_long:]))
        *tokens, r.at = yield Stream(r.data, r.at, *orders, DEFLATE_SIZES, DEFLATE_FARS, None)
        found.append(tuple(tokens))
        at += int(tokens[1].sum())
    return found


def matches(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows of start, length and distance: the matches among the tokens of a sequence."""
    symbol, size, far = (np.concatenate(x) for x in zip(*blocks, strict=True))
    return np.column_stack([np.cumsum(size) - size, size, far])[symbol > 256]


def parse(raw: bytes) -> np.ndarray:
    """The matches that zlib takes."""
    return matches(together([parsing(raw)])[0])


def packed_words(values: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers of up to 63 bits at ascending bits, in words of 64, the first bit lowest."""
    word, shift = start >> 6, start & 63
    out = np.zeros((int(start[-1] + sizes[-1]) >> 6) + 2, np.uint64)
    first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    # What a number has beyond its first word.
    over = np.flatnonzero(shift + sizes > 64)
    shift = shift.astype(np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out


def packed_bits(values: np.ndarray, sizes: np.ndarray) -> int:
    """Numbers of up to 63 bits one after the other, the first one lowest."""
    return int.from_bytes(packed_words(values, sizes, np.cumsum(sizes) - sizes).astype("<u8").tobytes(), "little")


def cache_slots(values: np.ndarray, cache_bits: int) -> np.ndarray:
    """The slot of each pixel that is in the cache when its turn comes, -1 for the others."""
    slots = ((np.uint32(0x1E35A7BD) * values.astype(np.uint32)) >> np.uint32(32 - cache_bits)).astype(np.int64)
    order = np.argsort(slots, kind="stable")
    alike = (slots[order[1:]] == slots[order[:-1]]) & (values[order[1:]] == values[order[:-1]])
    out = np.full(len(values), -1)
    hit = order[1:][alike]
    out[hit] = slots[hit]
    return out


@lru_cache(maxsize=64)
def near_codes(width: int) -> np.ndarray:
    """The codes of distances that are less than the array's length."""
    codes = np.arange(8 * width + 9) + 120
    for i, (x, y) in reversed([*enumerate(NEAR)]):
        if x + y * width > 0:
            codes[x + y * width] = i + 1
    return codes


def sorted_codes(owner: np.ndarray, symbols: np.ndarray, owners: int, many: int) -> tuple[list[dict[int, int]], np.ndarray, np.ndarray]:
    """Of each owner's symbols the Huffman code lengths, and for all ``many`` symbols of each the reversed codes and their lengths, by places
    owner * many + symbol."""
    tally = np.bincount(owner * many + symbols, minlength=owners * many).reshape(owners, many)
    order = np.argsort(tally, axis=1, kind="stable")
    some = np.count_nonzero(tally, axis=1)
    ascending = np.take_along_axis(tally, order, 1)
    found = []
    for by_count, counts, n in zip(order, ascending, some.tolist(), strict=True):
        found.append(dict(zip(by_count[many - n :].tolist(), depths(counts[many - n :].tolist(), 15), strict=True)) if n else {0: 1})
    lengths = np.zeros(owners * many, np.int64)
    known = np.arange(many) >= many - some[:, None]
    lengths[(order + np.arange(owners)[:, None] * many)[known]] = np.fromiter(chain.from_iterable(f.values() for f, n in zip(found, some.tolist(), strict=True) if n), np.int64, some.sum())
    lengths = lengths.reshape(owners, many)
    lengths[some < 2] = 0
    order = np.argsort(np.where(lengths, lengths, 16), axis=1, kind="stable")
    ascending = np.take_along_axis(lengths, order, 1)
    wide = np.where(ascending, 1 << (15 - ascending), 0)
    bits = np.empty_like(lengths)
    np.put_along_axis(bits, order, REVERSED[(np.cumsum(wide, axis=1) - wide) & 0x7FFF], 1)
    return found, bits.ravel().astype(np.uint64), lengths.ravel()


def write_greens(images: list[Greens]) -> None:
    """Writes images with the tokens that zlib makes of their green values; all at once but for the codes' lengths."""
    owners = np.arange(len(images))
    blocks = together(parsing(image.values.tobytes()) for image in images)
    owner = np.repeat(owners, [sum(len(b[0]) for b in some) for some in blocks])
    symbol, size, far = (np.concatenate(x) for x in zip(*chain.from_iterable(blocks), strict=True))
    match = np.flatnonzero(symbol > 255)
    size, far, matched = size[match], far[match], owner[match]
    coded = far + 120
    widths = np.array([image.width for image in images])
    for width in np.unique(widths).tolist():
        near = near_codes(width)
        some = np.flatnonzero((widths[matched] == width) & (far < len(near)))
        coded[some] = near[far[some]]
    (size, size_extra, size_bits), (place, place_extra, place_bits) = prefixes_of(size), prefixes_of(coded)
    symbol[match] = 256 + size
    greens, green_bits, green_sizes = sorted_codes(owner, symbol, len(images), 280)
    places, far_bits, far_sizes = sorted_codes(matched, place, len(images), 40)
    at = owner * 280 + symbol
    bits, wide = green_bits[at], green_sizes[at]
    at = matched * 40 + place
    b, n = bits[match], wide[match]
    for more, more_n in ((size_extra, size_bits), (far_bits[at], far_sizes[at]), (place_extra, place_bits)):
        b |= more.astype(np.uint64) << n.astype(np.uint64)
        n += more_n
    bits[match], wide[match] = b, n
    # Each image's tokens begin at a word.
    upto = np.concatenate([[0], np.cumsum(wide)])
    edges = np.searchsorted(owner, np.arange(len(images) + 1))
    total = np.diff(upto[edges])
    words = np.concatenate([[0], np.cumsum(-(-total // 64))])
    data = memoryview(packed_words(bits, wide, upto[:-1] + (64 * words[:-1] - upto[edges[:-1]])[owner]).astype("<u8").tobytes())
    for image, green, far, a, b, n in zip(images, greens, places, (8 * words[:-1]).tolist(), (8 * words[1:]).tolist(), total.tolist(), strict=True):
        w = image.writer
        w.bits(0, 2 if image.main else 1)  # no cache, one group
        write_code(w, green, 280)
        for s in image.others:
            write_code(w, {s: 1}, 256)
        write_code(w, far, 40)
        w.bits(int.from_bytes(data[a:b], "little"), n)


def write_pixels(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False) -> Asking:
    """An image with Huffman codes, zlib's matches as back-references (in images of up to 256 different pixels, or with one channel), and
    cache codes for what else is in the cache."""
    values = argb.ravel()
    plain = not ((values ^ values[0]) & np.uint32(0xFFFF00FF)).any()  # pixels differ in green alone
    if plain and references and not cache_bits:
        first = int(values[0])
        yield Greens(w, (values >> np.uint32(8)).astype(np.uint8), width, main, (first >> 16 & 255, first & 255, first >> 24))
        return
    values = values.astype(np.uint64)
    starts = lengths = far = np.zeros(0, np.int64)
    if references:
        rank = values >> np.uint64(8) if plain else np.unique(values, return_inverse=True)[1]
        if rank.max() < 256 or plain:
            blocks = yield from parsing(rank.astype(np.uint8).tobytes())
            starts, lengths, far = matches(blocks).T
    at = np.arange(len(values))
    if len(starts):
        edge = np.zeros(len(values) + 1, np.int64)
        edge[starts + 1] += 1
        edge[starts + lengths] -= 1
        at = np.flatnonzero(np.cumsum(edge[:-1]) == 0)  # pixels where a token begins
    v = values[at]
    match = np.zeros(len(values), bool)
    match[starts] = True
    match = match[at]
    green = (v >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    literal = ~match
    if cache_bits:
        slots = cache_slots(values, cache_bits)[at]
        cached = literal & (slots >= 0)
        green[cached] = 280 + slots[cached]
        literal &= ~cached
    near = near_codes(width)
    coded = np.where(far < len(near), near[np.minimum(far, len(near) - 1)], far + 120)
    (size, size_extra, size_bits), (place, place_extra, place_bits) = prefixes_of(lengths), prefixes_of(coded)
    green[match] = 256 + size
    rest = [(v[:1] if plain else v) >> np.uint64(s) & np.uint64(255) for s in (16, 0, 24)]
    rest = [c.astype(np.int64) for c in rest]
    used = [green, *(rest if plain else (c[literal] for c in rest)), place]
    w.bits(int(cache_bits > 0), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if main:
        w.bits(0, 1)
    tables = []
    for s, n in zip(used, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), strict=True):
        counts = np.bincount(s, minlength=1)
        some = np.flatnonzero(counts)
        table = np.zeros((2, n), np.uint64)
        if len(some) > 1:
            code = write_code(w, code_lengths(dict(zip(some.tolist(), counts[some].tolist(), strict=True))), n)
            table[:, code.symbols] = code.bits, code.lengths
        else:
            write_code(w, {int(some[0]) if len(some) else 0: 1}, n)
        tables.append(table)
    bits, wide = tables[0][0][green], tables[0][1][green]
    for table, channel in zip(tables[1:4], rest, strict=True):
        if table[1].any():
            bits = bits | np.where(literal, table[0][channel], np.uint64(0)) << wide
            wide = wide + np.where(literal, table[1][channel], np.uint64(0))
    if len(starts):
        b, n = bits[match], wide[match]
        for more, more_n in ((size_extra, size_bits), (tables[4][0][place], tables[4][1][place]), (place_extra, place_bits)):
            b, n = b | more.astype(np.uint64) << n, n + more_n.astype(np.uint64)
        bits[match], wide[match] = b, n
    wide = wide.astype(np.int64)
    w.bits(packed_bits(bits, wide), int(wide.sum()))


def container(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def header(w: Writer, width: int, height: int, alpha: bool) -> None:
    w.bits(0x2F, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(int(alpha), 1)
    w.bits(0, 3)


def encoding_with(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = True, modes: np.ndarray | None = None, elements: np.ndarray | None = None, bits: int = 2) -> Asking:
    """A file with Huffman codes and the given transforms, in their order. ``modes`` and ``elements`` are what the predictor and
    cross-colour transforms use for each block of 2**bits pixels a side (default: the top pixel, and no change)."""
    height, width = pixels.shape[:2]
    w = Writer()
    header(w, width, height, bool((pixels[..., 3] < 255).any()))
    across = width
    for kind in transforms:
        w.bits(1, 1)
        w.bits(kind, 2)
        shape = -(-height >> bits), -(-across >> bits)
        if kind == PREDICTOR:
            modes = np.full(shape, 2, np.uint8) if modes is None else modes
            w.bits(bits - 2, 3)
            data = np.zeros((*shape, 4), np.uint8)
            data[..., 1], data[..., 3] = modes, 255
            yield from write_pixels(w, numbers(data), shape[1], False)
            pixels = predictor(pixels, modes, bits, True)
        elif kind == CROSS:
            elements = np.zeros((*shape, 4), np.uint8) if elements is None else elements
            w.bits(bits - 2, 3)
            yield from write_pixels(w, numbers(elements), shape[1], False)
            pixels = cross(pixels, elements, bits, True)
        elif kind == GREEN:
            pixels = subtract_green(pixels, True)
        else:
            colours, index = np.unique(numbers(pixels), return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            w.bits(len(colours) - 1, 8)
            table = channels(colours)
            yield from write_pixels(w, numbers(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(colours), False)
            packed = bundle(len(colours))
            n = 8 >> packed
            index = index.reshape(height, across).astype(np.uint8)
            across_new = -(-across >> packed)
            index = np.pad(index, ((0, 0), (0, (across_new << packed) - across))).reshape(height, across_new, 1 << packed)
            pixels = np.zeros((height, across_new, 4), np.uint8)
            pixels[..., 3] = 255
            for j in range(1 << packed):
                pixels[..., 1] |= index[..., j] << (j * n) if packed else index[..., j]
            across = across_new
    w.bits(0, 1)
    yield from write_pixels(w, numbers(pixels), across, True, cache_bits, references)
    return container(w.value.to_bytes((w.at + 7) // 8, "little"))


def encode_with(pixels: np.ndarray, *more, **options) -> bytes:
    return together([encoding_with(pixels, *more, **options)])[0]


TILE = 4  # log2 of the pixels of a predictor block's side


def alike(samples: np.ndarray) -> np.ndarray:
    """Predictor modes of a grey image's blocks: left or top where most of a block's samples equal that neighbour, else none."""
    height, width = samples.shape
    left, top = np.zeros(samples.shape, bool), np.zeros(samples.shape, bool)
    left[:, 1:] = samples[:, 1:] == samples[:, :-1]
    top[1:] = samples[1:] == samples[:-1]
    rows, columns = np.arange(0, height, 1 << TILE), np.arange(0, width, 1 << TILE)
    share = lambda hit: np.add.reduceat(np.add.reduceat(hit.astype(float), rows, 0), columns, 1)
    a, b, whole = share(left), share(top), share(np.ones_like(left))
    return np.where(2 * np.maximum(a, b) < whole, 0, np.where(a >= b, 1, 2)).astype(np.uint8)


def encoding(samples: np.ndarray) -> Asking:
    """The shortest of a few files of the grey image (height, width) of 8-bit samples, with Huffman codes and back-references.

    Up to 16 different samples make a palette, whose indices share pixels; other images subtract green. Where most samples of a
    quarter of the blocks equal their left or top neighbours, a file with the predictor is tried as well. A colour cache and cross-colour never
    shorten a grey image: its pixels have one channel left, whose literals cost as much as cache codes, and green is all of it.
    """
    pixels = np.repeat(samples[..., None], 4, 2)
    pixels[..., 3] = 255
    few = len(np.flatnonzero(np.bincount(samples.ravel(), minlength=256))) <= 16
    found = [(yield from encoding_with(pixels, (PALETTE,) if few else (GREEN,)))]
    modes = alike(samples)
    if modes.astype(bool).mean() >= 0.25:
        found.append((yield from encoding_with(pixels, (PREDICTOR, GREEN), modes=modes, bits=TILE)))
    return min(found, key=len)


def encode(samples: np.ndarray) -> bytes:
    return together([encoding(samples)])[0]
