"""Arithmetic coding in 32-bit integers.

The model is a count for each byte, at least 1, halved together while their sum is above 2^28. The interval narrows to
each symbol's share; equal leading bits are written, and bits held back around the middle are counted and follow the next.
Model as bytes (fixed): 256 counts and their sum, 32 bits each, least significant byte first.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np

from .bits import unpack

TOP, HALF, QUARTER = 2**32 - 1, 2**31, 2**30
MOST = 2**28


def model(counts: list[int]) -> list[int]:
    held = np.maximum(np.array(counts, np.int64), 1)
    while held.sum() > MOST:
        held = np.maximum(held // 2, 1)
    return held.tolist()


def encode(data: bytes, counts: list[int]) -> bytes:
    sums = [0, *accumulate(counts)]
    total, low, high, held, out = sums[-1], 0, TOP, 0, []

    def put(bit: int) -> None:
        nonlocal held
        out.append(str(bit))
        out.append(str(1 - bit) * held)
        held = 0

    for b in data:
        width = high - low + 1
        high = low + width * sums[b + 1] // total - 1
        low = low + width * sums[b] // total
        while True:
            if high < HALF:
                put(0)
            elif low >= HALF:
                put(1)
                low, high = low - HALF, high - HALF
            elif low >= QUARTER and high < 3 * QUARTER:
                held += 1
                low, high = low - QUARTER, high - QUARTER
            else:
                break
            low, high = 2 * low, 2 * high + 1
    if data:
        held += 1
        put(int(low >= QUARTER))
    text = "".join(out)
    size = -(-len(text) // 8)
    return int(text.ljust(size * 8, "0") or "0", 2).to_bytes(size, "big")


def decode(data: bytes, counts: list[int], size: int) -> bytes:
    sums = [0, *accumulate(counts)]
    total, low, high, out = sums[-1], 0, TOP, bytearray()
    bits = unpack(data)
    value, at = int(bits[:32].ljust(32, "0"), 2), 32
    while len(out) < size:
        width = high - low + 1
        b = bisect_right(sums, ((value - low + 1) * total - 1) // width) - 1
        out.append(b)
        high = low + width * sums[b + 1] // total - 1
        low = low + width * sums[b] // total
        while True:
            if high < HALF:
                shift = 0
            elif low >= HALF:
                shift = HALF
            elif low >= QUARTER and high < 3 * QUARTER:
                shift = QUARTER
            else:
                break
            low, high = 2 * (low - shift), 2 * (high - shift) + 1
            value = 2 * (value - shift) + (bits[at : at + 1] == "1")
            at += 1
    return bytes(out)


# Many files at once. low and the width of the interval are kept; all shifts of a step are found together. low goes on without
# its former bits being taken off, and bits held back are left to carries: what is written is the sum of all steps that low
# took, each at its place, cut two bits after the last shift, and 1.

#: Files that are taken step by step in one array; fewer are gone through one by one.
LANES = 16
#: Steps of all files that are prepared together, and steps of one file that are added up together.
CELLS, HELD = 1 << 16, 1 << 16
#: Places of the sums that a table of their symbols may have.
PLACES = 1 << 26
MASK, WORD = HALF - 1, 2**32 - 1
#: Models with sums up to this are reckoned in doubles, others in integers; the results are the same (see ``shares``).
EXACT = 2**18
#: By a double's exponent, which is 1023 more than the place k of the highest bit: the bits below it, and 2^(31 - k).
BELOW = np.array([2 ** min(max(0, k - 1023), 32) - 1 for k in range(1060)], np.int64)
WIDER = np.array([2.0 ** min(31, 1054 - k) for k in range(1060)])
#: Numbers as arrays: a step of few files would take longer to convert them than to use them.
ONE, EXPONENT, SHIFTS, IN_WORD, WORDS, LOWEST = np.array(1.0), np.array(52), np.array(1054), np.array(31), np.array(5), np.array(TOP)
HIGHEST = np.array(32, np.uint64)


def order_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Files from the largest on, their sizes, and the number of steps until too few files are left."""
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    return order, falling, int(falling[LANES - 1]) if len(falling) >= LANES else 0


def blocks(falling: np.ndarray, steps: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of steps: the number of files that have the first step, of those that have all, and the steps."""
    t = 0
    while t < steps:
        m = int(np.searchsorted(-falling, -t, "left"))
        b = min(max(16, CELLS // m), steps - t)
        yield m, int(np.searchsorted(-falling, -(t + b), "right")), np.arange(t, t + b)
        t += b


def tables(models: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums of each of the distinct models, which of them each file has, and the file's total."""
    distinct = {id(counts): counts for counts in models}
    number = {key: k for k, key in enumerate(distinct)}
    sums = np.zeros((len(distinct), 257), np.int64)
    np.cumsum(np.array(list(distinct.values()), np.int64), axis=1, out=sums[:, 1:])
    which = np.array([number[id(counts)] for counts in models], np.int64)
    return sums, which, sums[which, -1]


def shares(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where symbols begin and end, by 257 times the model's number and the symbol; at last a symbol with the whole interval.

    As integers where a total is above EXACT, else as parts of 1 that are greater by 2^-51: a width, at most 2^32, times such
    a part, cut to an integer, is ``width * sum // total``. Three roundings, 2^-53 each at most, don't undo that excess, and
    with it the product is less than 2^-18 too great, while the next integer is 1 / total away at least.
    """
    if sums[:, -1].max() > EXACT:
        both = np.append(sums, (0, 0))
    else:
        both = np.append(sums / sums[:, -1:] * (1 + 2.0**-51), (0.0, 1 + 2.0**-51))
    return both[:-1], both[1:]


def by_totals(models: list[list[int]]) -> list[list[int]]:
    """Places of the files whose models have totals up to EXACT, and of the others."""
    large = {id(counts): sum(counts) > EXACT for counts in models}
    return [[i for i, counts in enumerate(models) if large[id(counts)] == kind] for kind in (False, True)]


class Intervals:
    """low and width of the first m files, narrowed and widened by one step of each at a time, without new arrays."""

    def __init__(self, low: np.ndarray, width: np.ndarray, total: np.ndarray | None):
        self.low, self.width, self.total = low, width, total
        self.cuts, self.spare = np.empty((2, len(low))), np.empty(len(low))
        self.begin, self.end = self.cuts
        self.bits, self.power, self.below = self.spare.view(np.int64), np.empty(len(low), np.int64), np.empty(len(low), np.int64)

    def narrow(self, parts: np.ndarray, step: np.ndarray, by: np.ndarray) -> None:
        """By the shares of the symbols; ``step`` is what low takes, ``by`` the bits by which the interval is widened.

        With v, the width less 1, whose highest bit is p, the interval can be widened until it is at least 2^30 wide, and once
        more if it lies in two adjacent quarters: 31 less the highest place of (low mod p) + v is both together.
        """
        low, width, spare, bits, power, below = self.low, self.width, self.spare, self.bits, self.power, self.below
        if self.total is None:
            np.multiply(width, parts, self.cuts)
            np.floor(self.cuts, self.cuts)
        else:
            np.copyto(self.cuts, width.astype(np.int64) * parts.astype(np.int64) // self.total)
        np.subtract(self.end, self.begin, width)
        np.copyto(step, self.begin, casting="unsafe")
        np.add(low, step, low)
        np.subtract(width, ONE, spare)
        np.right_shift(bits, EXPONENT, power)
        BELOW.take(power, out=below, mode="clip")
        np.bitwise_and(below, low, below)
        np.add(spare, below, spare)
        np.right_shift(bits, EXPONENT, power)
        np.subtract(SHIFTS, power, by)
        np.left_shift(low, by, low)
        WIDER.take(power, out=spare, mode="clip")
        np.multiply(width, spare, width)


def encode_many(files: list[bytes], models: list[list[int]]) -> list[bytes]:
    """``encode`` of each file with its model; files that share a model give the same list."""
    out = [b""] * len(files)
    for some in by_totals(models):
        if some:
            for i, made in zip(some, _encode_many([files[i] for i in some], [models[i] for i in some]), strict=True):
                out[i] = made
    return out


def _encode_many(files: list[bytes], models: list[list[int]]) -> list[bytes]:
    sizes = np.array([len(d) for d in files], np.int64)
    order, falling, steps = order_of(sizes)
    flat = np.frombuffer(b"".join(files), np.uint8)
    sums, which, total = tables(models)
    begins, ends = shares(sums)
    start, which, total = (np.cumsum(sizes) - sizes)[order], which[order], total[order]
    # at most these bits: rounding takes less than half a bit of a symbol's
    least = np.diff(sums)
    lengths = np.log2(sums[:, -1:] / np.maximum(least, 1)) + 0.5
    lengths[least == 0] = np.inf
    words = np.empty(len(files), np.int64)
    for k, (a, n, own) in enumerate(zip(start.tolist(), falling.tolist(), which.tolist(), strict=True)):
        counts = np.bincount(flat[a : a + n], minlength=256)
        there = counts.nonzero()[0]
        bits = float(counts[there] @ lengths[own, there])
        if bits == np.inf:
            raise ValueError("a byte has no share")
        words[k] = int(bits) // 32 + 4
    first = np.cumsum(words) - words
    code = np.zeros(int(words.sum()) + 2, np.int64)

    def add(step: np.ndarray, place: np.ndarray) -> None:
        """Adds each step, 32 bits from its place on, to two words. A column has the steps of a file, in their order."""
        begin = place[0] >> 5
        taken = (place[-1] >> 5) + 2 - begin
        lies = np.cumsum(taken) - taken
        bit, word = (place & 31).ravel(), ((place >> 5) + (lies - begin)).ravel()
        step, size = step.ravel(), int(taken.sum())
        whole = np.bincount(word, step >> bit, size)
        whole[1:] += np.bincount(word, (step << (32 - bit)) & WORD, size)[:-1]
        code[np.repeat(begin - lies, taken) + np.arange(size)] += whole.astype(np.int64)

    low, width, place = np.zeros(len(files), np.int64), np.full(len(files), float(TOP + 1)), first * 32
    for m, whole, t in blocks(falling, steps):
        cell = flat.take(start[:m, None] + t, mode="clip") + 257 * which[:m, None]
        if whole < m:
            cell[whole:][t >= falling[whole:m, None]] = len(begins) - 1
        parts = np.empty((len(t), 2, m))
        parts[:, 0], parts[:, 1] = begins[cell].T, ends[cell].T
        intervals = Intervals(low[:m], width[:m], total[:m] if begins.dtype == np.int64 else None)
        if intervals.total is not None and whole < m:  # the last symbol has all of its file's total
            parts[:, 1] = np.where(cell.T == len(begins) - 1, total[:m], parts[:, 1])
        step, by = np.empty((len(t), m), np.int64), np.empty((len(t) + 1, m), np.int64)
        by[0] = place[:m]
        for one in zip(parts, step, by[1:], strict=True):
            intervals.narrow(*one)
        np.cumsum(by, axis=0, out=by)
        place[:m] = by[-1]
        add(step, by[:-1])
    for k in range(min(LANES, len(files))):
        if falling[k] > steps:
            data, own = files[order[k]], sums[which[k]].tolist()
            for a in range(steps, len(data), HELD):
                low[k], width[k], taken, places = rest(data[a : a + HELD], own, int(low[k]) & MASK, int(width[k]), int(place[k]))
                place[k] = places.pop()
                add(np.array(taken, np.int64)[:, None], np.array(places, np.int64)[:, None])
    out = [b""] * len(files)
    for k, i in enumerate(order.tolist()):
        if not sizes[i]:
            continue
        part = code[first[k] : first[k] + words[k]]
        value = int.from_bytes((part & WORD).astype(">u4").tobytes(), "big") + (int.from_bytes((part >> 32).astype(">u4").tobytes(), "big") << 32)
        bits = int(place[k] - 32 * first[k]) + 2
        size = -(-bits // 8)
        out[i] = (((value >> (32 * int(words[k]) - bits)) + 1) << (8 * size - bits)).to_bytes(size, "big")
    return out


def rest(data: bytes, sums: list[int], low: int, width: int, place: int) -> tuple[int, int, list[int], list[int]]:
    """The same for a file by itself: low and width in the end, the steps and their places, the next place last."""
    total, steps, places = sums[-1], [], [place]
    for b in data:
        step = width * sums[b] // total
        width = width * sums[b + 1] // total - step
        low += step
        v = width - 1
        by = 32 - ((low & ((1 << (v.bit_length() - 1)) - 1)) + v).bit_length()
        low = (low << by) & MASK
        width <<= by
        place += by
        steps.append(step)
        places.append(place)
    return low, width, steps, places


def decode_many(files: list[bytes], models: list[list[int]], sizes: list[int]) -> list[bytes]:
    """``decode`` of each file.

    Damaged files give other bytes of the size asked for, and leave the rest as they are.
    """
    out = [b""] * len(files)
    for some in by_totals(models):
        if some:
            for i, made in zip(some, _decode_many([files[i] for i in some], [models[i] for i in some], [sizes[i] for i in some]), strict=True):
                out[i] = made
    return out


def _decode_many(files: list[bytes], models: list[list[int]], sizes: list[int]) -> list[bytes]:
    """How far the code lies above low is less than the width, whatever the code; a file that has ended may go on with any symbols."""
    size = np.array(sizes, np.int64)
    order, falling, steps = order_of(size)
    sums, which, total = tables(models)
    begins, ends = shares(sums)
    which, total = which[order], total[order]
    # the symbol of each place in the sums of all models, one on top of the other, where these are not too many
    under = np.cumsum(sums[:, -1]) - sums[:, -1]
    known = np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(sums)), np.diff(sums).ravel()) if under[-1] + sums[-1, -1] <= PLACES else None
    edges = (sums[:, :-1] + under[:, None]).ravel()
    under = under[which]
    # 64 bits from every 32nd bit on; zeros follow each file
    longs = [-(-len(d) // 4) + 3 for d in files]
    padded = np.frombuffer(b"".join(d.ljust(4 * n, b"\0") for d, n in zip(files, longs, strict=True)) + bytes(4), ">u4").astype(np.uint64)
    bits = padded[:-1] << np.uint64(32)
    bits |= padded[1:]
    del padded
    first = (np.cumsum(longs) - longs)[order]
    last = first + np.array(longs, np.int64)[order] - 2  # only zeros from there on
    low, width, at = np.zeros(len(files), np.int64), np.full(len(files), float(TOP + 1)), first * 32
    start = (np.cumsum(size) - size)[order]
    out = np.zeros(int(size.sum()), np.uint8)
    for m, whole, t in blocks(falling, steps):
        exact = begins.dtype != np.int64
        intervals = Intervals(low[:m], width[:m], None if exact else total[:m])
        n, model, base, end, place = total[:m] if not exact else total[:m].astype(np.float64), 257 * which[:m], under[:m], last[:m], at[:m]
        before = n - 1
        symbols, parts = np.empty((len(t), m), np.uint8), np.empty((2, m), begins.dtype)
        quotient, step, by, cell, window, over = np.empty(m), *np.empty((3, m), np.int64), np.empty(m, np.uint64), np.empty(m, np.int64)
        shift, code, low_now, first_part, last_part = cell.view(np.uint64), window.view(np.int64), intervals.low, parts[0], parts[1]
        for row in symbols:
            np.right_shift(place, WORDS, cell)
            np.minimum(cell, end, cell)
            bits.take(cell, out=window, mode="clip")
            np.bitwise_and(place, IN_WORD, cell)
            np.left_shift(window, shift, window)
            np.right_shift(window, HIGHEST, window)
            np.subtract(code, low_now, over)
            np.bitwise_and(over, LOWEST, over)
            # (over + 1) * n - 1 has 50 bits at most in doubles, and is too far from the next multiple of the width to be rounded to it
            if exact:
                np.multiply(over, n, quotient)
                np.add(quotient, before, quotient)
                np.divide(quotient, intervals.width, quotient)
                np.copyto(cell, quotient, casting="unsafe")
            else:
                np.floor_divide(over * n + before, intervals.width.astype(np.int64), out=cell)
            np.add(cell, base, cell)
            if known is not None:
                known.take(cell, out=row, mode="clip")
            else:
                np.subtract(np.searchsorted(edges, cell, "right") - 1, 256 * which[:m], out=row, casting="unsafe")
            np.add(model, row, cell)
            begins.take(cell, out=first_part, mode="clip")
            ends.take(cell, out=last_part, mode="clip")
            intervals.narrow(parts, step, by)
            np.add(place, by, place)
        out[start[:whole, None] + t] = symbols[:, :whole].T
        if whole < m:
            there = t < falling[whole:m, None]
            out[(start[whole:m, None] + t)[there]] = symbols[:, whole:].T[there]
    for k in range(min(LANES, len(files))):
        if falling[k] > steps:
            text = rest_decoded(files[order[k]], sums[which[k]].tolist(), int(falling[k]) - steps, int(low[k]) & TOP, int(width[k]), int(at[k] - 32 * first[k]))
            out[start[k] + steps : start[k] + falling[k]] = np.frombuffer(text, np.uint8)
    at = np.cumsum(size) - size
    return [out[a : a + n].tobytes() for a, n in zip(at.tolist(), sizes, strict=True)]


def rest_decoded(data: bytes, sums: list[int], size: int, low: int, width: int, at: int) -> bytes:
    total, out = sums[-1], bytearray()
    while len(out) < size:
        window = int.from_bytes(data[at >> 3 : (at >> 3) + 5].ljust(5, b"\0"), "big") >> (8 - (at & 7))
        over = (window - low) & TOP
        b = bisect_right(sums, ((over + 1) * total - 1) // width) - 1
        out.append(b)
        step = width * sums[b] // total
        width = width * sums[b + 1] // total - step
        low += step
        v = width - 1
        by = 32 - ((low & ((1 << (v.bit_length() - 1)) - 1)) + v).bit_length()
        low = (low << by) & TOP
        width <<= by
        at += by
    return bytes(out)


def write_model(counts: list[int]) -> bytes:
    return struct.pack("<257I", *counts, sum(counts))


def read_model(data: bytes) -> list[int]:
    *counts, total = struct.unpack("<257I", data)
    if sum(counts) != total:
        raise ValueError("the counts of an arithmetic model don't add up")
    return counts
