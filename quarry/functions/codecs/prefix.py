"""Prefix codes: Huffman and Shannon-Fano, with their models as bytes.

Huffman: symbols queue in byte order, the two least go first, ties in order of arrival; the first is the left branch, bit
0. One symbol alone gets the code 0. Shannon-Fano: symbols by falling count, then value; a group is cut after the first
symbols whose counts reach half of its total, with one symbol on each side at least. One symbol alone gets an empty code,
which can't be counted back, so that such data are not encodable.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np

from .bits import unpack

Tree = int | tuple["Tree", "Tree"]


def huffman_tree(counts: list[int]) -> Tree:
    order = itertools.count()
    queue = sorted((n, next(order), s) for s, n in enumerate(counts) if n)
    if not queue:
        raise ValueError("there is nothing to build a code from")
    while len(queue) > 1:
        (n, _, a), (m, _, b) = queue[:2]
        del queue[:2]
        bisect.insort(queue, (n + m, next(order), (a, b)), key=lambda x: x[:2])
    return queue[0][2]


def codes_of(tree: Tree) -> dict[int, str]:
    if isinstance(tree, int):
        return {tree: "0"}
    out, rest = {}, [(tree, "")]
    while rest:
        node, code = rest.pop()
        if isinstance(node, int):
            out[node] = code
        else:
            rest += [(node[1], code + "1"), (node[0], code + "0")]
    return out


def huffman_codes(counts: list[int]) -> dict[int, str]:
    return codes_of(huffman_tree(counts))


def shannon_codes(counts: list[int]) -> dict[int, str]:
    symbols = sorted((s for s, n in enumerate(counts) if n), key=lambda s: (-counts[s], s))
    out, rest = dict.fromkeys(symbols, ""), [symbols]
    while rest:
        group = rest.pop()
        if len(group) < 2:
            continue
        sums = list(itertools.accumulate(counts[s] for s in group))
        cut = min(max(bisect.bisect_left(sums, sums[-1] // 2) + 1, 1), len(group) - 1)
        for part, bit in ((group[:cut], "0"), (group[cut:], "1")):
            for s in part:
                out[s] += bit
            rest.append(part)
    return out


def size(counts: list[int], codes: dict[int, str]) -> int:
    """Bytes that data with these counts take."""
    return -(-sum(counts[s] * len(c) for s, c in codes.items()) // 8)


#: Bytes that are coded at once, and the longest codes that are read by a table of all windows of bits.
AT_ONCE, WINDOW = 1 << 16, 16


def encode(data: bytes, codes: dict[int, str]) -> bytes:
    if data and not all(codes.get(b) for b in set(data)):
        raise ValueError("a byte has no code")
    longest = max(map(len, codes.values()), default=0)
    bits, length = np.zeros((256, longest), np.uint8), np.zeros(256, np.int64)
    for s, c in codes.items():
        length[s] = len(c)
        bits[s, : len(c)] = np.frombuffer(c.encode(), np.uint8) - ord("0")
    out, places = [], np.arange(longest)
    for k in range(0, len(data), AT_ONCE):
        part = np.frombuffer(data, np.uint8, min(AT_ONCE, len(data) - k), k)
        out.append(bits[part][places < length[part][:, None]])
    return np.packbits(np.concatenate(out)).tobytes() if out else b""


def decode(data: bytes, codes: dict[int, str], size: int) -> bytes:
    """The first ``size`` symbols. With the code at every place of the bits known from a table, symbols are read by going from code to code."""
    longest = max(map(len, codes.values()), default=0)
    if longest > WINDOW or not longest:
        return decode_by_bits(data, codes, size)
    length, symbol = np.zeros(1 << longest, np.uint8), np.zeros(1 << longest, np.uint8)
    for s, c in codes.items():
        if c:
            first = int(c, 2) << (longest - len(c))
            length[first : first + (1 << (longest - len(c)))] = len(c)
            symbol[first : first + (1 << (longest - len(c)))] = s
    out, left, begin = [], size, 0
    while left:  # stretches of bits, each with the longest code's bits after it
        low = begin // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, max(0, min(AT_ONCE, len(data) - low)), low))
        n = len(bits)
        window = np.zeros(n, np.int64)
        padded = np.concatenate([bits, np.zeros(longest, np.uint8)])
        for k in range(longest):
            window = (window << 1) | padded[k : k + n]
        step, at, places = length[window].tolist(), begin - 8 * low, []
        last = n - longest if low + AT_ONCE < len(data) else n - 1
        while at <= last and left and step[at]:
            places.append(at)
            at += step[at]
            left -= 1
        out.append(symbol[window[places]].tobytes() if places else b"")
        if not places or 8 * low + at > 8 * len(data):
            raise ValueError("the data end before all symbols are read")
        begin = 8 * low + at
    return b"".join(out)


def decode_by_bits(data: bytes, codes: dict[int, str], size: int) -> bytes:
    symbols, out, code = {c: s for s, c in codes.items()}, bytearray(), ""
    for bit in unpack(data):
        if len(out) == size:
            break
        code += bit
        if code in symbols:
            out.append(symbols[code])
            code = ""
    if len(out) != size:
        raise ValueError("the data end before all symbols are read")
    return bytes(out)


def write_tree(tree: Tree) -> bytes:
    """Pre-order: 1 and the symbol for a leaf, 0 before two branches."""
    out, rest = bytearray(), [tree]
    while rest:
        node = rest.pop()
        if isinstance(node, int):
            out += bytes((1, node))
        else:
            out.append(0)
            rest += [node[1], node[0]]
    return bytes(out)


def read_tree(data: bytes) -> Tree:
    done: list[list] = [[]]
    for kind, symbol in _nodes(data):
        if kind:
            done[-1].append(symbol)
            while len(done) > 1 and len(done[-1]) == 2:
                pair = done.pop()
                done[-1].append((pair[0], pair[1]))
        else:
            done.append([])
    if len(done) != 1 or len(done[0]) != 1:
        raise ValueError("a code tree is not whole")
    return done[0][0]


def _nodes(data: bytes):
    i = 0
    while i < len(data):
        if data[i]:
            if i + 1 >= len(data):
                raise ValueError("a code tree is cut off")
            yield 1, data[i + 1]
            i += 2
        else:
            yield 0, 0
            i += 1


def write_codes(codes: dict[int, str]) -> bytes:
    """For each symbol: 1, the symbol, the length of its code and a byte for each bit."""
    return b"".join(bytes((1, s, len(c), *map(int, c))) for s, c in sorted(codes.items()))


def read_codes(data: bytes) -> dict[int, str]:
    out, i = {}, 0
    while i < len(data):
        if data[i] != 1 or i + 3 > len(data) or i + 3 + data[i + 2] > len(data):
            raise ValueError("a code table is not whole")
        out[data[i + 1]] = "".join(map(str, data[i + 3 : i + 3 + data[i + 2]]))
        i += 3 + data[i + 2]
    return out
