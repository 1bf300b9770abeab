"""Run lengths with an escape byte.

Format (fixed): a run of 4 to 258 bytes other than the escape is escape, length - 3, byte; 2 to 256 escapes are escape,
length - 1, escape; one escape is escape, 0; all else stands for itself.
"""

from __future__ import annotations

import itertools
import re

LEAST_RUN, MOST_RUN, MOST_ESCAPES = 4, 258, 256


def encode(data: bytes, escape: int) -> bytes:
    def packed(run: re.Match) -> bytes:
        byte, left, out = run[0][0], run.end() - run.start(), bytearray()
        most = MOST_ESCAPES if byte == escape else MOST_RUN
        for size in itertools.chain(itertools.repeat(most, left // most), [left % most]):
            if byte == escape:
                out += bytes((escape, size - 1, escape)) if size > 1 else bytes((escape, 0))[: 2 * size]
            elif size >= LEAST_RUN:
                out += bytes((escape, size - 3, byte))
            else:
                out += bytes((byte,)) * size
        return bytes(out)

    # all else stands for itself
    return re.sub(rb"%s+|(.)\1{%d,}" % (re.escape(bytes((escape,))), LEAST_RUN - 1), packed, data, flags=re.S)


def decode(data: bytes, escape: int) -> bytes:
    out, i = bytearray(), 0
    while (at := data.find(escape, i)) >= 0:
        out += data[i:at]
        if at + 1 >= len(data):
            out.append(escape)  # a cut-off end stands for itself
            return bytes(out)
        n = data[at + 1]
        if n == 0:
            out.append(escape)
            i = at + 2
        elif at + 2 >= len(data):
            return bytes(out) + data[at:]
        else:
            byte = data[at + 2]
            out += bytes((byte,)) * (n + (1 if byte == escape else 3))
            i = at + 3
    return bytes(out) + data[i:]
