"""Bits in and out of bytes, most significant first."""

from __future__ import annotations


def pack(codes: list[str]) -> bytes:
    """Strings of 0 and 1 one after another, with zeros to the end of the last byte."""
    text = "".join(codes)
    if not text:
        return b""
    size = -(-len(text) // 8)
    return int(text.ljust(size * 8, "0"), 2).to_bytes(size, "big")


def unpack(data: bytes) -> str:
    return bin(int.from_bytes(b"\1" + data, "big"))[3:] if data else ""
