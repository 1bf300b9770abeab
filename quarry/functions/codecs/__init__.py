"""Binary codecs: RLE, LZ77, LZ78, Huffman, Shannon-Fano and arithmetic coding, their models, and Arrow functions over columns."""

from .base import ALIASES, CODES, Codec, canonical, codec, compress, decompress, decode_column, encode_column, escape_byte, model_of, round_trip_column

__all__ = ["ALIASES", "CODES", "Codec", "canonical", "codec", "compress", "decompress", "decode_column", "encode_column", "escape_byte", "model_of", "round_trip_column"]
