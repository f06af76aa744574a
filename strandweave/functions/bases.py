"""Column functions on base strings; all built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data format: base codes 1-4, packed codes 0-3, complements, and the characters that drop a read.
CODES = {"A": 1, "C": 2, "T": 3, "G": 4}
PACK_ALPHABET = "ACTG"
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTacgt", "TGCATGCA"
LOW_QUALITY = "[H-OX-_h-ox-\\x7f]"


def is_low_quality(seq: Column) -> Column:
    """Whether a read holds a character that drops it."""
    return seq.rlike(LOW_QUALITY)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def encode(base: Column) -> Column:
    """1-4 for a one-character string, whatever its case."""
    return (F.shiftright(F.ascii(base), 1).bitwiseAND(3) + 1).cast("long")


def digits(seq: Column) -> Column:
    """The code of each ASCII character as a digit, by the rule of `encode`."""
    ascii_characters = [chr(c) for c in range(1, 128)]
    return F.translate(seq, "".join(ascii_characters), "".join(str((ord(c) >> 1 & 3) + 1) for c in ascii_characters))


def code_string(seq: Column) -> Column:
    """The codes of all bases as digits."""
    return F.translate(F.upper(seq), "".join(CODES), "".join(map(str, CODES.values())))


def base_at(seq: Column, position: int) -> Column:
    """The base at a 0-based position."""
    return F.substring(seq, position + 1, 1)


def pack(seq: Column) -> Column:
    """Two bits a base, the first base in the high bits, as upper-case hex; the last byte is filled with zero bits.

    Chunks of 16 bases are numbers to the base 4, which built-in base conversion turns into 8 hex digits each.
    """
    digits_ = F.rpad(F.translate(F.upper(seq), PACK_ALPHABET, "0123"), (F.ceil(F.length(seq) / 16) * 16).cast("int"), F.lit("0"))
    chunks = F.regexp_extract_all(digits_, F.lit("[0-9]{16}"), F.lit(0))
    text = F.array_join(F.transform(chunks, lambda c: F.lpad(F.conv(c, 4, 16), 8, "0")), "")
    return F.substring(text, F.lit(1), (F.ceil(F.length(seq) / 4) * 2).cast("int"))


def unpack(packed: Column, length: Column) -> Column:
    """The `length` bases of a packed string."""
    padded = F.rpad(packed, (F.ceil(F.length(packed) / 8) * 8).cast("int"), F.lit("0"))
    chunks = F.regexp_extract_all(padded, F.lit("[0-9A-F]{8}"), F.lit(0))
    digits_ = F.array_join(F.transform(chunks, lambda c: F.lpad(F.conv(c, 16, 4), 16, "0")), "")
    return F.substring(F.translate(digits_, "0123", PACK_ALPHABET), F.lit(1), length)
