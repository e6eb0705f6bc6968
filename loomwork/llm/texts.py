"""Column expressions and constants that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space that separates words, and the two cases of ASCII letters.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

#: CRC-32 of a text in SQL: bit by bit over its bytes with the reflected polynomial.
CRC32_SQL = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || hex(encode({0}))[2*i+1:2*i+2])::BIGINT), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does the same where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
