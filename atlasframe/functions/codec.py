"""Byte and token codecs as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the bundle's row formats.
MAX_PART, MAX_BLOB, MAX_TOKEN = 15, 255, 65_535


def checked(ok: Column, value: Column, message: Column | str) -> Column:
    """``value``, or the query fails with ``message`` where ``ok`` doesn't hold."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message) if isinstance(message, str) else message))


def hex_bytes(n: Column, size: int) -> Column:
    """``n`` as big-endian hexadecimal digits of ``size`` bytes; two's complement if negative."""
    return F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * size))


def _turned(digits: Column, size: int) -> Column:
    """Hexadecimal ``digits`` of ``size`` bytes with the bytes in reverse order."""
    return F.concat(*[F.substr(digits, F.lit(2 * k + 1), F.lit(2)) for k in range(size - 1, -1, -1)])


def little_endian(n: Column, size: int) -> Column:
    return F.unhex(_turned(hex_bytes(n, size), size))


def read_little_endian(data: Column, at: int, size: int, signed: bool = False) -> Column:
    """The integer at byte ``at`` (from 0)."""
    value = F.conv(_turned(F.hex(F.substring(data, at + 1, size)), size), 16, 10).cast("long")
    return F.when(value >= 1 << (8 * size - 1), value - (1 << 8 * size)).otherwise(value) if signed else value


def pack_nibbles(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 4).bitwiseOR(low)


def high_nibble(b: Column) -> Column:
    return F.shiftright(b, 4).bitwiseAND(F.lit(15))


def low_nibble(b: Column) -> Column:
    return b.bitwiseAND(F.lit(15))


def tokens_to_csv(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def tokens_from_csv(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ","), lambda i: i.cast("int")))


def tokens_to_blob(ids: Column) -> Column:
    """Two big-endian bytes a token; ids beyond 65535 fail."""
    safe = F.transform(ids, lambda i: checked((i >= 0) & (i <= MAX_TOKEN), i, "token id out of range"))
    return F.unhex(F.array_join(F.transform(safe, lambda i: hex_bytes(i, 2)), ""))


def tokens_from_blob(blob: Column) -> Column:
    """Tokens of a blob; the last byte of an odd one is ignored."""
    digits = F.hex(blob)
    pairs = F.sequence(F.lit(0), F.floor(F.octet_length(blob) / 2).cast("int") - 1)
    ids = F.transform(pairs, lambda i: F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    return F.when(F.octet_length(blob) >= 2, ids).otherwise(F.array().cast("array<int>"))


def length_prefixed(blob: Column) -> Column:
    """A token blob as a row: its length in one byte, then itself; blobs over 255 bytes fail."""
    n = F.octet_length(blob)
    return checked(n <= MAX_BLOB, F.concat(F.unhex(hex_bytes(n, 1)), blob), "token blob too large")


def decode_tokens(ids: Column, vocabulary: Column) -> Column:
    """Texts of ``ids`` run together; ``vocabulary`` is a map; unknown and empty ones show as ``<UNK:id>``."""
    one = lambda i: F.coalesce(F.nullif(F.try_element_at(vocabulary, i), F.lit("")), F.concat(F.lit("<UNK:"), i.cast("string"), F.lit(">")))
    return F.array_join(F.transform(ids, one), "")
