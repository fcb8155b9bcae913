"""Column expressions for the byte formats: varints, prefix deltas, checksums and file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_length(v: Column, bits: int = 32) -> Column:
    """Bytes of the LEB128 form of an unsigned number of 32 or 64 bits (64 bits: a long's, as they are)."""
    most = -(-bits // 7)
    if bits == 64:
        n = reduce(lambda out, k: F.when(F.shiftrightunsigned(v, 7 * k) == 0, k).otherwise(out), range(most - 1, 0, -1), F.lit(most))
    else:
        n = reduce(lambda out, k: F.when(v < 1 << 7 * k, k).otherwise(out), range(most - 1, 0, -1), F.lit(most))
    return n.cast("int")


def varint_hex(v: Column, bits: int = 32) -> Column:
    """LEB128 of such a number, in upper-case hex."""
    n, v = varint_length(v, bits), v.cast("long")
    byte = [F.shiftrightunsigned(v, 7 * k).bitwiseAND(F.lit(127)) + F.when(n > k + 1, 128).otherwise(0) for k in range(-(-bits // 7))]
    return F.concat(*[F.when(n > k, F.lpad(F.hex(b.cast("long")), 2, "0")).otherwise("") for k, b in enumerate(byte)])


def varint_value(hexed: Column, bits: int = 32) -> Column:
    """The number that a LEB128 form in hex stands for (64 bits: as a long's bits); null if it does not end."""
    part = [F.conv(F.substring(hexed, 2 * k + 1, 2), 16, 10).cast("long") for k in range(-(-bits // 7))]
    shifted = [F.when(F.length(hexed) > 2 * k, F.shiftleft(p.bitwiseAND(F.lit(127)), 7 * k)).otherwise(F.lit(0).cast("long")) for k, p in enumerate(part)]
    total = reduce(Column.bitwiseOR, shifted)
    last = F.conv(F.substring(hexed, -2, 2), 16, 10).cast("long")
    return F.when(last < 128, total)


def octets(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def record_size(key: Column, val: Column) -> Column:
    """Bytes of a log record: two varint lengths, key and value."""
    k, v = octets(key), octets(val)
    return (varint_length(k) + varint_length(v) + k + v).cast("long")


def entry_estimate(key: Column, val: Column) -> Column:
    return octets(key) + octets(val) + 8


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings begin with in common, in one pass over both."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    shorter = F.least(F.length(a), F.length(b))
    return F.least(F.when(first > 0, first - 1).otherwise(shorter), shorter).cast("int")


def checksum(data: Column) -> Column:
    """CRC-32 of a binary or string column."""
    return F.crc32(data.cast("binary"))


def verified(data: Column, stored: Column) -> Column:
    """Whether a stored checksum is that of the data."""
    return F.coalesce(checksum(data) == stored, F.lit(False))


def table_name(fid: Column) -> Column:
    return F.format_string("%05d.sst", fid)


def log_name(fid: Column) -> Column:
    return F.format_string("%05d.wal", fid)


def file_id(name: Column, extension: str) -> Column:
    """The number in a file name, null if the name has another form."""
    return F.regexp_extract(name, rf"(?:^|/)([0-9]+)\.{extension}$", 1).try_cast("bigint")


def odometer(n: Column) -> Column:
    """The n-th (from 1) of the three-letter strings "abc", "abd", ...; after "zzz" comes "aaa"."""
    first = 0 * 676 + 1 * 26 + 2  # "abc" in base 26
    v = (n - 1 + first) % 26**3
    letters = [F.char(F.lit(97) + F.floor(v / d) % 26) for d in (676, 26, 1)]
    return F.concat(*letters)


def readable(data: Column) -> Column:
    """UTF-8 text of bytes, null where they are none."""
    return F.try_validate_utf8(data)


#: Fixed value: the characters of random strings, of one to four bytes in UTF-8.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!?#@+-*/=_.,äöüßéñçøαβγδжщя中文字键值数据日本語한국어😀😁🚀🌍"


def rand_str(seed: Column, length: int) -> Column:
    """A string of ``length`` characters that follows from its seed alone (whole number or string)."""
    letters = F.array(*map(F.lit, ALPHABET))

    def letter(i: Column) -> Column:
        digits = F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), i.cast("string"))), 1, 8)
        return F.element_at(letters, (F.conv(digits, 16, 10).cast("long") % len(ALPHABET) + 1).cast("int"))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "")
