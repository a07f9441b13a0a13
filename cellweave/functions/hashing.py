"""Hashes and small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: First byte of what is hashed for a bytes element.
BYTES_DOMAIN = b"\x01"


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h


def element_hash(element: int | bytes) -> int:
    """XXH3-64 of an integer's 8 little-endian bytes, or of a tagged byte string."""
    import xxhash

    data = BYTES_DOMAIN + element if isinstance(element, bytes) else (element % (1 << 64)).to_bytes(8, "little")
    return xxhash.xxh3_64_intdigest(data)


def content_hash(text: str) -> str:
    """XXH3-128 of the text with its white space normalised, as hex digits."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(" ".join(text.split()).encode())


def base32_id(raw: bytes) -> str:
    """Lower-case base 32 without padding; ids sort as their bytes do."""
    from base64 import b32hexencode

    return b32hexencode(raw).decode().rstrip("=").lower()


def squeezed(column: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def bucket_of(ts: Column, width: int) -> Column:
    return ts - F.pmod(ts, F.lit(width))


def days(n: int) -> int:
    """Microseconds."""
    return n * 86_400_000_000
