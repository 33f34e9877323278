"""Word, line and hash helpers on Python strings, shared by the Arrow operators."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash

#: [\x20\x09-\x0D]; bytes.split() and bytes.lower() know exactly these and A-Z.
WS = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def key128(data: bytes) -> tuple[int, int]:
    """128-bit key as two signed longs."""
    d = xxhash.xxh3_128_intdigest(data)
    lo, hi = d & 0xFFFFFFFFFFFFFFFF, d >> 64
    return lo - (lo >> 63 << 64), hi - (hi >> 63 << 64)


def crc_mod(doc_id: int | None, m: int) -> int | None:
    """crc32 of the id as text, modulo m; null for a null id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64)) if not isinstance(values, list) else pa.array(values, type=pa.int64())
