"""Content hashes and derived identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS_HASH = "0" * 64
NOT_APPLICABLE = "not-applicable"


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def short_hash(value: Column) -> Column:
    return F.substring(value, 1, 12)


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` plus 24 hex digits of the SHA-256 over the NUL-joined parts."""
    joined = F.concat_ws("\0", *[p.cast("string") for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 24))


def sha256_text(value: str) -> str:
    """Driver-side counterpart for single literals such as profile hashes."""
    return hashlib.sha256(value.encode("utf-8")).hexdigest()


def stable_id_text(prefix: str, *parts: str) -> str:
    return f"{prefix}_{sha256_text(chr(0).join(parts))[:24]}"
