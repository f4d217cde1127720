"""Keyed pseudonyms from built-in hash functions."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwatch.config import HASH_CHARS, LOCAL_SALT, SALT_ENV

_BLOCK = 64


def hmac_sha256(value: Column, key: str) -> Column:
    """HMAC-SHA256 of a text as lower-case hex.

    The two padded keys are plan literals, so do not log plans of jobs with a real salt.
    """
    raw = key.encode("utf-8")
    if len(raw) > _BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in raw))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in raw))
    inner = F.sha2(F.concat(inner_pad, F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def pseudonym(value: Column, key: str) -> Column:
    return F.substring(hmac_sha256(value, key), 1, HASH_CHARS)


def resolve_salt(
    salt: str | None = None,
    env: str = SALT_ENV,
    require_own: bool = False,
) -> tuple[str, str]:
    """(salt, where it came from). Only the source may be written anywhere."""
    if salt:
        return salt, "cli"
    from_env = os.environ.get(env)
    if from_env:
        return from_env, f"env:{env}"
    if require_own:
        raise ValueError("a salt is required: pass one or set the salt variable")
    return LOCAL_SALT, "default-local"
