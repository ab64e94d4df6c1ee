"""Codecs: opaque cursors, capability masks, token formats."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import PLATFORMS

LONGEST_CURSOR = 256

# The fields of each list's cursor, in order.
CURSORS = {
    "catalog": ("createdAt", "canonicalId"), "delta": ("updatedAt", "canonicalId", "epoch"), "leads": ("firstSeenAt", "leadKey"),
    "rules": ("createdAt", "ruleId"), "profiles": ("createdAt", "profileId"), "takedowns": ("recordedAt", "takedownId"),
}


def encode_cursor(kind: str, **fields: str) -> str:
    """A cursor as base64url of compact JSON (F-31)."""
    raw = json.dumps({k: fields[k] for k in CURSORS[kind]}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode("latin-1")).decode().rstrip("=")


def decode_cursor(kind: str, text: str | None) -> dict[str, str] | None:
    """A cursor's fields, or None for anything that :func:`encode_cursor` would not have made."""
    if not text or len(text) > LONGEST_CURSOR:
        return None
    try:
        fields = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode("latin-1"))
        if all(isinstance(v, str) for v in fields.values()) and encode_cursor(kind, **fields) == text and set(fields) == set(CURSORS[kind]):
            return fields
    except (AttributeError, KeyError, TypeError, UnicodeError, ValueError):
        pass
    return None


def capability_mask(platforms: Column) -> Column:
    """A platform list as a bit mask (F-30); unknown names have no bit."""
    bits = F.array(*[F.lit(1 << k) for k in range(len(PLATFORMS))])
    bit = lambda p: F.element_at(bits, F.array_position(F.array(*map(F.lit, PLATFORMS)), p).cast("int"))
    known = F.filter(F.array_distinct(platforms), lambda p: p.isin(*PLATFORMS))
    return F.aggregate(known, F.lit(0), lambda m, p: m.bitwiseOR(bit(p)))


def capability_code(mask: Column) -> Column:
    """A mask as four hex digits."""
    return F.lpad(F.lower(F.hex(mask.cast("long"))), 4, "0")


def capabilities_of(code: Column) -> Column:
    """The platforms of a code, in their order; null unless it is four hex digits that name platforms."""
    mask = F.conv(code, 16, 10).cast("int")
    named = F.filter(F.array(*map(F.lit, PLATFORMS)), lambda p, k: mask.bitwiseAND(F.element_at(F.array(*[F.lit(1 << j) for j in range(len(PLATFORMS))]), k + 1)) > 0)
    return F.when(code.rlike("^[0-9a-fA-F]{4}$") & (mask > 0) & (mask < 1 << len(PLATFORMS)), named)


# The formats of credentials.
TOKEN_FORMATS = {"app": "^vrcp_app_[a-f0-9]{64}$", "user": "^vrcp_usr_[a-f0-9]{64}$", "node": "^vrcp_[0-9a-fA-F]{64}[0-9a-fA-F]{4}$", "operator": "^[0-9a-fA-F]{64}$"}


def token_kind(token: Column) -> Column:
    """The kind of credential by format, or null (P-18)."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(TOKEN_FORMATS.items()):
        out = F.when(token.rlike(pattern), kind).otherwise(out)
    return out
