"""Hashes and keys: FNV-1a, SimHash, Hamming distances, blocks, digests and lead keys."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow_function
from .text import SPACE

FNV_OFFSET, FNV_PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
BLOCKS, BLOCK_BITS = 4, 16


def fnv1a64(text: str) -> int:
    """FNV-1a over UTF-16 code units, modulo 2**64 (F-21)."""
    out = FNV_OFFSET
    raw = text.encode("utf-16-le", "surrogatepass")
    for unit in memoryview(raw).cast("H"):
        out = (out ^ unit) * FNV_PRIME & MASK
    return out


def fnv1a64_native(text: Column) -> Column:
    """FNV-1a of ASCII text as a signed long, in 32-bit halves so that nothing overflows."""
    low_prime, half = FNV_PRIME & 0xFFFFFFFF, F.lit(1 << 32).cast("long")

    def step(acc: Column, c: Column) -> Column:
        low = acc["l"].bitwiseXOR(F.ascii(c).cast("long"))
        product = low * F.lit(low_prime).cast("long")
        # The prime is 2**40 + 435: the high half gets the low half's bits from 8 up, and its own times 435.
        high = F.pmod(acc["h"] * F.lit(low_prime).cast("long") + F.shiftrightunsigned(product, 32) + low * F.lit(256).cast("long"), half)
        return F.struct(high.alias("h"), F.pmod(product, half).alias("l"))

    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("h"), F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("long").alias("l"))
    out = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    return F.shiftleft(out["h"], 32).bitwiseOR(out["l"])


def unsigned_text(hashed: Column) -> Column:
    """A signed long as the decimal text of its unsigned value."""
    return F.conv(F.hex(hashed), 16, 10)


# Loanwords in the order of replacement, weights of words, and suffixes that say nothing.
LOANWORDS = (("ツール", "tool"), ("シェーダー", "shader"), ("シェーダ", "shader"), ("アバター", "avatar"), ("システム", "system"), ("ギミック", "gimmick"), ("ワールド", "world"), ("プラグイン", "plugin"), ("エディタ", "editor"), ("エディター", "editor"), ("アニメーション", "animator"), ("アニメーター", "animator"))
WEIGHTS = {"vpm": 3.5, "vcc": 3.5, "ndmf": 3.5, "modularavatar": 3.5, "modular": 3.0, "udon": 3.0, "udonsharp": 3.0, "tool": 3.0, "shader": 2.5, "avatar": 2.5, "gimmick": 2.5, "plugin": 2.5, "physbone": 2.5, "editor": 2.5, "animator": 2.5, "world": 2.0, "system": 2.0, "prefab": 2.0}
SUFFIXES = "対応|向け|専用|無料|非公式"
MOST_COUNTED = 5

_CJK = "぀-ヿ㐀-䶿一-鿿"
_STEPS = tuple((re.compile(p, re.A if a else 0), r) for p, r, a in (
    (r"<[^>]+>", " ", 0), (r"【[^】]*】", " ", 0), (r"\[[^\]]*\]", " ", 0), (r"[（(][^）)]*[）)]", " ", 0),
    (r"(?<![A-Za-z0-9_])v?[0-9]+\.[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_])", " ", 1),
    (f"([a-z0-9]+)([{_CJK}])", r"\1 \2", 0), (f"([{_CJK}])([a-z0-9]+)", r"\1 \2", 0),
    (r"[（）「」『』_.,/#!$%^&*;:{}=\-`~()]", " ", 0),
))


def simhash_tokens(text: str | None) -> dict[str, int]:
    """Words of two or more characters, then pairs of neighbouring non-ASCII characters, with counts in first-seen order (F-9)."""
    clean = unicodedata.normalize("NFKC", text or "").lower()
    for pattern, into in _STEPS:
        clean = pattern.sub(into, clean)
    for native, word in LOANWORDS:
        clean = clean.replace(native, f" {word} ")
    clean = re.sub(f"[{SPACE}]+", " ", re.sub(SUFFIXES, " ", clean)).strip(" ")
    counts: dict[str, int] = {}
    wide = "".join(c for c in clean if c > "\x7f")
    for token in [w for w in clean.split(" ") if len(w.encode("utf-16-le")) >= 4] + [wide[k : k + 2] for k in range(len(wide) - 1)]:
        counts[token] = counts.get(token, 0) + 1
    return counts


@lru_cache(maxsize=1 << 17)
def _signs(token: str) -> np.ndarray:
    """A token's vote for each bit: 1 or -1. Tokens repeat, so a worker keeps those it met."""
    bits = np.unpackbits(np.frombuffer(fnv1a64(token).to_bytes(8, "little"), np.uint8), bitorder="little")
    return 2.0 * bits - 1


def simhash64(text: str | None) -> int:
    """A 64-bit SimHash; each vote is added to an integer, so fractions are cut towards zero step by step (A-10).

    Whole votes commute with each other, so those between two fractional ones are added together.
    """
    votes, signs, weights = np.zeros(64), [], []
    for token, count in simhash_tokens(text).items():
        weight = WEIGHTS.get(token, 1.0) * min(count, MOST_COUNTED)
        if weight.is_integer():
            signs.append(_signs(token))
            weights.append(weight)
            continue
        if signs:
            votes += np.array(weights) @ np.array(signs)
            signs, weights = [], []
        votes = np.trunc(votes + weight * _signs(token))
    if signs:
        votes += np.array(weights) @ np.array(signs)
    return int.from_bytes(np.packbits(votes > 0, bitorder="little").tobytes(), "little")


@arrow_function("long")
def simhash(text: pd.Series) -> pd.Series:
    """:func:`simhash64` in Arrow batches, as a signed long."""
    return pd.Series(np.array([simhash64(t) for t in text], np.uint64).view(np.int64))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ (F-22)."""
    return F.bit_count(a.bitwiseXOR(b))


def blocks(hashed: Column) -> Column:
    """The four 16-bit blocks of a hash, low first (F-23)."""
    return F.array(*[F.shiftrightunsigned(hashed, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")) for k in range(BLOCKS)])


def sha256(text: Column) -> Column:
    """SHA-256 as lower-case hex (F-24)."""
    return F.sha2(text, 256)


def key_of(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON array, in which null stays null: lead keys and deterministic identifiers (F-25)."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)


def digest_of(*columns: str) -> Column:
    """SHA-256 of fixed columns as a JSON object; only equality of digests means anything (F-26)."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def source_key(platform: Column, url: Column, item: Column) -> Column:
    """platform:url:item (F-32)."""
    return F.concat(platform, F.lit(":"), url, F.lit(":"), item)
