r"""Strict semantic versions: validity, cleaning, order."""

from __future__ import annotations

import re
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow_function

# The grammar of semantic versions, and the longest that counts.
_NUMBER, _WORD = r"(?:0|[1-9][0-9]*)", r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
STRICT = rf"^{_NUMBER}\.{_NUMBER}\.{_NUMBER}(?:-{_WORD}(?:\.{_WORD})*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
LONGEST, SAFE = 256, (1 << 53) - 1
_PARTS = re.compile(rf"({_NUMBER})\.({_NUMBER})\.({_NUMBER})(?:-({_WORD}(?:\.{_WORD})*))?(?:\+[0-9A-Za-z.-]+)?")


def is_version(text: Column) -> Column:
    """A strict version without ``v`` or white space (P-17)."""
    core = F.split(F.regexp_extract(text, r"^([0-9.]+)", 1), r"\.")
    safe = F.forall(F.slice(core, 1, 3), lambda n: (F.length(n) < 16) | ((F.length(n) == 16) & (n <= F.lit(str(SAFE)))))
    return F.coalesce((F.length(text) <= LONGEST) & text.rlike(STRICT) & safe, F.lit(False))


def parse(text: str) -> tuple[tuple[int, int, int], list[str]]:
    """(core numbers, words before release) of a valid version."""
    match = _PARTS.fullmatch(text)
    if not match:
        raise ValueError(f"not a version: {text}")
    return (int(match[1]), int(match[2]), int(match[3])), match[4].split(".") if match[4] else []


def compare(a: str, b: str) -> int:
    """-1, 0 or 1: by numbers, then a release after its previews, then previews word by word (F-27)."""
    (core_a, pre_a), (core_b, pre_b) = parse(a), parse(b)
    if core_a != core_b:
        return -1 if core_a < core_b else 1
    rank = lambda words: [(0, int(w), "") if w.isdigit() else (1, 0, w) for w in words] if words else [(2, 0, "")]
    key_a, key_b = rank(pre_a), rank(pre_b)
    return (key_a > key_b) - (key_a < key_b)


def clean(text: str | None) -> str | None:
    """A loose version string as a strict one, without build words, or None."""
    found = _PARTS.fullmatch(re.sub(r"^\s*[=v]+", "", (text or "").strip()).strip())
    return None if not found else f"{found[1]}.{found[2]}.{found[3]}{'-' + found[4] if found[4] else ''}"


@arrow_function("int")
def compare_versions(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`compare` in Arrow batches; null for what is no version."""

    def one(x: str | None, y: str | None) -> int | None:
        try:
            return compare(x, y)
        except (TypeError, ValueError):
            return None

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@arrow_function("string")
def clean_version(text: pd.Series) -> pd.Series:
    """:func:`clean` in Arrow batches."""
    return text.map(clean)


def sort_key(text: Column) -> Column:
    """A string whose order is the versions' order: numbers padded, previews ranked below the release. Native."""
    core = F.transform(F.split(F.regexp_extract(text, r"^([0-9]+\.[0-9]+\.[0-9]+)", 1), r"\."), lambda n: F.lpad(n, 16, "0"))
    pre = F.regexp_extract(text, r"^[0-9.]+-([0-9A-Za-z.-]+)", 1)
    word = lambda w: F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("1"), F.lpad(w, 16, "0"))).otherwise(F.concat(F.lit("2"), w))
    tail = F.when(pre == "", "~").otherwise(F.concat(F.lit("-"), F.array_join(F.transform(F.split(pre, r"\."), word), "\x01"), F.lit("\x00")))
    return F.concat(F.array_join(core, "."), tail)


newest = cmp_to_key(compare)
