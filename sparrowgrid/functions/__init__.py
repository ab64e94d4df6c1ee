"""Scalar functions: text, tags, URLs, hashes, versions, policy predicates, codecs and times."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of pandas Series as one of Columns. It is made at its first call, as a type's text needs a session to be read."""

    def wrap(function: Callable) -> Callable[..., Column]:
        make = functools.cache(lambda: F.pandas_udf(function, kind))

        @functools.wraps(function)
        def call(*columns: Column) -> Column:
            return make()(*columns)

        return call

    return wrap
