"""Arrow functions that are built when they are called, as workers import the modules without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorate a function of Arrow arrays; the result takes columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*cols: Column | str) -> Column:
            return F.arrow_udf(f, kind)(*cols)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return wrap
