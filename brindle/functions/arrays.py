"""Array expressions: values bound once, and folds that put out arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of one inner fold; its output is appended to the whole at once.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once, however often ``use`` names it (an expression that
    a lambda names is computed again for every element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def emitted(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """A fold that puts out an array: ``step(state, item)`` gives the next state and an array (of type
    ``kind``) to append, ``last(state)`` one more. Appending copies what is there, so items are folded in
    blocks, and only blocks are appended to the whole."""
    none = F.array().cast(kind)

    def whole(xs: Column) -> Column:
        def inner(so_far: Column, x: Column) -> Column:
            state, more = step(so_far["state"], x)
            return F.struct(state.alias("state"), F.concat(so_far["out"], more).alias("out"))

        def outer(so_far: Column, block: Column) -> Column:
            part = F.aggregate(F.slice(xs, block * BLOCK + 1, F.lit(BLOCK)), F.struct(so_far["state"].alias("state"), none.alias("out")), inner)
            return bound(part, lambda p: F.struct(p["state"].alias("state"), F.concat(so_far["out"], p["out"]).alias("out")))

        blocks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        end = lambda x: F.concat(x["out"], last(x["state"])) if last else x["out"]
        return F.aggregate(blocks, F.struct(start.alias("state"), none.alias("out")), outer, end)

    return bound(items, whole)
