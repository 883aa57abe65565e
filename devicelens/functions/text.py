"""Text assembly helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bullets(items: Column, mark: str = "- ") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")


def numbered(items: Column) -> Column:
    """'1. first\\n2. second' of a string array."""
    return F.array_join(
        F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"
    )


def lines(*parts: Column | str) -> Column:
    """Join parts with newlines; plain strings are literals."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def fill(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by columns; text between the placeholders is kept as it is."""
    import re

    pieces: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                pieces.append(F.lit(piece))
        elif piece in values:
            pieces.append(F.coalesce(values[piece].cast("string"), F.lit("None")))
        else:
            pieces.append(F.lit("{" + piece + "}"))
    return F.concat(*pieces)


def ordered_list(order: Iterable[Column], item: Column) -> Column:
    """Aggregate: ``item`` values sorted by ``order`` (for groups of bounded size)."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, item.alias("item"))))
    return F.transform(rows, lambda r: r["item"])


def fixed(value: Column, digits: int) -> Column:
    """``%.{digits}f`` with ties to even, as the studied system prints numbers."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))
