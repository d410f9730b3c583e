"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a Generate node, so that each is computed once per row.

    A plain projection could be merged with the next one, and an array that a
    lambda indexes would then be made anew for every element.
    """
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(made))


def number(df: DataFrame, column: str) -> Column:
    """A column of whole numbers as longs; of any other type it is refused before a job starts."""
    kind = df.select(F.col(f"`{column}`")).schema[0].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{column} must hold whole numbers, not {kind.simpleString()}")
    return F.col(f"`{column}`").cast("long")


# Every byte that is no digit, letter or part of a character beyond ASCII becomes a space; A-Z become a-z.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, a-z (A-Z in lower case) and all characters from U+0080, as UTF-8; null has none."""
    return (text or "").encode().translate(_WORD_BYTES).split()
