"""Scalar text functions, Column to Column, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() takes for white space.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

TITLE_CHARS = 30
ANSWER_MARKER = "Answer:"


def strip(text: Column) -> Column:
    """Without white space, of Unicode too, at either end."""
    # By a pattern, each space inside the text would be tried as the first of its end.
    return F.btrim(text, F.lit(SPACES))


def content_fingerprint(text: Column) -> Column:
    """MD5 of the text in one form: any line ending is a line feed, lines are stripped, blank lines go. Null counts as empty."""
    feeds = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.split(feeds, "\n")
    return F.md5(F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n"))


def _nearest(value: Column, step: int) -> Column:
    """To the nearest multiple of ``step``, halves to the even one."""
    return (F.bround(value / F.lit(float(step))) * step).cast("long")


def config_fingerprint(strategy: Column, size: Column, overlap: Column, threshold: Column) -> Column:
    """MD5 of the strategy and the rounded settings, so that nearly equal settings share a cache entry."""
    rounded = [_nearest(size, 100), _nearest(overlap, 25), _nearest(threshold, 1)]
    return F.md5(F.concat_ws("_", strategy, *[r.cast("string") for r in rounded]))


def title(text: Column, chars: int = TITLE_CHARS, always: bool = False) -> Column:
    """The first ``chars`` characters, with an ellipsis if that cuts something off, or always."""
    cut = F.concat(F.left(text, F.lit(chars)), F.lit("..."))
    return cut if always else F.when(F.length(text) > chars, cut).otherwise(text)


def saved_label(ts: Column) -> Column:
    """Hour, minute, day and month of a save, in the session's time zone."""
    return F.date_format(ts, "HH:mm dd/MM")


def _tenths(n: Column) -> Column:
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def size_label(n_bytes: Column) -> Column:
    """Megabytes with one decimal, halves up, from whole numbers, so that no float is formatted."""
    return F.concat(_tenths(F.floor((n_bytes.cast("long") * 10 + 524288) / 1048576)), F.lit(" MB"))


def time_label(milliseconds: Column) -> Column:
    """Seconds with one decimal, halves up."""
    return F.concat(_tenths(F.floor((milliseconds.cast("long") + 50) / 100)), F.lit("s"))


def safe_label(label: Column) -> Column:
    """A label as part of a key: slashes, spaces and colons become underscores."""
    return F.translate(label, "/ :", "___")


def extract_answer(text: Column, marker: str = ANSWER_MARKER) -> Column:
    """What follows the last ``marker``, or all of the text without one, stripped."""
    return strip(F.substring_index(text, marker, -1))


def build_prompt(context: Column, question: Column) -> Column:
    """The prompt for a generator: rules, context, question, and the marker that the answer follows."""
    return F.concat(
        F.lit("Use only the passages below. If they do not hold the answer, say that you do not know.\n\nPassages:\n"),
        context,
        F.lit("\n\nQuestion: "),
        question,
        F.lit(f"\n\n{ANSWER_MARKER}"),
    )


def short_hash(fingerprint: Column) -> Column:
    return F.left(fingerprint, F.lit(8))
