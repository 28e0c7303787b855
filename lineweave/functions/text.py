"""Column helpers for text: Unicode trim, line splitting, byte prefixes, word tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A Column used several times is a tree that is copied and, inside an array lambda,
    evaluated again for each use; as the element of a one-element array it is bound.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Trim every Unicode whitespace character (``F.trim`` alone strips spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def indent_of(text: Column) -> Column:
    """Number of leading whitespace characters."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(WHITESPACE)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def contains_any(text: Column, words) -> Column:
    return any_of([F.contains(text, F.lit(word)) for word in words])


def split_lines(content: Column, keep_cr: bool = False) -> Column:
    """Content as an array of lines.

    A final line break ends the last line and opens no new one; empty content has no
    lines.  ``\\r\\n`` counts as one break unless ``keep_cr`` is set (C sources).
    """
    text = content if keep_cr else F.replace(content, F.lit("\r\n"), F.lit("\n"))

    def without_last_break(pieces: Column) -> Column:
        return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)

    return let(F.split(text, "\n", -1), without_last_break)


def numbered(lines: Column) -> Column:
    """``array<string>`` to ``array<struct<line,text>>`` with 1-based line numbers."""
    return F.transform(lines, lambda text, i: F.struct((i + 1).alias("line"), text.alias("text")))


def byte_prefix(data: Column, n: int) -> Column:
    """First ``n`` bytes of binary ``data`` as a string, cut back to a character boundary.

    NULL when the bytes are not valid UTF-8 for another reason than the cut: cutting back is
    allowed only if the character that was cut is whole in the bytes behind ``n``.
    """
    def valid(size: int) -> Column:
        return F.try_validate_utf8(F.substring(data, 1, size).cast("string"))

    whole = F.try_validate_utf8(data.cast("string"))
    cut_inside = F.coalesce(*[valid(n + more) for more in (1, 2, 3)]).isNotNull()
    shorter = F.coalesce(*[valid(n - back) for back in (1, 2, 3) if n >= back])
    cut = F.coalesce(valid(n), F.when(cut_inside, shorter))
    return F.when(F.octet_length(data) <= n, whole).otherwise(cut)


def clip_bytes(text: Column, n: int) -> Column:
    """String clipped to ``n`` bytes on a character boundary."""
    return F.when(F.octet_length(text) <= n, text).otherwise(byte_prefix(F.encode(text, "UTF-8"), n))


def before_first(text: Column, word: str) -> Column:
    """Text before the first occurrence of ``word`` (all of it when absent)."""
    return F.substring_index(text, word, 1)


def byte_column(text: Column, word: str) -> Column:
    """1-based byte offset of the first ``word``; 1 when absent."""
    return F.when(
        F.contains(text, F.lit(word)), F.octet_length(before_first(text, word)) + 1
    ).otherwise(F.lit(1))


def first_hit_is_word(text: Column, word: str) -> Column:
    """Is the *first* occurrence of ``word`` bounded by non-word ASCII characters?

    Later occurrences do not count, which is why ``\\b`` is not enough.
    """
    head = before_first(text, word)
    rest = F.substr(text, F.length(head) + F.lit(len(word) + 1), F.lit(1))
    return (
        F.contains(text, F.lit(word))
        & ~F.rlike(head, F.lit("[A-Za-z0-9_]\\z"))
        & ~F.rlike(rest, F.lit("^[A-Za-z0-9_]"))
    )
