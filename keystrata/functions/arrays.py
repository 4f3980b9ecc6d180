"""Functions of array and text fields, with the edge rules of keyed documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- arrays: an unset array is empty


def array_size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0)).cast("long")


def array_get(a: Column, i: Column | int) -> Column:
    """Element i from 0; null out of bounds."""
    return F.get(a, i if isinstance(i, Column) else F.lit(i))


def array_get_text(a: Column, i: Column | int) -> Column:
    """Element i of a text array; empty out of bounds."""
    return F.coalesce(array_get(a, i), F.lit(""))


def append_one(a: Column, value: Column) -> Column:
    return F.array_append(a, value)


def append_all(a: Column, others: Column) -> Column:
    """All elements of others after those of a; either may be unset."""
    return F.when(a.isNull(), others).when(others.isNull(), a).otherwise(F.concat(a, others))


def pop_back(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def pop_front(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def push_front(a: Column, value: Column) -> Column:
    return F.array_prepend(a, value)


def insert_at(a: Column, i: int, value: Column) -> Column:
    """Value before element i, from 0."""
    return F.concat(F.slice(a, 1, i), F.array(value), F.slice(a, F.lit(i + 1), F.greatest(F.size(a) - i, F.lit(0))))


def erase_at(a: Column, i: int) -> Column:
    return F.concat(F.slice(a, 1, i), F.slice(a, F.lit(i + 2), F.greatest(F.size(a) - i - 1, F.lit(0))))


def resize(a: Column, n: int, fill: Column) -> Column:
    """The first n elements, and fill for those it has too few."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(fill, F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def front(a: Column) -> Column:
    return F.get(a, F.lit(0))


def back(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


# ---------------------------------------------------------------- text, positions from 0


def assign(text: Column, value: Column) -> Column:
    """The value in place of the text; an unset one is empty."""
    return F.coalesce(value, F.lit(""))


def append_text(text: Column, more: Column) -> Column:
    """The text with more behind it; either may be unset."""
    return F.concat(F.coalesce(text, F.lit("")), F.coalesce(more, F.lit("")))


def push_back(text: Column, character: str) -> Column:
    """The text with one character behind it."""
    if len(character) != 1:
        raise ValueError(f"not one character: {character!r}")
    return append_text(text, F.lit(character))


def clear(text: Column) -> Column:
    return F.lit("")


def find(text: Column, part: str) -> Column:
    """Where part begins, -1 if nowhere."""
    return (F.instr(text, part) - 1).cast("long")


def substr(text: Column, start: int, count: int) -> Column:
    """count characters from start; an error where start lies past the end."""
    past = F.char_length(text) < start
    return F.when(past, F.raise_error(F.lit("substr: position past the end"))).otherwise(F.substring(text, start + 1, count))


def at(text: Column, i: int) -> Column:
    """Character i; an error out of bounds."""
    return F.when(F.char_length(text) <= i, F.raise_error(F.lit("at: position past the end"))).otherwise(F.substring(text, i + 1, 1))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes, then by length."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def starts_with(text: Column, part: Column) -> Column:
    return F.startswith(text, part)


def ends_with(text: Column, part: Column) -> Column:
    return F.endswith(text, part)


# ---------------------------------------------------------------- words of indexed text


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, in order, repeats kept; other bytes separate."""
    return F.regexp_extract_all(lower_ascii(text), F.lit("[a-z0-9]+"), F.lit(0))
