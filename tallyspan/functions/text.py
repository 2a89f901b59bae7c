"""Text and parsing expressions. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# English month names and abbreviations, lower case.
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
MONTH_ABBREVIATIONS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def alnum_key(text: Column) -> Column:
    """Lower case, every run of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def fold_key(text: Column) -> Column:
    return F.lower(squeeze_spaces(text))


def number_or_null(text: Column) -> Column:
    """Plain decimal notation only; Java suffixes such as '1d' are not numbers."""
    clean = F.trim(text)
    return F.when(clean.rlike(NUMBER_PATTERN), clean.try_cast("double"))


def strict_integer(text: Column) -> Column:
    """'1' and '1.0' are whole, '1.5' and words are null. Only text that is a number is cast, since a failing cast is slow."""
    value = number_or_null(text)
    return F.when((value % 1 == 0) & (F.abs(value) < 9.0e15), value).cast("bigint")


def in_range(number: Column, low: int, high: int) -> Column:
    """The number where it lies in the range, else null; the number is computed once."""
    place = F.least(F.greatest(number - low, F.lit(-1)), F.lit(high - low + 1)).cast("int")
    return F.get(F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint")), place)


def month_number(text: Column) -> Column:
    names = {name: i + 1 for i, name in enumerate(MONTH_NAMES)}
    names.update({name: i + 1 for i, name in enumerate(MONTH_ABBREVIATIONS)})
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    number = F.coalesce(F.try_element_at(lookup, F.lower(F.trim(text))).cast("bigint"), strict_integer(text))
    return in_range(number, 1, 12)


def year_header(text: Column) -> Column:
    return in_range(strict_integer(text), 1900, 9999)


def block_code(text: Column) -> Column:
    """Spaces out, upper case, every dash the same."""
    bare = F.upper(F.regexp_replace(text, r"\s+", ""))
    return F.translate(bare, "–—", "--")


def block_code_error(code: Column, allowed: list[str] | None = None) -> Column:
    shape = code.rlike("^[AB][0-9]{2}-[AB][0-9]{2}$")
    result = F.when(code.isNull() | ~shape, "bad_pattern").when(
        F.substring(code, 1, 3) > F.substring(code, 5, 3), "reversed_range"
    )
    if allowed is not None:
        result = result.when(~code.isin(allowed), "outside_pool")
    return result


def date_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def number_text(value: Column, places: int) -> Column:
    """Fixed decimals for display, null left as text."""
    return F.when(value.isNull(), "Not available").otherwise(F.format_string(f"%.{places}f", F.bround(value, places)))
