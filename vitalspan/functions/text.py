"""Text cell parsing: everything arrives as text and becomes a typed, nullable value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number and date shapes that are accepted in text cells.
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_SHAPE = r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}([ T].*)?$"


def clean_text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def comma_double(c: Column) -> Column:
    """Decimal comma or point to double; other text gives NULL."""
    text = F.translate(F.trim(c.cast("string")), ",", ".")
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def rounded_int(number: Column) -> Column:
    """Number to int, rounding half away from zero."""
    return (F.signum(number) * F.floor(F.abs(number) + 0.5)).try_cast("int")


def comma_int(c: Column) -> Column:
    """Decimal text to int, rounding half away from zero."""
    return rounded_int(comma_double(c))


def comma_int_truncated(c: Column) -> Column:
    """Decimal text to int, dropping the fraction."""
    number = comma_double(c)
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("int")


def text_date(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(DATE_SHAPE), text.try_cast("date"))


def yes_no(c: Column) -> Column:
    """Swedish yes/no words to boolean, anything else NULL."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word == "ja", F.lit(True)).when(word == "nej", F.lit(False))


def tidy_boolean(c: Column) -> Column:
    """True/false, 1/0 and yes/no words to boolean; anything else NULL."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin("true", "1", "ja"), F.lit(True)).when(word.isin("false", "0", "nej"), F.lit(False))


def mentions(c: Column, fragment: str) -> Column:
    """Case-insensitive fragment test after unifying dash characters; never NULL."""
    plain = F.translate(F.coalesce(c.cast("string"), F.lit("")), "–−", "--")
    return F.contains(F.lower(plain), F.lit(fragment))


def code_list(c: Column) -> Column:
    """Upper-case code list without white space; a missing cell is an empty list."""
    return F.regexp_replace(F.upper(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", "")


def has_code_prefix(codes: Column, prefixes: Sequence[str], delimiter: str = ",") -> Column:
    """Any list entry that is one of the prefixes followed by letters or digits only."""
    return codes.rlike(f"(^|{delimiter})({'|'.join(prefixes)})[A-Z0-9]*({delimiter}|$)")


def has_code(codes: Column, wanted: Sequence[str], delimiter: str = ",") -> Column:
    """Any list entry that equals one of the wanted codes."""
    return codes.rlike(f"(^|{delimiter})({'|'.join(wanted)})({delimiter}|$)")


def join_key(c: Column) -> Column:
    """Key text without white space and without a trailing ``.0``."""
    trimmed = F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "")
    return F.nullif(F.regexp_replace(trimmed, r"\s+", ""), F.lit(""))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def person_key(digits: Column) -> Column:
    """Eight digits, a dash and the next four."""
    return F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 4))


def dashed_person_id(c: Column) -> Column:
    """Put a dash after eight characters unless one is there already."""
    text = F.trim(c)
    split = F.concat(F.substring(text, 1, 8), F.lit("-"), F.substr(text, F.lit(9)))
    return F.when(F.contains(text, F.lit("-")) | (F.length(text) < 9), text).otherwise(split)


def suffix_bucket(c: Column, buckets: int, width: int = 4) -> Column:
    """Trailing digits modulo a bucket count, -1 when they are not digits."""
    tail = F.right(F.replace(c, F.lit("-"), F.lit("")), F.lit(width))
    number = F.when(tail.rlike(f"^[0-9]{{{width}}}$"), tail.try_cast("int"))
    return F.coalesce(F.pmod(number, F.lit(buckets)), F.lit(-1))
