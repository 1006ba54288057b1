"""Number expressions for text typed by people or written by other programs."""

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType

from hoardbook.functions.text import WHITE_SPACE, strip
from hoardbook.schemas import MONEY

_DIGITS = r"[0-9]+(_[0-9]+)*"
_SPACE = f"[{WHITE_SPACE}]*"
_NUMBER = rf"^{_SPACE}[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?{_SPACE}$"
# Most texts are plain; they need no further reading.
_PLAIN = r"^[0-9]+\.?[0-9]*$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"


def _digits(value: Column) -> Column:
    """The text of a finite number, else null."""
    return F.when(value.rlike(_NUMBER), F.replace(strip(value), F.lit("_"), F.lit("")))


def _read(value: Column, kind: str | DataType) -> Column:
    """The text of a finite number as a type, null if it is none or does not fit."""
    return F.when(value.rlike(_PLAIN), value.try_cast(kind)).otherwise(
        F.when(value != "", _digits(value)).try_cast(kind)
    )


def clean_number(value: Column) -> Column:
    """Number or null; blanks and other texts are null."""
    text = strip(value)
    special = F.when(text.rlike(_SPECIAL), text)
    return F.coalesce(_digits(value), special).try_cast("double")


def finite_number(value: Column) -> Column:
    return _read(value, "double")


def money(value: Column, default: Column | None = None) -> Column:
    """Amount with two decimals; ``default`` (null unless given) when blank or unreadable."""
    amount = _read(value, MONEY)
    return amount if default is None else F.coalesce(amount, default.cast(MONEY))


def grade_number(value: Column) -> Column:
    """A grade is stored with one decimal, after the two-decimal reading of amounts."""
    return money(value).try_cast("decimal(4,1)")


def whole_number(value: Column) -> Column:
    """Whole part of a number, or null."""
    return finite_number(value).try_cast("int")


def does_not_fit(value: Column, read: Column) -> Column:
    """Whether a text is a number, though one that ``read``, its reading, could not hold."""
    return read.isNull() & finite_number(value).isNotNull()


def positive_whole_number(value: Column) -> Column:
    number = whole_number(value)
    return F.when(number > 0, number)


def quantity(value: Column) -> Column:
    """How many copies a row stands for: at least one, and one when unreadable. Rows whose number does not
    fit are told by ``does_not_fit`` and kept from being imported."""
    return F.greatest(F.lit(1), F.coalesce(whole_number(value), F.lit(1)))


def checkbox(value: Column) -> Column:
    return F.coalesce(value == "on", F.lit(False))


def safe_ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """Rounded decimal quotient, null when the denominator is zero."""
    return F.round(numerator / F.nullif(denominator, F.lit(0).cast("decimal(12,2)")), places)
