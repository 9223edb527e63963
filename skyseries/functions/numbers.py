"""Text to number under the strict grammar of the message formats.

Spark's casts also take blanks around a number and suffixes such as `1.0f`; the formats do not.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: decimal number grammar, without the words for infinity and not-a-number.
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# The same with the words.
FLOAT = r"(?i)^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def strict_int(text: Column, type_name: str = "int") -> Column:
    """Signed whole number, NULL when malformed or out of range."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(type_name))


def strict_unsigned(text: Column) -> Column:
    """Whole number without minus sign, as BIGINT."""
    return F.when(text.rlike(r"^[+]?[0-9]+$"), text.try_cast("bigint"))


def is_float(text: Column) -> Column:
    """Whether `strict_float` gives a value."""
    return text.rlike(FLOAT)


def strict_float(text: Column, type_name: str = "float") -> Column:
    """Decimal number, infinity or not-a-number; NULL when malformed."""
    word = F.lower(text)
    return (
        F.when(text.rlike(DECIMAL), text.try_cast(type_name))
        .when(word.isin("nan", "+nan", "-nan"), F.lit("NaN").cast(type_name))
        .when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit("Infinity").cast(type_name))
        .when(word.isin("-inf", "-infinity"), F.lit("-Infinity").cast(type_name))
    )
