"""Column functions over numbers as they stand in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from longleaf.functions.text import normal_signs

#: Punctuation around a number that isn't part of it; fixed value.
AROUND = r"^[,;:.!?()\[\]\x22']+|[,;:.!?()\[\]\x22']+$"
DECIMAL = r"^([-+0-9]*[0-9][-+0-9]*|([-+]+[0-9]*|[0-9]+)[.,][0-9]+)%?$"
ROMAN = r"^[IVXLCDM]+$"
#: Values of the letters of Roman numerals; fixed values.
ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def canonical_decimal(value: Column) -> Column:
    """A number with one separator at most, written with a point; anything else gives null."""
    plain = F.regexp_replace(normal_signs(value), AROUND, "")
    return F.when(plain.rlike(DECIMAL), F.regexp_replace(plain, ",", "."))


def roman_value(value: Column) -> Column:
    """The value of a Roman numeral: a letter before a greater one counts against it."""
    letters = F.split(F.upper(value), "")
    table = F.create_map(*[F.lit(x) for pair in ROMAN_VALUES.items() for x in pair])
    values = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0)))
    total = F.aggregate(
        F.reverse(values),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), v.alias("last")),
        lambda acc: acc["sum"],
    )
    return F.when(F.upper(value).rlike(ROMAN), total)


def folio(value: Column) -> Column:
    """(roman, value) of a page number: up to four digits or a Roman numeral; null for anything else."""
    trimmed = F.trim(value)
    digits = F.when(trimmed.rlike("^[0-9]{1,4}$"), trimmed.cast("int"))
    roman = roman_value(trimmed)
    return F.when(digits.isNotNull() | roman.isNotNull(), F.struct(digits.isNull().alias("roman"), F.coalesce(digits, roman).cast("long").alias("value")))
