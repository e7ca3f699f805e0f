"""Check digits of financial identifiers, as expressions in the JVM. Spaces are ignored; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(s: Column) -> Column:
    return F.upper(F.regexp_replace(s, r"\s+", ""))


def digits(s: Column) -> Column:
    """Letters as two digits: A is 10, Z is 35."""
    each = F.filter(F.split(s, ""), lambda c: c != "")
    return F.array_join(F.transform(each, lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def mod97(s: Column) -> Column:
    """The remainder of a long number in decimal digits."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: (a * 10 + c.cast("bigint")) % 97)


def bic(s: Column) -> Column:
    """Structure of a bank code: 4 letters, country, 2 of place, and 3 of branch or none."""
    return compact(s).rlike(r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$")


def iban(s: Column) -> Column:
    c = compact(s)
    turned = F.concat(F.substring(c, 5, 60), F.substring(c, 1, 4))
    return F.when(c.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), mod97(digits(turned)) == 1).otherwise(F.when(s.isNotNull(), F.lit(False)))


def isin(s: Column) -> Column:
    c = compact(s)
    return F.when(c.rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), F.call_function("luhn_check", digits(c))).otherwise(F.when(s.isNotNull(), F.lit(False)))


def lei(s: Column) -> Column:
    c = compact(s)
    return F.when(c.rlike(r"^[A-Z0-9]{18}[0-9]{2}$"), mod97(digits(c)) == 1).otherwise(F.when(s.isNotNull(), F.lit(False)))


def valid(kind: Column, value: Column) -> Column:
    """The check of each kind of identifier; an unknown kind gives null."""
    return F.when(kind == "BIC", bic(value)).when(kind == "IBAN", iban(value)).when(kind == "ISIN", isin(value)).when(kind == "LEI", lei(value))
