"""Predicates, shapes and generalisations of values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans import rules

SEPARATORS = "-./:+()@,#_ "


def as_text_sql(column: str, dtype: T.DataType) -> str:
    """The text of a value of any type, for a quoted column name, as SQL.

    Floating numbers are written out with six decimals, never with an exponent; NaN and infinity are null. Arrays
    of plain values are their texts with commas between, nulls left out; maps, structs and deeper arrays are JSON;
    binaries are hex digits.
    """
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"cast(try_cast(cast({column} as double) as decimal(38,6)) as string)"
    if isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return f"array_join(transform({column}, e -> {as_text_sql('e', dtype.elementType)}), ',')"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({column})"
    return f"lower(hex({column}))" if isinstance(dtype, T.BinaryType) else f"cast({column} as string)"


def as_text(name: str, dtype: T.DataType) -> Column:
    """``as_text_sql`` of a column's quoted name."""
    return F.expr(as_text_sql(name, dtype))


def is_email(v: Column) -> Column:
    return v.contains("@") & v.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}\z")


def is_national_id(v: Column) -> Column:
    return (F.length(v) == 11) & v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z")


def is_ip_address(v: Column) -> Column:
    return F.length(v).between(7, 15) & v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z")


def is_phone(v: Column) -> Column:
    """Ten to fifteen digits after a plus, however separated. Stated on the value as it is, it fails at the first letter of a text."""
    return (F.length(v) >= 10) & v.rlike(r"^[-. ()]*\+?([-. ()]*[0-9]){10,15}[-. ()]*\z")


def is_payment_card(v: Column) -> Column:
    return (F.length(v) >= 13) & v.rlike(r"^([- ]*[0-9]){13,19}[- ]*\z")


def is_sex(v: Column) -> Column:
    return (F.length(v) <= max(map(len, rules.SEX_WORDS))) & F.lower(v).isin(rules.SEX_WORDS)


#: category, predicate, strength of the evidence when all values match
PREDICATES = [
    ("email", is_email, 0.90),
    ("national_id", is_national_id, 0.90),
    ("ip_address", is_ip_address, 0.85),
    ("phone", is_phone, 0.70),
    ("payment_card", is_payment_card, 0.75),
    ("sex", is_sex, 0.70),
]


def shape(v: Column) -> Column:
    """Letters as A, digits as 9, twelve separators as they are, anything else as ?."""
    kept = F.regexp_replace(v, r"[^\p{L}\p{Nd}\-./:+()@,#_ ]", "?")
    return F.regexp_replace(F.regexp_replace(kept, r"\p{L}", "A"), r"\p{Nd}", "9")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the card checksum; false where it is empty or holds anything else."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2))
    total = F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)
    return F.when(number.rlike(r"^[0-9]+\z"), total % 10 == 0).otherwise(F.lit(False))


def tokens(name: Column) -> Column:
    """The words of a column name: split at capitals and at whatever is not a letter or digit, lower case."""
    spaced = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(spaced), "[^A-Za-z0-9]+"), lambda t: t != "")


def year(column: Column) -> Column:
    return F.year(column)


def postal_3(column: Column) -> Column:
    return F.substring(column.cast("string"), 1, 3)


def postal_padded(column: Column, keep: int) -> Column:
    """The first characters, the others starred. Null, and codes shorter than what is kept, are refused."""
    if keep < 1:
        raise ValueError("at least one character has to be kept")
    wrong = F.raise_error(F.concat(F.lit("can't generalise postal code "), F.coalesce(column, F.lit("null"))))
    return F.when(column.isNull() | (F.length(column) < keep), wrong.cast("string")).otherwise(F.rpad(F.substring(column, 1, keep), F.length(column), F.lit("*")))


def year_of(column: Column) -> Column:
    """The year of a date; null is refused."""
    return F.when(column.isNull(), F.raise_error(F.lit("can't coarsen a null date")).cast("int")).otherwise(F.year(column))


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed, which is not the same as whole minutes passed."""
    begun, ended = (F.unix_seconds(F.date_trunc("minute", c).cast("timestamp")) for c in (start, end))
    return ((ended - begun) / 60).cast("long")
