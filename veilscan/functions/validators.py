"""Issuance rules and checksums as boolean columns over the matched value."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weights of the routing-number checksum
ABA_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid_ssn(value: Column) -> Column:
    """Area is not 000, 666 or 9xx; group is not 00; serial is not 0000."""
    return ~digits_only(value).rlike("^(?:000|666|9)|^[0-9]{3}00|0000$")


def valid_itin(value: Column) -> Column:
    """Middle pair lies in 70-88, 90-92 or 94-99."""
    middle = F.substring(digits_only(value), 4, 2).cast("int")
    return middle.between(70, 88) | middle.between(90, 92) | middle.between(94, 99)


def valid_aba(value: Column) -> Column:
    """Weighted digit sum is positive and divisible by ten."""
    total = sum(
        (F.substring(value, pos + 1, 1).cast("int") * weight for pos, weight in enumerate(ABA_WEIGHTS)),
        F.lit(0),
    )
    return (F.length(value) == 9) & (total > 0) & (total % 10 == 0)


def known_issuer(digits: Column) -> Column:
    """Issuer ranges of the major card networks."""
    return digits.rlike("^(?:4|5[1-5]|3[04-8]|6011|65)") | F.substring(digits, 1, 4).cast("int").between(
        2221, 2720
    )


def valid_card(digits: Column) -> Column:
    """13-19 digits, not one digit repeated, a known issuer and a Luhn pass."""
    return (
        F.length(digits).between(13, 19)
        & F.call_function("luhn_check", digits)  # cheap, and nine of ten fail it
        & known_issuer(digits)
        & ~digits.rlike("^([0-9])\\1*$")
    )
