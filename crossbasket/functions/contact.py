"""Contact clean-up as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country prefixes, tried one after the other in this order.
COUNTRY_PREFIXES = ("+852", "+86", "852", "86")

# Every blank character a phone may be padded with: Unicode white space and the
# four ASCII separators that Unicode does not class as such.
_EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def cleanse_phone(phone: Column) -> Column:
    """The bare number: blanks off, text after the last dash, country prefixes cut.

    A missing phone becomes the empty string. Each prefix is tested on what the previous
    cut left, so ``+85286123`` loses both.
    """
    number = F.regexp_replace(F.coalesce(phone.cast("string"), F.lit("")), _EDGE_BLANKS, "")
    number = F.substring_index(number, "-", -1)
    for prefix in COUNTRY_PREFIXES:
        rest = F.substring(number, len(prefix) + 1, 2**31 - 1)
        number = F.when(number.startswith(prefix), rest).otherwise(number)
    return number


def normalise_email(email: Column) -> Column:
    return F.lower(email)


def usable(contact: Column) -> Column:
    """Whether a contact can identify anybody: neither missing nor empty."""
    return contact.isNotNull() & (contact != "")
