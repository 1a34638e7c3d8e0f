"""String cleaning of phones, amounts and dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def norm_phone(c: Column) -> Column:
    """strip the chat prefixes in order, keep 15 characters."""
    for p in fixed.SENDER_PREFIXES:
        c = F.replace(c, F.lit(p), F.lit(""))
    return F.substring(c, 1, fixed.PHONE_CHARS)


def e164(phone: Column) -> Column:
    """outward number: as is when it starts with '+', else +91 prefixed."""
    return F.when(phone.startswith("+"), phone).otherwise(F.concat(F.lit(fixed.COUNTRY_PREFIX), phone))


def clean_amount(c: Column) -> Column:
    """drop the rupee sign, commas and blanks, then 'Dr'/'Cr' (case
    sensitive); a value that does not parse is NULL, as is ''."""
    s = F.regexp_replace(c, r"[₹,\s]", "")
    s = F.trim(F.replace(F.replace(s, F.lit("Dr"), F.lit("")), F.lit("Cr"), F.lit("")))
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("double")).otherwise(s.try_cast("double"))


def clean_edit_amount(c: Column) -> Column:
    """an edited amount: drop 'rs', 'Rs' and commas, trim, parse."""
    s = F.trim(F.replace(F.replace(F.replace(c, F.lit("rs"), F.lit("")), F.lit("Rs"), F.lit("")), F.lit(","), F.lit("")))
    return s.try_cast("double")


def parse_invoice_date(c: Column) -> Column:
    """the first of d-M-yyyy, d/M/yyyy, yyyy-M-d that parses; else NULL. A format is
    tried on texts of its shape only: every failed try costs an exception."""
    def tried(fmt: str) -> Column:
        shape = re.sub("yyyy|d|M", lambda m: r"[+-]?\d{4,}" if m[0] == "yyyy" else r"[+-]?\d+", fmt)
        return F.when(c.rlike(f"^{shape}$"), F.try_to_timestamp(c, F.lit(fmt)))
    return F.coalesce(*[tried(fmt) for fmt in fixed.INVOICE_DATE_FORMATS]).cast("timestamp_ntz")
